"""Facts of frameworks from literal evidence rows."""

import json

from corpusloom.operators import facts as F

EDGE = "project_id string, source_path string, edge_key string, external_package string, type_only boolean, bindings array<struct<kind:string,imported_name:string,local_name:string,exported_name:string,type_only:boolean>>"
COLUMNS = [c.split()[0] for c in F.EVIDENCE.split(", ")]


def text(s):
    return {"kind": "string", "value": s}


def ident(*segments):
    return {"kind": "identifier", "reference": {"segments": list(segments)}}


def array(*items):
    return {"kind": "array", "items": list(items)}


def obj(**properties):
    return {"kind": "object", "properties": [{"key": k, "value": v} for k, v in properties.items()]}


UNKNOWN = {"kind": "unknown"}


def rows(spark, *items, scoped=True):
    out = []
    for i, item in enumerate(items):
        row = dict.fromkeys(COLUMNS) | {"project_id": "p", "path": "a.ts", "scope_key": "s", "evidence_key": f"e{i:02}", "start_byte": i * 10, "arguments": [], "parameter_counts": []} | item
        row["arguments"] = [json.dumps(a) for a in row["arguments"]]
        row["receiver_arguments"] = [json.dumps(a) for a in row["receiver_arguments"]] if row["receiver_arguments"] is not None else None
        out.append(tuple(row[c] for c in COLUMNS))
    df = spark.createDataFrame(out, F.EVIDENCE)
    return df if scoped else df.drop("scope_key")


def shown(facts):
    names = {r.identity_key: r.name for r in facts.entities.collect()}
    links = sorted((r.relationship_kind, names[r.source_key], r.target_name or "", r.certainty, names.get(r.target_key)) for r in facts.relationships.collect())
    return sorted((r.entity_kind, r.name, r.certainty) for r in facts.entities.collect()), links


def test_nest_facts(spark):
    named = [("named", n, n, None, False) for n in ("Module", "Controller", "Injectable", "Get", "Inject")]
    edges = spark.createDataFrame([("p", "a.ts", "e1", "@nestjs/common", False, [*named, ("namespace", None, "N", None, False)]), ("p", "a.ts", "e2", None, False, [("named", "Mail", "M", None, False)]), ("p", "a.ts", "e3", "x", False, [("named", "Get", "Other", None, False)])], EDGE)
    mark = lambda name, **k: {"kind": "decorator", "reference": [name]} | k
    evidence = rows(
        spark,
        mark("Controller", target_kind="class", target_name="Cats", arguments=[array(text("cats/"), text("/felines"))]),
        mark("Injectable", target_kind="class", target_name="CatService"),
        mark("Module", target_kind="class", target_name="App", arguments=[obj(controllers=array(ident("Cats")), providers=array(ident("CatService"), obj(provide=text("TOKEN"), useClass=ident("M")), UNKNOWN), imports=array(ident("M", "Sub")), exports=ident("all"))]),
        mark("Get", target_kind="method", owner_name="Cats", target_name="one", arguments=[text(":id")]),
        {"kind": "decorator", "reference": ["N", "Post"], "target_kind": "method", "owner_name": "Cats", "target_name": "add", "arguments": [UNKNOWN]},
        mark("Other", target_kind="method", owner_name="Cats", target_name="no"),
        mark("Inject", target_kind="parameter", owner_name="Cats", member_name="constructor", parameter_index=0, target_name="token", arguments=[text("TOKEN")]),
        {"kind": "constructor_parameter", "owner_name": "Cats", "parameter_index": 0, "target_name": "token", "reference": ["Ignored"]},
        {"kind": "constructor_parameter", "owner_name": "Cats", "parameter_index": 1, "target_name": "service", "reference": ["CatService"]},
        {"kind": "constructor_parameter", "owner_name": "CatService", "parameter_index": 0, "target_name": "x"},
        {"kind": "constructor_parameter", "owner_name": "Nobody", "parameter_index": 0, "target_name": "x", "reference": ["CatService"]},
        mark("Module", target_kind="class", target_name="Dyn", arguments=[ident("options")]),
    )
    facts = F.nest_facts(evidence, edges)
    entities, links = shown(facts)
    assert entities == [("controller", "Cats", "declared"), ("module", "App", "declared"), ("module", "Dyn", "unresolved"), ("provider", "CatService", "declared"), ("provider", "TOKEN", "declared"), ("route", "Cats.add POST", "unresolved"), ("route", "Cats.one GET", "declared")]
    assert [x for x in links if x[1] == "App"] == [
        ("exports_provider", "App", "", "unresolved", None),
        ("imports_module", "App", "Mail.Sub", "declared", None),
        ("registers_controller", "App", "Cats", "linked", "Cats"),
        ("registers_provider", "App", "", "unresolved", None),
        ("registers_provider", "App", "CatService", "linked", "CatService"),
        ("registers_provider", "App", "TOKEN", "linked", "TOKEN"),
    ]
    assert len([x for x in links if x[1] == "Dyn" and x[3] == "unresolved"]) == 4
    assert [x for x in links if x[0] == "injects"] == [("injects", "CatService", "", "unresolved", None), ("injects", "Cats", "CatService", "linked", "CatService"), ("injects", "Cats", "TOKEN", "linked", "TOKEN")]
    assert [x[2] for x in links if x[0] == "handles_route"] == ["Cats.add POST", "Cats.one GET"]
    routes = {r.name: json.loads(r.attributes) for r in facts.entities.where("entity_kind = 'route'").collect()}
    assert routes["Cats.one GET"]["full_paths"] == ["/cats/:id", "/felines/:id"] and routes["Cats.add POST"]["full_paths"] == []
    assert json.loads(facts.entities.where("name = 'TOKEN'").first().attributes) == {"origin": "module_registration", "token": "TOKEN", "use_class": "Mail"}
    assert sorted(r.evidence_key for r in facts.omissions.collect()) == ["e02", "e09", "e11"]
    assert facts.entities.count() == facts.entities.select("identity_key").distinct().count()


def test_express_facts(spark):
    edges = spark.createDataFrame([("p", "a.ts", "e1", "express", False, [("default", None, "express", None, False), ("named", "Router", "R", None, False)]), ("p", "a.ts", "e2", None, False, [("named", "apiRouter", "api", None, False)])], EDGE)
    call = lambda *reference, **k: {"kind": "call_expression", "reference": list(reference)} | k
    evidence = rows(
        spark,
        call("express", assigned_name="app"),
        call("R", assigned_name="router"),
        call("express", "Router", assigned_name="second"),
        call("express", "json", assigned_name="no"),
        call("app", "get", arguments=[text("/x/"), ident("auth", "check"), UNKNOWN], parameter_counts=[None, None, 2]),
        call("router", "post", arguments=[UNKNOWN, ident("make")]),
        {"kind": "call_expression", "member_name": "put", "receiver_reference": ["router", "route"], "receiver_arguments": [array(text("b"), text("/a"), text("a"))], "arguments": [ident("change")]},
        call("app", "use", arguments=[text("/api"), ident("router")]),
        call("app", "use", arguments=[ident("api")]),
        call("app", "use", arguments=[UNKNOWN, UNKNOWN], parameter_counts=[3, 4]),
        call("app", "use", arguments=[UNKNOWN]),
        call("other", "get", arguments=[text("/no")]),
    )
    facts = F.express_facts(evidence, edges)
    entities, links = shown(facts)
    assert entities == [
        ("application", "app", "declared"), ("middleware", "app.middleware.inline.0", "declared"), ("middleware", "app.middleware.inline.1", "declared"),
        ("route", "app.GET /x", "declared"), ("route", "router.POST dynamic", "unresolved"), ("route", "router.PUT /a|/b", "declared"), ("router", "router", "declared"), ("router", "second", "declared"),
    ]
    assert [x for x in links if x[0] == "mounts_router"] == [("mounts_router", "app", "apiRouter", "declared", None), ("mounts_router", "app", "router", "linked", "router")]
    assert [(x[2], x[3]) for x in links if x[0] == "handles_route"] == [("app.GET /x", "linked"), ("router.POST dynamic", "unresolved"), ("router.PUT /a|/b", "linked")]
    wired = {r.name: json.loads(r.attributes) for r in facts.entities.where("entity_kind = 'middleware'").collect()}
    assert [wired[f"app.middleware.inline.{i}"]["error_handler"] for i in (0, 1)] == [False, True] and wired["app.middleware.inline.0"]["paths"] == ["/"]
    assert json.loads(facts.entities.where("name = 'app.GET /x'").first().attributes)["handlers"] == ["auth.check"]
    assert sorted(r.evidence_key for r in facts.omissions.collect()) == ["e05", "e10"]


SEQUELIZE = [("named", "Model", "Model", None, False), ("default", None, "Sequelize", None, False)]


def model_rows(spark, **k):
    call = lambda *reference, **k: {"kind": "call_expression", "reference": list(reference)} | k
    yes = {"kind": "boolean", "value": True}
    return rows(
        spark,
        {"kind": "class_heritage", "target_name": "User", "reference": ["Model"]},
        {"kind": "class_heritage", "target_name": "Post", "reference": ["Sequelize", "Model"]},
        {"kind": "class_heritage", "target_name": "No", "reference": ["Base"]},
        call("this", "init", owner_name="User", arguments=[obj(id=obj(type=ident("DataTypes", "INTEGER"), primaryKey=yes), email=obj(type=ident("DataTypes", "STRING"), field=text("mail")))]),
        call("db", "define", assigned_name="Order", arguments=[text("orders"), obj(number=ident("DataTypes", "STRING"), dynamic=UNKNOWN), obj(tableName=text("t"), timestamps=yes)]),
        call("User", "hasMany", arguments=[ident("Post"), obj(foreignKey=text("authorId"))]),
        call("Order", "belongsTo", arguments=[ident("Customer"), obj(through=ident("Join"))]),
        call("Post", "init", arguments=[ident("fields")]),
        **k,
    )


def test_sequelize_facts_and_limits(spark):
    edges = spark.createDataFrame([("p", "a.ts", "e1", "sequelize", False, SEQUELIZE)], EDGE)
    facts = F.sequelize_facts(model_rows(spark), edges)
    entities, links = shown(facts)
    assert entities == [
        ("model", "Post", "declared"), ("model", "User", "declared"), ("model", "orders", "declared"), ("model_attribute", "User.email", "declared"),
        ("model_attribute", "User.id", "declared"), ("model_attribute", "orders.dynamic", "unresolved"), ("model_attribute", "orders.number", "declared"),
    ]
    assert [x for x in links if x[0] == "associates"] == [("associates", "User", "Post", "linked", "Post"), ("associates", "orders", "Customer", "declared", None)]
    about = {r.name: json.loads(r.attributes) for r in facts.entities.collect()}
    assert about["User.email"] == {"model": "User", "field": "mail", "type_name": "STRING"} and about["orders"] == {"origin": "define", "table_name": "t", "timestamps": True}
    assert about["User.id"]["primary_key"] is True and about["orders.number"]["type_name"] == "STRING"
    assert [(r.evidence_key, r.reason) for r in facts.omissions.collect()] == [("e07", "dynamic_value")]
    assert F.sequelize_facts(model_rows(spark), edges.where("false")).entities.isEmpty()
    few = F.limited(facts, max_entities=2, max_relationships=10)
    assert sorted(r.name for r in few.entities.collect()) == ["Post", "User"] and few.relationships.count() == 1
    assert {r.reason for r in few.omissions.collect()} == {"dynamic_value", "entity_limit"}


def test_index_frameworks(spark):
    edges = spark.createDataFrame([("p", "db/a.ts", "e1", "sequelize", False, SEQUELIZE)], EDGE)
    packages = spark.createDataFrame([("p", "db/package.json", '{"dependencies":{"sequelize":"1"}}'), ("p", "web/package.json", '{"dependencies":{"next":"1"}}')], "project_id string, path string, text string")
    files = spark.createDataFrame([("p", "db/a.ts"), ("p", "web/app/page.tsx"), ("p", "web/ui.tsx")], "project_id string, path string")
    symbols = spark.createDataFrame([("p", "db/a.ts", "k1", "User", "User", "class", True, 0, 9), ("p", "web/ui.tsx", "k2", "Card", "Card", "function", True, 0, 90)], "project_id string, path string, identity_key string, name string, qualified_name string, kind string, exported boolean, start_byte long, end_byte long")
    from pyspark.sql import functions as f

    evidence = model_rows(spark, scoped=False).withColumn("path", f.lit("db/a.ts"))
    ui = rows(spark, {"kind": "jsx", "reference": ["Icon"], "path": "web/ui.tsx"}, scoped=False)
    scopes, facts = F.index_frameworks(files, packages, edges, evidence.unionByName(ui), symbols)
    assert sorted(r.framework for r in scopes.collect()) == ["nextjs", "react", "sequelize"]
    got = {(r.framework, r.entity_kind, r.name): r.symbol_key for r in facts.entities.collect()}
    assert got["sequelize", "model", "User"] == "k1" and got["react", "component", "Card"] == "k2" and ("nextjs", "page", "web/app/page.tsx") in got and len(got) == 9
    assert sorted({r.relationship_kind for r in facts.relationships.collect()}) == ["associates", "defines_attribute", "renders_component"]


def test_sequelize_fields_are_written_parsed_and_attributes_not_at_all(spark, monkeypatch):
    written, write = {}, F.materialize
    monkeypatch.setattr(F, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    fields = obj(a=ident("DataTypes", "STRING"), b=obj(type=ident("DataTypes", "DATE"), allowNull={"kind": "boolean", "value": False}), c=UNKNOWN)
    evidence = rows(
        spark,
        {"kind": "class_heritage", "target_name": "User", "reference": ["Model"]},
        {"kind": "call_expression", "owner_name": "User", "reference": ["this", "init"], "arguments": [fields]},
    )
    edges = spark.createDataFrame([("p", "a.ts", "e1", "sequelize", False, [("named", "Model", "Model", None, False)])], EDGE)
    found = F.sequelize_facts(evidence, edges)
    shown = {r.name: (r.certainty, json.loads(r.attributes)) for r in found.entities.where("entity_kind = 'model_attribute'").collect()}
    assert shown == {
        "User.a": ("declared", {"model": "User", "type_name": "STRING"}),
        "User.b": ("declared", {"model": "User", "allow_null": False, "type_name": "DATE"}),
        "User.c": ("unresolved", {"model": "User"}),
    }
    assert found.relationships.where("relationship_kind = 'defines_attribute'").count() == 3
    assert "attributes" not in written and "arguments" not in written["filled"].columns


def test_a_route_belongs_to_the_last_controller_of_its_name_in_its_scope(spark):
    named = [("named", n, n, None, False) for n in ("Controller", "Get")]
    edges = spark.createDataFrame([("p", "a.ts", "e1", "@nestjs/common", False, named)], EDGE)
    head = lambda at, path, **k: {"kind": "decorator", "reference": ["Controller"], "target_kind": "class", "target_name": "Cats", "owner_name": "Cats", "start_byte": at, "arguments": [text(path)]} | k
    get = lambda at, **k: {"kind": "decorator", "reference": ["Get"], "target_kind": "method", "owner_name": "Cats", "member_name": "one", "target_name": "one", "start_byte": at, "arguments": [text("x")]} | k
    evidence = rows(spark, head(0, "old"), get(10), head(50, "new"), head(60, "other", scope_key="t"), get(70, scope_key="u"), get(80, owner_name="Dogs"), get(90, owner_name=None))
    facts = F.nest_facts(evidence, edges)
    routes = facts.entities.where("entity_kind = 'route'").collect()
    assert [(r.scope_key, json.loads(r.attributes)["full_paths"]) for r in routes] == [("s", ["/new/x"])]
    owner = {r.identity_key: r.start_byte for r in facts.entities.collect()}
    assert [(owner[r.source_key], owner[r.target_key]) for r in facts.relationships.collect()] == [(50, 10)]


def test_limits_of_names_and_relationships(spark):
    entity = "project_id string, path string, scope_key string, framework string, entity_kind string, name string, certainty string, evidence_key string, start_byte long, attributes string, symbol_name string, identity_key string"
    link = "project_id string, path string, scope_key string, framework string, relationship_kind string, source_key string, target_key string, target_name string, certainty string, evidence_key string, start_byte long, attributes string, symbol_name string, edge_key string, identity_key string"
    one = lambda path, name, at, key: ("p", path, "s", "f", "k", name, "declared", "e" + key, at, "{}", name, key)
    to = lambda path, source, target, name, at, key: ("p", path, "s", "f", "uses", source, target, name, "linked", "e" + key, at, "{}", name, None, key)
    entities = spark.createDataFrame([one("a", "A", 0, "1"), one("a", "", 1, "2"), one("a", "long name", 2, "3"), one("a", "B", 3, "4"), one("a", "C", 4, "5"), one("b", "A", 0, "1")], entity)
    links = spark.createDataFrame(
        [
            to("a", "1", "4", "B", 0, "r1"), to("a", "1", None, None, 1, "r2"), to("a", "1", "5", "C", 2, "r3"), to("a", "3", "1", "A", 3, "r4"), to("a", "1", None, "long name", 4, "r5"),
            to("a", "4", "1", "A", 5, "r6"), to("b", "1", "4", "B", 0, "r7"), to("b", "1", "1", "A", 1, "r8"),
        ],
        link,
    )
    few = F.limited(F.Facts(entities, links, spark.createDataFrame([], "project_id string, path string, scope_key string, evidence_key string, reason string")), 2, 2, 5)
    assert sorted((r.path, r.name) for r in few.entities.collect()) == [("a", "A"), ("a", "B"), ("b", "A")]
    assert sorted((r.identity_key, r.source_name) for r in few.relationships.collect()) == [("r1", "A"), ("r2", "A"), ("r8", "A")]
    assert sorted((r.evidence_key, r.reason) for r in few.omissions.collect()) == [("e2", "name_text_limit"), ("e3", "name_text_limit"), ("e5", "entity_limit"), ("er5", "name_text_limit"), ("er6", "relationship_limit")]


def test_indexing_frameworks_shuffles_little_of_what_it_finds(spark):
    from corpusloom.queries import QUERIES

    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty(30_000)
        executors = context.statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = shuffled()
    found = QUERIES["job11_index_frameworks"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == 4500 and (shuffled() - before) / len(found) < 200  # 850 a row when every step dealt its rows anew
    assert all(r.symbol for r in found) and {r.source_name is None for r in found if r.fact == "relationship"} == {False}


def test_tables_by_file_are_read_without_a_shuffle(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as f

    from corpusloom.plans.tables import materialize_by

    rows = spark.range(100).select((f.col("id") % 3).cast("string").alias("project_id"), (f.col("id") % 10).cast("string").alias("path"), "id")
    one, two = (materialize_by(df, "rows", ["project_id", "path"]) for df in (rows, rows.where("id > 50")))
    assert materialize_by(one, "again", ["project_id", "path"]) is one
    both = one.withColumn("k", f.col("id") % 2).unionByName(two.where("id > 60").withColumn("k", f.lit(0).cast("long")))
    placed = both.withColumn("n", f.row_number().over(Window.partitionBy("project_id", "path", "k").orderBy("id")))
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    assert placed.count() == 139 and sorted(r.id for r in one.collect()) == list(range(100))
