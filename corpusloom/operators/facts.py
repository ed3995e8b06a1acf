"""Facts of server frameworks and models: entities and the relationships between them, as joins of evidence within a file.

``evidence`` has the columns of ``EVIDENCE``: one row a decorator, call, class heading or
constructor parameter. Arguments are static values as JSON text: ``{"kind": "string",
"value": "x"}``, ``{"kind": "identifier", "reference": {"segments": ["a", "b"]}}``,
``{"kind": "array", "items": [...]}``, ``{"kind": "object", "properties": [{"key": "k",
"value": {...}}]}``, or kind boolean, number, null or unknown. ``edges`` are those of
``framework_imports``. What a file holds is bounded by its extractor, so small lookups
within one file are maps in its rows, and larger ones windows. Rows that several facts
start from are written once; those of many rows by file, so that all that goes by file
reads them without a shuffle.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.scalar import combine_routes, entity_key, normalize_route, relationship_key, scope_key
from corpusloom.operators.budgets import saturating_budget
from corpusloom.operators.frameworks import detect_scopes, framework_imports
from corpusloom.operators.paths import nearest_package
from corpusloom.plans.tables import materialize, materialize_by, parts

EVIDENCE = (
    "project_id string, path string, scope_key string, evidence_key string, kind string, reference array<string>, arguments array<string>, "
    "assigned_name string, member_name string, owner_name string, target_kind string, target_name string, parameter_index int, "
    "parameter_counts array<int>, receiver_reference array<string>, receiver_arguments array<string>, start_byte long"
)
FILE = ["project_id", "path", "scope_key"]
BY_FILE = FILE[:2]
# Names that the frameworks give.
NEST_HTTP = ["All", "Delete", "Get", "Head", "Options", "Patch", "Post", "Put"]
NEST_SECTIONS = {"imports": "imports_module", "controllers": "registers_controller", "providers": "registers_provider", "exports": "exports_provider"}
EXPRESS_HTTP = ["all", "delete", "get", "head", "options", "patch", "post", "put"]
ASSOCIATIONS = ["hasOne", "belongsTo", "hasMany", "belongsToMany"]
#: The kinds of evidence that each framework's facts are made of.
READS = {"nestjs": ["decorator", "constructor_parameter"], "express": ["call_expression"], "sequelize": ["call_expression", "class_heritage"], "nextjs": ["directive", "jsx"], "react": ["call_expression", "directive", "jsx"]}


class Facts(NamedTuple):
    """``entities`` and ``relationships`` have an ``identity_key``; ``omissions`` tell what was dynamic or over a limit."""

    entities: DataFrame
    relationships: DataFrame
    omissions: DataFrame


VALUE = "kind string, value string, reference struct<segments:array<string>>, items array<string>, properties array<struct<key:string,value:string>>"


def parsed(v: Column) -> Column:
    """A static value's JSON text as a struct, by one pass; values inside it stay text. Keep it as a column where it is read more than once."""
    return F.from_json(v, VALUE)


def value_kind(p: Column) -> Column:
    return p["kind"]


def value_text(p: Column) -> Column:
    return F.when(value_kind(p) == "string", p["value"])


def value_flag(p: Column) -> Column:
    return F.when(value_kind(p) == "boolean", p["value"].cast("boolean"))


def value_segments(p: Column) -> Column:
    return F.when(value_kind(p) == "identifier", p["reference"]["segments"])


def value_name(p: Column) -> Column:
    return F.array_join(value_segments(p), ".")


def value_items(p: Column) -> Column:
    return F.when(value_kind(p) == "array", p["items"])


def value_property(p: Column, key: str) -> Column:
    """The text of a property of a parsed object."""
    properties = F.when(value_kind(p) == "object", p["properties"])
    return F.get(F.filter(properties, lambda x: x["key"] == key), F.lit(0))["value"]


def _strings(p: Column) -> Column:
    """The text of a string or of an array of strings; null for all else."""
    items = F.transform(value_items(p), parsed)
    return F.when(value_kind(p) == "string", F.array(value_text(p))).when(~F.exists(items, lambda x: value_kind(x) != "string"), F.transform(items, value_text))


def _with_local(evidence: DataFrame, edges: DataFrame, framework: str, package: str) -> DataFrame:
    """Evidence that starts with a local name bound to the package in its file, with its ``imported_name``."""
    own = framework_imports(edges).where((F.col("framework") == framework) & (F.col("external_package") == package))
    own = own.withColumnRenamed("source_path", "path").repartition(*BY_FILE)
    own = own.groupBy(*BY_FILE, "local_name").agg(F.min_by("imported_name", "edge_key").alias("imported_name"))
    own = own.groupBy(*BY_FILE).agg(F.map_from_entries(F.collect_list(F.struct("local_name", "imported_name"))).alias("locals"))
    hit = evidence.join(own, BY_FILE).withColumn("imported_name", F.try_element_at("locals", F.get("reference", F.lit(0))))
    return hit.where("imported_name IS NOT NULL").drop("locals")


def _file_imports(edges: DataFrame) -> DataFrame:
    """Per file a map from each local name to what is imported under it; type-only imports do not count."""
    rows = edges.where("NOT type_only").select("project_id", F.col("source_path").alias("path"), "edge_key", "external_package", F.explode("bindings").alias("b"))
    rows = rows.where("b.local_name IS NOT NULL AND NOT coalesce(b.type_only, false)")
    first = rows.groupBy("project_id", "path", "b.local_name").agg(F.min_by(F.struct("b.imported_name", "edge_key", "external_package"), "edge_key").alias("to"))
    return first.groupBy("project_id", "path").agg(F.map_from_entries(F.collect_list(F.struct("local_name", "to"))).alias("imports"))


def _target(text: Column, segments: Column) -> Column:
    """Struct (local, name, edge_key, token) of a reference; needs the file's ``imports``. Null for values of other kinds."""
    to = F.try_element_at("imports", F.get(segments, F.lit(0)))
    base = F.when(to["imported_name"].isNull() | to["imported_name"].isin("default", "*"), F.get(segments, F.lit(0))).otherwise(to["imported_name"])
    name = F.array_join(F.concat(F.array(base), F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1)))), ".")
    none = F.lit(None).cast("string")
    named = F.struct(F.array_join(segments, ".").alias("local"), name.alias("name"), to["edge_key"].alias("edge_key"), F.lit("identifier").alias("token"))
    said = F.struct(text.alias("local"), text.alias("name"), none.alias("edge_key"), F.lit("string").alias("token"))
    return F.when(text.isNotNull(), said).when(F.size(segments) > 0, named)


def _value_target(p: Column) -> Column:
    return _target(value_text(p), value_segments(p))


def _last(entities: DataFrame, by: str = "name") -> DataFrame:
    """Of entities with the same kind and name in a file the last one."""
    w = Window.partitionBy(*FILE, "entity_kind", by).orderBy(F.desc("start_byte"), "evidence_key")
    return entities.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def _known(entities: DataFrame) -> DataFrame:
    """Per file a map from each scope to a map from ``kind:name`` to the entity's key."""
    pairs = _last(entities.where("scope_key IS NOT NULL")).select(*FILE, F.concat_ws(":", "entity_kind", "name").alias("k"), "identity_key")
    scopes = pairs.groupBy(*FILE).agg(F.map_from_entries(F.collect_list(F.struct("k", "identity_key"))).alias("keys"))
    return scopes.groupBy(*BY_FILE).agg(F.map_from_entries(F.collect_list(F.struct("scope_key", "keys"))).alias("known"))


def _key_of(kinds: list[str], names: list[Column]) -> Column:
    """The first known entity of these kinds, under any of these names."""
    keys = F.try_element_at("known", F.col("scope_key"))
    return F.coalesce(*(F.try_element_at(keys, F.concat(F.lit(f"{k}:"), n)) for k in kinds for n in names))


def _entities(rows: DataFrame, framework: str, kind: Column, name: Column, certainty: Column, role: Column, attributes: Column, symbol: Column, *extra: str, key: Column | None = None) -> DataFrame:
    key = entity_key("scope_key", kind, "path", role, F.col("evidence_key")) if key is None else key
    return rows.select(
        *FILE, F.lit(framework).alias("framework"), kind.alias("entity_kind"), name.alias("name"), certainty.alias("certainty"), "evidence_key", "start_byte",
        attributes.alias("attributes"), symbol.alias("symbol_name"), key.alias("identity_key"), *extra,
    )


def _relationships(rows: DataFrame, framework: str, kind: Column, target_key: Column, target_name: Column, certainty: Column, attributes: Column, symbol: Column, edge: Column) -> DataFrame:
    """``rows`` have the source's key as ``source_key`` and their ``place`` among those of the same evidence."""
    out = rows.select(
        *FILE, F.lit(framework).alias("framework"), kind.alias("relationship_kind"), "source_key", target_key.alias("target_key"), target_name.alias("target_name"),
        certainty.alias("certainty"), "evidence_key", "start_byte", attributes.alias("attributes"), symbol.alias("symbol_name"), edge.alias("edge_key"), "place",
    )
    to = F.coalesce("target_key", "target_name", F.concat(F.col("relationship_kind"), F.lit(":unresolved")))
    alike = Window.partitionBy(*FILE, "source_key", "relationship_kind", to, "evidence_key").orderBy("place")
    out = out.withColumn("occurrence", F.row_number().over(alike) - 1)
    key = relationship_key("scope_key", "relationship_kind", "source_key", F.concat_ws(":", to, "evidence_key"), "occurrence")
    return out.withColumn("identity_key", key).drop("place", "occurrence")


def _omitted(rows: DataFrame, reason: str = "dynamic_value") -> DataFrame:
    return rows.select(*FILE, "evidence_key", F.lit(reason).alias("reason"))


def _none() -> Column:
    return F.lit(None).cast("string")


def nest_facts(evidence: DataFrame, edges: DataFrame) -> Facts:
    """Modules, controllers, providers and routes; registrations, route ownership and injections.

    A target found in the file is linked, another one that is written out is declared,
    and what is computed is unresolved and omitted as ``dynamic_value``.
    """
    bound = F.when(F.size("reference") == 1, F.col("imported_name")).when((F.size("reference") == 2) & (F.col("imported_name") == "*"), F.get("reference", F.lit(1)))
    marks = _with_local(evidence.where("kind = 'decorator'"), edges, "nestjs", "@nestjs/common").withColumn("bound", bound)
    marks = marks.where(F.col("bound").isin("Module", "Controller", "Injectable", "Inject", *NEST_HTTP))
    marks = marks.withColumn("given", parsed(F.get("arguments", F.lit(0))))
    written = F.when(F.get("arguments", F.lit(0)).isNull(), F.array(F.lit(""))).otherwise(_strings(F.col("given")))
    marks = marks.withColumn("routes", F.transform(written, normalize_route))
    kinds = F.create_map(*(F.lit(x) for x in ("Module", "module", "Controller", "controller", "Injectable", "provider")))
    is_class = F.coalesce((F.col("target_kind") == "class") & F.col("target_name").isNotNull() & F.col("bound").isin("Module", "Controller", "Injectable"), F.lit(False))
    is_handler = F.coalesce((F.col("target_kind") == "method") & F.col("target_name").isNotNull() & F.col("bound").isin(*NEST_HTTP), F.lit(False))
    is_module, is_controller, name = F.col("bound") == "Module", F.col("bound") == "Controller", F.col("target_name")
    no_routes = F.array().cast("array<string>")
    joined = F.array_join(F.coalesce("routes", no_routes), "|")
    role = F.when(is_controller, F.concat(F.lit("controller:"), name, F.lit(":"), F.when(joined == "", "dynamic").otherwise(joined))).otherwise(F.concat(kinds[F.col("bound")], F.lit(":"), name))
    own_key = F.when(is_class, entity_key("scope_key", kinds[F.col("bound")], "path", role, F.col("evidence_key")))
    # A route's controller is the last one of its class's name, which lies with it in a window; ``key`` is that of the class or of that controller.
    heads = is_class & is_controller
    marks = marks.withColumns({"is_class": is_class, "heads": heads, "class": F.when(heads, name).when(is_handler, F.col("owner_name")), "key": own_key})
    latest = Window.partitionBy(*FILE, "class").orderBy(F.desc("heads"), F.desc("start_byte"), "evidence_key")
    above = F.first(F.when(F.col("heads"), F.struct("key", "routes"))).over(latest.rowsBetween(Window.unboundedPreceding, 0))
    marks = marks.repartition(parts(marks.sparkSession), *BY_FILE).withColumn("above", above).withColumn("full", F.when(is_handler, combine_routes(F.col("above.routes"), "routes")))
    marks = materialize_by(
        marks.select(
            *FILE, "evidence_key", "start_byte", "bound", "is_class", "target_kind", "target_name", "owner_name", "member_name", "parameter_index",
            F.when(F.col("bound").isin("Module", "Inject"), F.col("given")).alias("given"), F.when(F.col("is_class"), F.col("routes")).alias("routes"),
            (is_handler & F.col("above").isNotNull()).alias("is_route"), "full", F.when(is_handler, F.col("above.key")).otherwise(F.col("key")).alias("key"),
        ), "marks", BY_FILE,
    )
    imports = materialize_by(_file_imports(edges), "imports", BY_FILE)

    dynamic = F.when(is_module, ~F.coalesce(value_kind(F.col("given")) == "object", F.lit(False))).when(is_controller, F.col("routes").isNull()).otherwise(F.lit(False))
    attributes = (
        F.when(is_module, F.to_json(F.struct(dynamic.alias("dynamic_metadata"))))
        .when(is_controller, F.to_json(F.struct(dynamic.alias("dynamic_path"), F.coalesce("routes", no_routes).alias("paths"))))
        .otherwise(F.to_json(F.struct(F.lit("injectable").alias("origin"), name.alias("token"), name.alias("use_class"))))
    )
    own = _entities(marks.where("is_class"), "nestjs", kinds[F.col("bound")], name, F.when(dynamic, "unresolved").otherwise("declared"), role, attributes, name, "given", key=F.col("key"))

    modules = _last(own).where("entity_kind = 'module'").withColumnRenamed("identity_key", "source_key").select(*FILE, "source_key", "evidence_key", "start_byte", "given")
    is_object = F.coalesce(value_kind(F.col("given")) == "object", F.lit(False))
    stated = F.array(*(F.struct(F.lit(i).alias("nth"), F.lit(s).alias("section"), F.lit(k).alias("kind"), value_property(F.col("given"), s).alias("text")) for i, (s, k) in enumerate(NEST_SECTIONS.items())))
    sections = modules.withColumn("is_object", is_object).withColumn("s", F.explode(stated)).withColumn("p", parsed(F.col("s.text")))
    listed = F.when(F.col("is_object") & F.col("s.text").isNull(), no_routes).when(F.col("is_object"), value_items(F.col("p")))
    sections = sections.withColumn("items", listed).where("items IS NULL OR size(items) > 0")
    items = sections.select(*FILE, "source_key", "evidence_key", "start_byte", "s.nth", "s.section", "s.kind", F.posexplode_outer("items").alias("at", "v"))
    items = items.join(imports, ["project_id", "path"], "left").withColumn("place", F.coalesce("at", F.lit(0))).withColumn("p", parsed(F.col("v")))
    p, provides = F.col("p"), (F.col("section") == "providers") & (value_kind(F.col("p")) == "object")
    items = items.withColumn("given", F.when(provides, parsed(value_property(p, "provide"))).otherwise(p)).withColumn("used", F.when(provides, parsed(value_property(p, "useClass"))))
    items = items.withColumn("t", _value_target(F.col("given"))).withColumn("use_class", _value_target(F.col("used"))["name"]).drop("imports", "p", "given", "used", "v")
    items = materialize_by(items, "items", BY_FILE)

    told = items.where("section = 'providers' AND t IS NOT NULL").join(_known(own), BY_FILE, "left").where(_key_of(["provider"], [F.col("t.local"), F.col("t.name")]).isNull())
    first = Window.partitionBy(*FILE, "t.name").orderBy("start_byte", "evidence_key", "place")
    told = told.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    shown = F.to_json(F.struct(F.lit("module_registration").alias("origin"), F.col("t.name").alias("token"), "use_class"))
    extra = _entities(told, "nestjs", F.lit("provider"), F.col("t.name"), F.lit("declared"), F.concat(F.lit("registered-provider:"), F.col("t.name"), F.lit(":"), F.coalesce("use_class", F.lit(""))), shown, F.col("t.local"))

    extra = materialize_by(extra, "registered", BY_FILE)

    handlers = marks.where("is_route").withColumn("method", F.upper("bound")).withColumnRenamed("key", "source_key")
    handlers = handlers.withColumn("label", F.concat(F.col("owner_name"), F.lit("."), F.col("target_name"), F.lit(" "), F.col("method")))
    full = F.coalesce("full", no_routes)
    shown = F.to_json(F.struct("method", F.col("full").isNull().alias("dynamic_path"), full.alias("full_paths"), F.col("owner_name").alias("controller"), F.col("target_name").alias("handler")))
    role = F.concat(F.lit("route:"), F.col("label"), F.lit(":"), F.coalesce(F.array_join("full", "|"), F.lit("dynamic")))
    method_name = F.concat_ws(".", "owner_name", "target_name")
    routes = _entities(handlers, "nestjs", F.lit("route"), F.col("label"), F.when(F.col("full").isNull(), "unresolved").otherwise("declared"), role, shown, method_name, "source_key", "method")

    entities = own.drop("given").unionByName(extra)
    known = _known(entities)
    found = items.join(known, BY_FILE, "left")
    names = [F.col("t.local"), F.col("t.name")]
    key = F.when(F.col("section") == "imports", _key_of(["module"], names)).when(F.col("section") == "controllers", _key_of(["controller"], names)).when(F.col("section") == "providers", _key_of(["provider"], names)).otherwise(_key_of(["provider", "module"], names))
    sure = lambda key: F.when(F.col("t").isNull(), "unresolved").when(key.isNull(), "declared").otherwise("linked")
    registered = _relationships(found, "nestjs", F.col("kind"), key, F.col("t.name"), sure(key), F.to_json(F.struct("section")), F.col("t.local"), F.col("t.edge_key"))
    owned = _relationships(routes.withColumn("place", F.lit(0)), "nestjs", F.lit("handles_route"), F.col("identity_key"), F.col("name"), F.lit("linked"), F.to_json(F.struct("method")), F.col("symbol_name"), _none())

    stated = marks.where("bound = 'Inject' AND target_kind = 'parameter' AND member_name = 'constructor' AND owner_name IS NOT NULL")
    stated = stated.select(*FILE, "evidence_key", "start_byte", "owner_name", "parameter_index", "target_name", value_text(F.col("given")).alias("text"), value_segments(F.col("given")).alias("segments"))
    typed = evidence.where("kind = 'constructor_parameter'").withColumn("nth", F.coalesce("parameter_index", F.lit(-1)))
    typed = typed.join(stated.select(*FILE, "owner_name", F.coalesce("parameter_index", F.lit(-1)).alias("nth")), [*FILE, "owner_name", "nth"], "left_anti")
    wants = stated.unionByName(typed.select(*FILE, "evidence_key", "start_byte", "owner_name", "parameter_index", "target_name", _none().alias("text"), F.col("reference").alias("segments")))
    wants = wants.join(known, BY_FILE).withColumn("source_key", _key_of(["provider", "controller"], [F.col("owner_name")])).where("source_key IS NOT NULL")
    wants = wants.join(imports, ["project_id", "path"], "left").withColumn("t", _target(F.col("text"), F.col("segments"))).withColumn("place", F.lit(0))
    wants = materialize_by(wants.drop("imports"), "wants", BY_FILE)
    key = _key_of(["provider", "controller"], names)
    shown = F.to_json(F.struct("parameter_index", F.col("target_name").alias("parameter_name"), F.coalesce("t.token", F.lit("unknown")).alias("token_kind")))
    injected = _relationships(wants, "nestjs", F.lit("injects"), key, F.col("t.name"), sure(key), shown, F.col("t.local"), F.col("t.edge_key"))

    omissions = _omitted(items.where("t IS NULL")).union(_omitted(wants.where("t IS NULL"))).distinct()
    return Facts(entities.unionByName(routes.drop("source_key", "method")), registered.unionByName(owned).unionByName(injected), omissions)


def express_facts(evidence: DataFrame, edges: DataFrame) -> Facts:
    """Applications, routers, routes and middleware; route ownership, middleware registration and router mounts.

    An inline handler with four parameters handles errors. A mounted router of the file is
    linked, an imported one declared; paths that are no text are unresolved and omitted.
    """
    calls = evidence.where("kind = 'call_expression'")
    whole, second = F.col("imported_name").isin("default", "*"), F.get("reference", F.lit(1))
    kind = F.when((F.size("reference") == 1) & whole, "application").when((F.size("reference") == 1) & (F.col("imported_name") == "Router"), "router").when((F.size("reference") == 2) & whole & (second == "Router"), "router")
    made = _with_local(calls.where("assigned_name IS NOT NULL"), edges, "express", "express").withColumn("made", kind).where("made IS NOT NULL")
    local = F.col("assigned_name")
    owners = _entities(made, "express", F.col("made"), local, F.lit("declared"), F.concat_ws(":", "made", local), F.to_json(F.struct(local.alias("local_name"))), local)
    owners = materialize(owners, "owners")
    by_name = Window.partitionBy(*FILE, "name").orderBy(F.desc("start_byte"), "evidence_key")
    current = owners.withColumn("nth", F.row_number().over(by_name)).where("nth = 1").select(*FILE, F.col("name").alias("owner"), F.col("identity_key").alias("source_key"), F.col("entity_kind").alias("owner_kind"))

    direct = calls.where("size(reference) = 2").withColumn("owner", F.get("reference", F.lit(0))).withColumn("method", second).join(current, [*FILE, "owner"]).withColumn("first", parsed(F.get("arguments", F.lit(0))))
    direct = materialize(direct, "direct")
    plain = direct.where(F.col("method").isin(*EXPRESS_HTTP)).withColumn("paths", _paths(F.col("first"))).withColumn("rest", F.slice("arguments", 2, F.greatest(F.size("arguments"), F.lit(1)))).withColumn("skipped", F.lit(1))
    chained = calls.where(F.col("member_name").isin(*EXPRESS_HTTP)).where("size(receiver_reference) = 2 AND receiver_reference[1] = 'route'").withColumn("owner", F.get("receiver_reference", F.lit(0))).withColumn("method", F.col("member_name")).join(current, [*FILE, "owner"])
    chained = chained.join(plain.select(*FILE, "evidence_key"), [*FILE, "evidence_key"], "left_anti").withColumn("first", parsed(F.get("receiver_arguments", F.lit(0)))).withColumn("paths", _paths(F.col("first"))).withColumn("rest", F.col("arguments")).withColumn("skipped", F.lit(0))
    handled = plain.unionByName(chained).withColumn("handlers", _handlers()).withColumn("verb", F.upper("method"))
    no_paths, dynamic = F.array().cast("array<string>"), F.col("paths").isNull()
    label = F.concat(F.col("owner"), F.lit("."), F.col("verb"), F.lit(" "), F.coalesce(F.array_join("paths", "|"), F.lit("dynamic")))
    handled = handled.withColumn("label", F.when(F.size("paths") == 0, F.concat(F.col("owner"), F.lit("."), F.col("verb"), F.lit(" dynamic"))).otherwise(label))
    names = F.transform("handlers", lambda h: h["name"])
    shown = F.to_json(F.struct(F.col("verb").alias("method"), dynamic.alias("dynamic_path"), F.coalesce("paths", no_paths).alias("paths"), F.filter(names, lambda n: n.isNotNull()).alias("handlers"), "owner"))
    role = F.concat(F.lit("route:"), F.col("label"), F.lit(":"), F.array_join(F.transform(names, lambda n: F.coalesce(n, F.lit("inline"))), "|"))
    routes = _entities(handled, "express", F.lit("route"), F.col("label"), F.when(dynamic, "unresolved").otherwise("declared"), role, shown, F.get(F.filter(names, lambda n: n.isNotNull()), F.lit(0)), "source_key", "verb", "paths")
    routes = materialize(routes, "routes")
    owned = _relationships(routes.withColumn("place", F.lit(0)), "express", F.lit("handles_route"), F.col("identity_key"), F.col("name"), F.when(F.col("certainty") == "unresolved", "unresolved").otherwise("linked"), F.to_json(F.struct(F.col("verb").alias("method"))), F.col("symbol_name"), _none())

    first = F.col("first")
    stated = F.coalesce(value_kind(first).isin("string", "array"), F.lit(False))
    bare = ~stated & (F.coalesce(value_kind(first) == "identifier", F.lit(False)) | F.get("parameter_counts", F.lit(0)).isNotNull())
    uses = direct.where("method = 'use'").withColumn("paths", F.when(stated, _paths(first)).when(bare, F.array(F.lit("/"))))
    uses = uses.withColumn("rest", F.when(bare, F.col("arguments")).otherwise(F.slice("arguments", 2, F.greatest(F.size("arguments"), F.lit(1))))).withColumn("skipped", F.when(bare, 0).otherwise(1))
    one = value_segments(F.col("one"))
    uses = uses.withColumn("one", parsed(F.get("rest", F.lit(0)))).withColumn("router", F.when(F.size(one) == 1, F.get(one, F.lit(0)))).withColumn("handlers", _handlers()).drop("first", "one")
    routers = current.where("owner_kind = 'router'").select(*FILE, F.col("owner").alias("router"), F.col("source_key").alias("router_key"))
    uses = uses.join(routers, [*FILE, "router"], "left").join(_file_imports(edges), ["project_id", "path"], "left").withColumn("to", F.try_element_at("imports", F.col("router")))
    local = F.col("to").isNotNull() & F.col("to.external_package").isNull()
    uses = uses.withColumn("mounted", F.col("router_key").isNotNull() | F.coalesce(local, F.lit(False))).withColumn("place", F.lit(0))
    uses = materialize(uses.drop("imports"), "uses")
    to_name = F.when(F.col("router_key").isNotNull(), F.col("router")).otherwise(F.coalesce("to.imported_name", "router"))
    shown = F.to_json(F.struct(dynamic.alias("dynamic_path"), F.coalesce("paths", no_paths).alias("paths")))
    mounts = uses.where("mounted")
    mounted = _relationships(mounts, "express", F.lit("mounts_router"), F.col("router_key"), to_name, F.when(dynamic, "unresolved").when(F.col("router_key").isNull(), "declared").otherwise("linked"), shown, F.when(F.col("router_key").isNotNull(), F.col("router")), F.when(F.col("router_key").isNull(), F.col("to.edge_key")))
    others = uses.where("NOT mounted")
    each = others.drop("place").select("*", F.posexplode("handlers").alias("place", "h"))
    each = each.withColumn("label", F.concat(F.col("owner"), F.lit(".middleware."), F.coalesce("h.name", F.lit("inline")), F.lit("."), F.col("place").cast("string")))
    shown = F.to_json(F.struct(dynamic.alias("dynamic_path"), F.col("h.error").alias("error_handler"), F.col("h.name").alias("handler"), "owner", F.coalesce("paths", no_paths).alias("paths")))
    joined = F.array_join(F.coalesce("paths", no_paths), "|")
    role = F.concat(F.lit("middleware:"), F.col("label"), F.lit(":"), F.when(joined == "", "dynamic").otherwise(joined))
    middleware = _entities(each, "express", F.lit("middleware"), F.col("label"), F.when(dynamic, "unresolved").otherwise("declared"), role, shown, F.col("h.name"), "source_key", "place")
    middleware = materialize(middleware, "middleware")
    wired = _relationships(middleware, "express", F.lit("uses_middleware"), F.col("identity_key"), F.col("name"), F.when(F.col("certainty") == "unresolved", "unresolved").otherwise("linked"), F.col("attributes"), F.col("symbol_name"), _none())

    open_ = routes.where(dynamic).select(*FILE, "evidence_key").union(uses.where(dynamic | (~F.col("mounted") & (F.size("handlers") == 0))).select(*FILE, "evidence_key"))
    entities = owners.unionByName(routes.drop("source_key", "verb", "paths")).unionByName(middleware.drop("source_key", "place"))
    return Facts(entities, owned.unionByName(mounted).unionByName(wired), _omitted(open_).distinct())


def _paths(p: Column) -> Column:
    """Sorted distinct routes of a string or an array of strings; null for all else."""
    return F.array_sort(F.array_distinct(F.transform(_strings(p), normalize_route)))


def _handlers() -> Column:
    """Structs (name, error) of the arguments in ``rest``, which follow ``skipped`` others; values that are no handlers vanish."""
    read = lambda x, i: F.struct(value_name(x).alias("name"), F.get("parameter_counts", i + F.col("skipped")).alias("n"))
    found = F.filter(F.transform(F.transform("rest", parsed), read), lambda h: h["name"].isNotNull() | h["n"].isNotNull())
    return F.coalesce(F.transform(found, lambda h: F.struct(h["name"].alias("name"), (h["name"].isNull() & (h["n"] == 4)).alias("error"))), F.array().cast("array<struct<name:string,error:boolean>>"))


def sequelize_facts(evidence: DataFrame, edges: DataFrame) -> Facts:
    """Models of classes and ``define`` calls, their attributes, and the associations between models.

    Only files that import the package count. An associated model of the file is linked, another one declared.
    """
    imports = framework_imports(edges).where("framework = 'sequelize' AND external_package = 'sequelize'")
    seen = evidence.join(imports.select("project_id", F.col("source_path").alias("path")).distinct(), ["project_id", "path"], "left_semi")
    calls = seen.where("kind = 'call_expression'").withColumn("a", F.get("reference", F.lit(0))).withColumn("b", F.get("reference", F.lit(1)))
    heads = _with_local(seen.where("kind = 'class_heritage' AND target_name IS NOT NULL"), edges, "sequelize", "sequelize")
    heads = heads.where("(imported_name = 'Model' AND size(reference) = 1) OR (imported_name IN ('*', 'default') AND reference[1] = 'Model')")
    own = F.col("target_name")
    classes = _entities(heads, "sequelize", F.lit("model"), own, F.lit("declared"), F.concat(F.lit("model:class:"), own), F.to_json(F.struct(F.lit("class_init").alias("origin"))), own).withColumn("local", F.col("name"))
    defined = calls.where("size(reference) = 2 AND b = 'define' AND assigned_name IS NOT NULL").withColumn("model", F.coalesce(value_text(parsed(F.get("arguments", F.lit(0)))), "assigned_name")).withColumn("options", parsed(F.get("arguments", F.lit(2))))
    option = lambda key, read=value_text: read(parsed(value_property(F.col("options"), key)))
    shown = F.to_json(F.struct(F.lit("define").alias("origin"), option("tableName").alias("table_name"), option("timestamps", value_flag).alias("timestamps")))
    defines = _entities(defined, "sequelize", F.lit("model"), F.col("model"), F.lit("declared"), F.concat(F.lit("model:define:"), F.col("model")), shown, F.col("assigned_name"), "assigned_name").withColumnRenamed("assigned_name", "local")
    every = classes.withColumn("nth", F.lit(0)).unionByName(defines.withColumn("nth", F.lit(1)))
    every = materialize(every, "models")
    latest = Window.partitionBy(*FILE, "local").orderBy(F.desc("nth"), F.desc("start_byte"), "evidence_key")
    models = every.withColumn("place", F.row_number().over(latest)).where("place = 1").select(*FILE, "local", F.col("name").alias("model"), F.col("identity_key").alias("source_key"))

    local = F.when((F.col("b") == "init") & (F.col("a") == "this") & F.col("owner_name").isNotNull(), F.col("owner_name")).when(F.col("b") == "init", F.col("a")).when(F.col("b") == "define", F.col("assigned_name"))
    filled = calls.withColumn("local", local).join(models, [*FILE, "local"]).withColumn("first", parsed(F.get("arguments", F.when(F.col("b") == "define", 1).otherwise(0))))
    fields = F.when(value_kind(F.col("first")) == "object", F.col("first.properties"))
    filled = materialize(filled.select(*FILE, "model", "source_key", "evidence_key", "start_byte", fields.alias("fields")), "filled")
    fields = filled.select(*FILE, "model", "source_key", "evidence_key", "start_byte", F.posexplode("fields").alias("place", "p"))
    fields = fields.withColumn("value", parsed(F.col("p.value")))
    value, is_object = F.col("value"), F.coalesce(value_kind(F.col("value")) == "object", F.lit(False))
    fields = fields.withColumn("type", F.when(is_object, parsed(value_property(value, "type"))).otherwise(value))
    kind = F.element_at(value_segments(F.col("type")), -1)
    of = lambda key: parsed(value_property(value, key))
    flag = lambda key: value_flag(of(key))
    shown = F.to_json(F.struct("model", flag("allowNull").alias("allow_null"), value_text(of("field")).alias("field"), flag("primaryKey").alias("primary_key"), kind.alias("type_name"), flag("unique").alias("unique")))
    attributes = _entities(fields, "sequelize", F.lit("model_attribute"), F.concat_ws(".", "model", "p.key"), F.when(value_kind(value) == "unknown", "unresolved").otherwise("declared"), F.concat(F.lit("attribute:"), F.concat_ws(":", "model", "p.key")), shown, _none(), "source_key", "place")
    defines_ = _relationships(attributes, "sequelize", F.lit("defines_attribute"), F.col("identity_key"), F.col("name"), F.col("certainty"), _none(), _none(), _none())

    linked = calls.where(F.col("b").isin(*ASSOCIATIONS)).withColumn("local", F.col("a")).join(models, [*FILE, "local"]).withColumn("target", value_name(parsed(F.get("arguments", F.lit(0))))).where("target IS NOT NULL")
    linked = linked.join(models.select(*FILE, F.col("local").alias("target"), F.col("source_key").alias("there")), [*FILE, "target"], "left").withColumn("options", parsed(F.get("arguments", F.lit(1)))).withColumn("place", F.lit(0))
    through = F.coalesce(option("through", value_name), option("through"))
    shown = F.to_json(F.struct(F.col("b").alias("association"), option("foreignKey").alias("foreign_key"), option("targetKey").alias("target_key"), through.alias("through")))
    associates = _relationships(linked, "sequelize", F.lit("associates"), F.col("there"), F.col("target"), F.when(F.col("there").isNull(), "declared").otherwise("linked"), shown, F.col("target"), _none())
    entities = every.drop("local", "nth").unionByName(attributes.drop("source_key", "place"))
    return Facts(entities, defines_.unionByName(associates), _omitted(filled.where("fields IS NULL")).distinct())


def _judged(facts: Facts, max_entities: int, max_relationships: int, max_name_bytes: int) -> DataFrame:
    """Entities and relationships as rows of one table, with the ``state`` kept, the reason why a row is left out, or null where it goes with its entities.

    Keys meet in windows within their file, so rows that are dealt by file stay where they are.
    """
    none = _none()
    shared = ["certainty", "evidence_key", "start_byte", "attributes", "symbol_name", "identity_key"]
    entities = facts.entities.select(*FILE, "framework", F.lit(False).alias("link"), F.col("entity_kind").alias("kind"), "name", *shared, none.alias("source_key"), none.alias("target_key"), none.alias("edge_key"))
    links = facts.relationships.select(*FILE, "framework", F.lit(True).alias("link"), F.col("relationship_kind").alias("kind"), F.col("target_name").alias("name"), *shared, "source_key", "target_key", "edge_key")
    rows = entities.unionByName(links).withColumn("bad", (F.octet_length("name") == 0) | (F.octet_length("name") > max_name_bytes))
    place = lambda *by: F.row_number().over(Window.partitionBy(*FILE, "framework", "link", *by).orderBy("start_byte", "kind", "identity_key"))
    with_entity = lambda key: Window.partitionBy(*FILE, F.when(F.col("link"), F.col(key)).otherwise(F.col("identity_key")))
    rows = rows.withColumn("nth", place("bad")).withColumn("stays", F.coalesce(~F.col("link") & ~F.col("bad") & (F.col("nth") <= max_entities), F.lit(False)))
    rows = rows.withColumn("source_name", F.max(F.when(F.col("stays"), F.col("name"))).over(with_entity("source_key"))).withColumn("there", F.max("stays").over(with_entity("target_key")))
    rows = rows.withColumn("alive", F.col("link") & F.col("source_name").isNotNull() & (F.col("target_key").isNull() | F.col("there")))
    far = F.coalesce(F.col("bad"), F.lit(False))
    rows = rows.withColumn("stays", F.col("stays") | (F.col("alive") & ~far)).withColumn("nth", F.when(F.col("link"), place("stays")).otherwise(F.col("nth")))
    state = (
        F.when(F.col("stays") & (F.col("nth") <= F.when(F.col("link"), max_relationships).otherwise(max_entities)), "kept")
        .when(F.col("bad") & (~F.col("link") | F.col("alive")), "name_text_limit")
        .when(~F.col("link") & ~F.col("bad"), "entity_limit")
        .when(F.col("stays"), "relationship_limit")
    )
    return rows.withColumn("state", state).withColumn("source_name", F.when(F.col("link"), F.col("source_name"))).drop("bad", "nth", "stays", "there", "alive")


def _told_apart(rows: DataFrame, omissions: DataFrame, *symbol: str) -> Facts:
    """Facts of a written table of ``_judged``."""
    shared = ["certainty", "evidence_key", "start_byte", "attributes", "symbol_name", "identity_key"]
    kept = rows.where("state = 'kept'")
    entities = kept.where("NOT link").select(*FILE, "framework", F.col("kind").alias("entity_kind"), "name", *shared, *symbol)
    links = kept.where("link").select(*FILE, "framework", F.col("kind").alias("relationship_kind"), "source_key", "target_key", F.col("name").alias("target_name"), "source_name", *shared, "edge_key", *symbol)
    left_out = rows.where("state <> 'kept'").select(*FILE, "evidence_key", F.col("state").alias("reason"))
    return Facts(entities, links, omissions.union(left_out).distinct())


def limited(facts: Facts, max_entities: int = 2_000, max_relationships: int = 5_000, max_name_bytes: int = 1_024) -> Facts:
    """Facts within each file's limits, by start, kind and key; what is left out is an omission.

    Empty or too long names count as ``name_text_limit``. Relationships of entities that were left out go with them;
    the others tell their source's name.
    """
    rows = _judged(facts, max_entities, max_relationships, max_name_bytes)
    return _told_apart(materialize_by(rows.where("state IS NOT NULL"), "facts", BY_FILE), facts.omissions)


def within_project(facts: Facts, max_entities: int = 100_000, max_relationships: int = 200_000) -> tuple[Facts, DataFrame]:
    """Facts within each project's totals, by path and each file's stable order; and per project the reasons met.

    Relationships of entities that were cut go first, then those beyond the limit. Places
    are sums in two levels; no task ranks a project.
    """
    start, gone = F.coalesce("start_byte", F.lit(-1)), ["project_id", "path", "scope_key"]
    entities, entity_status = saturating_budget(facts.entities.withColumn("at", start), [*gone[1:], "at", "entity_kind", "identity_key"], max_entities)
    entities = materialize(entities.drop("at"), "entities")
    own = facts.relationships.join(entities.select(*FILE, F.col("identity_key").alias("source_key")), [*FILE, "source_key"], "left_semi")
    own = own.withColumn("to", F.coalesce("target_key", "target_name", F.lit("")))
    links, link_status = saturating_budget(materialize(own, "links"), [*gone[1:], "source_key", "relationship_kind", "to", "identity_key"], max_relationships)
    counts = facts.relationships.groupBy("project_id").agg(F.count("*").alias("had"))
    reasons = entity_status.select("project_id", (F.col("omitted") > 0).alias("cut")).join(counts.join(link_status.select("project_id", "kept"), "project_id", "left"), "project_id", "full_outer")
    met = F.array_compact(F.array(F.when(F.col("cut"), F.lit("total_entities")), F.when(F.col("had") > F.coalesce("kept", F.lit(0)), F.lit("total_relationships"))))
    return Facts(entities, materialize(links.drop("to"), "relationships"), facts.omissions), reasons.select("project_id", met.alias("limit_reasons"))


def with_symbols(rows: DataFrame, symbols: DataFrame, kind: str = "kind") -> DataFrame:
    """Facts with the ``symbol_key`` of the first symbol of their file that has their simple or qualified name, and its qualified name as ``symbol``; else nulls.

    Names meet in windows within their file, as in ``_judged``.
    """
    said = F.struct("start_byte", "identity_key", "qualified_name").alias("said")
    named = symbols.select(*BY_FILE, F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("symbol_name"), said).where("symbol_name IS NOT NULL")
    simple = F.when(F.col("said").isNotNull() | F.col(kind).isin("route", "handles_route"), F.col("symbol_name")).otherwise(F.substring_index("symbol_name", ".", -1))
    every = rows.withColumn("fact", F.lit(True)).unionByName(named, allowMissingColumns=True).withColumn("simple", simple)
    for name, found in (("symbol_name", "whole"), ("simple", "part")):
        every = every.withColumn(found, F.min("said").over(Window.partitionBy(*BY_FILE, name)))
    hit = F.when(F.col("symbol_name").isNotNull(), F.coalesce("whole", "part"))
    return every.where("fact").withColumn("symbol_key", hit["identity_key"]).withColumn("symbol", hit["qualified_name"]).select(*rows.columns, "symbol_key", "symbol")


def index_frameworks(files: DataFrame, packages: DataFrame, edges: DataFrame, evidence: DataFrame, symbols: DataFrame, max_entities: int = 2_000, max_relationships: int = 5_000) -> tuple[DataFrame, Facts]:
    """Scopes, and the facts of every framework in the files of its scopes.

    ``files(project_id, path)``; ``evidence`` without ``scope_key``; the others as in
    ``detect_scopes`` and ``build_symbols``. A file belongs to its nearest package; a
    framework is looked for only where that package is a scope of it.
    """
    edges = materialize(edges, "edges")
    scopes = detect_scopes(packages, edges).withColumn("scope_key", scope_key("project_id", "root_path", "framework"))
    roots = nearest_package(files, scopes.select("project_id", F.col("root_path").alias("root")).distinct())
    tasks = roots.select("project_id", "path", F.col("root").alias("root_path")).join(scopes.drop("evidence"), ["project_id", "root_path"])
    scopes, tasks = materialize(scopes, "scopes"), materialize_by(tasks, "tasks", BY_FILE)
    present = {r.framework for r in scopes.select("framework").distinct().collect()} or {"react"}  # at most the five below; without any, no rows of one
    kinds = sorted({kind for framework in present for kind in READS[framework]})
    evidence, symbols = materialize_by(evidence.where(F.col("kind").isin(kinds)), "evidence", BY_FILE), materialize_by(symbols, "symbols", BY_FILE)
    of = lambda framework: evidence.join(tasks.where(F.col("framework") == framework).select(*FILE), BY_FILE)
    from corpusloom.operators import facts_ui  # it builds on this module

    builders = {
        "nestjs": lambda: nest_facts(of("nestjs"), edges),
        "express": lambda: express_facts(of("express"), edges),
        "sequelize": lambda: sequelize_facts(of("sequelize"), edges),
        "nextjs": lambda: facts_ui.next_facts(tasks.where("framework = 'nextjs'").select(*FILE, "root_path"), evidence, symbols),
        "react": lambda: facts_ui.react_facts(of("react"), edges, symbols),
    }
    built = [build() for framework, build in builders.items() if framework in present]
    entities, links, omissions = (reduce(DataFrame.unionByName, rows) for rows in zip(*built, strict=True))
    judged = _judged(Facts(entities, links, omissions), max_entities, max_relationships, 1_024)
    rows = materialize_by(with_symbols(judged.where("state IS NOT NULL"), symbols), "facts", BY_FILE)
    return scopes, _told_apart(rows, materialize(omissions, "omissions"), "symbol_key", "symbol")
