"""Facts of page routers and component libraries: file routes with their components, and which component renders or wraps which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.scalar import entity_key, file_route
from corpusloom.operators import facts as base
from corpusloom.operators.facts import FILE, Facts
from corpusloom.operators.frameworks import HANDLERS
from corpusloom.plans.tables import materialize

PASCAL = "^[A-Z][A-Za-z0-9]*$"
_FACT = "project_id string, path string, scope_key string, framework string, entity_kind string, name string, certainty string, evidence_key string, start_byte long, attributes string, symbol_name string, identity_key string"


def client_files(evidence: DataFrame) -> DataFrame:
    """project_id, path of files that say "use client"."""
    said = F.get_json_object(F.get("arguments", F.lit(0)), "$.value")
    return evidence.where((F.col("kind") == "directive") & (said == "use client")).select("project_id", "path").distinct()


def _with_client(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    marked = client_files(evidence).withColumn("client_boundary", F.lit(True))
    return rows.join(marked, ["project_id", "path"], "left").withColumn("client_boundary", F.coalesce("client_boundary", F.lit(False)))


def _elements_in(symbols: DataFrame, evidence: DataFrame) -> DataFrame:
    """Elements with each symbol of their file around them: the element's columns, and the symbol as ``s``."""
    own = symbols.select("project_id", "path", F.struct("identity_key", "name", "kind", "start_byte", "end_byte").alias("s"))
    return evidence.where("kind = 'jsx'").join(own, ["project_id", "path"]).where("s.start_byte <= start_byte AND s.end_byte > start_byte")


def next_facts(files: DataFrame, evidence: DataFrame, symbols: DataFrame) -> Facts:
    """Pages, layouts, special files and route handlers by the place of a file, and the component that a page or layout contains.

    ``files(project_id, path, scope_key, root_path)`` are those of the framework's scopes;
    paths are read below the root. An app router's handlers are its exported functions
    with the name of an HTTP method. The component is the first exported class or
    function with a capitalised name that holds an element.
    """
    inner = F.when(F.col("root_path") == ".", F.col("path")).otherwise(F.substring("path", F.length("root_path") + 2, F.length("path")))
    routes = files.withColumn("r", file_route(inner)).where("r IS NOT NULL").select(*FILE, "r.*")
    key = F.sha2(F.concat_ws(":", F.lit("next"), "path", F.when(F.col("kind") == "special_file", "special").when(F.col("kind") == "route_handler", "route").otherwise(F.col("kind"))), 256)
    routes = _with_client(routes.withColumn("evidence_key", key), evidence)
    fit = symbols.where(F.col("exported") & F.col("kind").isin("class", "function") & F.col("name").rlike(PASCAL))
    held = _elements_in(fit, evidence).groupBy("project_id", "path").agg(F.min_by("s.name", F.struct("s.start_byte", "s.identity_key")).alias("component"))
    named = symbols.where(F.col("exported") & (F.col("kind") == "function") & F.col("name").isin(*HANDLERS)).groupBy("project_id", "path").agg(F.array_sort(F.collect_set("name")).alias("methods"))
    routes = routes.join(held, ["project_id", "path"], "left").join(named, ["project_id", "path"], "left")
    listed = (F.col("kind") == "route_handler") & (F.col("router") == "app")
    routes = routes.withColumn("method", F.explode_outer(F.when(listed, F.col("methods")))).where(~listed | F.col("method").isNotNull())
    handler, special = F.col("kind") == "route_handler", F.col("kind") == "special_file"
    pattern = F.coalesce("route_pattern", F.lit("unresolved"))
    role = (
        F.when(F.col("kind") == "page", F.concat_ws(":", F.lit("page"), "router", pattern))
        .when(F.col("kind") == "layout", F.concat_ws(":", F.lit("layout"), "role", pattern))
        .when(special, F.concat_ws(":", F.lit("special"), "role"))
        .otherwise(F.concat_ws(":", F.lit("route-handler"), "router", pattern, F.coalesce("method", F.lit("default"))))
    )
    shown = F.to_json(
        F.when(F.col("kind") == "page", F.struct(F.lit("next_page").alias("kind"), "client_boundary", "router", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("method"), "route_pattern"))
        .when(F.col("kind") == "layout", F.struct(F.lit("next_layout").alias("kind"), "client_boundary", F.lit(None).cast("string").alias("router"), "role", F.lit(None).cast("string").alias("method"), "route_pattern"))
        .when(special, F.struct(F.lit("next_special_file").alias("kind"), F.lit(None).cast("boolean").alias("client_boundary"), F.lit(None).cast("string").alias("router"), "role", F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("route_pattern")))
        .otherwise(F.struct(F.lit("next_route_handler").alias("kind"), F.lit(None).cast("boolean").alias("client_boundary"), "router", F.lit(None).cast("string").alias("role"), "method", "route_pattern"))
    )
    kind = F.when(special, "component").otherwise(F.col("kind"))
    certainty = F.when(F.col("route_pattern").isNull() & ~special, "unresolved").otherwise("convention")
    name = F.when(handler, F.concat_ws(":", "path", F.coalesce("method", F.lit("default")))).otherwise(F.col("path"))
    symbol = F.when(handler, F.col("method")).otherwise(F.col("component"))
    routes = materialize(routes.select(*FILE, F.lit("nextjs").alias("framework"), kind.alias("entity_kind"), name.alias("name"), certainty.alias("certainty"), "evidence_key", F.lit(None).cast("long").alias("start_byte"), shown.alias("attributes"), symbol.alias("symbol_name"), entity_key("scope_key", kind, "path", role, F.col("evidence_key")).alias("identity_key"), "component"), "routes")
    owned = routes.where("entity_kind IN ('page', 'layout') AND component IS NOT NULL").withColumn("source_key", F.col("identity_key")).withColumn("place", F.lit(0))
    contains = base._relationships(owned, "nextjs", F.lit("contains"), F.lit(None).cast("string"), F.col("component"), F.lit("declared"), F.lit('{"kind":"next_component_ownership"}'), F.col("component"), F.lit(None).cast("string"))
    return Facts(routes.drop("component"), contains, _no_omissions(routes))


def _no_omissions(rows: DataFrame) -> DataFrame:
    return rows.limit(0).select(*FILE, "evidence_key", F.lit("").alias("reason"))


def _local_targets(edges: DataFrame) -> DataFrame:
    """Per file and local name the first runtime import under it: imported_name, edge_key."""
    rows = edges.where("NOT type_only").select("project_id", F.col("source_path").alias("path"), "edge_key", F.explode("bindings").alias("b"))
    rows = rows.where("b.local_name IS NOT NULL AND NOT coalesce(b.type_only, false)")
    return rows.groupBy("project_id", "path", F.col("b.local_name").alias("target_name")).agg(F.min_by("b.imported_name", "edge_key").alias("imported_name"), F.min("edge_key").alias("edge_key"))


def react_facts(evidence: DataFrame, edges: DataFrame, symbols: DataFrame) -> Facts:
    """Components, what they render and what they wrap.

    A component is an exported symbol with a capitalised name that holds an element, or
    to which ``memo`` or ``forwardRef`` of the library is assigned; that call is then its
    evidence, else the first element. Each element with a capitalised plain name is one
    ``renders_component`` of the first component around it, unless it is that component
    itself; it is linked to a component of the file, else declared with its imported name.
    A wrapper around a name is one ``wraps``, with a target if that component comes before.
    """
    keys = ["project_id", "path"]
    scoped = evidence.select(*FILE).distinct()
    named = symbols.where(F.col("exported") & F.col("name").rlike(PASCAL)).join(scoped, keys)
    calls = base._with_local(evidence.where("kind = 'call_expression' AND assigned_name IS NOT NULL AND size(reference) > 0"), edges, "react", "react")
    wrapper = F.when(F.col("imported_name") == "*", F.get("reference", F.lit(1))).otherwise(F.col("imported_name"))
    calls = calls.withColumn("wrapper", wrapper).where(F.col("wrapper").isin("memo", "forwardRef"))
    wraps = base.value_name(base.parsed(F.get("arguments", F.lit(0))))
    calls = calls.groupBy(*keys, F.col("assigned_name").alias("name")).agg(F.min_by(F.struct("evidence_key", "start_byte", "wrapper", wraps.alias("wraps")), F.struct("start_byte", "evidence_key")).alias("call"))
    inside = materialize(_elements_in(named.select(*keys, "identity_key", "name", "kind", "start_byte", "end_byte"), evidence), "elements")
    direct = inside.groupBy(*keys, F.col("s.identity_key").alias("identity_key")).agg(F.min_by(F.struct("evidence_key", "start_byte"), F.struct("start_byte", "evidence_key")).alias("element"))
    found = named.withColumnRenamed("identity_key", "symbol_key").join(direct.withColumnRenamed("identity_key", "symbol_key"), [*keys, "symbol_key"], "left").join(calls, [*keys, "name"], "left")
    found = _with_client(found.where("call IS NOT NULL OR element IS NOT NULL"), evidence)
    kind = F.coalesce("call.wrapper", F.lit("plain"))
    shown = F.to_json(F.struct(F.lit("react_component").alias("kind"), "client_boundary", F.col("call.wrapper").alias("wrapper")))
    evidence_key = F.coalesce("call.evidence_key", "element.evidence_key")
    key = entity_key("scope_key", F.lit("component"), "path", F.concat_ws(":", F.lit("component"), "name", kind), evidence_key)
    nth = F.row_number().over(Window.partitionBy(*keys, "name").orderBy(F.desc("start_byte"), "symbol_key"))
    found = materialize(found.select(*FILE, "symbol_key", "name", F.col("start_byte").alias("at"), "end_byte", evidence_key.alias("evidence_key"), F.coalesce("call.start_byte", "element.start_byte").alias("start_byte"), "call", shown.alias("attributes"), key.alias("identity_key"), nth.alias("nth")), "components")
    entities = found.select(*FILE, F.lit("react").alias("framework"), F.lit("component").alias("entity_kind"), "name", F.lit("declared").alias("certainty"), "evidence_key", "start_byte", "attributes", F.col("name").alias("symbol_name"), "identity_key")
    known = found.where("nth = 1").select(*keys, F.col("name").alias("target_name"), F.col("identity_key").alias("target_key"), F.col("at").alias("target_at"))
    imported = _local_targets(edges)
    none = F.lit(None).cast("string")

    wrapped = found.where("call.wraps IS NOT NULL").withColumn("source_key", F.col("identity_key")).withColumn("target_name", F.col("call.wraps")).withColumn("place", F.lit(0))
    wrapped = wrapped.drop("identity_key").join(known, [*keys, "target_name"], "left").join(imported.drop("imported_name"), [*keys, "target_name"], "left")
    before = F.when(F.col("target_at") < F.col("at"), F.col("target_key"))
    links = base._relationships(wrapped, "react", F.lit("wraps"), before, F.col("target_name"), F.lit("declared"), F.to_json(F.struct(F.lit("react_component_wrapper").alias("kind"), F.col("call.wrapper").alias("wrapper"))), F.col("target_name"), F.col("edge_key"))

    sources = found.where("nth = 1").select(*keys, F.col("symbol_key"), F.col("identity_key").alias("source_key"), F.col("name").alias("source_name"), "at")
    used = inside.withColumn("symbol_key", F.col("s.identity_key")).where((F.size("reference") == 1) & F.get("reference", F.lit(0)).rlike(PASCAL)).join(sources, [*keys, "symbol_key"])
    first = F.row_number().over(Window.partitionBy(*keys, "evidence_key").orderBy("at", "symbol_key"))
    used = used.withColumn("first", first).where("first = 1").withColumn("target_name", F.get("reference", F.lit(0))).where("target_name <> source_name").withColumn("place", F.lit(0))
    used = used.join(known.drop("target_at"), [*keys, "target_name"], "left").join(imported, [*keys, "target_name"], "left")
    free = F.col("target_key").isNull()
    shown_name = F.when(free, F.coalesce("imported_name", "target_name")).otherwise(F.col("target_name"))
    rendered = base._relationships(used.withColumn("tag", F.col("target_name")), "react", F.lit("renders_component"), F.col("target_key"), shown_name, F.when(free, "declared").otherwise("linked"), F.lit('{"kind":"react_component_render"}'), F.col("tag"), F.when(free, F.col("edge_key")).otherwise(none))
    return Facts(entities, links.unionByName(rendered), _no_omissions(entities))
