"""Framework scopes, imports and facts from evidence tables, as joins on file and local name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.scalar import package_facts
from corpusloom.operators.paths import nearest_package, parent

# Frameworks by the package that brings them.
FRAMEWORKS = {"@nestjs/common": ["nestjs"], "@nestjs/core": ["nestjs"], "express": ["express"], "next": ["nextjs", "react"], "react": ["react"], "react-dom": ["react"], "sequelize": ["sequelize"]}
HANDLERS = ["GET", "HEAD", "POST", "PUT", "PATCH", "DELETE", "OPTIONS"]


def frameworks_of(package: str):
    """The frameworks of a package name; empty for others."""
    table = F.create_map(*(x for p, fs in FRAMEWORKS.items() for x in (F.lit(p), F.array(*map(F.lit, fs)))))
    return F.coalesce(F.try_element_at(table, F.col(package)), F.array().cast("array<string>"))


def detect_scopes(packages: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, root_path, framework, evidence): from package.json files and from runtime imports below them.

    ``packages(project_id, path, text)``; ``edges(project_id, source_path, external_package, type_only, edge_key)``.
    Evidence is distinct and sorted, package metadata before imports; type-only imports do not count.
    """
    facts = packages.select("project_id", "path", parent(F.col("path")).alias("root_path"), package_facts("text").alias("f")).where("NOT f.warning")
    stated = facts.select("project_id", "path", "root_path", F.explode("f.dependencies").alias("package"))
    stated = stated.select("project_id", "root_path", F.explode(frameworks_of("package")).alias("framework"), F.struct(F.lit(0).alias("place"), F.lit("package_metadata").alias("kind"), "path", F.lit(None).cast("string").alias("edge_key")).alias("e"))
    used = edges.where("external_package IS NOT NULL AND NOT type_only").select("project_id", F.col("source_path").alias("path"), "edge_key", F.explode(frameworks_of("external_package")).alias("framework"))
    roots = nearest_package(used.select("project_id", "path").distinct(), facts.select("project_id", F.col("root_path").alias("root")))
    used = used.join(roots, ["project_id", "path"]).select("project_id", F.col("root").alias("root_path"), "framework", F.struct(F.lit(1).alias("place"), F.lit("import_binding").alias("kind"), "path", "edge_key").alias("e"))
    every = stated.union(used).groupBy("project_id", "root_path", "framework").agg(F.array_sort(F.collect_set("e")).alias("e"))
    return every.select("project_id", "root_path", "framework", F.transform("e", lambda x: F.struct(x["kind"].alias("kind"), x["path"].alias("path"), x["edge_key"].alias("edge_key"))).alias("evidence"))


def framework_imports(edges: DataFrame) -> DataFrame:
    """One row a framework and local name: runtime imports of its packages, imported names defaulted by the kind of binding."""
    rows = edges.where("external_package IS NOT NULL AND NOT type_only").select("project_id", "source_path", "edge_key", "external_package", F.explode("bindings").alias("b"), frameworks_of("external_package").alias("fs"))
    name = F.coalesce("b.imported_name", F.when(F.col("b.kind").isin("default", "commonjs_default"), "default").when(F.col("b.kind").isin("namespace", "import_equals"), "*").otherwise("unknown"))
    kept = rows.where("b.local_name IS NOT NULL AND NOT coalesce(b.type_only, false)")
    return kept.select("project_id", "source_path", "edge_key", "external_package", F.col("b.local_name").alias("local_name"), name.alias("imported_name"), F.explode("fs").alias("framework"))


def bind_evidence(evidence: DataFrame, imports: DataFrame, framework: str) -> DataFrame:
    """Evidence whose first reference segment is a local name bound to the framework in its file, with the name it stands for."""
    own = imports.where(F.col("framework") == framework).select("project_id", F.col("source_path").alias("path"), F.col("local_name").alias("first"), "imported_name", "external_package", "edge_key").distinct()
    hit = evidence.withColumn("first", F.get("reference", F.lit(0))).join(own, ["project_id", "path", "first"])
    return hit.withColumn("bound_name", F.when(F.col("imported_name").isin("*", "default") & (F.size("reference") > 1), F.get("reference", F.lit(1))).otherwise(F.col("imported_name"))).drop("first")


def link_relationships(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with their entities' ids: a source must exist, a target may be missing."""
    ids = entities.select("project_id", "identity_key", "id")
    source = ids.select("project_id", F.col("identity_key").alias("source_key"), F.col("id").alias("source_id"))
    target = ids.select("project_id", F.col("identity_key").alias("target_key"), F.col("id").alias("target_id"))
    return relationships.join(source, ["project_id", "source_key"]).join(target, ["project_id", "target_key"], "left")


def framework_catalog(entities: DataFrame, relationships: DataFrame, scopes: DataFrame, framework: str | None = None, kind: str | None = None, path: str | None = None, root: str | None = None, max_entities: int = 100, max_relationships: int = 200) -> dict[str, DataFrame]:
    """One page of each project's facts: its first entities that pass the filters, their relationships, and the scopes they lie in.

    ``entities(project_id, id, root_path, framework, path, start_byte, entity_kind)``,
    ``relationships(project_id, id, source_id, target_id, relationship_kind)``,
    ``scopes(project_id, root_path, framework)``. Both ends of a relationship must be
    on the page, unless its target is unknown. Each list has ``more``, true where the
    limit left rows out.
    """
    wanted = entities
    for column, value in (("framework", framework), ("entity_kind", kind), ("path", path), ("root_path", root)):
        if value is not None:
            wanted = wanted.where(F.col(column) == value)
    place = [F.col("root_path"), F.col("framework"), F.col("path"), F.coalesce("start_byte", F.lit(-1)), F.col("entity_kind"), F.col("id")]
    page = _first_rows(wanted, place, max_entities)
    ids = page.select("project_id", "id")
    own = relationships.join(ids.withColumnRenamed("id", "source_id"), ["project_id", "source_id"], "left_semi")
    both = own.join(ids.withColumnRenamed("id", "target_id").withColumn("there", F.lit(True)), ["project_id", "target_id"], "left").where("target_id IS NULL OR there").drop("there")
    links = _first_rows(both, [F.col("source_id"), F.col("relationship_kind"), F.col("id")], max_relationships)
    return {"entities": page, "relationships": links, "scopes": scopes.join(page.select("project_id", "root_path", "framework"), ["project_id", "root_path", "framework"], "left_semi")}


def _first_rows(rows: DataFrame, order: list, limit: int) -> DataFrame:
    own = Window.partitionBy("project_id").orderBy(*order)
    numbered = rows.withColumn("place", F.row_number().over(own)).where(F.col("place") <= limit + 1)
    more = F.max(F.col("place") > limit).over(Window.partitionBy("project_id"))
    return numbered.withColumn("more", more).where(F.col("place") <= limit)


#: The stable order of each kind of result, by columns of the facts; null text counts as empty and a null offset as -1.
ORDERS = {
    "edges": ["source_path", "start_byte", "id"],
    "entities": ["start_byte", "entity_kind", "identity_key"],
    "relationships": ["source_key", "relationship_kind", "target", "identity_key"],
    "omissions": ["reason", "evidence_key"],
}


def canonical_order(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` of a kind of ``ORDERS``, project by project, in its stable order."""
    by = [F.coalesce(F.col(c), F.lit(-1) if c == "start_byte" else F.lit("")) for c in ORDERS[kind] if c != "target"]
    if kind == "relationships":
        by.insert(2, F.coalesce("target_key", "target_name", F.lit("")))
    return rows.orderBy("project_id", *by)
