"""Snapshots: runs and freshness, differences, reuse, reports and data-quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_run(runs: DataFrame) -> DataFrame:
    """The newest completed or limited run of each project and stage."""
    order = Window.partitionBy("project_id", "stage").orderBy(F.desc("completed_at"), F.desc("run_id"))
    return runs.where(F.col("status").isin("completed", "limited")).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of each project and stage whatever its status."""
    order = Window.partitionBy("project_id", "stage").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def stage_freshness(runs: DataFrame, links: dict[str, list[str]]) -> DataFrame:
    """(project_id, stage, fresh, reason): ``runs.upstream`` maps a stage to the run that was read.

    A stage is stale if it has no current run, if one is running, or if a link's recorded
    run is not the current one.
    """
    now = current_run(runs)
    running = latest_run(runs).where("status = 'running'").select("project_id", "stage", F.lit(True).alias("running"))
    stages = list(links)
    rows = runs.select("project_id").distinct().withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    rows = rows.join(now.select("project_id", "stage", "run_id", "upstream"), ["project_id", "stage"], "left").join(running, ["project_id", "stage"], "left")
    ids = now.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "run_id"))).alias("current"))
    rows = rows.join(ids, "project_id", "left")
    broken = F.lit(False)
    for stage, ups in links.items():
        for up in ups:
            differs = ~F.coalesce(F.try_element_at("upstream", F.lit(up)).eqNullSafe(F.try_element_at("current", F.lit(up))), F.lit(False))
            broken = broken | ((F.col("stage") == stage) & differs)
    reason = F.when(F.col("run_id").isNull(), "missing").when(F.coalesce("running", F.lit(False)), "running").when(broken, "stale")
    return rows.select("project_id", "stage", reason.isNull().alias("fresh"), reason.alias("reason"))


def catalog_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with change added, removed, changed or unchanged."""
    a, b = old.select(*keys, F.col(value).alias("old")).withColumn("was", F.lit(True)), new.select(*keys, F.col(value).alias("new")).withColumn("is", F.lit(True))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def reuse_split(current: DataFrame, previous: DataFrame, keys: list[str], reusable: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose composite key was handled before with a reusable status, and the rest."""
    done = previous.where(F.col("status").isin(*reusable)).select(*keys)
    return current.join(done, keys, "left_semi"), current.join(done, keys, "left_anti")


def sweep_stale(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the old catalog that the new run does not have."""
    return old.join(new.select(*keys), keys, "left_anti")


def inventory_summary(files: DataFrame, skipped: DataFrame | None = None, reasons: DataFrame | None = None) -> DataFrame:
    """Files and bytes by project; ``ignored_paths`` and ``skipped_links`` from ``skipped(project_id, path, kind)`` of kinds ignored and link, ``limit_reasons`` from ``reasons``.

    A project of any of the three tables has a row.
    """
    own = files.groupBy("project_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    if skipped is not None:
        left = skipped.groupBy("project_id").agg(F.count_if(F.col("kind") == "ignored").alias("ignored_paths"), F.count_if(F.col("kind") == "link").alias("skipped_links"))
        own = own.join(left, "project_id", "full_outer")
    else:
        own = own.withColumn("ignored_paths", F.lit(0).cast("long")).withColumn("skipped_links", F.lit(0).cast("long"))
    own = own.join(reasons, "project_id", "full_outer") if reasons is not None else own.withColumn("limit_reasons", F.array().cast("array<string>"))
    return own.na.fill(0).withColumn("limit_reasons", F.coalesce("limit_reasons", F.array().cast("array<string>")))


def source_summary(files: DataFrame) -> DataFrame:
    """Ready and skipped counts and bytes by project."""
    ready = F.col("status") == "ready"
    return files.groupBy("project_id").agg(F.count_if(ready).alias("ready_files"), F.count_if(~ready).alias("skipped_files"), F.sum("size_bytes").alias("inspected_bytes"), F.coalesce(F.sum(F.when(ready, F.col("size_bytes"))), F.lit(0)).alias("ready_bytes"))


def symbol_summary(files: DataFrame) -> DataFrame:
    """Outcomes of symbol extraction by project."""
    return files.groupBy("project_id").agg(*(F.count_if(F.col("status") == s).alias(f"{s}_files") for s in ("parsed", "reused", "unsupported", "failed")), F.sum("symbols").alias("symbols"), F.sum("omitted").alias("omitted"))


def edge_summary(edges: DataFrame) -> DataFrame:
    """Edges and bindings by project, and edges by resolution."""
    kinds = ("local", "external", "builtin", "unresolved")
    return edges.groupBy("project_id").agg(F.count("*").alias("edges"), F.sum(F.size("bindings")).alias("bindings"), *(F.count_if(F.col("resolution_kind") == k).alias(k) for k in kinds))


def framework_summary(entities: DataFrame, relationships: DataFrame, omissions: DataFrame | None = None) -> DataFrame:
    """Entities, relationships, those without a known target or certainty, and omissions by project."""
    a = entities.groupBy("project_id").agg(F.count("*").alias("entities"))
    b = relationships.groupBy("project_id").agg(F.count("*").alias("relationships"), F.count_if((F.col("certainty") == "unresolved") | F.col("target_key").isNull()).alias("unresolved"))
    out = a.join(b, "project_id", "full_outer")
    if omissions is None:
        return out.withColumn("omissions", F.lit(0).cast("long")).na.fill(0)
    return out.join(omissions.groupBy("project_id").agg(F.count("*").alias("omissions")), "project_id", "full_outer").na.fill(0)


def embedding_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("project_id").agg(F.count_distinct("path").alias("files"), F.count("*").alias("chunks"), F.count_if(~F.col("reused")).alias("embedded"), F.count_if("reused").alias("reused"))


def limit_reasons(stages: DataFrame) -> DataFrame:
    """Distinct reasons of all stages of a project."""
    return stages.select("project_id", F.explode("limit_reasons").alias("r")).groupBy("project_id").agg(F.array_sort(F.collect_set("r")).alias("limit_reasons"))


def omission_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows were left out for each reason, as a map."""
    counts = df.groupBy(*keys, "reason").count()
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("omissions"))


def context_hash(rows: DataFrame, parts: list[str]) -> DataFrame:
    """By project, a hash over its rows that is the same for any order and partitioning, and differs if a row or its number does.

    A tree over the rows' hashes by their first hexadecimal digits: six, three, none. Each
    node hashes its sorted children, so no array holds a project: a node of the lower level
    has a 16-millionth of the rows, one of the others at most 4,096 children.
    """
    leaf = F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts)), 256)
    level = rows.select("project_id", leaf.alias("h")).groupBy("project_id", "h").agg(F.count("*").alias("n"))
    level = level.select("project_id", F.substring("h", 1, 6).alias("prefix"), F.concat_ws(":", "h", "n").alias("h"))
    for digits in (3, 0):
        node = F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)
        level = level.groupBy("project_id", "prefix").agg(node.alias("h")).select("project_id", F.substring("prefix", 1, digits).alias("prefix"), F.concat_ws(":", "prefix", "h").alias("h"))
    return level.groupBy("project_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("context_hash"))


def corpus_counts(symbols: DataFrame, edges: DataFrame, entities: DataFrame, chunks: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row a project with the number of its symbols, edges, entities and chunks, and its limited stages in order from ``runs(project_id, stage, place, status)``."""
    named = {"symbols": symbols, "edges": edges, "entities": entities, "chunks": chunks}
    every = None
    for name, df in named.items():
        part = df.groupBy("project_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(name))
        every = part if every is None else every.unionByName(part)
    out = every.groupBy("project_id").agg(*(F.coalesce(F.sum(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).alias(n) for n in named))
    if runs is None:
        return out.withColumn("limited_stages", F.array().cast("array<string>"))
    stages = F.transform(F.array_sort(F.collect_set(F.when(F.col("status") == "limited", F.struct("place", "stage")))), lambda x: x["stage"])
    return out.join(runs.groupBy("project_id").agg(stages.alias("limited_stages")), "project_id", "full_outer").na.fill(0)


def catalog_violations(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(rule, key columns) for each rule that does not hold on a row, and duplicate_key for repeated keys."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items())))
    rows = df.select(F.explode(broken).alias("rule"), *keys)
    again = df.groupBy(*keys).count().where("count > 1").select(F.lit("duplicate_key").alias("rule"), *keys)
    return rows.unionByName(again)
