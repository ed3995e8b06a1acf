"""Budgets over ordered rows as windows: sticky, saturating, per group; occurrence numbers and pages.

Windows carry keys and sizes, never contents, and are partitioned by project.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.tables import materialize


def running_totals(rows: DataFrame, order: str | list[str], **counted: Column) -> DataFrame:
    """Adds each project's running sum of ``counted`` by the columns of ``order``, in two levels, so that no task holds a whole project.

    Rows are dealt into ranges of (project, order) and written once; sums of the ranges
    before go onto the sums within a range.
    """
    order = [order] if isinstance(order, str) else order
    ranged = rows.repartitionByRange("project_id", *order).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged.withColumns(counted), "ranged")
    before = Window.partitionBy("project_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("project_id", "range").agg(*(F.sum(c).alias(c) for c in counted))
    sums = sums.select("project_id", "range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in counted))
    within = Window.partitionBy("project_id", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(sums, ["project_id", "range"])
    return joined.withColumns({c: F.sum(c).over(within) + F.col(f"{c}_before") for c in counted}).drop("range", *(f"{c}_before" for c in counted))


def byte_budget(files: DataFrame, max_total: int) -> DataFrame:
    """Sticky: from the first ready file in path order that would pass ``max_total`` on, every file is ``run_limit``.

    Sizes are never negative, so a total beyond the limit stays beyond it.
    """
    cut = running_totals(files, "path", total=F.when(F.col("status") == "ready", F.coalesce("size_bytes", F.lit(0))).otherwise(0)).withColumn("over", F.col("total") > max_total)
    return cut.withColumn("skip_reason", F.when(F.col("over"), "run_limit").otherwise(F.col("skip_reason"))).withColumn("status", F.when(F.col("over"), "skipped").otherwise(F.col("status"))).select(files.columns)


def depth_first_key(path: str = "path") -> Column:
    """Orders a directory's files before its sub-directories, each by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda s, i: F.concat(F.when(i == F.size(parts) - 1, F.lit("0")).otherwise(F.lit("1")), s))


def inventory_budget(files: DataFrame, max_files: int, max_bytes: int, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """The files that a depth-first walk takes before its limits, and the reasons met by project."""
    deep = F.size(F.split("path", "/")) - 1 > max_depth
    shallow = files.where(~deep).withColumn("walk", depth_first_key())
    run = running_totals(shallow, "walk", n=F.lit(1), bytes=F.coalesce("size_bytes", F.lit(0)))
    run = run.withColumn("cut", F.when(F.col("n") > max_files, 2).when(F.col("bytes") > max_bytes, 1).otherwise(0))
    met = run.where("cut > 0").select("project_id", F.when(F.col("n") > max_files, "file_limit").otherwise("byte_limit").alias("reason"), "n")
    first = met.groupBy("project_id").agg(F.min_by("reason", "n").alias("reason"))
    reasons = first.union(files.where(deep).select("project_id", F.lit("depth_limit").alias("reason"))).groupBy("project_id").agg(F.array_sort(F.collect_set("reason")).alias("limit_reasons"))
    return run.where("cut = 0").select(files.columns), reasons


def saturating_budget(df: DataFrame, order: list[str], max_total: int) -> tuple[DataFrame, DataFrame]:
    """The first ``max_total`` rows of each project by ``order``, and per project how many there are and whether it is ``limited``.

    Places are sums in two levels, so no task ranks a whole project.
    """
    placed = running_totals(df, order, place=F.lit(1))
    sizes = df.groupBy("project_id").agg(F.count("*").alias("n"))
    status = sizes.select("project_id", F.least("n", F.lit(max_total)).alias("kept"), F.greatest(F.col("n") - max_total, F.lit(0)).alias("omitted"), F.when(F.col("n") > max_total, "limited").otherwise("completed").alias("status"))
    return placed.where(F.col("place") <= max_total).select(df.columns), status


def _taken(sums: np.ndarray, edges: int, bindings: int) -> int:
    """How many edges a file keeps when so many edges and bindings are left; ``sums`` are its running bindings."""
    return 0 if edges <= 0 or bindings <= 0 else min(edges, int(np.searchsorted(sums, bindings, "right")))


def recovering_budget(edges: DataFrame, max_edges: int, max_bindings: int, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges of each project within both totals: a file is cut at its first edge that does not fit, the next file goes on with what is left.

    ``edges(project_id, source_path, n_bindings, ...)``; files go by path, edges of a file
    by ``order`` (start_byte, edge_key). A file for which no edge or no binding is left
    keeps nothing. Returns the kept edges, and per file its path, n_edges, kept_edges,
    n_bindings, kept_bindings and reason: null, ``total_edges`` or ``total_bindings``.

    Sums in two levels give the first file of each project that does not fit; all before
    it are whole. What is left after its cut is less than the bindings of one edge and
    never grows, so a later file whose first edge has more keeps nothing and is not gone
    through. Each range of paths of the others becomes a small table, from the bindings
    left before it to those after it and the edges that it takes. The tables are chained
    per project, then every range is gone through from its true start until nothing is
    left. A project is many tasks, and a task holds the files of a range, or one array of
    that small size a range. Edges that are alike in ``order`` go by their bindings.
    """
    by = order or ["start_byte", "edge_key"]
    file = ["project_id", "source_path"]
    within = Window.partitionBy(*file).orderBy(*by, "n_bindings")
    placed = edges.withColumn("place", F.row_number().over(within)).withColumn("sum", F.sum("n_bindings").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    sums = F.transform(F.array_sort(F.collect_list(F.struct("place", "sum"))), lambda x: x["sum"].cast("long"))
    files = placed.groupBy(*file).agg(F.count("*").alias("n"), F.max("sum").alias("b"), sums.alias("sums"))
    files = materialize(files, "files")
    total = materialize(running_totals(files, "source_path", all_n=F.col("n"), all_b=F.col("b")), "totals")
    spent = (F.col("all_n") - F.col("n") >= max_edges) | (F.col("all_b") - F.col("b") >= max_bindings)  # nothing is left for the file
    over = spent | (F.col("all_n") > max_edges) | (F.col("all_b") > max_bindings)
    first = total.where(over).groupBy("project_id").agg(F.min_by(F.struct("source_path", "n", "b", "all_n", "all_b", "sums"), "source_path").alias("f"))
    left_e, left_b = F.lit(max_edges) - (F.col("f.all_n") - F.col("f.n")), F.lit(max_bindings) - (F.col("f.all_b") - F.col("f.b"))
    fits = F.size(F.filter("f.sums", lambda x: x <= left_b))
    took = F.when((left_e > 0) & (left_b > 0), F.least(left_e, fits)).otherwise(0)
    cut = first.select("project_id", F.col("f.source_path").alias("cut_path"), took.cast("long").alias("cut_k"), (left_e - took).alias("e"), (left_b - F.when(took > 0, F.element_at("f.sums", took.cast("int"))).otherwise(0)).alias("r"), left_e.alias("e_in"))
    cut = materialize(cut, "cuts")
    open_ = cut.where("e > 0 AND r > 0")
    tail = total.join(open_, "project_id").where("source_path > cut_path AND sums[0] <= r").select("project_id", "source_path", "sums", "e", "r")
    tail = materialize(tail.repartitionByRange("project_id", "source_path").withColumn("part", F.spark_partition_id()), "tail")

    def table(rows: pa.Table) -> pa.Table:
        most, most_edges = rows["r"][0].as_py(), rows["e"][0].as_py()
        left, count = np.arange(most + 1), np.zeros(most + 1, np.int64)
        for sums in (np.array(x.as_py()) for x in rows.sort_by("source_path")["sums"]):
            k = np.where(left > 0, np.searchsorted(sums, left, "right"), 0)
            count += k
            left = left - np.concatenate([[0], sums])[k]
            if ((left <= 0) | (count >= most_edges)).all():  # nothing is left, whatever was before
                break
        return pa.table({"project_id": rows["project_id"][:1], "part": rows["part"][:1].cast(pa.int32()), "left": pa.array([left]), "count": pa.array([count]), "e": rows["e"][:1].cast(pa.int64()), "r": rows["r"][:1].cast(pa.int64())})

    def chain(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        e, r, out = rows["e"][0].as_py(), max(0, rows["r"][0].as_py()), []
        for left, count in zip(rows["left"], rows["count"], strict=True):
            out.append((e, r))
            took = count[r].as_py()
            e, r = max(0, e - took), left[r].as_py()
        return pa.table({"project_id": rows["project_id"], "part": rows["part"], "e": pa.array([x[0] for x in out], pa.int64()), "r": pa.array([x[1] for x in out], pa.int64())})

    def walk(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("source_path")
        e, r, out = rows["e"][0].as_py(), rows["r"][0].as_py(), []
        for x in rows["sums"]:
            if e <= 0 or r <= 0:
                break
            sums = np.array(x.as_py())
            k = _taken(sums, e, r)
            out.append((k, e))
            e, r = e - k, r - (int(sums[k - 1]) if k else 0)
        gone = rows.slice(0, len(out))
        return pa.table({"project_id": gone["project_id"], "source_path": gone["source_path"], **{c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("k", "e_in"))}})

    ranges = tail.groupBy("project_id", "part").applyInArrow(table, "project_id string, part int, left array<long>, count array<long>, e long, r long")
    starts = ranges.groupBy("project_id").applyInArrow(chain, "project_id string, part int, e long, r long")
    later = tail.drop("e", "r").join(starts, ["project_id", "part"]).groupBy("project_id", "part").applyInArrow(walk, "project_id string, source_path string, k long, e_in long")
    later = materialize(later.unionByName(cut.select("project_id", F.col("cut_path").alias("source_path"), F.col("cut_k").alias("k"), F.col("e_in").cast("long"))), "later")
    spent = later.where("e_in <= k").groupBy("project_id").agg(F.min("source_path").alias("spent_path"))  # no edge is left for the files after it
    ends = cut.select("project_id", "cut_path").join(spent, "project_id", "left")
    found = total.drop("all_n", "all_b").join(ends, "project_id", "left").join(later, file, "left")
    found = found.withColumn("kept_edges", F.coalesce("k", F.when(F.col("source_path") > F.col("cut_path"), 0).otherwise(F.col("n"))))
    found = found.withColumn("e_in", F.coalesce("e_in", F.when(F.col("source_path") > F.col("spent_path"), 0).otherwise(1)))  # only whether any is left counts
    kept_b = F.when(F.col("kept_edges") > 0, F.element_at("sums", F.col("kept_edges").cast("int"))).otherwise(0)
    reason = F.when(F.col("kept_edges") < F.col("n"), F.when(F.col("kept_edges") >= F.col("e_in"), "total_edges").otherwise("total_bindings"))
    found = materialize(found.select(*file, F.col("n").alias("n_edges"), "kept_edges", F.col("b").alias("n_bindings"), kept_b.alias("kept_bindings"), reason.alias("reason")), "budget")
    kept = placed.join(found.select(*file, "kept_edges"), file).where("place <= kept_edges").select(edges.columns)
    return kept, found


def per_group_limit(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most ``n`` rows a group, with the count of those left out on each."""
    w = Window.partitionBy(*keys)
    return df.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("omitted", F.greatest(F.count("*").over(w) - n, F.lit(0))).where(F.col("place") <= n).drop("place")


def occurrence_number(df: DataFrame, keys: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """How many rows of the same keys come before."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def limit_plus_one(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group, and on each whether there are more; only n + 1 rows a group are ranked."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n + 1)
    return ranked.withColumn("truncated", F.max("place").over(Window.partitionBy(*keys)) > n).where(F.col("place") <= n)


def paged(df: DataFrame, order: list[str], limit: int, after: tuple | None = None) -> DataFrame:
    """The first ``limit`` rows by the columns of ``order`` after the row whose values are ``after``, and on each whether more follow.

    The order must be that of a key, ascending, without nulls. The place to go on from is
    a filter on its columns, of which the first reaches the scan, so rows of earlier pages
    are neither sorted nor, where files are ordered, read. Only limit + 1 rows are ranked.
    """
    if after is not None:
        ahead, same = F.lit(False), F.lit(True)
        for column, value in zip(order, after, strict=True):
            ahead, same = ahead | (same & (F.col(column) > F.lit(value))), same & (F.col(column) == F.lit(value))
        df = df.where(F.col(order[0]) >= F.lit(after[0])).where(ahead)
    rows = df.orderBy(*order).limit(limit + 1)
    ranked = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return ranked.withColumn("has_more", F.max("place").over(Window.partitionBy()) > limit).where(F.col("place") <= limit).drop("place")


def outermost_ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of nested or disjoint ranges the outer ones: each that starts at or after the end of all before it."""
    before = Window.partitionBy(*keys).orderBy("start_byte", F.desc("end_byte"), "identity_key").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("covered", F.coalesce(F.max("end_byte").over(before), F.lit(0))).where("start_byte >= covered").drop("covered")


def cover_gaps(kept: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """``kept`` with ownerless ranges for the stretches of each file between and after its ranges."""
    ends = Window.partitionBy(*keys).orderBy("start_byte")
    spans = kept.select(*keys, "start_byte", "end_byte", "identity_key")
    before = spans.select(*keys, F.lag("end_byte", 1, 0).over(ends).alias("start_byte"), F.col("start_byte").alias("end_byte"))
    last = spans.groupBy(*keys).agg(F.max("end_byte").alias("start_byte"))
    after = sizes.join(last, keys, "left").select(*keys, F.coalesce("start_byte", F.lit(0)).alias("start_byte"), F.col("size_bytes").alias("end_byte"))
    gaps = before.unionByName(after).where("start_byte < end_byte").withColumn("identity_key", F.lit(None).cast("string"))
    return spans.unionByName(gaps)
