"""Hard negatives by Fagin's threshold algorithm over blocks of anchors and parts of the rows.

Each part of the rows keeps one list a dimension, sorted by that component. An anchor
reads the lists of its non-zero components from the end that its sign asks for, side by
side and ever deeper; each row that turns up is scored by random access to its whole
vector. The inner product of the anchor with the components at the depth reached bounds
every row that has not turned up yet, so reading stops once that bound falls strictly
below the k-th score of each window, or below the window. The parts' answers are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import materialize

#: Every whole number up to here is a double of its own, so sums and products below are exact in doubles.
EXACT = 2**53
LONG = 2**63 - 1


def whole(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """floor(256 x) of each component, a row a vector, in doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.floor(256 * np.asarray(flat.flatten(), np.float64)).reshape(len(flat), dim)


class Lists:
    """Rows with their sorted lists, one a dimension."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids, self.n = x, ids, len(x)
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(np.ascontiguousarray(x.T), self.order, 1)

    def best(self, anchor: np.ndarray, windows: list[tuple], k: int, allowed: np.ndarray, step: int = 32) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each window (low, high) the rows and scores of its first ``k`` rows by score, then id, and the depth read.

        ``low`` None stands for no lower end. ``allowed`` marks the rows that may be taken.
        """
        up, down = np.nonzero(anchor > 0)[0], np.nonzero(anchor < 0)[0]
        found = [(np.zeros(0, np.int64), self.x[:0, 0] if self.x.shape[1] else np.zeros(0)) for _ in windows]
        seen, depth = ~allowed, 0
        while True:
            stop = min(self.n, depth + step)
            if len(up) or len(down):
                fresh = np.zeros(self.n, bool)
                fresh[self.order[up, self.n - stop : self.n - depth]] = True
                fresh[self.order[down, depth:stop]] = True
                rows = np.nonzero(fresh & ~seen)[0]
            else:  # every score is 0
                stop, rows = self.n, np.nonzero(~seen)[0]
            seen[rows] = True
            scores = self.x[rows] @ anchor
            for w, (low, high) in enumerate(windows):
                inside = np.ones(len(rows), bool) if low is None else (scores >= low) & (scores <= high)
                if inside.any():
                    r, s = np.concatenate([found[w][0], rows[inside]]), np.concatenate([found[w][1], scores[inside]])
                    if len(s) > 4 * k and s.dtype != object:  # drop what is below the k-th score before sorting
                        keep = s >= -np.partition(-s, k - 1)[k - 1]
                        r, s = r[keep], s[keep]
                    first = np.lexsort((self.ids[r], -s))[:k]
                    found[w] = r[first], s[first]
            depth, step = stop, 2 * step
            if depth == self.n:
                return found, depth
            bound = anchor[up] @ self.sorted[up, self.n - depth] + anchor[down] @ self.sorted[down, depth - 1]
            ends = [s[k - 1] if len(s) == k else low for (_, s), (low, _) in zip(found, windows, strict=True)]
            if all(end is not None and bound < end for end in ends):
                return found, depth


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks(), np.int64)


def _exact(x: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As doubles while every score and its multiples are exact, else as Python's integers."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * max(1, x.shape[1])
    if most < EXACT:
        return x, anchors
    return (np.array([[int(v) for v in row] for row in y.tolist()], object).reshape(y.shape) for y in (x, anchors))


def _rows(columns: dict[str, list]) -> pa.Table:
    return pa.table({name: pa.array([max(-LONG - 1, min(LONG, int(v))) for v in values], pa.int64()) for name, values in columns.items()})


def _positives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows of each anchor's own label in one part: a list a dimension and label."""
    dim = len(anchors.column("embedding")[0]) if anchors.num_rows else 0
    out = {"anchor": [], "vec_id": [], "score": []}
    if not anchors.num_rows or not rows.num_rows:
        return _rows(out)
    x, a = _exact(whole(rows.column("embedding"), dim), whole(anchors.column("embedding"), dim))
    ids, own, labels = _numbers(rows, "vec_id"), _numbers(rows, "row"), _numbers(rows, "label")
    mine, wanted = _numbers(anchors, "row"), _numbers(anchors, "label")
    for label in np.unique(wanted).tolist():
        members = np.nonzero(labels == label)[0]
        if not len(members):
            continue
        lists = Lists(x[members], ids[members])
        for i in np.nonzero(wanted == label)[0].tolist():
            found, scores = lists.best(a[i], [(None, None)], k, own[members] != mine[i])[0][0]
            out["anchor"] += [mine[i]] * len(found)
            out["vec_id"] += lists.ids[found].tolist()
            out["score"] += scores.tolist()
    return _rows(out)


def _negatives(anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """The first ``k`` rows of other labels in each window of each anchor, in one part."""
    dim = len(anchors.column("embedding")[0]) if anchors.num_rows else 0
    out = {"anchor": [], "place": [], "vec_id": [], "score": []}
    if not anchors.num_rows or not rows.num_rows:
        return _rows(out)
    x, a = _exact(whole(rows.column("embedding"), dim), whole(anchors.column("embedding"), dim))
    lists, labels = Lists(x, _numbers(rows, "vec_id")), _numbers(rows, "label")
    mine, wanted, positives = _numbers(anchors, "row"), _numbers(anchors, "label"), anchors.column("scores").to_pylist()
    for i in range(len(mine)):
        windows = [(-(-low * p // 100), high * p // 100) for p in positives[i]]
        found = lists.best(a[i], windows, k, labels != wanted[i])[0]
        for place, (members, scores) in enumerate(found, 1):
            out["anchor"] += [mine[i]] * len(members)
            out["place"] += [place] * len(members)
            out["vec_id"] += lists.ids[members].tolist()
            out["score"] += scores.tolist()
    return _rows(out)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, part_cells: int = 1 << 19, block_cells: int = 1 << 17) -> DataFrame:
    """Hard negatives of the rows of ``vectors(vec_id, embedding, label)`` that ``anchor`` holds for.

    A row's score is its inner product with the anchor over floor(256 x) of the
    components, exact. An anchor's positives are its first ``positives`` other rows of
    its label; for each, the first ``negatives`` rows of other labels are returned whose
    score is between ``low`` and ``high`` hundredths of the positive's, ends included.
    Higher scores come first, then smaller vec_ids. Columns: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score.

    Anchors are dealt into blocks, rows into parts, by a hash of their row, so that no
    label or copy is a key; each block meets each part in a task of its own, which holds
    ``part_cells`` and ``block_cells`` components (about thirty bytes each). Only the
    parts' first rows are shuffled on.

    Rows with a null vec_id, a null label, a null vector or a null or non-finite
    component (256 times it, too) take no part. Vectors of different lengths do not meet.
    Rows that repeat a vec_id are rows of their own: each is an anchor and a candidate.
    An anchor without another row of its label gives no rows, as does an empty table.
    Other columns are not read. Scores beyond a long are cut to its ends.
    """
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * 256) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", F.coalesce(anchor, F.lit(False)).alias("anchor")).where(fine)
    rows = materialize(rows.select("*", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("row")), "vectors")
    cells = F.greatest("dim", F.lit(1)).cast("long")
    sizes = rows.agg(F.sum(cells).alias("all"), F.sum(F.when(F.col("anchor"), cells)).alias("anchors")).first()
    parts, blocks = (max(1, -(-(n or 0) // most)) for n, most in ((sizes["all"], part_cells), (sizes["anchors"], block_cells)))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    chosen = rows.where("anchor").drop("anchor")
    keys = ["dim", "block", "part"]

    def met(asking: DataFrame, work, schema: str) -> DataFrame:
        asking = asking.select(*(F.col(c).alias(c) for c in asking.columns), dealt(blocks).alias("block"), each(parts).alias("part"))
        asked = rows.drop("anchor").select("*", dealt(parts).alias("part"), each(blocks).alias("block"))
        return asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(work, schema)

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    found = met(chosen, lambda a, r: _positives(a, r, positives), "anchor long, vec_id long, score long")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    found = materialize(found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found")), "positives")
    asking = chosen.join(found.select(F.col("anchor").alias("row"), F.col("found.score").alias("scores")), "row")
    taken = met(asking, lambda a, r: _negatives(a, r, negatives, low, high), "anchor long, place long, vec_id long, score long")
    nearest = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    taken = taken.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= negatives)
    names = chosen.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    own = found.join(names, "anchor").select("anchor", "anchor_id", F.inline("found").alias("place", "positive_id", "positive_score"))
    taken = taken.select("anchor", F.col("place").cast("int").alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return own.join(taken, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_threshold_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.e) = len(b.e)
), positives AS (
    SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id)::INT AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.a = n.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
