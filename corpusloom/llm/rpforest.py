"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits the vectors at the median of a random direction, again and again; a
vector near a split goes to both sides. Vectors are compared within leaves only, all
pairs of a leaf in double precision. A pair that meets in several leaves is counted in
the one with the smallest number, so no table of pairs is ever made: each leaf returns,
for each vector, how many links it owns and one edge to a linked vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import connected_components, materialize


#: Leaves of vectors of unusual length are numbered from here on.
OTHER = 1 << 40


class Tree:
    """Splits as (direction, threshold, left, right); a negative child is leaf -1 - child."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, margin: float, rng: np.random.Generator):
        self.splits: list[tuple[np.ndarray, float, int, int]] = []
        self.leaves, self.margin = 0, margin
        self.root = self._grow(sample, leaf_rows, rng)

    def _grow(self, x: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> int:
        if len(x) > leaf_rows:
            direction = rng.normal(size=x.shape[1])
            direction /= np.linalg.norm(direction)
            at = x @ direction
            threshold = float(np.median(at))
            left, right = x[at <= threshold], x[at > threshold]
            if len(left) and len(right):
                number = len(self.splits)
                self.splits.append((direction, threshold, 0, 0))
                a = self._grow(left, leaf_rows, rng)
                b = self._grow(right, leaf_rows, rng)
                self.splits[number] = (direction, threshold, a, b)
                return number
        self.leaves += 1
        return -self.leaves

    def route(self, x: np.ndarray, first: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf number, rows) with numbers from ``first`` on."""
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield first - 1 - node, rows
                continue
            direction, threshold, a, b = self.splits[node]
            at = x[rows] @ direction
            todo += [(a, rows[at <= threshold + self.margin]), (b, rows[at > threshold - self.margin])]


def grow_forest(sample: np.ndarray, total: int, trees: int, leaf_rows: int, margin: float, seed: int) -> list[tuple[int, Tree]]:
    """Trees on a sample, split until a leaf should hold ``leaf_rows`` of all ``total`` rows (16 of the sample at least), each with its first leaf number."""
    rng, out, first = np.random.default_rng(seed), [], 0
    own = max(16, int(leaf_rows * len(sample) / max(1, total)))
    for _ in range(trees):
        out.append((first, Tree(sample, own, margin, rng)))
        first += out[-1][1].leaves
    return out


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of length one; each is divided by its largest component first, so that no square is too large or too small."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), dim)
    x = x / np.abs(x).max(1, initial=0)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _leaf_lists(forest: list, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, leaf) by row and leaf."""
    rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, tree in forest:
        for leaf, own in tree.route(x, first):
            rows.append(own)
            leaves.append(np.full(len(own), leaf))
    rows, leaves = np.concatenate(rows), np.concatenate(leaves)
    order = np.lexsort((leaves, rows))
    return rows[order], leaves[order]


def _dealt(forest: list, column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, leaf) by row and leaf; a vector of another length than ``dim`` is in one leaf, that of its length."""
    lengths = np.asarray(column.value_lengths(), np.int64)
    usual, other = np.nonzero(lengths == dim)[0], np.nonzero(lengths != dim)[0]
    rows, leaves = _leaf_lists(forest, unit(column.take(pa.array(usual)), dim))
    rows, leaves = np.concatenate([usual[rows], other]), np.concatenate([leaves, OTHER + lengths[other]])
    order = np.lexsort((leaves, rows))
    return rows[order], leaves[order]


def _owned(table: pa.Table, threshold: float) -> pa.Table:
    """Of one leaf, or one pair of its blocks: each vector's owned links, counted with copies, and the smallest vector that it reaches here."""
    leaf, low, high = (table.column(c)[0].as_py() for c in ("leaf", "low", "high"))
    table = table.combine_chunks()
    one = lambda c: table.column(c).combine_chunks() if isinstance(table.column(c), pa.ChunkedArray) else table.column(c)
    reps, copies, block = (np.asarray(one(c), np.int64) for c in ("rep", "copies", "block"))
    order = np.argsort(reps, kind="stable")
    x = unit(one("embedding"), len(one("embedding")[0]))[order]
    lists = one("leaves")
    sizes, flat = np.asarray(lists.value_lengths(), np.int64), np.asarray(lists.flatten(), np.int64)
    earlier = np.unique(flat[flat < leaf])
    marks = np.zeros((len(reps), len(earlier)), bool)
    row_of = np.repeat(np.arange(len(reps)), sizes)
    marks[row_of[flat < leaf], np.searchsorted(earlier, flat[flat < leaf])] = True
    marks = np.packbits(marks, axis=1)[order]
    reps, copies, block = reps[order], copies[order], block[order]
    links, root = np.zeros(len(reps), np.int64), np.arange(len(reps))
    found = []
    for at in range(0, len(reps), 256):
        i, j = np.nonzero(x[at : at + 256] @ x.T >= threshold)
        i = i + at
        keep = (i < j) if low == high else ((i < j) & (block[i] != block[j]))
        i, j = i[keep], j[keep]
        own = np.ones(len(i), bool)
        for k in range(0, len(i), 65536):
            own[k : k + 65536] = ~(marks[i[k : k + 65536]] & marks[j[k : k + 65536]]).any(1)
        found.append((i[own], j[own]))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    while True:
        before = root.copy()
        np.minimum.at(root, j, root[i])
        np.minimum.at(root, i, root[j])
        root = root[root]
        if (before == root).all():
            break
    some = links > 0
    return pa.table({"rep": pa.array(reps[some]), "links": pa.array(links[some]), "root": pa.array(reps[root[some]])})


def near_vectors(vectors: DataFrame, threshold: float = 0.95, trees: int = 8, leaf_rows: int = 1024, max_leaf: int = 4096, spill: float = 0.6, sample_rows: int = 16384, seed: int = 11) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> vec_id, n_links, component_id, kept.

    Two vectors are linked if a leaf holds both and their cosine is at least
    ``threshold``. ``spill`` times the usual projected distance of such a pair is the
    margin within which a vector goes to both sides of a split; with the default eight
    trees a pair at the threshold is missed about once in a million. Trees are grown on
    ``sample_rows`` vectors, the smallest by a hash of vec_id, so that a tree has
    sample_rows / 16 leaves at most; leaves above ``max_leaf`` rows are compared in
    pairs of blocks. Equal vectors are one class, compared once and counted in full.

    Vectors that are null, zero, or hold null or non-finite components link with nothing,
    as do rows without a vec_id. Vectors of different lengths do not link; those of
    another length than most form one leaf a length, compared whole in blocks. Rows that
    repeat a vec_id count as that many vectors, each with the links of its own values.
    Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    fine = F.col("vec_id").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", "embedding", F.coalesce(fine, F.lit(False)).alias("fine"), F.xxhash64("embedding").alias("m1"), F.xxhash64(F.lit(7), "embedding").alias("m2"))
    good = rows.where("fine")
    usual = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = usual["dim"] if usual else 1
    classes = good.groupBy("m1", "m2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    sample = classes.where(F.size("embedding") == dim).orderBy("m1", "m2").limit(sample_rows).select("embedding").toArrow()
    margin = spill * float(np.sqrt(2 * (1 - threshold) / dim))
    known = unit(sample["embedding"].combine_chunks(), dim) if sample.num_rows else np.zeros((0, dim))
    forest = spark.sparkContext.broadcast(grow_forest(known, total, trees, leaf_rows, margin, seed))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, n = np.unique(_dealt(forest.value, batch.column(0), dim)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(n)], ["leaf", "n"])

    sizes = classes.select("embedding").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).where(F.col("n") > max_leaf)
    blocks = {r.leaf: -(-2 * r.n // max_leaf) for r in sizes.collect()}  # at most a row a leaf or length of more than max_leaf vectors

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows, leaves = _dealt(forest.value, batch.column(2), dim)
                n = np.array([blocks.get(leaf, 1) for leaf in leaves.tolist()], np.int64)
                draw = (np.asarray(batch.column(0), np.int64)[rows] * 0x9E3779B1 >> 8) % n
                cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(leaves))
                again = np.repeat(np.arange(len(rows)), n)
                other = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                low, high, take = np.minimum(draw[again], other), np.maximum(draw[again], other), pa.array(rows[again])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves[again]), pa.array(low), pa.array(high), pa.array(draw[again]), *(c.take(take) for c in batch.columns), lists.take(take)],
                    ["leaf", "low", "high", "block", "rep", "copies", "embedding", "leaves"],
                )

    kind = dict(vectors.dtypes)["embedding"]
    dealt = classes.select("rep", "copies", "embedding").mapInArrow(deal, f"leaf long, low long, high long, block long, rep long, copies long, embedding {kind}, leaves array<long>")
    owned = dealt.groupBy("leaf", "low", "high").applyInArrow(lambda table: _owned(table, threshold), "rep long, links long, root long")
    owned = materialize(owned, "owned")
    links = owned.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(owned.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    components = classes.select("rep", "least").join(components.withColumnRenamed("id", "rep"), "rep")
    least = components.groupBy("component").agg(F.min("least").alias("first"))
    first = materialize(components.select("rep", "component").join(least, "component").select("rep", "first"), "firsts")
    known = classes.select("m1", "m2", "rep", "copies", "least").join(links, "rep", "left").join(first, "rep", "left")
    known = known.select("m1", "m2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("first", "least").alias("component"))
    out = rows.select("vec_id", F.when(F.col("fine"), F.col("m1")).alias("m1"), F.when(F.col("fine"), F.col("m2")).alias("m2")).join(known, ["m1", "m2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op5_rp_forest_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
