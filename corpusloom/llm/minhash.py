"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard verification.

One permutation (a hash) deals shingles out over 2**20 places; a second permutation of
those places, shifted by one place a coordinate, gives every coordinate of a signature.
Coordinates are banded; documents that share a band's key are candidates. Links are
confirmed on full shingle sets, and only as far as components need it: documents with
equal sets are one class, and pairs that are connected already are not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import connected_components, materialize
from corpusloom.llm.words import LOWER, distinct, mix, slices, texts_of, words_of

PLACES_BITS = 20


@lru_cache(maxsize=2)
def _circle(coordinates: int, seed: int = 7) -> np.ndarray:
    """Row x holds the second permutation's values at the places x, x + 1, ..., around the circle."""
    places = np.random.default_rng(seed).permutation(1 << PLACES_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([places, places[: coordinates - 1]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The smallest value of each coordinate over a set of 64-bit shingle hashes that is not empty."""
    circle, places = _circle(coordinates), (shingles >> np.uint64(64 - PLACES_BITS)).astype(np.int64)
    out = circle[places[:4096]].min(0)
    for at in range(4096, len(places), 4096):
        out = np.minimum(out, circle[places[at : at + 4096]].min(0))
    return out


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words, A-Z lower-cased.

    A text with fewer words is one run of all of them; a text without words has none.
    """
    for a, b in slices(texts):
        words = words_of(texts.slice(a, b - a))
        h = words.hashes(0, LOWER)
        n = len(h) - size + 1
        runs = h.copy()
        for j in range(1, size):
            runs[: max(0, n)] = mix(runs[: max(0, n)] * np.uint64(0x9FB21C651E98DF25) + h[j : j + max(0, n)])
        for i, j in zip(words.first[:-1], words.first[1:], strict=True):
            if j - i >= size:
                yield distinct(runs[i : j - size + 1])
            else:
                run = h[i : min(j, i + 1)].copy()
                for k in range(i + 1, j):
                    run = mix(run * np.uint64(0x9FB21C651E98DF25) + h[k : k + 1])
                yield run


def _profiles(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = texts_of(whole.column(1))
            for at, stop in slices(texts):
                counts, marks, keys = [], [], []
                for shingles in shingle_sets(texts.slice(at, stop - at), size):
                    counts.append(len(shingles))
                    marks.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                    if len(shingles):
                        band = signature(shingles, bands * rows).astype(np.uint64).reshape(bands, rows)
                        key = np.arange(bands, dtype=np.uint64)
                        for j in range(rows):
                            key = mix(key * np.uint64(0xD1342543DE82EF95) + band[:, j])
                        keys.append(key.view(np.int64))
                    else:
                        keys.append(None)
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(at, stop - at), pa.array(counts, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "mark", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, mark binary, keys array<long>")


def _compared(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``pairs(a, b)`` with the sizes of the intersection and the union of their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                both, either = [], []
                sets = [shingle_sets(texts_of(batch.column(c)), size) for c in (2, 3)]
                for one, other in zip(*sets, strict=True):
                    both.append(len(np.intersect1d(one, other, assume_unique=True)))
                    either.append(len(one) + len(other) - both[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "both", "either"])

    side = lambda end: texts.select(F.col("doc_id").alias(end), F.col("text").alias(f"text_{end}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, both long, either long")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, small_bucket: int = 16, block_rows: int = 512) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets
    of distinct ``shingle_words``-word shingles. ``component_id`` is the smallest doc_id
    that links reach; ``kept`` marks that document. A pair at the threshold shares no
    band with probability (1 - 0.8 ** rows) ** bands, about 1e-7 by default.

    Within a bucket all members are first compared to the one with the smallest doc_id.
    Where more than one component is left, pairs of different components are compared,
    in buckets of up to ``small_bucket`` documents pair by pair, in larger ones in
    blocks of about ``block_rows``: no link is lost, and a large group of copies costs
    about one comparison a member.

    A null or empty text, or one without words, has no shingles, is linked with nothing
    and kept. A null doc_id is kept alone with a null component. Rows that repeat a
    doc_id are one document with the links of each of its sets: all of them have the
    component that any of them reaches, and each has its own n_shingles. Texts of any length stay whole.
    Other columns are not read. An empty table gives no rows.
    """
    profiles = materialize(_profiles(docs, shingle_words, bands, rows), "profiles")
    known = profiles.where("doc_id IS NOT NULL AND mark IS NOT NULL")
    classes = known.groupBy("mark").agg(F.min("doc_id").alias("class_id"))
    heads = known.join(classes.withColumnRenamed("class_id", "doc_id"), ["mark", "doc_id"], "left_semi")
    entries = heads.select("doc_id", "n_shingles", F.posexplode("keys").alias("band", "key"))
    shared = entries.groupBy("band", "key").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "n_shingles")).alias("p")).where("size > 1")
    shared = shared.select("band", "key", "size", F.col("p.doc_id").alias("pivot"), F.col("p.n_shingles").alias("n_pivot"))
    members = materialize(entries.join(shared, ["band", "key"]), "members")
    near = docs.select("doc_id", "text").join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    near = materialize(near.dropDuplicates(["doc_id", "text"]), "texts")
    alike = lambda n, m: F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)
    first = members.where(alike(F.col("n_shingles"), F.col("n_pivot"))).where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = materialize(_compared(first, near, shingle_words), "stars")
    linked = F.lit(100) * F.col("both") >= F.lit(percent) * F.col("either")
    labels = materialize(connected_components(stars.where(linked)), "labels")
    far = stars.select(F.col("a").alias("pivot"), F.col("b").alias("doc_id"), (1 - F.col("both") / F.col("either")).alias("away"))
    left = _still_open(members, labels).join(far, ["pivot", "doc_id"], "left")
    left = materialize(left.withColumn("away", F.when(F.col("pivot") == F.col("doc_id"), F.lit(0.0)).otherwise(F.col("away"))), "open")
    pairs = materialize(_pairs(left.where(F.col("size") <= small_bucket), alike, 1 - percent / 100), "pairs")
    found = pairs.join(_compared(pairs.select("a", "b"), near, shingle_words).where(linked), ["a", "b"], "left_semi").select("label_a", "label_b")
    found = found.union(_block_links(left.where(F.col("size") > small_bucket), near, shingle_words, percent, block_rows))
    mine = materialize(known.select(F.col("doc_id").alias("id")).distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("label")), "mine")
    merged = connected_components(found.union(_repeated(profiles, known, classes, mine)).toDF("a", "b"))
    merged = merged.select(F.col("id").alias("label"), F.col("component").alias("new"))
    labels = mine.join(merged, "label", "left").select(F.col("id").alias("class_id"), F.coalesce("new", "label").alias("component"))
    bare = profiles.where("doc_id IS NOT NULL AND mark IS NULL").withColumn("class_id", F.col("doc_id"))
    own = known.join(classes, "mark").unionByName(bare).join(labels, "class_id", "left")
    own = own.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"))
    alone = profiles.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return own.unionByName(alone).select("*", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def _repeated(profiles: DataFrame, known: DataFrame, classes: DataFrame, mine: DataFrame) -> DataFrame:
    """Pairs of labels that one doc_id with different sets joins: its rows are one document, with the links of each."""
    mark = F.coalesce("mark", F.lit(b""))
    several = profiles.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high").select("doc_id")
    ties = known.join(several, "doc_id", "left_semi").select("doc_id", "mark").distinct().join(classes, "mark").where("doc_id <> class_id")
    label = lambda of, end: mine.select(F.col("id").alias(of), F.col("label").alias(end))
    return ties.join(label("doc_id", "label_a"), "doc_id").join(label("class_id", "label_b"), "class_id").where("label_a <> label_b").select("label_a", "label_b")


def _still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets of more than two whose members are not one component yet, with their labels."""
    now = members.where("size > 2").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    open_ = now.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band", "key")
    return now.join(open_, ["band", "key"], "left_semi")


def _pairs(members: DataFrame, alike, reach: float) -> DataFrame:
    """Every pair of a bucket for which a link is still possible and of use.

    Labels must differ, the sizes of the sets must be close, and so must the distances
    to the bucket's pivot: Jaccard distance keeps the triangle inequality, so a pair
    whose distances to it differ by more than ``reach`` has no link.
    """
    b = members.select("band", "key", *(F.col(c).alias(f"{c}_b") for c in ("doc_id", "n_shingles", "label", "away")))
    close = F.coalesce(F.abs(F.col("away") - F.col("away_b")) <= reach + 1e-9, F.lit(True))
    both = members.join(b, ["band", "key"]).where("label <> label_b AND doc_id < doc_id_b").where(close & alike(F.col("n_shingles"), F.col("n_shingles_b")))
    return both.select(F.col("doc_id").alias("a"), F.col("doc_id_b").alias("b"), F.col("label").alias("label_a"), "label_b").distinct()


def _block_links(members: DataFrame, texts: DataFrame, size: int, percent: int, block_rows: int) -> DataFrame:
    """Links between components within large buckets, as pairs of labels.

    Documents are dealt into blocks of about ``block_rows`` documents, one of w thousand
    shingles counting as w: by their largest bucket, where that fills a block, else with
    other such buckets of the same cluster, that is of the buckets that share documents.
    Blocks that share a bucket are compared as wholes, so that neither pairs of documents
    nor a whole bucket are ever in one place. The documents of a component that could
    fill a block have blocks of their own, which are not compared with each other.
    """
    cluster = connected_components(members.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")), "clusters").toDF("doc_id", "cluster")
    home = members.groupBy("doc_id", "label", "n_shingles").agg(F.max(F.struct("size", "band", "key")).alias("home"))
    home = home.select("doc_id", "label", "home.band", "home.key", F.greatest(F.lit(1), F.ceil(F.col("n_shingles") / 1000)).alias("w")).join(cluster, "doc_id")
    large = home.groupBy("label").agg(F.sum("w").alias("all")).where(F.col("all") >= block_rows // 2).select("label", F.col("label").alias("inner"))
    home = materialize(home.join(large, "label", "left"), "homes")
    homes = home.groupBy("cluster", "inner", "band", "key").agg(F.sum("w").alias("all")).withColumn("small", F.col("all") < block_rows // 2)
    shared = homes.where("small").groupBy("cluster", "inner").agg(F.sum("all").alias("most"))
    homes = homes.join(shared.select(F.col("cluster").alias("c"), F.col("inner").alias("i"), "most"), F.expr("cluster = c AND inner <=> i"), "left")
    bins = F.when(F.col("small"), F.pmod(F.xxhash64("band", "key"), F.ceil(F.col("most") / block_rows)))
    homes = homes.select("band", "key", F.col("inner").alias("i"), F.col("cluster").alias("c"), bins.alias("bin"), F.ceil(F.col("all") / block_rows).alias("parts"))
    home = home.join(homes, ["band", "key"]).where("cluster = c AND inner <=> i")
    apart = F.xxhash64("band", "key", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    block = F.xxhash64("cluster", F.coalesce("inner", F.lit(-1)), F.coalesce("bin", apart), F.col("bin").isNull())
    home = materialize(home.select("doc_id", "label", "inner", block.alias("block")), "blocks")
    held = members.select("band", "key", "doc_id").join(home, "doc_id").select("band", "key", "block", "inner").distinct()
    other = held.select("band", "key", F.col("block").alias("block_b"), F.col("inner").alias("inner_b"))
    grid = held.join(other, ["band", "key"]).where("block <= block_b AND NOT coalesce(inner = inner_b, false)").select("block", "block_b").distinct()
    sides = grid.select("block", "block_b", F.explode(F.array_distinct(F.array("block", "block_b"))).alias("side"))
    filled = home.select(F.col("block").alias("side"), "doc_id", "label").join(texts, "doc_id")
    dealt = sides.join(filled, "side")

    def compare(table: pa.Table) -> pa.Table:
        one, label = np.asarray(table["side"]), np.asarray(table["label"])
        first = one == table["block"][0].as_py()
        sets = list(shingle_sets(texts_of(table["text"]), size))
        sizes = np.array([len(x) for x in sets])
        keys = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(keys, kind="stable")
        keys, row = keys[order], row[order]
        column = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
        both = np.zeros((len(sets), len(sets)), np.float32)
        at = 0
        while at < len(keys):
            stop = int(np.searchsorted(column, column[at] + 8192))
            part = np.zeros((len(sets), column[stop - 1] - column[at] + 1), np.float32)
            part[row[at:stop], column[at:stop] - column[at]] = 1
            both += part @ part.T
            at = stop
        near = 100 * both.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - both.astype(np.int64))
        if not first.all():
            near &= first[:, None] & ~first[None, :]
        i, j = np.nonzero(near & (label[:, None] != label[None, :]))
        found = np.unique(np.stack([label[i], label[j]], 1), axis=0)
        return pa.table({"label_a": pa.array(found[:, 0]), "label_b": pa.array(found[:, 1])})

    return dealt.groupBy("block", "block_b").applyInArrow(compare, "label_a long, label_b long")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2, percent=80)
