"""Target-distribution importance resampling over hashed word n-grams.

The texts of a batch are joined with a sentinel byte and cut by one pass of a regular
expression; the documents of the words come from their offsets by binary search, which
also drops the n-grams that run from one document into the next. Buckets are counted by
bincount. Counts of the corpus are sums of the tasks' counts; the draw is the Gumbel
top-k of the scores, found from a histogram of the integer scores in two levels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import materialize

#: Words of lower-cased UTF-8: digits, letters a to z and all bytes beyond ASCII. The group keeps the gaps between them too.
WORDS = re.compile(rb"([0-9a-z\x80-\xff]+)")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Stands between the texts of a batch; it is in no word.
SENTINEL = b"\x00"
#: Bytes of joined text that are cut into words at once, and of texts that are joined.
BLOCK, JOINED = 1 << 20, 1 << 22


def grams(texts: list[bytes], longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, text number of each n-gram, bucket of each n-gram) for blocks of the joined texts; n-grams do not leave their text."""
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    data = SENTINEL.join(texts).lower()
    words, owners, at = [], np.zeros(0, np.int64), 0
    while at < len(data):
        gap = GAP.search(data, at + BLOCK)
        stop = gap.start() if gap else len(data)
        parts = WORDS.split(data[at:stop])
        ends = at + np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        at = stop
        tail = min(len(words), longest - 1)  # words of the block before that still begin an n-gram
        words = [*words[len(words) - tail :], *parts[1::2]]
        owners = np.concatenate([owners[len(owners) - tail :], np.searchsorted(offsets, ends[:-1:2], "right") - 1])
        for n in range(1, longest + 1):
            first = max(0, tail - n + 1)
            runs = words[first:] if n == 1 else map(b" ".join, zip(*(words[first + i :] for i in range(n)), strict=False))
            codes = np.fromiter(map(crc32, runs), np.int64)
            owner = owners[first : first + len(codes)]
            inside = owner == owners[first + n - 1 : first + n - 1 + len(codes)]
            yield n, owner[inside], codes[inside] % buckets


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row ranges of at most JOINED bytes of text in the last column, or of one row."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(batch.num_columns - 1).cast(pa.large_binary())), np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, before + JOINED, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _texts(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary").alias("text")


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many n-grams of ``texts(text)`` fall into each bucket; tasks add up their own first, the driver gets a number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in _joined(batches):
            for _, _, found in grams(batch.column(0).to_pylist(), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = texts.select(_texts(F.col("text"))).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # at most a row a bucket
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over its share of the source."""
    s_all, t_all, size = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.float64)


def weigh(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean of the gains of a document's features, 0 without any."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches):
            rows = batch.num_rows
            n_words, n_features, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for n, owner, found in grams(batch.column(1).to_pylist(), longest, buckets):
                many = np.bincount(owner, minlength=rows)
                n_features += many
                n_words += many if n == 1 else 0
                total += np.bincount(owner, weights=gain[found], minlength=rows).astype(np.int64)  # whole numbers far below 2^53
            weight = total // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _texts(F.col("text"))).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 times) a Gumbel number that depends on the seed and the id only; null for a null id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, percent: int) -> DataFrame:
    """``scored(doc_id, n_features, weight, score, takes_part)`` with ranks of the drawn rows, null for the rest.

    Scores are whole numbers in a range that the formula bounds (some 10^5 values), so
    their histogram is small; it is summed up in spans of 256 scores, then within them.
    Only rows that reach the last drawn score are sorted, by score and id; equal rows are
    counted before. Rows without a score take no part.
    """
    part = F.col("takes_part") & F.col("score").isNotNull()
    counts = materialize(scored.where(part).groupBy("score").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("score") / 256)), "scores")
    above = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.groupBy("span").agg(F.sum("n").alias("n"))
    spans = spans.select("span", F.coalesce(F.sum("n").over(above().orderBy(F.desc("span"))), F.lit(0)).alias("spans_above"))
    inside = F.coalesce(F.sum("n").over(above("span").orderBy(F.desc("score"))), F.lit(0))
    counts = counts.withColumn("above", inside).join(spans, "span").select("score", (F.col("above") + F.col("spans_above")).alias("above"), "n")
    counts = materialize(counts, "ranks")
    size = (counts.agg(F.sum("n").alias("n")).first().n or 0) * percent // 100
    least = counts.where(F.col("above") < size).agg(F.min("score").alias("least")).first().least
    reaches = F.coalesce(part & (F.col("score") >= F.lit(least).cast("long")), F.lit(False))
    names = ["doc_id", "n_features", "weight", "score"]
    same = scored.where(reaches).groupBy(*names).agg(F.count("*").alias("copies"))
    order = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("before", F.coalesce(F.sum("copies").over(order), F.lit(0)))
    ranked = same.join(counts.select("score", "above"), "score").select(*names, "above", "before", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    rank = F.col("above") + F.col("before") + F.col("copy")
    ranked = ranked.select(*names, F.when(rank <= size, rank).alias("rank"))
    return ranked.unionByName(scored.where(~reaches).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10000, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``docs(doc_id, text)`` weighed towards ``target(text)``: doc_id, n_features, weight, score, rank.

    Features are all runs of 1 to ``longest`` words. Of the N documents with at least
    ``least_words`` words the floor(percent * N / 100) with the highest scores are drawn
    without replacement and ranked from 1; ties go to the smaller doc_id. Counts are over
    all documents and all target texts. Texts are read twice, nothing of them is shuffled.

    A null or empty text has no features and weight 0. A row without a doc_id has no
    score, is not drawn and is not among the N. Repeated rows count as often as they
    occur and get ranks of their own. Very long texts are worked through in blocks. Other
    columns are not read. Empty tables: no documents give no rows, no target texts give
    a target of equal shares.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    weighed = weigh(docs, gain, longest)
    score = F.col("weight") + noise(F.col("doc_id"), seed)
    scored = weighed.select("doc_id", "n_features", "weight", score.alias("score"), (F.col("n_words") >= least_words).alias("takes_part"))
    return draw(materialize(scored, "weighed"), percent)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_FEATURES = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH bytes AS (
    SELECT list(c ORDER BY i) AS crcs
    FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))
), d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce({_FEATURES}, []) AS words FROM documents
), w AS (
    SELECT r, unnest(words) AS word FROM d
), b AS (
    SELECT unnest(coalesce({_FEATURES}, [])) AS word FROM benchmark
), coded AS (
    SELECT word, xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(range(1, strlen(word) + 1), lambda k: ('0x' || substr(hex(encode(word)), 2 * k - 1, 2))::BIGINT)),
        lambda c, x: xor(crcs[xor(c, x) % 256 + 1], c >> 8))) % 10000 AS bucket
    FROM (SELECT word FROM w UNION SELECT word FROM b), bytes
), s AS (
    SELECT bucket, count(*) AS n FROM w JOIN coded USING (word) GROUP BY bucket
), t AS (
    SELECT bucket, count(*) AS n FROM b JOIN coded USING (word) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000)
        / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain
    FROM s FULL JOIN t USING (bucket)
), weighed AS (
    SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN coded USING (word) JOIN gains USING (bucket) GROUP BY r
), scored AS (
    SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
        + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM d LEFT JOIN weighed USING (r)
), fit AS (
    SELECT *, n_features >= 20 AND score IS NOT NULL AS fits, count(*) FILTER (n_features >= 20 AND score IS NOT NULL) OVER () AS total FROM scored
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY fits ORDER BY score DESC, doc_id) AS place FROM fit
)
SELECT doc_id, n_features, weight, score, CASE WHEN fits AND place <= 10 * total // 100 THEN place END AS rank FROM ranked
"""
