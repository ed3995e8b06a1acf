"""Exact k nearest binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments, each with an index from its value to the codes that
hold it, as one row. Rounds probe one more bit of difference in one or more segments: with radius
r[s] probed in segment s, no code within ``sum(r[s] + 1) - 1`` bits is unseen. A query is
done once its k-th verified distance is within that reach.
"""

from __future__ import annotations

from math import ceil, comb, log2

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import materialize

BITS = 64
#: Codes under one segment value above which the value's entries are dealt out over several join keys.
BUCKET = 4096


def sign_codes(vectors: DataFrame) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> id, code: bit i is set where component i is above zero.

    A null vector, one with a null component and one of more than 64 components have a null code.
    """
    bits = F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).when(x.isNotNull(), F.lit(0).cast("long")))
    code = F.when((F.size("embedding") <= BITS) & ~F.exists(bits, lambda b: b.isNull()), F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    return vectors.select(F.col("vec_id").alias("id"), code.alias("code"))


def _spans(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of each segment; numbers differ by one at most."""
    cuts = [BITS * s // segments for s in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _steps(segments: int) -> list[tuple[int, list[int], int]]:
    """(radius, segments probed at it, reach afterwards): whole rounds while balls are small, then half rounds."""
    widths, done, out = [w for _, w in _spans(segments)], [0] * segments, []
    for r in range(1, max(widths) + 1):
        whole = list(range(segments))
        for part in [whole] if comb(max(widths), r) <= 600 else [whole[: segments // 2], whole[segments // 2 :]]:
            for s in part:
                done[s] = min(r, widths[s])
            out.append((r, part, sum(d + 1 for d in done) - 1))
    return out


def _masks(spark: SparkSession, widths: dict[int, int], low: int, high: int) -> DataFrame:
    """s, flips: for each segment of ``widths`` the masks of ``low`` to ``high`` set bits, at most 2 ** width rows a segment."""
    out = None
    for width in sorted(set(widths.values())):
        own = F.explode(F.array(*(F.lit(s) for s, w in widths.items() if w == width)))
        one = spark.range(1 << width).where(F.bit_count("id").between(low, high)).select(own.alias("s"), F.col("id").alias("flips"))
        out = one if out is None else out.unionByName(one)
    return out


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    """``rows(q, distance, id, code, n)`` -> q, best, ids, far: what k rows of other ids than one can need.

    ``n`` counts equal rows. Of an id the first k rows stay, and of ids the k + 1 that
    come first; ``ids`` is their number and ``far`` the distance at which the last of them comes in.
    """
    rows = rows.repartition("q").groupBy("q", "distance", "id", "code").agg(F.first("n").alias("n"))
    own = Window.partitionBy("q", "id").orderBy("distance", "code")
    rows = rows.withColumn("before", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1))).where("coalesce(before, 0) < %d" % k)
    rows = rows.withColumn("first", F.min("distance").over(Window.partitionBy("q", "id")))
    rows = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("q").orderBy("first", "id"))).where(F.col("place") <= k + 1)
    best = F.sort_array(F.collect_list(F.struct("distance", "id", "code", "n")))
    return rows.groupBy("q").agg(best.alias("best"), F.max("place").alias("ids"), F.max("first").alias("far"))


def nearest_codes(queries: DataFrame, index: DataFrame, k: int = 10, segments: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """``queries(id, code)`` against ``index(id, code)`` -> query_id, rank, id, distance.

    The k codes of smallest Hamming distance, smaller ids first on ties, without the rows
    of the query's own id. Equal codes are one entry with its k + 1 smallest ids and how
    often each is there, so a large group of copies costs one probe. ``segments`` (3 to
    8) is 64 / log2(number of codes), rounded up, unless given: a segment value then holds
    one code or several, and a probe meets them as one row. Values that hold more than
    ``bucket`` codes are dealt out over several rows. Of the codes that a probe meets
    only those can count that come first: k + 1, times the most codes that one id has.

    Null ids and codes are left out on both sides. Rows that repeat an id in the index
    count each; repeated queries give repeated results. With fewer than k other rows
    all of them are returned. Empty tables give no rows. Other columns are not read.
    """
    queries = queries.select("id", "code").where("id IS NOT NULL AND code IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    copies = index.select("id", "code").where("id IS NOT NULL AND code IS NOT NULL").groupBy("code", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    entries = copies.withColumn("place", rank).where(F.col("place") <= k + 1)
    entries = materialize(entries.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("ids")), "codes")
    n = entries.count()
    segments = segments or min(8, max(3, ceil(BITS / log2(max(2, n)))))
    asked = queries.select(F.col("code").alias("q")).distinct().where(F.lit(n > 0))
    spread = entries.select(F.explode("ids.id").alias("id")).groupBy("id").count().agg(F.max("count")).first()[0] or 1
    done = _probed(asked, entries, k, segments, bucket, (k + 1) * spread)
    others = F.filter("best", lambda b: b["id"] != F.col("query_id"))
    others = F.slice(F.flatten(F.transform(others, lambda b: F.array_repeat(F.struct(b["distance"].alias("distance"), b["id"].alias("id")), b["n"]))), 1, k)
    found = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(done.hint("merge"), "q").select("query_id", F.posexplode(others).alias("at", "b"))
    return found.select("query_id", (F.col("at") + 1).alias("rank"), "b.id", "b.distance")


def _keyed(entries: DataFrame, spans: list[tuple[int, int]], bucket: int) -> tuple[DataFrame, DataFrame | None]:
    """The index: key (segment and value), sub, and its codes with their ids as ``held``; and the keys of more than ``bucket`` codes with their number of subs, if there are any."""
    keyed = entries.select("code", "ids", F.explode(F.array(*(_value("code", s, span) for s, span in enumerate(spans)))).alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > bucket).select("key", F.ceil(F.col("count") / bucket).cast("int").alias("subs"))
    hot = materialize(hot, "hot-values")
    grouped = lambda rows: materialize(rows.groupBy("key", "sub").agg(F.collect_list(F.struct("code", "ids")).alias("held")), "segments")
    if hot.isEmpty():
        return grouped(keyed.withColumn("sub", F.lit(0))), None
    keyed = keyed.join(hot, "key", "left").withColumn("sub", F.pmod(F.xxhash64("code"), F.coalesce("subs", F.lit(1))).cast("int"))
    return grouped(keyed), hot


def _value(code: str, s: int, span: tuple[int, int]):
    """A code's value in segment s, with the segment's number above bit 56."""
    at, width = span
    return F.shiftrightunsigned(F.col(code), at).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(s << 56))


def _probed(asked: DataFrame, entries: DataFrame, k: int, segments: int, bucket: int, most: int) -> DataFrame:
    """The rounds of multi-index hashing: q, best; a probe, and a round of a query, brings ``most`` codes at most. Of an index of k ids or fewer every code is seen. The masks of a radius are a table of bounded size, the index is never broadcast."""
    spark, spans, need = asked.sparkSession, _spans(segments), k + 1
    keyed, hot = _keyed(entries, spans, bucket)
    none = F.array().cast("array<struct<distance:int,id:bigint,code:bigint,n:int>>")
    state = asked.select("q", none.alias("best"), F.lit(0).alias("ids"), F.lit(BITS).alias("far"))
    done = None
    for radius, part, reach in _steps(segments):
        bound = F.when(F.col("ids") >= need, F.col("far")).otherwise(BITS)
        values = F.array(*(F.struct(_value("q", s, spans[s]).alias("value"), F.lit(s).alias("s")) for s in part))
        masks = _masks(spark, {s: spans[s][1] for s in part}, 0 if radius == 1 else radius, radius)
        probes = state.select("q", bound.alias("bound"), F.explode(values).alias("v")).select("q", "bound", "v.*")
        probes = probes.join(F.broadcast(masks), "s").select("q", "bound", F.col("value").bitwiseXOR(F.col("flips")).alias("key"))
        if hot is None:
            probes = probes.withColumn("sub", F.lit(0))
        else:
            probes = probes.join(hot, "key", "left").withColumn("sub", F.explode(F.sequence(F.lit(0), F.coalesce("subs", F.lit(1)) - 1)))
        distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        seen = probes.join(keyed.hint("merge"), ["key", "sub"]).withColumn("near", F.filter("held", lambda c: F.bit_count(F.col("q").bitwiseXOR(c["code"])) <= F.col("bound"))).where("size(near) > 0")
        ranked = F.transform("near", lambda c: F.struct(F.bit_count(F.col("q").bitwiseXOR(c["code"])).alias("distance"), c["ids"][0]["id"].alias("id"), c["code"].alias("code"), c["ids"].alias("ids")))
        seen = seen.select("q", ranked.alias("near")).withColumn("near", F.when(F.size("near") > most, F.slice(F.sort_array("near"), 1, most)).otherwise(F.col("near")))
        seen = seen.groupBy("q").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))
        once = F.filter("near", lambda x, at: (at == 0) | (F.get("near", at - 1)["code"] != x["code"]))  # several segments may bring a code
        seen = seen.select("q", F.inline(F.slice(once, 1, most))).select("q", "code", "ids")
        fresh = seen.select("q", distance.alias("distance"), "code", F.explode("ids").alias("e")).select("q", "distance", "e.id", "code", "e.n")
        old = state.select("q", F.explode("best").alias("b")).select("q", "b.distance", "b.id", "b.code", "b.n")
        best = _nearest(fresh.union(old) if radius > 1 else fresh, k).toDF("q", "new", "new_ids", "new_far")
        state = state.join(best.hint("merge"), "q", "left").select("q", F.coalesce("new", "best").alias("best"), F.coalesce("new_ids", "ids").alias("ids"), F.coalesce("new_far", "far").alias("far"))
        state = materialize(state, "nearest")
        ready = (F.col("ids") >= need) & (F.col("far") <= reach)
        part_done = state.where(ready)
        done = part_done if done is None else done.union(part_done)
        state = state.where(~ready)
        if state.isEmpty():
            break
    return done.union(state).select("q", "best")


def op1_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = materialize(sign_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "sign-codes")
    return nearest_codes(codes.where("id % 20 = 0"), codes, k=10)


OP1_SQL = """
WITH codes AS (
  SELECT vec_id AS id, CAST(list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INTEGER) ELSE CAST(0 AS HUGEINT) END)) AS HUGEINT) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) <= 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0
), pairs AS (
  SELECT q.id AS query_id, c.id, CAST(bit_count(xor(q.code, c.code)) AS INTEGER) AS distance
  FROM codes q JOIN codes c ON q.id <> c.id WHERE q.id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, id, distance FROM ranked WHERE rank <= 10
"""
