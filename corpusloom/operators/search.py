"""Batched hybrid retrieval: dense and lexical candidates, fused by reciprocal ranks."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.scalar import candidate_limit, lexical_terms, rrf
from corpusloom.plans.tables import materialize

ORDER = ("path", "start_byte", "chunk_id")


def allowed(prefix: str = "path_prefix", languages: str = "languages") -> Column:
    """A query's own path and language filters; null or empty ones let everything through."""
    path = F.col(prefix).isNull() | (F.col(prefix) == "") | (F.col("path") == F.col(prefix)) | F.startswith("path", F.concat(F.col(prefix), F.lit("/")))
    return path & (F.col(languages).isNull() | (F.size(languages) == 0) | F.array_contains(F.col(languages), F.col("language")))


#: The most candidates that ``candidate_limit`` gives, and one more to tell whether there are others.
MOST = 201


def _ranked(df: DataFrame, score: Column, name: str, limit: Column, key: str = "query_id") -> DataFrame:
    order = Window.partitionBy(key).orderBy(score.desc(), *ORDER)
    return df.withColumn(name, F.row_number().over(order)).where((F.col(name) <= MOST) & (F.col(name) <= limit))


def dense_topk(queries: DataFrame, chunks: DataFrame, block_queries: int = 8192, part_chunks: int = 4096) -> DataFrame:
    """Exact cosine top list of each ``queries(query_id, project_id, vector, path_prefix, languages, k)``.

    Queries are dealt into blocks of about ``block_queries``, chunks into parts of about
    ``part_chunks`` of one project; each block meets each part of its project in a task
    that holds these two only and passes on its own best rows of each query. Rows travel
    one by one, so no record grows with a block. Cosines that are equal to nine digits
    tie. Null and zero vectors, and vectors of another size, match nothing.
    """
    wanted = queries.where("vector IS NOT NULL").select("project_id", "query_id", F.transform("vector", lambda v: v.cast("double")).alias("vector"), "path_prefix", "languages", candidate_limit("k").alias("want"), F.size("vector").alias("size"))
    given = chunks.where("embedding IS NOT NULL").select(F.col("project_id").alias("project_id"), "chunk_id", "path", "start_byte", "language", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"), F.size("embedding").alias("size"))
    shares = lambda rows, name, most: rows.groupBy("project_id").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    counts = shares(wanted, "blocks", block_queries).join(shares(given, "parts", part_chunks), "project_id")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = wanted.join(counts, "project_id").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("part", copies("parts")).drop("blocks", "parts")
    right = given.join(counts, "project_id").withColumn("part", F.pmod(F.xxhash64("chunk_id"), "parts").cast("int")).withColumn("block", copies("blocks")).drop("blocks", "parts")
    key = ["project_id", "size", "part", "block"]
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best_of_part, "query_id long, chunk_id string, path string, start_byte long, score double, want int")
    return _ranked(best, F.round("score", 9), "dense_rank", F.col("want") + 1).drop("want")


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Equally long lists of doubles as rows; nulls are NaN."""
    flat = pa.concat_arrays([c.flatten() for c in vectors.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _best_of_part(asked: pa.Table, given: pa.Table) -> pa.Table:
    """The first ``want`` + 1 chunks of each query, 256 queries at a time."""
    found: list[list] = [[], [], []]
    wants = asked["want"].to_numpy()
    if len(asked) and len(given):
        given = given.sort_by([(c, "ascending") for c in ORDER])  # so that places among the chunks break ties
        paths, languages = given["path"].to_pylist(), np.array(given["language"].to_pylist(), object)
        prefixes, allowed_languages = asked["path_prefix"].to_pylist(), asked["languages"].to_pylist()
        x, y = _matrix(asked["vector"]), _matrix(given["embedding"])
        with np.errstate(invalid="ignore", divide="ignore"):
            x, y = x / np.linalg.norm(x, axis=1)[:, None], (y / np.linalg.norm(y, axis=1)[:, None]).T
        for at in range(0, len(x), 256):
            with np.errstate(invalid="ignore"):
                s = np.round(np.clip(x[at : at + 256] @ y, -1, 1), 9)
            s[~np.isfinite(s)] = -np.inf
            most = min(int(wants[at : at + 256].max()) + 1, s.shape[1])
            least = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
            for i, row in enumerate(s):
                n, own = int(wants[at + i]) + 1, slice(None)
                prefix, tongues = prefixes[at + i], allowed_languages[at + i]
                places = None
                if prefix or tongues:
                    fine = np.ones(len(row), bool)
                    if prefix:
                        fine[:] = False
                        for low, high in ((prefix, prefix + "\0"), (prefix + "/", prefix + "0")):  # the character after / is 0
                            fine[bisect_left(paths, low) : bisect_left(paths, high)] = True
                    if tongues:
                        fine &= np.isin(languages, [t for t in tongues if t is not None])
                    places = np.nonzero(fine & (row > -np.inf))[0]
                    if len(places) > n:
                        bound = np.partition(row[places], len(places) - n)[len(places) - n]
                        places = places[row[places] >= bound]
                else:
                    places = np.nonzero((row >= least[i]) & (row > -np.inf))[0]
                places = places[np.argsort(-row[places], kind="stable")][:n]
                found[0].append(np.full(len(places), at + i))
                found[1].append(places)
                found[2].append(row[places])
    query, chunk, score = (np.concatenate(c) if c else np.array([], t) for c, t in zip(found, (np.int64, np.int64, np.float64), strict=True))
    query, chunk = pa.array(query.astype(np.int64)), pa.array(chunk.astype(np.int64))
    columns = {"query_id": asked["query_id"].take(query), **{c: given[c].take(chunk) for c in ("chunk_id", "path", "start_byte")}, "score": pa.array(score), "want": asked["want"].take(query)}
    return pa.table(columns).cast(pa.schema([("query_id", pa.int64()), ("chunk_id", pa.string()), ("path", pa.string()), ("start_byte", pa.int64()), ("score", pa.float64()), ("want", pa.int32())]))


def _class(*columns: str) -> Column:
    """One text for equal rows."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def lexical_topk(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of ``documents(project_id, chunk_id, source, path, start_byte, language, terms)`` that hold all terms of a query.

    ``terms`` are (term, weight) structs; a document's score is the sum over the query's
    terms of the best weight, a chunk's score that of its best document.

    Queries that ask alike are one, and so are documents of one language with the same
    terms and weights below the same asked path prefix: of such documents the first
    ``MOST`` chunks are all that any query can need. A query meets only the kinds of
    documents that hold the rarest of its terms, by one equi-join on project, prefix and
    term; the others are looked up in the row. No side is broadcast, as either may grow.
    """
    asked = queries.select("project_id", "query_id", "path_prefix", "languages", candidate_limit("k").alias("want"), F.array_distinct(lexical_terms("text")).alias("asked")).where(F.size("asked") > 0)
    asked = asked.withColumn("scope", F.coalesce("path_prefix", F.lit("")))
    asked = materialize(asked.withColumn("ask", _class("project_id", "scope", "languages", "want", "asked")), "asked")
    asks = asked.select("ask", "project_id", "scope", "languages", "want", "asked").dropDuplicates(["ask"])
    scopes = asked.select("project_id", "scope").distinct()

    held = F.array_sort(F.array_distinct(F.col("terms.term")))
    weight = lambda a: F.array_max(F.transform(F.filter("terms", lambda t: t["term"] == a), lambda t: t["weight"].cast("double")))
    bags = documents.where("terms IS NOT NULL").select("project_id", "chunk_id", "path", "start_byte", "language", F.transform(held, lambda a: F.struct(a.alias("term"), weight(a).alias("weight"))).alias("bag"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    below = F.explode(F.array_distinct(F.filter(above, lambda p: p != "")))
    under = bags.withColumn("scope", below).join(scopes, ["project_id", "scope"], "left_semi")
    rows = bags.withColumn("scope", F.lit("")).unionByName(under).withColumn("kind", _class("project_id", "scope", "language", "bag"))
    rows = materialize(rows.dropDuplicates(["kind", "chunk_id", "path", "start_byte"]), "bags")
    kinds = rows.select("kind", "project_id", "scope", "language", "bag").dropDuplicates(["kind"])
    members = _ranked(rows.select("kind", *ORDER), F.lit(0), "place", F.lit(MOST), "kind")

    place = ["project_id", "scope", "term"]
    postings = kinds.select("kind", "language", "bag", "project_id", "scope", F.explode("bag.term").alias("term"))
    often = postings.groupBy(*place).agg(F.count("*").alias("often"))
    rarest = asks.select("ask", "project_id", "scope", F.explode("asked").alias("term")).join(often.hint("merge"), place)
    rarest = rarest.groupBy("ask").agg(F.min_by("term", F.struct("often", "term")).alias("term"))
    spoken = F.col("languages").isNull() | (F.size("languages") == 0) | F.array_contains("languages", F.col("language"))
    hits = postings.join(asks.join(rarest.hint("merge"), "ask").hint("merge"), place).where(spoken & (F.size(F.array_except("asked", F.col("bag.term"))) == 0))
    best_of = lambda a: F.get(F.filter("bag", lambda t: t["term"] == a), F.lit(0))["weight"]
    hits = hits.select("ask", "kind", "want", F.aggregate("asked", F.lit(0.0), lambda sum_, a: sum_ + best_of(a)).alias("score"))
    whole = members.join(hits.hint("merge"), "kind").where(F.col("place") <= F.col("want") + 1)
    best = whole.groupBy("ask", "chunk_id", "path", "start_byte", "want").agg(F.max("score").alias("score"))
    ranked = _ranked(best, F.col("score"), "lexical_rank", F.col("want") + 1, "ask").drop("want")
    return asked.select("query_id", "ask").join(ranked.hint("merge"), "ask").select("query_id", "chunk_id", "path", "start_byte", "score", "lexical_rank")


def chunk_documents(chunks: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Weighted documents of chunks, and of the entities that touch them: same symbol, no range, or overlapping ranges."""
    from corpusloom.functions.scalar import weighted_document

    place = ["project_id", "chunk_id", "path", "start_byte", "language"]
    own = chunks.select(*place, F.lit("chunk").alias("source"), weighted_document(["path", "symbol_name"], ["language", "symbol_kind"]).alias("terms"))
    if entities is None:
        return own
    facts = entities.select("project_id", F.col("path").alias("entity_path"), F.col("identity_key").alias("source"), "symbol_key", F.col("start_byte").alias("from_byte"), F.col("end_byte").alias("to_byte"), weighted_document(["name"], ["framework", "entity_kind", "path"]).alias("terms"))
    near = chunks.join(facts, (chunks.project_id == facts.project_id) & (chunks.path == facts.entity_path)).drop(facts.project_id)
    touch = F.coalesce(F.col("owner_key") == F.col("symbol_key"), F.lit(False)) | F.col("from_byte").isNull() | ((F.col("start_byte") < F.col("to_byte")) & (F.col("end_byte") > F.col("from_byte")))
    return own.unionByName(near.where(touch).select(*place, "source", "terms"))


def fuse(queries: DataFrame, dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Both lists joined on query and chunk, scored by reciprocal ranks, cut to each query's k, with a truncated flag."""
    limits = queries.select("query_id", "k", candidate_limit("k").alias("want"))
    a = dense.select("query_id", "chunk_id", "path", "start_byte", "dense_rank", F.col("score").alias("similarity"))
    b = lexical.select("query_id", "chunk_id", F.col("path").alias("path_b"), F.col("start_byte").alias("start_b"), "lexical_rank")
    both = a.join(b, ["query_id", "chunk_id"], "full_outer").join(limits, "query_id")
    more = F.max(F.coalesce(F.greatest("dense_rank", "lexical_rank"), F.lit(0)) > F.col("want")).over(Window.partitionBy("query_id"))
    both = both.withColumn("over", more).where((F.coalesce("dense_rank", F.lit(1 << 30)) <= F.col("want")) | (F.coalesce("lexical_rank", F.lit(1 << 30)) <= F.col("want")))
    for c in ("dense_rank", "lexical_rank"):
        both = both.withColumn(c, F.when(F.col(c) <= F.col("want"), F.col(c)))
    both = both.select("query_id", "chunk_id", F.coalesce("path", "path_b").alias("path"), F.coalesce("start_byte", "start_b").alias("start_byte"), "dense_rank", "lexical_rank", "similarity", rrf("dense_rank", "lexical_rank").alias("score"), "k", "over")
    found = F.count("*").over(Window.partitionBy("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ORDER)
    out = both.withColumn("truncated", F.col("over") | (found > F.col("k"))).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= F.col("k")).drop("k", "over")


def hybrid_search(queries: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Dense and lexical candidates of a batch of queries, fused, in one plan."""
    return fuse(queries, dense_topk(queries, chunks), lexical_topk(queries, documents))
