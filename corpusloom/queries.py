"""The registered queries of the library's own operators over the given tables, and their SQL, by name.

The tables hold no code, so documents stand for files (project = source), embeddings and
parts for chunks, orders for runs, conversations for chats and events for generations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import scalar as S
from corpusloom.operators import budgets, catalog, chunks, context, conversations, facts, files, graph, paths, search
from corpusloom.streaming import events as ev

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ENDINGS = ["ts", "py", "md", "go", "txt", "TSX"]


def file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ending)
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select(F.col("source").alias("project_id"), path.alias("path"), F.col("text").cast("binary").alias("content"), "text", "doc_id", F.octet_length("text").cast("long").alias("size_bytes"))


FILES_SQL = """
files AS (
  SELECT source AS project_id, source || '/' || CAST(doc_id AS VARCHAR) || '.' || (['ts', 'py', 'md', 'go', 'txt', 'TSX'])[CAST(doc_id % 6 + 1 AS INTEGER)] AS path,
         (['typescript', 'python', 'markdown', 'go', 'plaintext', 'typescriptreact'])[CAST(doc_id % 6 + 1 AS INTEGER)] AS language,
         text, doc_id, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS content_hash
  FROM documents WHERE text IS NOT NULL
)"""

INDEXED_SQL = f"""WITH {FILES_SQL}, checked AS (
  SELECT *, CASE WHEN size_bytes > 1048576 THEN 'too_large' WHEN contains(text, chr(0)) THEN 'binary_content' END AS reason FROM files
), run AS (
  SELECT *, sum(CASE WHEN reason IS NULL THEN size_bytes ELSE 0 END) OVER (PARTITION BY project_id ORDER BY path ROWS UNBOUNDED PRECEDING) AS total FROM checked
), cut AS (
  SELECT *, max(CASE WHEN reason IS NULL AND total > 268435456 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY path ROWS UNBOUNDED PRECEDING) AS over FROM run
), indexed AS (
  SELECT project_id, path, language, size_bytes, CASE WHEN over = 1 THEN 'run_limit' ELSE reason END AS skip_reason,
         CASE WHEN over = 1 OR reason IS NOT NULL THEN 'skipped' ELSE 'ready' END AS status, CASE WHEN over = 0 AND reason IS NULL THEN content_hash END AS content_hash
  FROM cut
)"""


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = files.fingerprint(file_table(spark, sf_dir)).select("project_id", "path", "language", "size_bytes", "status", "skip_reason", "content_hash")
    return budgets.byte_budget(done, 256 << 20).withColumn("content_hash", F.when(F.col("status") == "ready", F.col("content_hash")))


@register("job1_index_sources", INDEXED_SQL + " SELECT project_id, path, language, size_bytes, skip_reason, status, content_hash FROM indexed")
def job1(spark, sf_dir):
    return indexed(spark, sf_dir)


@register(
    "ag2_source_summary",
    INDEXED_SQL
    + """ SELECT project_id, CAST(count(*) FILTER (status = 'ready') AS BIGINT) AS ready_files, CAST(count(*) FILTER (status <> 'ready') AS BIGINT) AS skipped_files,
    CAST(sum(size_bytes) AS BIGINT) AS inspected_bytes, CAST(coalesce(sum(size_bytes) FILTER (status = 'ready'), 0) AS BIGINT) AS ready_bytes FROM indexed GROUP BY project_id""",
)
def ag2(spark, sf_dir):
    return catalog.source_summary(indexed(spark, sf_dir))


@register("set4_first_of_equal_files", f"WITH {FILES_SQL} SELECT project_id, content_hash, min(doc_id) AS doc_id, arg_min(path, doc_id) AS path FROM files GROUP BY project_id, content_hash")
def set4(spark, sf_dir):
    rows = file_table(spark, sf_dir).select("project_id", F.sha2("content", 256).alias("content_hash"), "doc_id", "path")
    return files.dedupe_by_key(rows, ["project_id", "content_hash"], [F.col("doc_id")])


@register(
    "jn1_reuse_split",
    f"""WITH {FILES_SQL} SELECT project_id, path, (doc_id % 3 = 0 AND doc_id % 4 <> 0 AND doc_id % 7 <> 0) AS reused FROM files""",
)
def jn1(spark, sf_dir):
    now = file_table(spark, sf_dir).select("project_id", "path", F.sha2("content", 256).alias("content_hash"), files.classify_language("path").alias("language"), F.lit("extractor-1:500").alias("extractor"), "doc_id")
    before = now.where("doc_id % 3 = 0").withColumn("status", F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("parsed")).withColumn("extractor", F.when(F.col("doc_id") % 7 == 0, "extractor-1:400").otherwise(F.col("extractor")))
    reused, rest = catalog.reuse_split(now, before, ["project_id", "path", "content_hash", "language", "extractor"], ["parsed"])
    return reused.select("project_id", "path", F.lit(True).alias("reused")).union(rest.select("project_id", "path", F.lit(False).alias("reused")))


@register(
    "snk4_catalog_diff",
    f"""WITH {FILES_SQL} SELECT project_id, path, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'removed' WHEN doc_id % 11 = 0 THEN 'changed' ELSE 'unchanged' END AS change
    FROM files WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0""",
)
def snk4(spark, sf_dir):
    rows = file_table(spark, sf_dir).select("project_id", "path", "doc_id", F.sha2("content", 256).alias("h"))
    new = rows.where("doc_id % 7 <> 0").withColumn("h", F.when(F.col("doc_id") % 11 == 0, F.sha2("h", 256)).otherwise(F.col("h")))
    return catalog.catalog_diff(rows.where("doc_id % 5 <> 0"), new, ["project_id", "path"], "h")


@register(
    "ag11_context_hash",
    f"""WITH {FILES_SQL}, leaves AS (SELECT project_id, sha256(path || chr(0) || content_hash) AS h FROM files),
    counted AS (SELECT project_id, h || ':' || CAST(count(*) AS VARCHAR) AS h FROM leaves GROUP BY project_id, leaves.h),
    low AS (SELECT project_id, substr(h, 1, 6) AS prefix, sha256(string_agg(h, '' ORDER BY h)) AS h FROM counted GROUP BY ALL),
    mid AS (SELECT project_id, substr(prefix, 1, 3) AS prefix, sha256(string_agg(prefix || ':' || h, '' ORDER BY prefix)) AS h FROM low GROUP BY project_id, substr(prefix, 1, 3))
    SELECT project_id, sha256(string_agg(prefix || ':' || h, '' ORDER BY prefix)) AS context_hash FROM mid GROUP BY project_id""",
)
def ag11(spark, sf_dir):
    return catalog.context_hash(file_table(spark, sf_dir).withColumn("h", F.sha2("content", 256)), ["path", "h"])


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.concat(F.lit("label"), F.col("label").cast("string")), F.col("vec_id").cast("string"))
    return table(spark, sf_dir, "embeddings").select(F.lit("p").alias("project_id"), F.col("vec_id").cast("string").alias("chunk_id"), path.alias("path"), F.col("vec_id").alias("start_byte"), F.lit("text").alias("language"), "embedding", "vec_id", "label")


def vector_queries(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = vector_chunks(spark, sf_dir).where("vec_id % 20 = 0")
    prefix = F.when(F.col("vec_id") % 100 == 0, F.concat(F.lit("label"), F.col("label").cast("string")))
    return rows.select(F.col("vec_id").alias("query_id"), "project_id", F.col("embedding").alias("vector"), prefix.alias("path_prefix"), F.lit(None).cast("array<string>").alias("languages"), F.lit(k).alias("k"), "vec_id")


DENSE_SQL = """
v AS (
  SELECT vec_id, 'label' || CAST(label AS VARCHAR) || '/' || CAST(vec_id AS VARCHAR) AS path, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, c.path, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 100 <> 0 OR q.label = c.label WHERE q.vec_id % 20 = 0
), dense AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, vec_id) AS INTEGER) AS dense_rank FROM scored
)"""


@register("tk1_dense_topk", f"WITH {DENSE_SQL} SELECT query_id, CAST(vec_id AS VARCHAR) AS chunk_id, dense_rank, round(score, 6) AS score FROM dense WHERE dense_rank <= 21")
def tk1(spark, sf_dir):
    return search.dense_topk(vector_queries(spark, sf_dir, 5), vector_chunks(spark, sf_dir)).select("query_id", "chunk_id", "dense_rank", F.round("score", 6).alias("score"))


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = S.weighted_document(["p_name"], ["p_brand", "p_type"])
    return table(spark, sf_dir, "part").select(F.lit("p").alias("project_id"), F.col("p_partkey").cast("string").alias("chunk_id"), F.lit("chunk").alias("source"), F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").alias("start_byte"), F.lower("p_type").alias("language"), terms.alias("terms"), "p_partkey", "p_name", "p_type")


def part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "p_name", "p_type")
    return part_documents(spark, sf_dir).where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), "project_id", text.alias("text"), F.lit(None).cast("string").alias("path_prefix"), F.lit(None).cast("array<string>").alias("languages"), F.lit(6).alias("k"))


LEXICAL_SQL = r"""
t AS (
  SELECT p_partkey, p_brand || '/' || CAST(p_partkey AS VARCHAR) AS path, term, max(weight) AS weight FROM (
    SELECT p_partkey, p_brand, unnest(string_split_regex(lower(regexp_replace(p_name, '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+')) AS term, 1.0::DOUBLE AS weight FROM part
    UNION ALL
    SELECT p_partkey, p_brand, unnest(string_split_regex(lower(regexp_replace(p_brand || ' ' || p_type, '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+')), 0.4::DOUBLE FROM part
  ) WHERE term <> '' GROUP BY ALL
), asked AS (
  SELECT DISTINCT p_partkey AS query_id, unnest(string_split_regex(lower(regexp_replace(p_name || ' ' || p_type, '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+')) AS term FROM part WHERE p_partkey % 20 = 0
), n AS (SELECT query_id, count(*) AS n FROM asked WHERE term <> '' GROUP BY query_id),
whole AS (
  SELECT a.query_id, t.p_partkey, t.path, sum(t.weight) AS score FROM asked a JOIN t ON a.term = t.term JOIN n ON n.query_id = a.query_id GROUP BY a.query_id, t.p_partkey, t.path, n.n HAVING count(*) = n.n
), lexical AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, p_partkey) AS INTEGER) AS lexical_rank FROM whole
)"""


@register("tk2_lexical_topk", f"WITH {LEXICAL_SQL} SELECT query_id, CAST(p_partkey AS VARCHAR) AS chunk_id, lexical_rank, round(score, 6) AS score FROM lexical WHERE lexical_rank <= 25")
def tk2(spark, sf_dir):
    return search.lexical_topk(part_queries(spark, sf_dir), part_documents(spark, sf_dir)).select("query_id", "chunk_id", "lexical_rank", F.round("score", 6).alias("score"))


HYBRID_SQL = f"""WITH {DENSE_SQL}, names AS (
  SELECT v.vec_id, v.path, v.label, p.p_name, p.p_type FROM v LEFT JOIN part p ON p.p_partkey = v.vec_id
), lex AS (
  SELECT q.vec_id AS query_id, c.vec_id, c.path, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY c.path, c.vec_id) AS INTEGER) AS lexical_rank
  FROM names q JOIN names c ON lower(q.p_name) = lower(c.p_name) WHERE q.vec_id % 20 = 0 AND (q.vec_id % 100 <> 0 OR q.label = c.label)
), fused AS (
  SELECT coalesce(d.query_id, l.query_id) AS query_id, coalesce(d.vec_id, l.vec_id) AS vec_id, coalesce(d.path, l.path) AS path, d.dense_rank, l.lexical_rank,
         coalesce(1.0::DOUBLE / (60 + d.dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + l.lexical_rank), 0) AS score
  FROM (SELECT * FROM dense WHERE dense_rank <= 20) d FULL JOIN (SELECT * FROM lex WHERE lexical_rank <= 20) l ON d.query_id = l.query_id AND d.vec_id = l.vec_id
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, vec_id) AS INTEGER) AS rank FROM fused)
SELECT query_id, rank, CAST(vec_id AS VARCHAR) AS chunk_id, dense_rank, lexical_rank, round(score, 9) AS score FROM ranked WHERE rank <= 5"""


@register("job14_hybrid_search", HYBRID_SQL)
def job14(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), F.lower("p_name").alias("text"))
    chunk = vector_chunks(spark, sf_dir).join(names, "vec_id", "left")
    asked = vector_queries(spark, sf_dir, 5).join(names, "vec_id", "left")
    terms = F.transform(S.lexical_terms(F.coalesce("text", F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("weight")))
    documents = chunk.select("project_id", "chunk_id", F.lit("chunk").alias("source"), "path", "start_byte", "language", terms.alias("terms"))
    return search.hybrid_search(asked, chunk, documents).select("query_id", "rank", "chunk_id", "dense_rank", "lexical_rank", F.round("score", 9).alias("score"))


@register(
    "wn1_current_run",
    """WITH r AS (SELECT o_custkey AS project_id, o_orderkey AS run_id, o_orderstatus, o_orderdate AS completed_at FROM orders WHERE o_orderstatus IN ('F', 'O')),
    n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY completed_at DESC, run_id DESC) AS n FROM r)
    SELECT project_id, run_id, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'limited' END AS status FROM n WHERE n = 1""",
)
def wn1(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "limited").otherwise("failed")
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.lit("source").alias("stage"), F.col("o_orderkey").alias("run_id"), status.alias("status"), F.col("o_orderdate").alias("completed_at"))
    return catalog.current_run(runs).select("project_id", "run_id", "status")


@register(
    "flt12_catalog_violations",
    """SELECT rule, o_orderkey FROM (
      SELECT CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'known_status' END AS rule, o_orderkey FROM orders
      UNION ALL SELECT CASE WHEN o_totalprice > 400000 THEN 'price_limit' END, o_orderkey FROM orders) WHERE rule IS NOT NULL""",
)
def flt12(spark, sf_dir):
    return catalog.catalog_violations(table(spark, sf_dir, "orders"), {"known_status": F.col("o_orderstatus").isin("F", "O"), "price_limit": F.col("o_totalprice") <= 400_000}, ["o_orderkey"])


def message_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("ordinal"), "role", F.col("text").alias("content"), F.lit("completed").alias("status"))


TOKENS = "(CAST(ceil((length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) / 4.0) AS INTEGER) + 4)"


@register(
    "wn11_complete_turns",
    f"""WITH m AS (SELECT conv_id, turn, role, lag(role) OVER w AS last_role, lag(turn) OVER w AS last_turn, {TOKENS.format("coalesce(text, '')")} AS t, lag({TOKENS.format("coalesce(text, '')")}) OVER w AS last_t
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT conv_id AS session_id, CAST(last_turn AS BIGINT) AS user_ordinal, CAST(turn AS BIGINT) AS assistant_ordinal, CAST(last_t + t AS INTEGER) AS tokens FROM m WHERE role = 'assistant' AND last_role = 'user'),
    s AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY session_id ORDER BY user_ordinal DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM p)
    SELECT * FROM s WHERE spent <= 2560""",
)
def wn11(spark, sf_dir):
    rows = message_table(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("")))
    return conversations.complete_turns(rows, 2560).select("session_id", "user_ordinal", "assistant_ordinal", "tokens", "spent")


@register(
    "job19_model_context",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations),
    b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS m FROM a WHERE n <= 200 AND text <> ''),
    c AS (SELECT *, first(role) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS last_role FROM b WHERE m <= 40)
    SELECT conv_id AS session_id, CAST(turn AS BIGINT) AS ordinal, role FROM c WHERE last_role = 'user'""",
)
def job19(spark, sf_dir):
    return conversations.model_context(message_table(spark, sf_dir), 200, 40).select("session_id", "ordinal", "role")


@register("ag6_session_summaries", "SELECT conv_id AS session_id, max(turn) AS updated_at, count(*) AS message_count FROM conversations GROUP BY conv_id ORDER BY updated_at DESC, session_id DESC LIMIT 50")
def ag6(spark, sf_dir):
    messages = message_table(spark, sf_dir)
    sessions = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.max("turn").alias("updated_at"))
    return conversations.session_summaries(sessions, messages, 50)


SYSTEM = "You answer questions about a code base."


@register(
    "job17_build_prompts",
    f"""WITH c AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text, {TOKENS.format("coalesce(text, '')")} AS t FROM conversations),
    m AS (SELECT *, lag(role) OVER w AS last_role, lag(turn) OVER w AS last_turn, lag(text) OVER w AS last_text, lag(t) OVER w AS last_t FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    s AS (SELECT *, sum(last_t + t) OVER (PARTITION BY conv_id ORDER BY last_turn DESC ROWS UNBOUNDED PRECEDING) AS spent FROM m WHERE role = 'assistant' AND last_role = 'user'),
    q AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS text, arg_max(t, turn) FILTER (role = 'user') + {TOKENS.format(f"'{SYSTEM}'")} AS required, arg_min(text, turn) AS context, arg_min(t, turn) AS ct FROM c GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0),
    b AS (SELECT *, CASE WHEN required <= 6144 AND ct <= least(3072, 6144 - required) THEN ct ELSE 0 END AS used FROM q),
    h AS (SELECT b.conv_id, string_agg(CAST(s.last_turn AS VARCHAR) || ':' || s.last_text || chr(30) || s.text, chr(29) ORDER BY s.last_turn) AS history, max(s.spent) AS spent
      FROM b JOIN s ON s.conv_id = b.conv_id AND s.spent <= 2560 AND s.spent <= least(2560, 6144 - b.required - b.used) GROUP BY b.conv_id)
    SELECT b.conv_id AS query_id, b.conv_id AS session_id, '{SYSTEM}' AS system, CASE WHEN used > 0 THEN context END AS context, CASE WHEN required <= 6144 THEN history END AS history, b.text,
      CASE WHEN required <= 6144 THEN CAST(required + used + coalesce(h.spent, 0) AS BIGINT) END AS tokens, CASE WHEN required > 6144 THEN 'prompt_too_large' END AS error
    FROM b LEFT JOIN h ON h.conv_id = b.conv_id""",
)
def job17(spark, sf_dir):
    rows = message_table(spark, sf_dir).withColumn("content", F.coalesce("content", F.lit("")))
    asked = rows.where("role = 'user'").groupBy("session_id").agg(F.max_by("content", "ordinal").alias("text")).select(F.col("session_id").alias("query_id"), "session_id", "text")
    context_ = rows.groupBy(F.col("session_id").alias("query_id")).agg(F.min_by("content", "ordinal").alias("context"))
    turn = lambda h: F.concat(h["user_ordinal"].cast("string"), F.lit(":"), h["user_content"], F.lit("\x1e"), h["assistant_content"])
    return context.build_prompts(asked, context_, rows, SYSTEM).withColumn("history", F.array_join(F.transform("history", turn), "\x1d"))


def generation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "error").otherwise("delta")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("request_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("event_ts"), kind.alias("type"), F.concat(F.substring("event_type", 1, 1), F.lit(" ")).alias("content"))


EVENTS_SQL = """
e AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS request_id, event_id AS seq, ts AS event_ts,
         CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'delta' END AS type, substr(event_type, 1, 1) || ' ' AS content FROM events
), ends AS (SELECT session_id, request_id, min(seq) AS last FROM e WHERE type <> 'delta' GROUP BY ALL),
kept AS (SELECT e.* FROM e LEFT JOIN ends USING (session_id, request_id) WHERE last IS NULL OR seq <= last)"""


@register(
    "str1_fold_deltas",
    f"""WITH {EVENTS_SQL} SELECT session_id, request_id, coalesce(string_agg(content, '' ORDER BY seq) FILTER (type = 'delta'), '') AS content,
    CASE max(type) FILTER (type <> 'delta') WHEN 'error' THEN 'failed' WHEN 'completed' THEN 'completed' ELSE CASE WHEN count(*) FILTER (type = 'delta') > 0 THEN 'streaming' ELSE 'pending' END END AS status,
    count(*) FILTER (type = 'delta') AS deltas FROM kept GROUP BY session_id, request_id""",
)
def str1(spark, sf_dir):
    return ev.fold_deltas(generation_events(spark, sf_dir))


@register(
    "str5_detect_stalled",
    f"""WITH {EVENTS_SQL}, n AS (SELECT *, coalesce(lead(event_ts) OVER (PARTITION BY session_id, request_id ORDER BY seq), (SELECT max(event_ts) FROM e)) AS next_ts FROM kept)
    SELECT session_id, request_id, epoch_us(min(event_ts)) AS stalled_after FROM n WHERE type = 'delta' AND epoch_us(next_ts) - epoch_us(event_ts) > 330000000 GROUP BY ALL""",
)
def str5(spark, sf_dir):
    return ev.detect_stalled(generation_events(spark, sf_dir)).withColumn("stalled_after", F.unix_micros("stalled_after"))


@register("str3_dedupe_requests", f"WITH {EVENTS_SQL} SELECT session_id, request_id, min(seq) AS seq FROM e GROUP BY ALL")
def str3(spark, sf_dir):
    return ev.dedupe_requests(generation_events(spark, sf_dir).withColumn("event_ts", F.lit(0))).select("session_id", "request_id", "seq")


@register(
    "wn5_per_group_limit",
    """WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST(greatest(c - 3, 0) AS BIGINT) AS omitted FROM n WHERE n <= 3""",
)
def wn5(spark, sf_dir):
    return budgets.per_group_limit(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 3).select("l_orderkey", "l_linenumber", "omitted")


@register("wn6_occurrence_number", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS occurrence FROM lineitem")
def wn6(spark, sf_dir):
    out = budgets.occurrence_number(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("occurrence").cast("int").alias("occurrence"))


RANGES = "SELECT l_orderkey, l_linenumber, CAST(l_linenumber / 3 AS BIGINT) * 100 AS start_byte, CAST(l_linenumber / 3 AS BIGINT) * 100 + 60 + l_partkey % 40 AS end_byte, CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS identity_key FROM lineitem"


def range_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.floor(F.col("l_linenumber") / 3 + F.lit(0.5)).cast("long") * 100
    key = F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", start.alias("start_byte"), (start + 60 + F.col("l_partkey") % 40).alias("end_byte"), key.alias("identity_key"))


@register(
    "wn7_outermost_ranges",
    f"""WITH r AS ({RANGES}), c AS (SELECT *, coalesce(max(end_byte) OVER (PARTITION BY l_orderkey ORDER BY start_byte, end_byte DESC, identity_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered FROM r)
    SELECT l_orderkey, identity_key, start_byte, end_byte FROM c WHERE start_byte >= covered""",
)
def wn7(spark, sf_dir):
    return budgets.outermost_ranges(range_table(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "identity_key", "start_byte", "end_byte")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(by).alias("target")).where("target IS NOT NULL").distinct()
    return pairs.withColumn("edge_key", F.concat_ws(">", F.col("source").cast("string"), F.col("target").cast("string")))


EDGES_SQL = """
pairs AS (
  SELECT DISTINCT source, target FROM (SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS target FROM lineitem) WHERE target IS NOT NULL
)"""


@register(
    "job5_traverse",
    f"""WITH RECURSIVE {EDGES_SQL}, walk AS (
      SELECT DISTINCT source AS start_id, source AS node, 0 AS level FROM pairs
      UNION SELECT w.start_id, p.target, w.level + 1 FROM walk w JOIN pairs p ON p.source = w.node WHERE w.level < 2
    ), reached AS (SELECT start_id, node, min(level) AS level FROM walk GROUP BY ALL)
    SELECT r.start_id, CAST(r.level + 1 AS INTEGER) AS level, CAST(p.source AS VARCHAR) || '>' || CAST(p.target AS VARCHAR) AS edge_key FROM reached r JOIN pairs p ON p.source = r.node WHERE r.level < 2""",
)
def job5(spark, sf_dir):
    edges = part_edges(spark, sf_dir)
    starts = edges.select(F.col("source").alias("start_id"), F.col("source").alias("node")).distinct()
    return graph.traverse(edges, starts, "outgoing", 2).edges.select("start_id", "level", "edge_key")


@register(
    "job5_traverse_capped",
    f"""WITH {EDGES_SQL}, e AS (SELECT *, CAST(source AS VARCHAR) || '>' || CAST(target AS VARCHAR) AS edge_key FROM pairs),
    s AS (SELECT DISTINCT source AS start_id FROM pairs),
    a AS (SELECT start_id, edge_key, target, row_number() OVER (PARTITION BY start_id ORDER BY edge_key) AS pos FROM s JOIN e ON source = start_id),
    a_new AS (SELECT start_id, target, row_number() OVER (PARTITION BY start_id ORDER BY min(pos)) AS nth FROM a WHERE pos <= 12 AND target <> start_id GROUP BY start_id, target),
    a_kept AS (SELECT a.* FROM a LEFT JOIN a_new n USING (start_id, target) WHERE pos <= 12 AND (a.target = start_id OR n.nth <= 8)),
    a_nodes AS (SELECT start_id, start_id AS node, 0 AS nth FROM s UNION ALL SELECT start_id, target, nth FROM a_new WHERE nth <= 8),
    had AS (SELECT s.start_id, count(k.edge_key) AS n, (SELECT count(*) FROM a_nodes x WHERE x.start_id = s.start_id) AS nodes FROM s LEFT JOIN a_kept k USING (start_id) GROUP BY 1),
    b AS (SELECT n.start_id, e.edge_key, e.target, row_number() OVER (PARTITION BY n.start_id ORDER BY e.source, e.edge_key) AS pos, h.n, h.nodes, EXISTS (FROM a_nodes x WHERE x.start_id = n.start_id AND x.node = e.target) AS known
          FROM a_nodes n JOIN had h ON n.start_id = h.start_id AND n.nth > 0 AND h.n < 12 JOIN e ON e.source = n.node),
    b_new AS (SELECT start_id, target, row_number() OVER (PARTITION BY start_id ORDER BY min(pos)) AS nth FROM b WHERE pos + n <= 12 AND NOT known GROUP BY start_id, target),
    b_kept AS (SELECT b.*, known OR coalesce(x.nth + nodes <= 9, FALSE) AS kept FROM b LEFT JOIN b_new x USING (start_id, target) WHERE pos + n <= 12),
    flags AS (SELECT start_id, bool_or(edges) AS edges, bool_or(nodes) AS nodes FROM (
      SELECT start_id, max(pos) > 12 AS edges, count(*) FILTER (pos <= 12) > (SELECT count(*) FROM a_kept k WHERE k.start_id = a.start_id) AS nodes FROM a GROUP BY start_id
      UNION ALL SELECT start_id, max(pos + n) > 12, FALSE FROM b GROUP BY start_id UNION ALL SELECT start_id, FALSE, bool_or(NOT kept) FROM b_kept GROUP BY start_id
      UNION ALL SELECT start_id, TRUE, FALSE FROM had WHERE n >= 12 AND nodes > 1
      UNION ALL SELECT h.start_id, TRUE, FALSE FROM had h JOIN (SELECT start_id, count(*) AS m FROM b_kept WHERE kept GROUP BY 1) k USING (start_id) WHERE h.n + k.m >= 12 AND EXISTS (FROM b_kept y WHERE y.start_id = h.start_id AND y.kept AND NOT y.known)
    ) GROUP BY start_id)
    SELECT start_id, level, edge_key, f.edges AS edge_limit, f.nodes AS node_limit
    FROM (SELECT start_id, 1 AS level, edge_key FROM a_kept UNION ALL SELECT start_id, 2, edge_key FROM b_kept WHERE kept) JOIN flags f USING (start_id)""",
)
def job5_capped(spark, sf_dir):
    edges = part_edges(spark, sf_dir)
    starts = edges.select(F.col("source").alias("start_id"), F.col("source").alias("node")).distinct()
    found = graph.traverse(edges, starts, "outgoing", 2, max_nodes=9, max_edges=12, flags=True)
    limits = found.limits.select("start_id", F.col("edges").alias("edge_limit"), F.col("nodes").alias("node_limit"))
    return found.edges.join(limits, "start_id").select("start_id", "level", "edge_key", "edge_limit", "node_limit")


@register(
    "ag4_edge_summary",
    f"""WITH {EDGES_SQL} SELECT CAST(source % 10 AS BIGINT) AS project_id, count(*) AS edges, CAST(sum(target % 3) AS BIGINT) AS bindings, count(*) FILTER (target % 5 < 2) AS local, count(*) FILTER (target % 5 = 2) AS external,
    count(*) FILTER (target % 5 = 3) AS builtin, count(*) FILTER (target % 5 = 4) AS unresolved FROM pairs GROUP BY 1""",
)
def ag4(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("local", "local", "external", "builtin", "unresolved"))), (F.col("target") % 5 + 1).cast("int"))
    edges = part_edges(spark, sf_dir).select((F.col("source") % 10).alias("project_id"), kind.alias("resolution_kind"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("target") % 3).cast("int")).alias("bindings"))
    return catalog.edge_summary(edges)


@register("flt1_normalize_path", r"SELECT page_id, array_to_string(list_filter(string_split(regexp_extract(url, '://([^?#]*)', 1), '/'), lambda s: s <> '' AND s <> '.'), '/') AS path FROM pages WHERE url IS NOT NULL")
def flt1(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", paths.normalize_path(F.regexp_extract("url", r"://([^?#]*)", 1)).alias("path"))


@register(
    "jn6_nearest_package",
    f"""WITH {FILES_SQL} SELECT f.project_id, f.path, CASE WHEN CAST(substr(f.project_id, 4) AS INTEGER) % 2 = 0 THEN f.project_id ELSE '.' END AS root FROM files f""",
)
def jn6(spark, sf_dir):
    rows = file_table(spark, sf_dir).select("project_id", "path")
    packages = rows.where(F.regexp_extract("project_id", "[0-9]+$", 0).try_cast("int") % 2 == 0).select("project_id", F.col("project_id").alias("root")).distinct()
    return paths.nearest_package(rows, packages)


@register(
    "jn4_resolve_imports",
    """WITH f AS (SELECT source AS project_id, doc_id, 'src/' || CAST(doc_id % 3 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) AS stem, (['.ts', '.tsx', '/index.js'])[CAST(doc_id % 3 + 1 AS INTEGER)] AS ending FROM documents),
    e AS (SELECT *, CAST(doc_id % 5 AS INTEGER) AS way FROM f),
    t AS (SELECT project_id, doc_id, stem || ending AS path FROM f)
    SELECT e.project_id, e.doc_id, CASE e.way WHEN 0 THEN CASE WHEN t.path IS NULL THEN 'unresolved' ELSE 'local' END WHEN 1 THEN 'external' WHEN 2 THEN 'builtin' WHEN 3 THEN 'unresolved' ELSE 'external' END AS resolution_kind,
      CASE WHEN e.way = 0 THEN t.path END AS target_path, CASE e.way WHEN 1 THEN '@scope/name' WHEN 2 THEN 'node:fs/promises' WHEN 4 THEN 'react' END AS external_package,
      CASE e.way WHEN 0 THEN CASE WHEN t.path IS NULL THEN 'not_found' END WHEN 3 THEN 'outside_project' END AS unresolved_reason
    FROM e LEFT JOIN t ON t.project_id = e.project_id AND t.doc_id = e.doc_id - e.doc_id % 20 + (e.doc_id + 20) % 20""",
)
def jn4(spark, sf_dir):
    ending = F.element_at(F.array(F.lit(".ts"), F.lit(".tsx"), F.lit("/index.js")), (F.col("doc_id") % 3 + 1).cast("int"))
    stem = F.concat(F.lit("src/"), (F.col("doc_id") % 3).cast("string"), F.lit("/"), F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), "doc_id", F.concat(stem, ending).alias("path"))
    other = F.col("doc_id") - F.col("doc_id") % 20 + (F.col("doc_id") + 20) % 20
    near = F.concat(F.when(F.endswith("path", F.lit("/index.js")), "../../").otherwise("../"), (other % 3).cast("string"), F.lit("/"), other.cast("string"), F.when(other % 3 == 0, ".js").when(other % 3 == 1, ".jsx").otherwise(""))
    specifier = F.element_at(F.array(near, F.lit("@scope/name/deep/x"), F.lit("fs/promises"), F.lit("../../../../x"), F.lit("react/jsx-runtime")), (F.col("doc_id") % 5 + 1).cast("int"))
    edges = rows.select("project_id", "doc_id", F.col("path").alias("source_path"), specifier.alias("specifier"))
    return graph.resolve_imports(edges, rows).select("project_id", "doc_id", "resolution_kind", "target_path", "external_package", "unresolved_reason")


CHUNKS_SQL = f"""WITH RECURSIVE {FILES_SQL}, body AS (SELECT project_id, path, language, regexp_replace(text, '^\\x{{FEFF}}', '') AS text FROM files),
lines AS (SELECT *, list_transform(string_split(text, chr(10)), lambda l: strlen(l)) AS sizes FROM body),
ended AS (SELECT *, encode(text) AS data, CAST(strlen(text) AS BIGINT) AS size, list_transform(range(1, len(sizes)), lambda i: CAST(list_sum(sizes[1:i]) + i AS BIGINT)) AS ends FROM lines),
cut AS (
  SELECT project_id, path, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM ended
  UNION ALL
  SELECT e.project_id, e.path, c.b, CASE WHEN c.b + 8192 >= e.size THEN e.size ELSE coalesce(list_max(list_filter(e.ends, lambda x: x > c.b AND x <= c.b + 8192)),
    CASE WHEN substr(hex(e.data), 2 * (c.b + 8192) + 1, 2) NOT BETWEEN '80' AND 'BF' THEN c.b + 8192 WHEN substr(hex(e.data), 2 * (c.b + 8191) + 1, 2) NOT BETWEEN '80' AND 'BF' THEN c.b + 8191
         WHEN substr(hex(e.data), 2 * (c.b + 8190) + 1, 2) NOT BETWEEN '80' AND 'BF' THEN c.b + 8190 ELSE c.b + 8189 END) END
  FROM cut c JOIN ended e ON e.project_id = c.project_id AND e.path = c.path WHERE c.b < e.size
),
pieces AS (
  SELECT e.project_id, e.path, e.language, c.a, c.b, decode(e.data[c.a + 1:c.b]) AS content, e.ends, CAST(len(list_filter(e.ends, lambda x: x <= c.a)) AS BIGINT) AS start_line, CAST(len(list_filter(e.ends, lambda x: x <= c.b)) AS BIGINT) AS end_line
  FROM cut c JOIN ended e ON e.project_id = c.project_id AND e.path = c.path WHERE c.a < c.b
),
n AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, path ORDER BY a) - 1 AS ordinal, row_number() OVER (PARTITION BY project_id, path, content ORDER BY a) - 1 AS occurrence, count(*) OVER (PARTITION BY project_id, path) > 500 AS truncated
  FROM pieces WHERE trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
)
SELECT project_id, path, language, CAST(ordinal AS INTEGER) AS ordinal, a AS start_byte, b AS end_byte, start_line, end_line, a - CASE WHEN start_line > 0 THEN ends[start_line] ELSE 0 END AS start_col,
  b - CASE WHEN end_line > 0 THEN ends[end_line] ELSE 0 END AS end_col, CAST(NULL AS VARCHAR) AS owner_key, CAST(occurrence AS INTEGER) AS occurrence, truncated, sha256(content) AS content_hash,
  sha256('chunks-1' || chr(0) || path || chr(0) || sha256(content) || chr(0) || chr(0) || CAST(occurrence AS VARCHAR)) AS identity_key, CAST(NULL AS VARCHAR) AS symbol_name, CAST(NULL AS VARCHAR) AS symbol_kind,
  sha256('file: ' || path || chr(10) || 'language: ' || language || chr(10) || '---' || chr(10) || content) AS input_hash
FROM n WHERE ordinal < 500"""


@register("job12_chunk_sources", CHUNKS_SQL)
def job12(spark, sf_dir):
    rows = file_table(spark, sf_dir).select("project_id", "path", files.classify_language("path").alias("language"), "text")
    return chunks.chunk_sources(rows).drop("content")


@register("sc9_term_counts", r"""SELECT term, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(regexp_replace(text, '([\p{Ll}0-9])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+')) AS term FROM benchmark) WHERE term <> '' GROUP BY term""")
def sc9(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(S.lexical_terms("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def static(kind: str, **parts) -> Column:
    """A static value as JSON text; ``parts`` are columns, JSON text where they hold values."""
    return F.to_json(F.struct(F.lit(kind).alias("kind"), *(c.alias(name) for name, c in parts.items())))


def static_name(*segments) -> Column:
    return static("identifier", reference=F.struct(F.array(*segments).alias("segments")))


def listed(values) -> Column:
    """A static array of a column of JSON texts."""
    return F.concat(F.lit('{"kind":"array","items":['), F.array_join(values, ","), F.lit("]}"))


UNKNOWN = '{"kind":"unknown"}'


def evidence_rows(rows: DataFrame, **given) -> DataFrame:
    """Evidence with the columns that are ``given``, all others null."""
    names = [c.split() for c in facts.EVIDENCE.split(", ")]
    defaults = {"project_id": F.col("project_id"), "path": F.col("path"), "scope_key": F.col("project_id"), "evidence_key": F.concat_ws(":", "kind_", "id_"), "start_byte": F.col("at_")}
    rows = rows.withColumns({"kind_": given.pop("tag"), "id_": given.pop("id").cast("string"), "at_": given.pop("at").cast("long")})
    return rows.select(*((given.get(n, defaults.get(n, F.lit(None)))).cast(t).alias(n) for n, t in names))


def customer_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A file a customer, and its orders with that file."""
    own = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("project_id"), F.concat(F.lit("c/"), F.col("c_custkey").cast("string"), F.lit(".ts")).alias("path"), "c_custkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return own, orders.join(own, "c_custkey")


def file_edges(own: DataFrame, package: str | None, key: str, *bindings: tuple[str, str | None, str]) -> DataFrame:
    names = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(i).cast("string").alias("imported_name"), F.lit(n).alias("local_name"), F.lit(False).alias("type_only")) for k, i, n in bindings))
    return own.select("project_id", F.col("path").alias("source_path"), F.lit(key).alias("edge_key"), F.lit(package).cast("string").alias("external_package"), F.lit(False).alias("type_only"), names.alias("bindings"))


OWNERS = ["module", "controller", "provider", "application", "router", "model"]  # the kinds that relationships start from


def named_links(found: facts.Facts) -> DataFrame:
    names = found.entities.where(F.col("entity_kind").isin(*OWNERS)).select("project_id", "path", F.col("identity_key").alias("source_key"), F.col("name").alias("source_name"))
    return found.relationships.join(names, ["project_id", "path", "source_key"]).select("project_id", "path", "relationship_kind", "source_name", "target_name", "certainty")


CUSTOMER_SQL = """
own AS (SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS project_id, 'c/' || CAST(c_custkey AS VARCHAR) || '.ts' AS path, c_custkey FROM customer),
o AS (SELECT own.*, CAST(o_orderkey AS VARCHAR) AS k, o_orderkey, o_orderstatus FROM orders JOIN own ON o_custkey = c_custkey)"""


@register(
    "job6_nest_facts",
    f"""WITH {CUSTOMER_SQL}
    SELECT project_id, path, 'registers_provider' AS relationship_kind, 'Mod' AS source_name, 'S' || k AS target_name, 'linked' AS certainty FROM o
    UNION ALL SELECT project_id, path, 'registers_controller', 'Mod', 'Ctl', 'linked' FROM own
    UNION ALL SELECT project_id, path, 'imports_module', 'Mod', 'Shared.Lib', 'declared' FROM own
    UNION ALL SELECT project_id, path, 'exports_provider', 'Mod', NULL, 'unresolved' FROM own
    UNION ALL SELECT project_id, path, 'injects', 'Ctl', 'S' || k, 'linked' FROM o WHERE o_orderstatus = 'O'
    UNION ALL SELECT project_id, path, 'handles_route', 'Ctl', 'Ctl.h' || k || ' GET', 'linked' FROM o WHERE o_orderstatus = 'P'""",
)
def job6(spark, sf_dir):
    own, orders = customer_files(spark, sf_dir)
    k = F.col("o_orderkey").cast("string")
    served = orders.groupBy("c_custkey").agg(F.array_sort(F.collect_list(static_name(F.concat(F.lit("S"), k)))).alias("served"))
    told = own.join(served, "c_custkey", "left").withColumn("served", F.coalesce("served", F.array().cast("array<string>")))
    sections = {"imports": listed(F.array(static_name(F.lit("Lib"), F.lit("Lib")))), "controllers": listed(F.array(static_name(F.lit("Ctl")))), "providers": listed("served"), "exports": F.lit(UNKNOWN)}
    module = F.concat(F.lit('{"kind":"object","properties":['), F.concat_ws(",", *(F.concat(F.lit('{"key":"' + s + '","value":'), v, F.lit("}")) for s, v in sections.items())), F.lit("]}"))
    mark = {"kind": F.lit("decorator"), "target_kind": F.lit("class")}
    rows = evidence_rows(told, tag=F.lit("m"), id=F.lit(0), at=F.lit(0), reference=F.array(F.lit("Module")), target_name=F.lit("Mod"), arguments=F.array(module), **mark)
    rows = rows.unionByName(evidence_rows(own, tag=F.lit("c"), id=F.lit(0), at=F.lit(1), reference=F.array(F.lit("Controller")), target_name=F.lit("Ctl"), arguments=F.array(static("string", value=F.col("path"))), **mark))
    rows = rows.unionByName(evidence_rows(orders.where("o_orderstatus = 'F'"), tag=F.lit("i"), id=k, at=F.col("o_orderkey") + 2, reference=F.array(F.lit("N"), F.lit("Injectable")), target_name=F.concat(F.lit("S"), k), arguments=F.array().cast("array<string>"), **mark))
    rows = rows.unionByName(evidence_rows(orders.where("o_orderstatus = 'O'"), tag=F.lit("p"), id=k, at=F.col("o_orderkey") + 2, kind=F.lit("constructor_parameter"), owner_name=F.lit("Ctl"), parameter_index=F.col("o_orderkey"), reference=F.array(F.concat(F.lit("S"), k))))
    rows = rows.unionByName(evidence_rows(orders.where("o_orderstatus = 'P'"), tag=F.lit("r"), id=k, at=F.col("o_orderkey") + 2, kind=F.lit("decorator"), reference=F.array(F.lit("Get")), target_kind=F.lit("method"), owner_name=F.lit("Ctl"), target_name=F.concat(F.lit("h"), k), arguments=F.array(static("string", value=k))))
    common = file_edges(own, "@nestjs/common", "e1", ("named", "Module", "Module"), ("named", "Controller", "Controller"), ("named", "Get", "Get"), ("namespace", None, "N"))
    return named_links(facts.nest_facts(rows, common.unionByName(file_edges(own, None, "e2", ("named", "Shared", "Lib")))))


@register(
    "job7_express_facts",
    f"""WITH {CUSTOMER_SQL}
    SELECT project_id, path, 'mounts_router' AS relationship_kind, 'app' AS source_name, 'router' AS target_name, 'linked' AS certainty FROM own
    UNION ALL SELECT project_id, path, 'handles_route', 'app', 'app.GET /o/' || k, 'linked' FROM o WHERE o_orderstatus = 'F'
    UNION ALL SELECT project_id, path, 'handles_route', 'router', 'router.POST dynamic', 'unresolved' FROM o WHERE o_orderstatus = 'P'
    UNION ALL SELECT project_id, path, 'uses_middleware', 'app', 'app.middleware.inline.0', 'linked' FROM o WHERE o_orderstatus = 'O'""",
)
def job7(spark, sf_dir):
    own, orders = customer_files(spark, sf_dir)
    k, at = F.col("o_orderkey").cast("string"), F.col("o_orderkey") + 9
    call = lambda rows, name, at, *segments, **given: evidence_rows(rows, tag=F.lit(name), at=at, kind=F.lit("call_expression"), reference=F.array(*map(F.lit, segments)), **given)
    rows = call(own, "a", F.lit(0), "express", id=F.lit(0), assigned_name=F.lit("app"))
    rows = rows.unionByName(call(own, "b", F.lit(1), "express", "Router", id=F.lit(0), assigned_name=F.lit("router")))
    rows = rows.unionByName(call(own, "c", F.lit(2), "app", "use", id=F.lit(0), arguments=F.array(static("string", value=F.lit("/api")), static_name(F.lit("router")))))
    rows = rows.unionByName(call(orders.where("o_orderstatus = 'F'"), "f", at, "app", "get", id=k, arguments=F.array(static("string", value=F.concat(F.lit("o//"), k)), static_name(F.lit("one")))))
    rows = rows.unionByName(call(orders.where("o_orderstatus = 'P'"), "p", at, "router", "post", id=k, arguments=F.array(F.lit(UNKNOWN), static_name(F.lit("two")))))
    rows = rows.unionByName(call(orders.where("o_orderstatus = 'O'"), "o", at, "app", "use", id=k, arguments=F.array(F.lit(UNKNOWN)), parameter_counts=F.array(F.lit(4))))
    return named_links(facts.express_facts(rows, file_edges(own, "express", "e1", ("default", None, "express"))))


@register(
    "job10_sequelize_facts",
    f"""WITH {CUSTOMER_SQL}, n AS (SELECT *, lead(k) OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS next FROM o)
    SELECT project_id, path, 'associates' AS relationship_kind, 'Order' || k AS source_name, coalesce('Order' || next, 'Missing') AS target_name, CASE WHEN next IS NULL THEN 'declared' ELSE 'linked' END AS certainty FROM n
    UNION ALL SELECT project_id, path, 'defines_attribute', 'Order' || k, 'Order' || k || '.line' || CAST(l_linenumber AS VARCHAR), CASE WHEN l_returnflag = 'N' THEN 'unresolved' ELSE 'declared' END FROM o JOIN lineitem ON l_orderkey = o_orderkey""",
)
def job10(spark, sf_dir):
    own, orders = customer_files(spark, sf_dir)
    k = F.col("o_orderkey").cast("string")
    later = F.lead("o_orderkey").over(Window.partitionBy("c_custkey").orderBy("o_orderkey")).cast("string")
    orders = orders.withColumn("model", F.concat(F.lit("Order"), k)).withColumn("next", F.coalesce(F.concat(F.lit("Order"), later), F.lit("Missing")))
    value = F.when(F.col("l_returnflag") == "N", F.lit(UNKNOWN)).otherwise(static_name(F.lit("DataTypes"), F.lit("STRING")))
    line = F.concat(F.lit('{"key":"line'), F.col("l_linenumber").cast("string"), F.lit('","value":'), value, F.lit("}"))
    fields = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    filled = F.concat(F.lit('{"kind":"object","properties":['), F.array_join("lines", ","), F.lit("]}"))
    rows = evidence_rows(orders, tag=F.lit("c"), id=k, at=F.col("o_orderkey"), kind=F.lit("class_heritage"), target_name=F.col("model"), reference=F.array(F.lit("Model")))
    rows = rows.unionByName(evidence_rows(orders.join(fields, "o_orderkey"), tag=F.lit("i"), id=k, at=F.col("o_orderkey"), kind=F.lit("call_expression"), owner_name=F.col("model"), reference=F.array(F.lit("this"), F.lit("init")), arguments=F.array(filled)))
    rows = rows.unionByName(evidence_rows(orders, tag=F.lit("a"), id=k, at=F.col("o_orderkey"), kind=F.lit("call_expression"), reference=F.array(F.col("model"), F.lit("belongsTo")), arguments=F.array(static_name(F.col("next")))))
    return named_links(facts.sequelize_facts(rows, file_edges(own, "sequelize", "e1", ("named", "Model", "Model"))))


from corpusloom import code_queries  # noqa: E402, F401 registers the queries over source text
