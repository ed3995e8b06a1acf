"""Queries of the operators that read source text. The given tables hold no code, so Spark writes a file a customer from its orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import budgets, evidence, facts, graph, imports, symbols
from corpusloom.plans.tables import materialize, materialize_by, parts, shared_dir
from corpusloom.queries import register, table
from corpusloom.sources import sinks

FILE = ["project_id", "path"]
HEAD = 'import { Controller, Get } from "@nestjs/common";\n'
#: A class with one route for each order; the SQL below builds the same text.
PIECE = [
    '@Controller("c', "key", '")\nexport class C', "key", ' {\n  @Get("', "status", '")\n  m', "key", "() {\n    return load(", "small", ");\n  }\n}\n",
]


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project_id, path, language and text of a file for each customer."""
    own = {"key": F.col("o_orderkey").cast("string"), "status": F.col("o_orderstatus"), "small": (F.col("o_orderkey") % 100).cast("string")}
    piece = F.concat(*(own.get(part, F.lit(part)) for part in PIECE))
    path = F.concat(F.lit("src/c"), F.col("o_custkey").cast("string"), F.lit(".ts"))
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).cast("string").alias("project_id"), path.alias("path"), F.struct("o_orderkey", piece.alias("piece")).alias("one"))
    text = F.concat(F.lit(HEAD), F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["piece"]), ""))
    # Reading a text costs far more than its bytes tell, so its partitions are not merged by their size.
    files = rows.repartition(parts(spark), *FILE).groupBy(*FILE).agg(text.alias("text"))
    return files.select(*FILE, F.lit("typescript").alias("language"), "text")


def _text(part: str) -> str:
    return {"key": "CAST(o_orderkey AS VARCHAR)", "status": "o_orderstatus", "small": "CAST(o_orderkey % 100 AS VARCHAR)"}.get(part, "'" + part.replace("'", "''") + "'")


PIECES_SQL = f"""WITH p AS (
  SELECT CAST(o_custkey % 25 AS VARCHAR) AS project_id, 'src/c' || CAST(o_custkey AS VARCHAR) || '.ts' AS path, o_custkey, o_orderkey, o_orderstatus, CAST(o_orderkey AS VARCHAR) AS k, {" || ".join(map(_text, PIECE))} AS piece FROM orders
), b AS (
  SELECT *, CAST({len(HEAD)} + coalesce(sum(strlen(piece)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM p
)"""


@register(
    "fn3_extract_symbols",
    f"""{PIECES_SQL}
SELECT project_id, path, 'class' AS kind, 'C' || k AS qualified_name, TRUE AS exported, base + instr(piece, 'class ') - 1 AS start_byte, base + strlen(piece) - 1 AS end_byte FROM b
UNION ALL SELECT project_id, path, 'method', 'C' || k || '.m' || k, FALSE, base + instr(piece, '  m' || k) + 1, base + strlen(piece) - 3 FROM b""",
)
def fn3(spark, sf_dir):
    found = symbols.build_symbols(evidence.extract_symbols(order_files(spark, sf_dir)))
    return found.select("project_id", "path", "kind", "qualified_name", "exported", "start_byte", "end_byte")


@register(
    "fn4_extract_evidence",
    f"""{PIECES_SQL}, e AS (
  SELECT b.*, x.* FROM b, (VALUES (1, 'decorator', 'Controller', 'class'), (2, 'call_expression', 'Controller', NULL), (3, 'decorator', 'Get', 'method'), (4, 'call_expression', 'Get', NULL), (5, 'call_expression', 'load', NULL)) x(n, kind, reference, target_kind)
)
SELECT project_id, path, kind, reference, target_kind, CASE WHEN n <> 2 THEN 'C' || k END AS owner_name, CASE n WHEN 3 THEN 'm' || k END AS member_name, CASE n WHEN 1 THEN 'C' || k WHEN 3 THEN 'm' || k END AS target_name,
  CASE WHEN n < 3 THEN '{{"kind":"string","value":"c' || k || '"}}' WHEN n < 5 THEN '{{"kind":"string","value":"' || o_orderstatus || '"}}' ELSE '{{"kind":"number","value":' || CAST(o_orderkey % 100 AS VARCHAR) || '}}' END AS argument,
  base + CASE n WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 5 THEN instr(piece, 'load(') - 1 ELSE instr(piece, '@Get') + n - 4 END AS start_byte
FROM e""",
)
def fn4(spark, sf_dir):
    found, _ = evidence.extract_evidence(order_files(spark, sf_dir))
    return found.select("project_id", "path", "kind", F.array_join("reference", ".").alias("reference"), "target_kind", "owner_name", "member_name", "target_name", F.get("arguments", F.lit(0)).alias("argument"), "start_byte")


def order_project(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Files, packages, resolved edges, evidence and symbols of those files; texts and symbols are written once, as several facts read them."""
    # Not bucketed: Spark would take the deal below for done, but read small buckets in few tasks, of which each sorts what it finds for all its buckets.
    files = materialize(order_files(spark, sf_dir), "files", "zstd")
    packages = files.select("project_id").distinct().select("project_id", F.lit("package.json").alias("path"), F.lit('{"dependencies": {"@nestjs/common": "11"}}').alias("text"))
    found, _ = evidence.extract_evidence(files, dealt=True)
    named = symbols.build_symbols(evidence.extract_symbols(files)).drop("language", "parent_key", "occurrence")
    edges = graph.resolve_imports(imports.extract_dependencies(files), files.select("project_id", "path"))
    return {"files": files.select("project_id", "path"), "packages": packages, "edges": edges, "evidence": found.drop("end_byte"), "symbols": materialize_by(named, "symbols", FILE, dealt=True)}


@register(
    "job11_index_frameworks",
    f"""{PIECES_SQL}, f AS (
  SELECT b.*, 'C' || k AS class, 'm' || k AS handler, base + instr(piece, '@Get') - 1 AS got FROM b
)
SELECT project_id, path, 'entity' AS fact, 'controller' AS kind, class AS name, NULL AS source_name, 'declared' AS certainty, class AS symbol, '{{"dynamic_path":false,"paths":["/c' || k || '"]}}' AS attributes, base AS start_byte FROM f
UNION ALL SELECT project_id, path, 'entity', 'route', class || '.' || handler || ' GET', NULL, 'declared', class || '.' || handler,
  '{{"method":"GET","dynamic_path":false,"full_paths":["/c' || k || '/' || o_orderstatus || '"],"controller":"' || class || '","handler":"' || handler || '"}}', got FROM f
UNION ALL SELECT project_id, path, 'relationship', 'handles_route', class || '.' || handler || ' GET', class, 'linked', class || '.' || handler, '{{"method":"GET"}}', got FROM f""",
)
def job11(spark, sf_dir):
    _, found = facts.index_frameworks(**order_project(spark, sf_dir))
    shown = ["certainty", "symbol", "attributes", "start_byte"]
    rows = found.entities.select(*FILE, F.lit("entity").alias("fact"), F.col("entity_kind").alias("kind"), "name", F.lit(None).cast("string").alias("source_name"), *shown)
    return rows.unionByName(found.relationships.select(*FILE, F.lit("relationship").alias("fact"), F.col("relationship_kind").alias("kind"), F.col("target_name").alias("name"), "source_name", *shown))


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as imports: a file an order, a project a twentieth of the orders."""
    lines = table(spark, sf_dir, "lineitem")
    path = F.lpad(F.col("l_orderkey").cast("string"), 12, "0")
    key = F.concat_ws("-", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.col("l_shipdate").cast("date").cast("string"))
    return lines.select((F.col("l_orderkey") % 20).cast("string").alias("project_id"), path.alias("source_path"), F.col("l_linenumber").alias("start_byte"), key.alias("edge_key"), (F.col("l_quantity").cast("int") % 6).alias("n_bindings"))


LINES_SQL = """e AS (
  SELECT CAST(l_orderkey % 20 AS VARCHAR) AS project_id, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS source_path, l_linenumber AS start_byte,
    concat_ws('-', l_partkey, l_suppkey, CAST(l_quantity AS INTEGER), CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS edge_key, CAST(l_quantity AS INTEGER) % 6 AS n_bindings FROM lineitem
), pre AS (
  SELECT *, row_number() OVER w AS pos, sum(n_bindings) OVER (w ROWS UNBOUNDED PRECEDING) AS sum FROM e WINDOW w AS (PARTITION BY project_id, source_path ORDER BY start_byte, edge_key)
)"""


@register(
    "wn4_saturating_budget",
    f"""WITH {LINES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY source_path, start_byte, edge_key) AS place, count(*) OVER (PARTITION BY project_id) AS total FROM e)
    SELECT project_id, source_path, start_byte, edge_key, total - 200 AS omitted, CASE WHEN total > 200 THEN 'limited' ELSE 'completed' END AS status FROM n WHERE place <= 200""",
)
def wn4(spark, sf_dir):
    kept, status = budgets.saturating_budget(line_edges(spark, sf_dir), ["source_path", "start_byte", "edge_key"], 200)
    return kept.join(status, "project_id").select("project_id", "source_path", "start_byte", "edge_key", "omitted", "status")


@register(
    "job4_recovering_budget",
    f"""WITH RECURSIVE {LINES_SQL}, f AS (
      SELECT project_id, source_path, count(*) AS n_edges, sum(n_bindings) AS n_bindings, row_number() OVER (PARTITION BY project_id ORDER BY source_path) AS i FROM e GROUP BY project_id, source_path
    ), step AS (
      SELECT p.project_id, CAST(0 AS BIGINT) AS i, CAST(150 AS BIGINT) AS e, CAST(240 AS BIGINT) AS r, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS b FROM (SELECT DISTINCT project_id FROM f) p
      UNION ALL
      SELECT s.project_id, s.i + 1, s.e - t.k, s.r - t.b, t.k, t.b FROM step s JOIN f ON f.project_id = s.project_id AND f.i = s.i + 1,
        LATERAL (SELECT CAST(coalesce(max(pos), 0) AS BIGINT) AS k, CAST(coalesce(max(sum), 0) AS BIGINT) AS b FROM pre WHERE pre.project_id = f.project_id AND pre.source_path = f.source_path AND s.e > 0 AND s.r > 0 AND pos <= s.e AND sum <= s.r) t
    )
    SELECT f.project_id, f.source_path, n_edges, k AS kept_edges, CAST(n_bindings AS BIGINT) AS n_bindings, b AS kept_bindings FROM f JOIN step USING (project_id, i)""",
)
def job4_budget(spark, sf_dir):
    _, found = budgets.recovering_budget(line_edges(spark, sf_dir), 150, 240)
    return found.select("project_id", "source_path", "n_edges", "kept_edges", "n_bindings", "kept_bindings")


@register(
    "snk1_publish",
    """WITH o AS (SELECT CAST(o_custkey % 25 AS VARCHAR) AS project_id, o_orderkey AS path, o_totalprice AS price FROM orders)
    SELECT project_id, path, CASE WHEN CAST(project_id AS INTEGER) < 10 THEN price + 1 ELSE price END AS price, CASE WHEN CAST(project_id AS INTEGER) < 10 THEN 'second' ELSE 'first' END AS run_id,
      sha256('orders' || chr(0) || project_id || chr(0) || CAST(path AS VARCHAR)) AS id
    FROM o WHERE CASE WHEN CAST(project_id AS INTEGER) < 10 THEN path % 3 = 0 ELSE path % 2 = 0 END""",
)
def snk1(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).cast("string").alias("project_id"), F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("price"))
    path = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    keys = ["project_id", "path"]
    sinks.publish(rows.where("path % 2 = 0"), rows.select("project_id"), "orders", keys, "first", path)
    again = rows.where("CAST(project_id AS INT) < 10")
    sinks.write_run(again.where("path % 5 = 0"), "orders", keys, "broken", path)  # a run that never comes to its pointers
    return sinks.publish(again.where("path % 3 = 0").withColumn("price", F.col("price") + 1), again.select("project_id"), "orders", keys, "second", path)


@register(
    "tk5_paged",
    """SELECT o_orderdate, o_orderkey, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1995-06-30') > 100 AS has_more
    FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1995-06-30' ORDER BY o_orderdate, o_orderkey LIMIT 100""",
)
def tk5(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    last = F.lit("1995-06-30").cast(dict(rows.dtypes)["o_orderdate"])
    return budgets.paged(rows, ["o_orderdate", "o_orderkey"], 100, (last, 1 << 60))


@register(
    "jn4_nearest_aliases",
    """WITH f AS (SELECT source AS project_id, doc_id, doc_id % 3 AS k, 'pkg' || CAST(doc_id % 3 AS VARCHAR) || '/src/' || CAST(doc_id AS VARCHAR) || '.ts' AS path FROM documents WHERE text IS NOT NULL)
    SELECT a.project_id, a.path AS source_path, 'app/' || CAST(a.doc_id + 3 AS VARCHAR) AS specifier, CASE WHEN a.k = 2 THEN 'external' WHEN b.path IS NULL THEN 'unresolved' ELSE 'local' END AS resolution_kind,
      CASE WHEN a.k < 2 THEN b.path END AS target_path, CASE WHEN a.k = 2 THEN 'app' END AS external_package, CASE WHEN a.k < 2 AND b.path IS NULL THEN 'not_found' END AS unresolved_reason
    FROM f a LEFT JOIN f b ON a.project_id IS NOT DISTINCT FROM b.project_id AND b.doc_id = a.doc_id + 3""",
)
def jn4_scoped(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    folder = F.concat(F.lit("pkg"), (F.col("doc_id") % 3).cast("string"))
    files = docs.select(F.col("source").alias("project_id"), F.concat(folder, F.lit("/src/"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), "doc_id")
    edges = files.select("project_id", F.col("path").alias("source_path"), F.concat(F.lit("app/"), (F.col("doc_id") + 3).cast("string")).alias("specifier"))
    text = F.lit('{"compilerOptions": {"baseUrl": "src", "paths": {"app/*": ["*"]}}}')
    each = F.explode(F.array(F.lit("pkg0/tsconfig.json"), F.lit("pkg1/tsconfig.json")))
    configs = files.select("project_id").distinct().select("project_id", each.alias("path"), text.alias("text"))
    return graph.resolve_imports(edges, files, graph.config_aliases(configs), configs.select("project_id", "path"))
