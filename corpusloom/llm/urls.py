"""URL filtering with DataFrame operations: listed rules first, then association rules mined by FP-growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import materialize

#: (action, host, path): a rule fits its host and all subdomains, where the path starts with its own.
LISTED = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both are empty for a null url or one without ``://``."""
    at = F.coalesce(F.instr("url", "://"), F.lit(0))
    rest = F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length("url")), r"^[^?#]*", 0)
    return pages.withColumn("host", F.translate(raw, UPPER, LOWER)).withColumn("path", F.when(at > 0, path).otherwise(""))


def listed_rule(rules: list[tuple[str, str, str]]):
    """The longest listed rule that fits host and path, as a struct of rule and action; null where none does."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def tokens():
    """The distinct tokens of a URL: host and its parent domains, path segments (digits as 0), the ending, query keys and scheme."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, n - i + 1, i), ".")))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    words = F.transform(segments, lambda s: F.concat(F.lit("path:"), F.regexp_replace(F.lower(s), r"[0-9]+", "0")))
    ending = F.array(F.concat(F.lit("ending:"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1))))
    keys = F.transform(F.filter(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda s: s != ""), lambda s: F.concat(F.lit("key:"), F.regexp_extract(s, r"^[^=]*", 0)))
    every = F.concat(domains, words, F.when(ending[0] != "ending:", ending).otherwise(F.array().cast("array<string>")), keys, F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract("url", r"^[A-Za-z]*", 0)))))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


RULES = "tokens array<string>, class string, confidence double, certainty double, support double"


def mine(pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_certainty: float = 0.1) -> DataFrame:
    """Token combinations that foretell a label: tokens, class, confidence, certainty, support.

    ``pages(page_id, url)`` meets ``labels(doc_id, quality)`` on the id; quality 0 is
    class block and 1 allow, the lower one where an id has both. FP-growth runs over all
    labelled pages. ``certainty`` is how far the confidence of a rule goes from the
    share of its class among them towards 1, (confidence - share) / (1 - share), so that
    a rare class needs no higher confidence than a common one. Rules are kept from
    ``min_support`` and ``min_certainty`` on, unless some part of their tokens foretells
    the class as well or better.

    Null ids, labels and URLs without a host are left out; without labelled pages of
    both classes there are no rules.
    """
    spark = pages.sparkSession
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("quality"))
    named = F.when(F.col("quality") == 0, "class:block").otherwise("class:allow")
    found = with_parts(pages.select("page_id", "url")).join(known, "page_id").select(tokens().alias("tokens"), named.alias("named"))
    baskets = materialize(found.where(F.size("tokens") > 0).select(F.array_append("tokens", F.col("named")).alias("items")), "baskets")
    share = baskets.agg(F.avg(F.array_contains("items", "class:block").cast("double"))).first()[0]
    if not share or share == 1:
        return spark.createDataFrame([], RULES)
    floor = {"class:block": share, "class:allow": 1 - share}
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_certainty + (1 - min_certainty) * min(floor.values())).fit(baskets)
    class_ = F.col("consequent")[0]
    certainty = F.when(class_ == "class:block", (F.col("confidence") - share) / (1 - share)).when(class_ == "class:allow", (F.col("confidence") - (1 - share)) / share)
    rules = model.associationRules.withColumn("certainty", certainty).where(F.col("certainty") >= min_certainty)
    rules = materialize(rules.select(F.sort_array("antecedent").alias("tokens"), F.substring(class_, 7, 9).alias("class"), "confidence", "certainty", "support"), "mined-rules")
    parts = indexed(rules).select("token", F.col("tokens").alias("part"), "class", F.col("confidence").alias("as_well"))
    held = rules.withColumn("token", F.explode("tokens")).join(parts, ["token", "class"])
    idle = held.where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("as_well") >= F.col("confidence")))
    return rules.join(idle.select("tokens", "class").distinct(), ["tokens", "class"], "left_anti").select("tokens", "class", "confidence", "certainty", "support")


def indexed(rules: DataFrame) -> DataFrame:
    """Each rule with ``token``, that of its tokens which the fewest rules hold."""
    often = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("often"))
    rarest = rules.select("tokens", F.explode(F.array_distinct("tokens")).alias("token")).join(often, "token").groupBy("tokens").agg(F.min(F.struct("often", "token")).alias("first"))
    return rules.join(rarest.select("tokens", F.col("first.token").alias("token")), "tokens")


def judge(pages: DataFrame, mined: DataFrame, rules: list[tuple[str, str, str]] = LISTED) -> DataFrame:
    """``pages(page_id, url)`` -> page_id, host, path, rule, verdict, mined_rule, certainty.

    The longest listed rule decides; else the mined rule with the highest certainty,
    then support, then the first by its tokens, whose tokens the URL all has
    (``mined_rule``, joined by " & "); else the verdict is allow. Mined rules are found
    through an index by their rarest token, so that a URL meets only rules that start
    from one of its tokens; each distinct URL is matched once.

    A null url or one without ``://`` has empty host and path and is allowed. Repeated
    rows give repeated rows; page_id may be null. Other columns are not read. An empty
    table gives no rows.
    """
    parts = with_parts(pages.select("page_id", "url")).withColumn("listed", listed_rule(rules))
    urls = parts.where("listed IS NULL AND host <> ''").select("url", "host", "path").distinct().withColumn("own", tokens())
    hits = urls.select("url", "own", F.explode("own").alias("token")).join(indexed(mined), "token").where(F.size(F.array_except("tokens", "own")) == 0)
    first = F.struct((-F.col("certainty")).alias("c"), (-F.col("support")).alias("s"), "tokens", "class", "certainty")
    best = hits.groupBy("url").agg(F.min(first).alias("best"))
    out = parts.join(best, "url", "left")
    verdict = F.coalesce("listed.action", "best.class", F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), F.array_join("best.tokens", " & ").alias("mined_rule"), F.col("best.certainty").alias("certainty"))


def op6_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, mine(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))
