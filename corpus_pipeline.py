"""From raw documents to packed training sequences in five stages, each one of the operators in corpusloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents,
whatever else those hold. Null and empty texts, null ids and an empty table pass through
every stage; without usable labels nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.minhash import near_duplicates
from corpusloom.llm.packing import pack
from corpusloom.llm.pii import redact
from corpusloom.llm.quality import keep_good, train
from corpusloom.llm.shared import materialize
from corpusloom.llm.substring import remove_repeats


def _with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, in the columns and types of ``like``."""
    now = docs.withColumn("n_chars", F.char_length("text"))
    return now.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in like.schema))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject; a null text is judged as an empty one, equal rows alike."""
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id; documents without an id stay.

    An id may repeat: rows equal in id and text are one, the first by their other
    columns, and rows that share an id but not the text are documents of their own.
    """
    known = docs.where("doc_id IS NOT NULL")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id")
        one = docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    else:
        whole = known.select("doc_id", F.sha2("text", 256).alias("hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
        same = Window.partitionBy("doc_id", "hash").orderBy(F.to_json("whole"))
        rows = whole.withColumn("place", F.row_number().over(same)).where("place = 1")
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        groups = near_duplicates(rows.select(F.col("row").alias("doc_id"), "whole.text")).select(F.col("doc_id").alias("row"), "component_id")
        first = rows.select("row", "doc_id", "hash").join(groups, "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "hash", "row")).alias("first"))
        one = rows.join(first.select("first.row"), "row", "left_semi").select("whole.*")
    return one.unionByName(docs.where("doc_id IS NULL"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds too; white space stays as it was.

    Null texts become empty. Rows without an id, and rows that share an id, take no words from each other.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = remove_repeats(docs, carry=others)
    return _with_length(cut.select("doc_id", F.col("kept").alias("text"), *(["carried.*"] if others else [])), docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, equal rows alike; a null text is empty by now."""
    return _with_length(redact(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids; an empty text is one end mark, equal rows are packed each."""
    return pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("pii", pii), ("packing", packing)]

#: Classifier, MinHash and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
