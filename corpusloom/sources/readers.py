"""Readers of repositories and chat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.paths import normalize_path


def _files(spark: SparkSession, root: str, project_id: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    base = root.rstrip("/") + "/"
    inner = F.substring_index(F.col("path"), base.split(":", 1)[-1] if ":" in base[:8] else base, -1)
    return reader.load(root).withColumn("path", normalize_path(inner)).withColumn("project_id", F.lit(project_id))


def read_listing(spark: SparkSession, root: str, project_id: str, glob: str | None = None) -> DataFrame:
    """project_id, path, size_bytes, modified_at of every file; contents are not read."""
    return _files(spark, root, project_id, glob).select("project_id", "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def read_sources(spark: SparkSession, root: str, project_id: str, max_bytes: int = 1 << 20, glob: str | None = None) -> DataFrame:
    """The same with contents, of files up to ``max_bytes``; the length is filtered before contents are read."""
    rows = _files(spark, root, project_id, glob).where(F.col("length") <= max_bytes)
    return rows.select("project_id", "path", "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def _metadata(files: DataFrame, names: str, sources: DataFrame | None, max_bytes: int) -> DataFrame:
    found = files.where(F.element_at(F.split("path", "/"), -1).rlike(names)).where(F.octet_length("content") <= max_bytes)
    if sources is not None:
        known = sources.select("project_id", "path", F.col("content_hash").alias("known_hash"))
        found = found.join(known, ["project_id", "path"]).where(F.sha2("content", 256) == F.col("known_hash")).drop("known_hash")
    return found.withColumn("text", F.col("content").cast("string"))


def read_package_metadata(files: DataFrame, sources: DataFrame | None = None, max_bytes: int = 1 << 18) -> DataFrame:
    """package.json files of ``files(project_id, path, content)`` as text, up to ``max_bytes``.

    With ``sources(project_id, path, content_hash)`` only those whose content is still
    the one that was indexed.
    """
    return _metadata(files, r"^package\.json$", sources, max_bytes)


def read_resolver_metadata(files: DataFrame, sources: DataFrame | None = None, max_bytes: int = 1 << 18) -> DataFrame:
    """The same with tsconfig*.json and jsconfig*.json files, too: all that import resolution reads."""
    return _metadata(files, r"^(package|[tj]sconfig[^/]*)\.json$", sources, max_bytes)


MESSAGES = "session_id string, ordinal long, role string, content string, status string"
SESSIONS = "session_id string, title string"


def _checked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table that has at least the columns of ``schema``, in those types; other columns stay."""
    rows = spark.read.parquet(path)
    have = dict(rows.dtypes)
    wrong = [c for c in schema.split(", ") if have.get(c.split()[0], "").replace("bigint", "long") != c.split()[1]]
    if wrong:
        raise ValueError(f"{path} lacks {', '.join(wrong)}")
    return rows


def read_messages(spark: SparkSession, path: str, schema: str = MESSAGES) -> DataFrame:
    """Messages of chats; a table without the columns of ``schema`` is refused before any job runs."""
    return _checked(spark, path, schema)


def read_sessions(spark: SparkSession, path: str, schema: str = SESSIONS) -> DataFrame:
    return _checked(spark, path, schema)
