"""Files of a corpus: fingerprints, languages, hash verification, text limits, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by whole file name and by ending.
NAMES = {"dockerfile": "dockerfile", "gemfile": "ruby", "makefile": "makefile", "procfile": "plaintext"}
ENDINGS = {
    "bash": "shell", "c": "c", "cc": "cpp", "cjs": "javascript", "cpp": "cpp", "cs": "csharp", "css": "css", "csv": "csv", "go": "go", "gql": "graphql", "graphql": "graphql", "h": "c", "hpp": "cpp", "html": "html", "java": "java", "js": "javascript",
    "json": "json", "jsx": "javascriptreact", "kt": "kotlin", "kts": "kotlin", "md": "markdown", "mdx": "mdx", "mjs": "javascript", "php": "php", "prisma": "prisma", "py": "python", "rb": "ruby", "rs": "rust", "scss": "scss", "sh": "shell", "sql": "sql",
    "svelte": "svelte", "swift": "swift", "toml": "toml", "ts": "typescript", "tsx": "typescriptreact", "txt": "plaintext", "vue": "vue", "yaml": "yaml", "yml": "yaml", "zsh": "shell",
}


def classify_language(path: str | Column) -> Column:
    """By the lower-cased file name, then its ending, else plaintext; a leading dot begins no ending."""
    name = F.lower(F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1))
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    ending = F.regexp_extract(name, r"(?s).\.([^.]*)$", 1)
    return F.coalesce(F.try_element_at(table(NAMES), name), F.try_element_at(table(ENDINGS), ending), F.lit("plaintext"))


def fingerprint(files: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """Adds status, skip_reason, content_hash and language to ``(project_id, path, content, size_bytes, modified_at, listed_size, listed_at)``.

    The listed columns are what the inventory saw; where they are absent the file counts as fresh.
    """
    size = F.octet_length("content")
    seen = set(files.columns)
    stale = F.lit(False)
    if "listed_size" in seen:
        stale = stale | (F.col("listed_size") != F.col("size_bytes"))
    if "listed_at" in seen:
        stale = stale | (F.abs(F.unix_millis("modified_at") - F.unix_millis("listed_at")) >= 2)
    reason = F.when(size > max_bytes, "too_large").when(F.coalesce(stale, F.lit(False)), "inventory_stale").when(F.contains("content", F.lit(b"\0")), "binary_content").when(~F.is_valid_utf8("content"), "invalid_utf8")
    out = files.withColumn("skip_reason", reason).withColumn("status", F.when(F.col("skip_reason").isNull(), "ready").otherwise("skipped"))
    return out.withColumn("content_hash", F.when(F.col("status") == "ready", F.sha2("content", 256))).withColumn("language", classify_language("path"))


def hash_verified(reads: DataFrame, catalog: DataFrame) -> DataFrame:
    """Reads with ``verified``: whether their hash is still the cataloged one."""
    known = catalog.select("project_id", "path", F.col("content_hash").alias("catalog_hash"))
    return reads.join(known, ["project_id", "path"], "left").withColumn("verified", F.coalesce(F.sha2("content", 256) == F.col("catalog_hash"), F.lit(False)))


def text_limit_filter(df: DataFrame, column: str, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose text fits, and the count of those omitted by project; texts are never cut."""
    long = F.octet_length(column) > max_bytes
    return df.where(~F.coalesce(long, F.lit(False))), df.groupBy("project_id").agg(F.count_if(long).alias("omitted"))


def redact_projection(df: DataFrame) -> DataFrame:
    """Without text, vectors and absolute paths."""
    return df.drop("content", "text", "embedding", "vector", "root_path", "query_text")


def dedupe_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(least.alias("row")).select(*keys, "row.*")
