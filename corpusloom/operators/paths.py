"""Paths and their ancestors: normal form, prefixes, nearest configuration and package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_path(c: str | Column) -> Column:
    """Forward slashes, no empty or ``.`` segments; null for NUL, absolute, drive-letter, ``..`` and empty paths."""
    raw = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\\", "/")
    parts = F.filter(F.split(raw, "/"), lambda s: (s != "") & (s != "."))
    bad = F.contains(raw, F.lit("\0")) | F.startswith(raw, F.lit("/")) | raw.rlike("^[A-Za-z]:") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def path_prefix_filter(df: DataFrame, prefix: str | None, column: str = "path") -> DataFrame:
    """Rows at the prefix or below it, never at half a segment."""
    return df if not prefix else df.where((F.col(column) == prefix) | F.startswith(column, F.lit(prefix + "/")))


def language_filter(df: DataFrame, languages: list[str] | None) -> DataFrame:
    return df.where(F.col("language").isin(*languages)) if languages else df


def parent(c: Column) -> Column:
    """The directory of a path; ``.`` at the top."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


def ancestors(c: Column) -> Column:
    """All directories above a path, the top ``.`` first, as structs (dir, depth)."""
    parts = F.split(c, "/")
    below = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), i.alias("depth")))
    top = F.array(F.struct(F.lit(".").alias("dir"), F.lit(0).alias("depth")))
    return F.when(F.size(parts) > 1, F.concat(top, below)).otherwise(top)


def _nearest(files: DataFrame, owners: DataFrame, value: str, rank: Column, default: str | None) -> DataFrame:
    """The owner in the deepest ancestor directory: an equi-join on directories, then one maximum a path."""
    lifted = files.select("project_id", "path", F.explode(ancestors(F.col("path"))).alias("up")).select("project_id", "path", F.col("up.dir").alias("dir"), F.col("up.depth").alias("depth"))
    best = lifted.join(owners, ["project_id", "dir"]).groupBy("project_id", "path").agg(F.max_by(value, F.struct("depth", rank)).alias(value))
    out = files.select("project_id", "path").join(best, ["project_id", "path"], "left")
    return out.withColumn(value, F.coalesce(value, F.lit(default))) if default else out


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """``configs(project_id, path)`` of tsconfig.json and jsconfig.json -> project_id, path, config; tsconfig first."""
    owners = configs.select("project_id", parent(F.col("path")).alias("dir"), F.col("path").alias("config"))
    return _nearest(files, owners, "config", F.endswith("config", F.lit("tsconfig.json")).cast("int"), None)


def nearest_package(files: DataFrame, packages: DataFrame) -> DataFrame:
    """``packages(project_id, root)`` -> project_id, path, root: the deepest package above a path, else ``.``."""
    owners = packages.select("project_id", F.col("root").alias("dir"), "root").distinct()
    return _nearest(files, owners, "root", F.lit(0), ".")
