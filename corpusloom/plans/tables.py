"""Tables written to the folder that driver and executors share, to end a lineage."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Tables that ``materialize_by`` made, with their keys.
_BUCKETED: WeakKeyDictionary[DataFrame, tuple[str, ...]] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode only, one of our own where it is unset."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends there and survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize_by(df: DataFrame, name: str, keys: list[str], dealt: bool = False) -> DataFrame:
    """As ``materialize``, but bucketed by ``keys``: joins on them, and windows and groups by them and more, need no shuffle.

    A table that this made with the same keys is returned as it is. ``dealt`` tells that
    the rows of a bucket come from few tasks already, where Spark cannot see that they do.
    """
    if _BUCKETED.get(df) == tuple(keys):
        return df
    spark = df.sparkSession
    table, n = f"{name}_{uuid.uuid4().hex}", parts(spark)
    rows = df if dealt else df.repartition(n, *keys)
    # zstd, as the keys of rows are hex digits, which the default leaves as long as they are.
    rows.write.option("path", f"{shared_dir(spark)}/{table}").option("compression", "zstd").bucketBy(n, *keys).saveAsTable(table, format="parquet")
    found = spark.table(table).toDF(*df.columns)  # columns without the table's name: with it, Spark does not see that tables of a union are dealt alike
    spark.sql(f"DROP TABLE {table}")  # the name only, the files stay
    _BUCKETED[found] = tuple(keys)
    return found
