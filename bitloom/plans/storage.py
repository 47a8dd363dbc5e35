"""Where intermediate tables go.

Anything that must not be computed twice (a layout whose row numbers are used
later, a round of an iterative job) is written as Parquet below the shared
folder the session names in ``spark.checkpoint.dir``. A written table survives
the loss of executors, is read column by column, and gives the optimizer a real
size on which to choose a join.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, taken from the session's settings.

    ``spark.checkpoint.dir`` or the context's checkpoint folder; a session that
    names neither keeps them in its warehouse, unless that is a folder of one
    machine and the session runs on several.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if re.match(r"file:|/", warehouse) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/intermediate"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/bitloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


_named: dict[str, list[str]] = {}  # catalog tables by application


def remember_table(spark: SparkSession, name: str) -> None:
    """Have `drop_intermediate` drop a catalog table whose files lie among the intermediate ones."""
    _named.setdefault(spark.sparkContext.applicationId, []).append(name)


def drop_intermediate(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result needs them any more."""
    for name in _named.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, label: str, rows_left: int = 4096) -> DataFrame:
    """``df`` as it lies, or written in even parts if one task would read more than twice its share.

    A file of one row group is read by one task, however large it is. Up to
    ``rows_left`` rows stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    if sum(sizes) <= rows_left or max(sizes) * cores <= 2 * sum(sizes):
        return df
    return materialize(df.repartition(4 * cores), label)


def fits(df: DataFrame, limit: int) -> bool:
    """True if ``df`` has at most ``limit`` rows; the rows are counted where they lie."""
    return df.count() <= limit
