"""The input tables of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as it lies; its files and row groups decide the partitions."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bitext_from_turns(turns: DataFrame) -> DataFrame:
    """Pairs of a user turn and the assistant turn that follows it."""
    # a turn has 32 bits to itself; larger conversation numbers than fit beside it raise
    key = (F.col("conv_id").cast("long") * F.lit(1 << 32) + F.col("turn")).alias("pair_id")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", key, F.col("text").alias("src"))
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt")
    )
    return asked.join(answered, ["conv_id", "turn"]).select("pair_id", "src", "tgt")
