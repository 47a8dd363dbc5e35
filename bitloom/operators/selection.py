"""Choosing among hypotheses, and samples to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.operators.batching import hash_number
from bitloom.plans.ranking import global_rank


def topk_candidates(
    df: DataFrame, k: int, key: str = "pair_id", score: str = "score", cand: str = "cand"
) -> DataFrame:
    """The ``k`` best-scoring candidates per source, ties by candidate order.

    Up to a ``k`` of ``spark.sql.optimizer.windowGroupLimitThreshold`` the limit
    is applied inside each partition before the shuffle, so a source with very
    many candidates sends ``k`` rows per task. Beyond, rows are ranked by range
    partitioning, which spreads one source over many tasks.
    """
    if k > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        order = [F.desc(score), F.col(cand)]
        # ranges half as long as usual: the sampled cuts could else leave the best of one source in a single task
        parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranked = global_rank(df, order, [key], "rank", parts=parts).filter(F.col("rank") <= k)
        return ranked.withColumn("rank", F.col("rank").cast("int"))
    best = Window.partitionBy(key).orderBy(F.desc(score), F.col(cand))
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def sample_predictions(df: DataFrame, frac: float = 0.05, seed: int = 0, key: str = "sent_id") -> DataFrame:
    """A repeatable share of the rows, chosen by a hash of seed and key."""
    return df.filter(hash_number(seed, key) < int(frac * (1 << 60)))


def first_prediction(df: DataFrame, key: str = "sent_id") -> DataFrame:
    """The first pair of a run."""
    return df.orderBy(key).limit(1)
