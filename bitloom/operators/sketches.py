"""Reports from mergeable summaries: one pass over the text, a few kilobytes per group, batch or stream.

Summaries of splits, days or micro-batches are stored and merged later; "all" is
their merge, not another pass. Quantiles come from KLL sketches, numbers of
distinct tokens from HyperLogLog sketches, and frequent tokens from a summary of
a bounded number of counters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.operators.lengths import PERCENTILES

KLL_K = 400  # normalised rank error of about 0.7 %
HLL_BITS = 12  # standard error of about 1.6 %


def length_summary(df: DataFrame, col: str, by: Sequence[str] = (), k: int = KLL_K) -> DataFrame:
    """``by, n, min, max, total, sketch``: null lengths are left out; an empty table without groups gives no row."""
    lengths = df.select(*by, F.col(col).cast("long").alias("_len")).filter("_len IS NOT NULL")
    return lengths.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min("_len").alias("min"),
        F.max("_len").alias("max"),
        F.sum("_len").alias("total"),
        F.kll_sketch_agg_bigint("_len", F.lit(k)).alias("sketch"),
    ).filter("n > 0")


def merge_length_summaries(summaries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One summary for each value of ``by`` from any number of summaries; without ``by``, one of all."""
    return summaries.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.sum("total").alias("total"),
        F.kll_merge_agg_bigint("sketch").alias("sketch"),
    ).filter("n > 0")


def _quantile(q: float | Sequence[float]) -> Column:
    ranks = F.lit(q) if isinstance(q, float) else F.array(*[F.lit(x) for x in q])
    return F.kll_sketch_get_quantile_bigint("sketch", ranks)


def length_report(summaries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The columns of `lengths.length_stats`; the median and percentiles are lengths within the sketch's rank error."""
    points = summaries.withColumn("_p", _quantile([0.5, *PERCENTILES.values()]))
    cuts = [F.col("_p")[i + 1].alias(name) for i, name in enumerate(PERCENTILES)]
    mean = F.try_divide("total", "n").alias("mean")
    return points.select(*by, "n", "min", "max", mean, F.col("_p")[0].cast("double").alias("median"), *cuts)


def suggest_max_len(summaries: DataFrame, q: float = 0.999) -> DataFrame:
    """``suggested, global_max`` over all summaries, such as those of both sides: see `lengths.suggest_max_len`."""
    return summaries.select(_quantile(q).alias("_q"), "max").agg(F.max("_q").alias("suggested"), F.max("max").alias("global_max"))


def token_summary(df: DataFrame, tokens: str = "tokens", by: Sequence[str] = (), counters: int = 4096) -> DataFrame:
    """``by, n, frequent, distinct``: tokens counted, a summary of frequent ones and a sketch of distinct ones.

    ``counters`` bounds the summary, whatever the vocabulary. An estimate is off
    by at most 3.5 n / counters (the bound of the underlying summary), so a token
    with more than that share is never missed.
    """
    words = df.select(*by, F.explode(tokens).alias("_token")).filter("_token IS NOT NULL")
    return words.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.call_function("approx_top_k_accumulate", F.col("_token"), F.lit(counters)).alias("frequent"),
        F.hll_sketch_agg("_token", F.lit(HLL_BITS)).alias("distinct"),
    ).filter("n > 0")


def merge_token_summaries(summaries: DataFrame, by: Sequence[str] = (), counters: int = 4096) -> DataFrame:
    """One summary for each value of ``by`` from any number of summaries of the same number of counters."""
    return summaries.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(counters)).alias("frequent"),
        F.call_function("hll_union_agg", F.col("distinct")).alias("distinct"),
    ).filter("n > 0")


def frequent_tokens(summaries: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """``by, token, freq, rank``: the ``k`` tokens with the largest estimates, ties by token."""
    listed = F.transform(
        F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(k)),
        lambda x: F.struct((-x["count"]).alias("less"), x["item"].alias("token")),
    )
    ranked = summaries.select(*by, F.posexplode(F.array_sort(listed)).alias("_at", "_t"))
    return ranked.select(*by, F.col("_t.token").alias("token"), (-F.col("_t.less")).alias("freq"), (F.col("_at") + 1).alias("rank"))


def distinct_tokens(summaries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, n, types``: tokens, and the estimated number of different ones."""
    return summaries.select(*by, "n", F.hll_sketch_estimate("distinct").alias("types"))
