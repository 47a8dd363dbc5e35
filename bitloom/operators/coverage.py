"""How much of a corpus its most frequent tokens cover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators.counting import count_of_counts, ranked_tokens
from bitloom.plans.storage import materialize

# Fixed values of the coverage report.
THRESHOLDS = [0.90, 0.95, 0.98, 0.99, 0.995]
GUIDES = [0.95, 0.98, 0.99]
MIN_FREQS = [1, 2, 3, 5, 8, 10, 20]
CURVE_LIMIT = 30_000


def coverage_size(counts: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Smallest number of top tokens whose share of the corpus reaches each threshold.

    Solved on the table of distinct frequencies: find the first frequency that
    reaches the threshold, then how many of its tokens are needed.
    """
    return _coverage_size(count_of_counts(counts), thresholds).select("lang", "threshold", "n_types")


def _coverage_size(steps: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    steps = steps.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))

    def share(n):
        return (F.col("tokens_above") + n * F.col("freq")).cast("double") / F.col("total")

    reached = steps.filter(share(F.col("n_types")) >= F.col("threshold")).filter(
        (F.col("types_above") == 0)
        | (F.col("tokens_above").cast("double") / F.col("total") < F.col("threshold"))
    )
    guess = F.ceil((F.col("threshold") * F.col("total") - F.col("tokens_above")) / F.col("freq"))
    low = F.greatest(guess - 1, F.lit(1))  # the division may be off by one unit of rounding
    need = (
        F.when(share(low) >= F.col("threshold"), low)
        .when(share(low + 1) >= F.col("threshold"), low + 1)
        .otherwise(low + 2)
    )
    return reached.select(
        "lang", "threshold", "types", (F.col("types_above") + need).cast("long").alias("n_types")
    )


def coverage_guides(
    counts: DataFrame, thresholds: Sequence[float] = GUIDES, limit: int = CURVE_LIMIT
) -> DataFrame:
    """0-based rank at which each guide line meets the curve, if inside the view."""
    idx0 = F.col("n_types") - 1
    return (
        _coverage_size(count_of_counts(counts), thresholds)
        .filter(idx0 < F.least(F.lit(limit), F.col("types")))
        .select("lang", "threshold", idx0.alias("idx0"))
    )


def min_freq_sweep(counts: DataFrame, freqs: Sequence[int] = MIN_FREQS) -> DataFrame:
    """Vocabulary size and token coverage for each minimum frequency."""
    sums = []
    for m in freqs:
        sums.append(F.count_if(F.col("freq") >= m).alias(f"_types_{m}"))
        sums.append(F.sum(F.when(F.col("freq") >= m, F.col("freq")).otherwise(0)).alias(f"_tokens_{m}"))
    wide = counts.groupBy("lang").agg(F.sum("freq").alias("_total"), *sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("min_freq"),
                F.col(f"_types_{m}").alias("vocab_size"),
                F.try_divide(F.col(f"_tokens_{m}"), F.col("_total")).alias("token_coverage"),
            )
            for m in freqs
        ]
    )
    return wide.select("lang", F.inline(rows))


def coverage_curve(counts: DataFrame, limit: int | None = None, tie: str = "token") -> DataFrame:
    """Running count and share by rank. ``limit`` is the width of the plotted view.

    The ranking carries the running count, and a view ranks only the tokens it
    shows.
    """
    counts = materialize(counts, "counts")
    # one row per language; written, so that the join below is planned by its size
    totals = materialize(counts.groupBy(F.col("lang").alias("_of")).agg(F.sum("freq").alias("total")), "totals")
    ranked = ranked_tokens(counts, tie, limit, running={"_before": "freq"})
    cum = F.col("_before") + F.col("freq")
    return (
        ranked.join(totals, F.col("lang").eqNullSafe(F.col("_of")))
        .select(
            "lang",
            "rank",
            "token",
            "freq",
            cum.alias("cum"),
            (cum.cast("double") / F.col("total")).alias("coverage"),
        )
    )


def rank_frequency(counts: DataFrame, tie: str = "token") -> DataFrame:
    """0-based rank against frequency, and both as log10 (rank 0 has no logarithm)."""
    rank0 = F.col("rank") - 1
    return ranked_tokens(counts, tie).select(
        "lang",
        rank0.alias("rank0"),
        "freq",
        F.when(rank0 > 0, F.log10(rank0)).alias("log_rank"),
        F.log10("freq").alias("log_freq"),
    )


def vocabulary_totals(counts: DataFrame) -> DataFrame:
    """Number of tokens and of token types per language."""
    return counts.groupBy("lang").agg(
        F.sum("freq").alias("total_tokens"), F.count("*").alias("vocab_size")
    )
