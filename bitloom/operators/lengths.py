"""Sentence lengths: statistics, curves and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the length report.
PERCENTILES = {"p90": 0.90, "p95": 0.95, "p98": 0.98, "p99": 0.99, "p995": 0.995, "p999": 0.999}


def length_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per length; everything below works on this table.

    It has one row per distinct length and group, and the partial aggregation
    shrinks a group of any size before the shuffle.
    """
    # counting the value drops missing lengths without a filter on the tokens themselves
    return df.groupBy(*by, F.col(col).cast("long").alias("len")).agg(F.count(col).alias("n")).filter("n > 0")


def length_stats(df: DataFrame, col: str, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Count, min, max, mean, median and upper percentiles (cut to whole tokens)."""
    points = F.array(F.lit(0.5), *[F.lit(p) for p in PERCENTILES.values()])
    if exact:
        spread = F.percentile("len", points, F.col("n"))
        source = length_counts(df, col, by)
        total, mass = F.sum("n"), F.sum(F.col("len") * F.col("n"))
    else:
        spread = F.approx_percentile("len", points, 100_000)
        source = df.select(*by, F.col(col).cast("long").alias("len")).filter("len IS NOT NULL")
        total, mass = F.count("*"), F.sum("len")
    stats = source.groupBy(*by).agg(
        total.alias("n"),
        F.min("len").alias("min"),
        F.max("len").alias("max"),
        F.try_divide(mass, total).alias("mean"),
        spread.alias("_p"),
    )
    cuts = [F.col("_p")[i + 1].cast("long").alias(name) for i, name in enumerate(PERCENTILES)]
    return stats.select(*by, "n", "min", "max", "mean", F.col("_p")[0].cast("double").alias("median"), *cuts)


def _with_range(lengths: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach min, max, size and moments of each group to its distinct lengths."""
    total = F.sum("n")
    mass = F.sum(F.col("len") * F.col("n"))
    long_len = F.col("len").cast("decimal(10,0)")
    square = F.sum(long_len * long_len * F.col("n").cast("decimal(18,0)"))  # exact beyond the range of a long
    keys = list(by)
    if not keys:
        keys = ["_all"]
        lengths = lengths.withColumn("_all", F.lit(0))
    ranges = lengths.groupBy(*keys).agg(
        F.min("len").alias("_min"),
        F.max("len").alias("_max"),
        total.alias("_n"),
        mass.alias("_sum"),
        square.alias("_square"),
    )
    return lengths.join(ranges, keys)


def length_histogram(df: DataFrame, col: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins on [min, max], the last one closed; empty bins are kept."""
    lengths = _with_range(length_counts(df, col, by), by)
    flat = F.col("_min") == F.col("_max")
    start = F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min").cast("double"))
    stop = F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max").cast("double"))
    step = (stop - start) / bins

    def edge(i: Column) -> Column:
        return F.when(i >= bins, stop).otherwise(start + i * step)

    guess = F.least(F.floor((F.col("len") - start) / step), F.lit(bins - 1))
    placed = (
        F.when(F.col("len") < edge(guess), guess - 1)
        .when((F.col("len") >= edge(guess + 1)) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )
    filled = (
        lengths.select(
            *by, start.alias("_start"), stop.alias("_stop"), placed.cast("int").alias("bin"), F.col("n").alias("_in")
        )
        .groupBy(*by, "_start", "_stop")
        .agg(*[F.sum(F.when(F.col("bin") == b, F.col("_in")).otherwise(0)).alias(f"_{b}") for b in range(bins)])
    )
    width = (F.col("_stop") - F.col("_start")) / bins
    cells = F.array(*[F.col(f"_{b}") for b in range(bins)])
    out = filled.select(*by, "_start", "_stop", F.posexplode(cells).alias("bin", "n"))
    upper = F.when(F.col("bin") == bins - 1, F.col("_stop")).otherwise(F.col("_start") + (F.col("bin") + 1) * width)
    return out.select(*by, "bin", (F.col("_start") + F.col("bin") * width).alias("lo"), upper.alias("hi"), "n")


def length_kde(df: DataFrame, col: str, grid: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """Gaussian density curve on ``grid`` points from min to max, Scott's bandwidth."""
    lengths = _with_range(length_counts(df, col, by), by)
    n = F.col("_n").cast("double")
    total = F.col("_sum").cast("decimal(19,0)")
    scatter = F.col("_square") - total * total / F.col("_n").cast("decimal(19,0)")
    deviation = F.sqrt(scatter.cast("double") / (n - 1))
    width = F.pow(n, F.lit(-0.2)) * deviation
    cells = lengths.filter("_n > 1 AND _max > _min").select(
        *by,
        "len",
        "n",
        "_min",
        "_max",
        n.alias("_total"),
        width.alias("_width"),
        F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"),
    )
    x = F.col("_min") + F.col("point") * (F.col("_max") - F.col("_min")) / F.lit(grid - 1)
    z = (x - F.col("len")) / F.col("_width")
    scale = F.col("_total") * F.col("_width") * F.sqrt(2 * F.pi())
    return (
        cells.groupBy(*by, "point", x.alias("x"))
        .agg(F.sum(F.col("n") * F.exp(-0.5 * z * z) / scale).alias("density"))
        .select(*by, "point", "x", "density")
    )


def suggest_max_len(df: DataFrame, src_len: str, tgt_len: str, q: float = 0.999) -> DataFrame:
    """Length that covers share ``q`` of both sides, and the longest of all."""
    sides = df.select(F.explode(F.array(
        F.struct(F.lit("src").alias("side"), F.col(src_len).alias("len")),
        F.struct(F.lit("tgt").alias("side"), F.col(tgt_len).alias("len")),
    )).alias("_s")).select("_s.side", "_s.len")
    per_side = length_counts(sides, "len", ["side"]).groupBy("side").agg(
        F.percentile("len", F.lit(q), F.col("n")).alias("_q"), F.max("len").alias("_max")
    )
    return per_side.agg(F.max("_q").cast("long").alias("suggested"), F.max("_max").alias("global_max"))


def _fits(src: Column, tgt: Column, max_len: int, boundaries: int) -> Column:
    return (src + boundaries <= max_len) & (tgt + boundaries <= max_len)


def filter_by_length(df: DataFrame, max_len: int = 128, src: str = "src_tokens", tgt: str = "tgt_tokens") -> DataFrame:
    """Drop pairs with a side longer than ``max_len`` once both boundaries are added."""
    return df.filter(_fits(F.size(src), F.size(tgt), max_len, 2))


def filter_bpe_length(
    df: DataFrame, max_len: int, mode: str = "truncate", src: str = "src_ids", tgt: str = "tgt_ids"
) -> DataFrame:
    """Limit encoded sides, boundaries included: cut them, or drop the pair.

    Cutting keeps the closing boundary, which is the last id of each side.
    """
    if mode == "filter":
        return df.filter(_fits(F.size(src), F.size(tgt), max_len, 0))
    if mode != "truncate":
        raise ValueError(f"unknown mode: {mode}")

    def cut(ids: str) -> Column:
        short = F.concat(F.slice(ids, 1, max_len - 1), F.slice(ids, -1, 1))
        return F.when(F.size(ids) > max_len, short).otherwise(F.col(ids))

    return df.withColumns({src: cut(src), tgt: cut(tgt)})


def length_filter_report(
    df: DataFrame, max_len: int = 128, src: str = "src_tokens", tgt: str = "tgt_tokens", by: Sequence[str] = ("split",)
) -> DataFrame:
    """Kept and dropped pairs of `filter_by_length`."""
    keep = _fits(F.size(src), F.size(tgt), max_len, 2)
    return df.groupBy(*by).agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("ignored"))


def drop_blank_sources(df: DataFrame, src: str = "src") -> DataFrame:
    """Drop rows whose source is empty after stripping whitespace."""
    return df.filter(F.col(src).rlike(r"(?U)\S"))
