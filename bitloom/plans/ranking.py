"""Global row numbers without a single-task window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.plans.storage import materialize


def global_rank(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "rank",
    running: Mapping[str, str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row within its ``by`` group.

    ``running`` maps new columns to numeric columns: each new column holds the
    sum of the numeric one over the earlier rows of the group (the row itself
    not counted).

    ``order`` must be a total order inside a group. The rows are range
    partitioned on ``by + order``, so a group holding most of the data is spread
    over as many tasks as its size needs. Each row gets its slot in its own
    partition; a small table (one row per partition and group) carries how many
    rows of the group lie in earlier partitions. The laid-out rows are written
    once, because a recomputed range partitioning may cut at other places.
    ``parts`` is the number of ranges, if not left to Spark.
    """
    by = list(by)
    keys = [F.col(c) for c in by] + list(order)
    laid = materialize(
        df.repartitionByRange(*([parts] if parts else []), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "rank",
    )
    part = F.shiftright("_slot", 33)
    running = dict(running or {})
    earlier = (
        Window.partitionBy(*by)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # at most (partitions + groups) rows; written so that the join is planned by its size
    starts = materialize(
        laid.groupBy(*by, part.alias("_part"))
        .agg(
            F.count("*").alias("_n"),
            F.min("_slot").alias("_first"),
            *[F.sum(column).alias(f"_sum_{new}") for new, column in running.items()],
        )
        .select(
            *by,
            "_part",
            (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
            *[F.coalesce(F.sum(f"_sum_{new}").over(earlier), F.lit(0)).alias(f"_from_{new}") for new in running],
        ),
        "rank-starts",
    )
    placed = laid.withColumn("_part", part).join(_same_name(starts, by), _same_group(by)).withColumn(
        name, F.col("_slot") + F.col("_shift")
    )
    before = (
        Window.partitionBy(*by, "_part")
        .orderBy("_slot")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = {
        new: F.col(f"_from_{new}") + F.coalesce(F.sum(column).over(before), F.lit(0)) for new, column in running.items()
    }
    return placed.withColumns(sums).select(*df.columns, name, *running) if running else placed.select(*df.columns, name)


def _same_name(starts: DataFrame, by: Sequence[str]) -> DataFrame:
    for column in [*by, "_part"]:
        starts = starts.withColumnRenamed(column, f"_of_{column}")
    return starts


def _same_group(by: Sequence[str]) -> Column:
    """Null-safe, so that the rows of a null group are numbered too."""
    same = F.col("_part") == F.col("_of__part")
    for column in by:
        same &= F.col(column).eqNullSafe(F.col(f"_of_{column}"))
    return same
