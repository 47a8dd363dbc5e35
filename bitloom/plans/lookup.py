"""Joining a large token stream to a lookup table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.plans.storage import materialize

HOT_KEYS = 10_000


def skew_safe_left_join(rows: DataFrame, table: DataFrame, on: str, spread_by: list[str]) -> DataFrame:
    """``rows`` left join ``table`` (one row per ``on`` value) without a hot task.

    A value is hot when it makes up more than 1/HOT_KEYS of the rows, so there
    are fewer than HOT_KEYS of them: they are broadcast under that bound, and
    their rows are salted by ``spread_by`` in the shuffle join that resolves all
    other values.
    """
    payload = [c for c in table.columns if c != on]
    counts = materialize(rows.groupBy(on).count(), "lookup-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot_values = counts.filter(F.col("count") * HOT_KEYS > total).select(on)
    hot = hot_values.join(table, on, "left").select(
        F.col(on), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in payload]
    )
    salt = F.when(F.col("_hot") | F.col(on).isNull(), 1 + F.pmod(F.xxhash64(*spread_by), F.lit(1 << 20)))
    marked = rows.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.coalesce(salt, F.lit(0)).cast("long")
    )
    cold = table.withColumn("_salt", F.lit(0).cast("long"))
    return marked.join(cold, [on, "_salt"], "left").select(
        *rows.columns,
        *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in payload],
    )
