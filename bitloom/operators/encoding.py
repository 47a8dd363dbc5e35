"""Tokens to ids and back."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.operators.counting import SPECIALS, UNK
from bitloom.plans.lookup import skew_safe_left_join
from bitloom.plans.storage import fits, materialize

BROADCAST_ENTRIES = 500_000


def _inside(lists: pa.ListArray, convert) -> pa.ListArray:
    """Apply ``convert`` to the elements of a list array, keeping its shape."""
    nulls = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(lists.offsets, convert(lists.values), mask=nulls)


def _translate(df: DataFrame, entries: pa.Table, source: str, out_type: str, missing, out: str) -> DataFrame:
    """Add ``out``: every element of ``source`` replaced through a small table.

    The table goes to each executor once; the rows are neither shuffled nor
    reordered, and the look-up runs on whole Arrow columns.
    """
    keys = entries.column(0).combine_chunks()
    values = pa.concat_arrays(
        [entries.column(1).combine_chunks(), pa.array([missing], entries.column(1).type)]
    )
    shared = df.sparkSession.sparkContext.broadcast((keys, values))

    @F.arrow_udf(out_type)
    def translate(lists: pa.Array) -> pa.Array:
        known, results = shared.value

        def convert(items: pa.Array) -> pa.Array:
            places = pc.fill_null(pc.index_in(items.cast(known.type), value_set=known), len(known))
            return results.take(places)

        return _inside(lists, convert)

    return df.withColumn(out, translate(F.col(source)))


def _translate_by_join(df: DataFrame, table: DataFrame, source: str, missing, out: str) -> DataFrame:
    """The same through a shuffle join, for tables too large to send around.

    Rows are told apart by an id of their own: they are written once with it,
    so that it stays the same in both uses.
    """
    lookup = table.toDF("_item", "_value")
    numbered = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    items = numbered.select("_row", F.posexplode_outer(source).alias("_pos", "_item")).filter(F.col("_pos").isNotNull())
    found = skew_safe_left_join(items, lookup, "_item", ["_row", "_pos"])
    placed = F.struct("_pos", F.coalesce("_value", F.lit(missing)).alias("_value"))
    rows = found.groupBy("_row").agg(F.array_sort(F.collect_list(placed)).alias("_placed"))
    empty = F.slice(F.array(F.lit(missing)), 1, 0)
    return (
        numbered.join(rows, "_row", "left")
        .withColumn(
            out,
            F.when(F.col(source).isNotNull(), F.coalesce(F.transform("_placed", lambda p: p["_value"]), empty)),
        )
        .drop("_row", "_placed")
    )


def _look_up(df: DataFrame, table: DataFrame, source: str, out_type: str, missing, out: str, route: str, entries: int) -> DataFrame:
    """By the chosen route; of a repeated key of ``table`` the least value counts, a null key does not."""
    key, value = table.columns
    table = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))
    if route not in ("auto", "broadcast", "join"):
        raise ValueError(f"unknown route: {route}")
    if route == "join" and df.isStreaming:
        raise ValueError("the rows of a stream cannot be put together after a join: let the route be broadcast")
    if route == "broadcast" or df.isStreaming or (route == "auto" and fits(table, entries)):
        return _translate(df, table.toArrow(), source, out_type, missing, out)
    return _translate_by_join(df, table, source, missing, out)


def numericalize(
    df: DataFrame,
    vocab: DataFrame,
    tokens_col: str = "tokens",
    key: str = "pair_id",
    unk: int = UNK,
    out: str = "ids",
    broadcast_entries: int = BROADCAST_ENTRIES,
    route: str = "auto",
) -> DataFrame:
    """Add ``out``: the ids of the tokens, ``unk`` for those not in the vocabulary.

    ``vocab`` is the vocabulary of one language (``id, token``); a repeated
    token has its smallest id. ``route="broadcast"`` sends it to the executors,
    ``"join"`` joins it by shuffle with hot tokens kept apart, and ``"auto"``
    joins a batch beyond ``broadcast_entries``. All give the same; a stream is
    never joined. Rows need no unique key: ``key`` is no longer read.
    """
    table = vocab.select("token", F.col("id").cast("int").alias("id"))
    return _look_up(df, table, tokens_col, "array<int>", unk, out, route, broadcast_entries)


def lookup_tokens(
    df: DataFrame,
    vocab: DataFrame,
    ids_col: str = "ids",
    key: str = "pair_id",
    out: str = "tokens",
    broadcast_entries: int = BROADCAST_ENTRIES,
    route: str = "auto",
) -> DataFrame:
    """Add ``out``: the tokens of the ids, ``<unk>`` for unknown ids; routes as in `numericalize`."""
    table = vocab.select(F.col("id").cast("int").alias("id"), "token")
    return _look_up(df, table, ids_col, "array<string>", SPECIALS[UNK], out, route, broadcast_entries)
