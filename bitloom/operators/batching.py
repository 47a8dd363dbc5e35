"""Batches of encoded pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.plans.ranking import global_rank
from bitloom.plans.storage import materialize


def hash_number(seed: int, *keys: Column | str) -> Column:
    """Repeatable number below 2**60 from a seed and the row's keys."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _whole(number: str, size: int) -> Column:
    """Integer division."""
    return ((F.col(number) - F.col(number) % size) / size).cast("long")


def _ranked_keys(df: DataFrame, shuffle: bool, seed: int, key: str, *extra: str) -> DataFrame:
    """0-based place of every key in key order or in a seeded random order.

    Only the key (and ``extra``) is read and sorted; the rows themselves are
    computed and shuffled once, when the places are joined to them.
    """
    order = [hash_number(seed, key), F.col(key)] if shuffle else [F.col(key)]
    keys = df.select(key, *extra)
    if extra:  # computed from the rows, and sampled before it is sorted: write it first
        keys = materialize(keys, "keys")
    ranked = global_rank(keys, order, name="_rank")
    twice = ranked.groupBy(key).count().filter("count > 1").take(1)
    if twice:
        raise ValueError(f"{key} is not unique: {twice[0][0]} occurs {twice[0][1]} times")
    return ranked.withColumn("_place", F.col("_rank") - 1).drop("_rank")


def make_batches(
    df: DataFrame, size: int, shuffle: bool = False, seed: int = 0, key: str = "pair_id"
) -> DataFrame:
    """Consecutive groups of ``size`` rows in key order, or in a seeded random order.

    A repeated ``key`` raises, as its rows could not be placed. The last batch may be short; the order depends on seed
    and key only.
    """
    places = _ranked_keys(df, shuffle, seed, key).select(
        key,
        _whole("_place", size).alias("batch_id"),
        (F.col("_place") % size).cast("int").alias("pos_in_batch"),
    )
    return df.join(places, key)


def length_bucketed_batches(
    df: DataFrame, size: int, mega: int = 50, seed: int = 0, length: str = "src_len", key: str = "pair_id"
) -> DataFrame:
    """Batches of similar length: shuffle, take ``mega`` batches at a time, sort those by length.

    The window below holds ``size * mega`` rows, whatever the size of the data.
    """
    grouped = _ranked_keys(df, True, seed, key, length).withColumn("_mega", _whole("_place", size * mega))
    longest = Window.partitionBy("_mega").orderBy(F.desc(length), F.col(key))
    inside = grouped.withColumn("_inside", F.row_number().over(longest) - 1)
    places = inside.select(
        key,
        (F.col("_mega") * mega + _whole("_inside", size)).alias("batch_id"),
        (F.col("_inside") % size).cast("int").alias("pos_in_batch"),
    )
    return df.join(places, key)


def pad_batch(
    df: DataFrame, pad: int, batch: str = "batch_id", src: str = "src_ids", tgt: str = "tgt_ids"
) -> DataFrame:
    """Pad both sides on the right to the longest row of the batch; keep the source length."""
    whole = Window.partitionBy(batch)

    def padded(ids: str) -> Column:
        longest = F.max(F.size(ids)).over(whole)
        return F.concat(F.col(ids), F.array_repeat(F.lit(pad), longest - F.size(ids)))

    return df.withColumns(
        {"src_padded": padded(src), "tgt_padded": padded(tgt), "src_len": F.size(src)}
    )


def padding_waste(
    df: DataFrame, batch: str = "batch_id", src: str = "src_ids", tgt: str = "tgt_ids"
) -> DataFrame:
    """Cells and padding cells each batch would have, without building them."""
    sizes = df.select(batch, F.size(src).alias("_s"), F.size(tgt).alias("_t"))
    cells = F.count("*") * (F.max("_s") + F.max("_t"))
    used = F.sum(F.col("_s") + F.col("_t"))
    return sizes.groupBy(batch).agg(
        cells.alias("cells"),
        (cells - used).alias("pad_cells"),
        F.try_divide(cells - used, cells).alias("waste"),
    )


def total_padding_waste(waste: DataFrame) -> DataFrame:
    """`padding_waste` summed over all batches."""
    return waste.agg(
        F.count("*").alias("n_batches"),
        F.sum("cells").alias("cells"),
        F.sum("pad_cells").alias("pad_cells"),
        F.try_divide(F.sum("pad_cells"), F.sum("cells")).alias("waste"),
    )
