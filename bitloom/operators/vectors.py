"""Pretrained word vectors laid along a vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.operators.counting import PAD


WORD = (1 << 31) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 31-bit numbers by xor-shifts and odd multipliers; no product exceeds 62 bits."""
    x = x ^ (x >> 15)
    x = (x * 0x2C1B3C6D) & WORD
    x = x ^ (x >> 12)
    x = (x * 0x297A2D39) & WORD
    return x ^ (x >> 15)


def noise(seed: int, rows: np.ndarray, dim: int) -> np.ndarray:
    """Standard normal numbers, ``dim`` for each row number, from a counter: they depend on seed, row and place only.

    A pair of places takes two numbers by Box and Muller, so a cell costs one mix.
    """
    base = _mixed(np.int64(seed & WORD))
    base = _mixed(_mixed(base ^ (rows & WORD)) ^ ((rows >> 31) & WORD))
    drawn = _mixed(base[:, None] ^ np.arange(dim + dim % 2, dtype=np.int64))
    radius = np.sqrt(-2 * np.log((drawn[:, 0::2] + 1) / 2.0**31))
    angle = 2 * np.pi * (drawn[:, 1::2] / 2.0**31)
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], 2).reshape(len(rows), -1)[:, :dim]


def _noise_column(seed: int, dim: int, scale: float) -> Column:
    @F.arrow_udf("array<double>")
    def drawn(ids: pa.Array) -> pa.Array:
        cells = noise(seed, ids.to_numpy(zero_copy_only=False).astype(np.int64), dim) * scale
        return pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, dim, dtype=np.int32)), pa.array(cells.ravel()))

    return drawn(F.col("id"))


def _wanted(vocab: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """The vectors of vocabulary words; all others are dropped before any shuffle of vectors."""
    return vectors.filter(F.size("vector") == dim).join(vocab.select("token"), "token", "left_semi")


def align_vectors(
    vocab: DataFrame, vectors: DataFrame, dim: int, seed: int = 0, scale: float = 0.6
) -> DataFrame:
    """One vector per vocabulary entry.

    A token found in ``vectors`` (``line_no, token, vector``) gets the vector of
    its last line, the padding entry gets zeros, all others get noise
    N(0, scale) that depends only on seed, id and place (`noise`). Repeats of a word shrink in the
    partial aggregation.
    """
    last = _wanted(vocab, vectors, dim).groupBy("token").agg(F.max_by("vector", "line_no").alias("_found"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    hit = F.col("_found").isNotNull()
    vector = F.when(F.col("id") == PAD, zeros).when(hit, F.col("_found").cast("array<double>")).otherwise(_noise_column(seed, dim, scale))
    return vocab.join(last, "token", "left").select("id", "token", vector.alias("vector"), hit.alias("hit"))


def vector_hit_stats(vocab: DataFrame, vectors: DataFrame, dim: int, count_repeats: bool = False) -> DataFrame:
    """How many vocabulary entries have a pretrained vector.

    With ``count_repeats`` every usable line of a word counts.
    """
    lines = _wanted(vocab, vectors, dim).groupBy("token").agg(F.count("*").alias("_lines"))
    matched = vocab.select("token").join(lines, "token", "left")
    hits = F.sum("_lines") if count_repeats else F.count("_lines")
    return matched.agg(F.count("*").alias("vocab_size"), F.coalesce(hits, F.lit(0)).alias("hits")).select(
        "vocab_size", "hits", F.try_divide("hits", "vocab_size").alias("hit_rate")
    )
