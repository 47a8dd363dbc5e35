"""Shards of near-equal bytes by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.plans.ranking import global_rank
from bitloom.plans.storage import materialize


class BinTree:
    """Open bins in a balanced search tree (AA tree) ordered by remaining capacity, then number."""

    def __init__(self):
        self.root = None

    # a node is [key, left, right, level]
    @staticmethod
    def _skew(t):
        if t and t[1] and t[1][3] == t[3]:
            left = t[1]
            t[1], left[2] = left[2], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[2] and t[2][2] and t[3] == t[2][2][3]:
            right = t[2]
            t[2], right[1] = right[1], t
            right[3] += 1
            return right
        return t

    def _insert(self, t, key):
        if t is None:
            return [key, None, None, 1]
        side = 1 if key < t[0] else 2
        t[side] = self._insert(t[side], key)
        return self._split(self._skew(t))

    def _remove(self, t, key):
        if t is None:
            return None
        if key != t[0]:
            side = 1 if key < t[0] else 2
            t[side] = self._remove(t[side], key)
        elif t[1] is None or t[2] is None:
            return t[1] or t[2]
        else:
            heir = t[2]
            while heir[1]:
                heir = heir[1]
            t[0] = heir[0]
            t[2] = self._remove(t[2], heir[0])
        level = min(t[1][3] if t[1] else 0, t[2][3] if t[2] else 0) + 1
        if level < t[3]:
            t[3] = level
            if t[2] and t[2][3] > level:
                t[2][3] = level
        t = self._skew(t)
        t[2] = self._skew(t[2])
        if t[2]:
            t[2][2] = self._skew(t[2][2])
        t = self._split(t)
        t[2] = self._split(t[2])
        return t

    def put(self, remaining: int, number: int) -> None:
        self.root = self._insert(self.root, (remaining, number))

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that holds ``size``."""
        t, best = self.root, None
        while t:
            if t[0][0] >= size:
                best, t = t[0], t[1]
            else:
                t = t[2]
        if best:
            self.root = self._remove(self.root, best)
        return best


def best_fit(sizes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Best-fit decreasing over ``(size, count)`` in falling order of size: runs ``(size, first, last, bin)``.

    Groups of one size are interchangeable, so a bin takes as many of them as it
    holds; ``first`` to ``last`` are their 1-based places among the groups of that
    size. A group above the capacity has a bin of its own. None if more than
    ``most`` bins would be needed.
    """
    tree, bins, runs = BinTree(), 0, []
    for size, count in sizes:
        done = 0
        while done < count:
            found = tree.take(size)
            if found is None:
                if bins == most:
                    return None
                found = (max(capacity, size), bins)
                bins += 1
            remaining, number = found
            n = min(count - done, remaining // size) if size else count - done
            runs.append((size, done + 1, done + n, number))
            done += n
            tree.put(remaining - n * size, number)
    return runs


def even_fit(sizes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing into ``bins`` bins at the least capacity found by bisection.

    Groups larger than an even share of what is left get a bin each; the others
    share the rest, so that one giant group does not unbalance them.
    """
    own, rest, total = [], list(sizes), sum(size * count for size, count in sizes)
    while rest and len(own) < bins - 1 and rest[0][0] * (bins - len(own)) > total:
        size, count = rest[0]
        first = 1 + sum(last - first + 1 for s, first, last, _ in own if s == size)
        own.append((size, first, first, len(own)))
        total -= size
        rest[0] = (size, count - 1)
        if count == 1:
            rest.pop(0)
    if not rest:
        return own
    free = bins - len(own)
    low, high = max(-(-total // free), rest[0][0]), total
    best = best_fit(rest, high, free)
    while low < high:
        middle = (low + high) // 2
        runs = best_fit(rest, middle, free)
        if runs is None:
            low = middle + 1
        else:
            best, high = runs, middle
    taken = {size: sum(last - first + 1 for s, first, last, _ in own if s == size) for size, *_ in own}
    shift = {rest[0][0]: taken.get(rest[0][0], 0)}
    return own + [(s, a + shift.get(s, 0), b + shift.get(s, 0), k + len(own)) for s, a, b, k in best]


def pack(groups: DataFrame, key: str, size: str, bins: int | None = None, capacity: int | None = None) -> DataFrame:
    """``key, size, bin``: every group in one bin; give ``bins`` for even bins or ``capacity`` for the fewest.

    Only the table of distinct sizes (size, number of groups) meets in one task:
    D distinct sizes need at least D(D+1)/2 bytes of data, so it has at most
    √(2·bytes) rows, 14 million for 100 TB. It is streamed to that task sorted,
    and the task returns runs of equal groups. The groups are ranked inside
    their size across all tasks and joined to the runs.
    """
    if (bins is None) == (capacity is None):
        raise ValueError("give either bins or capacity")
    ranked = global_rank(groups.select(F.col(key).alias("key"), F.col(size).alias("size")), [F.col("key")], ["size"], "place")
    ranked = materialize(ranked, "ranked-groups")
    sizes = ranked.groupBy("size").agg(F.count("*").alias("n")).coalesce(1).sortWithinPartitions(F.desc("size"))

    def decide(batches):
        table = [(int(s), int(n)) for frame in batches for s, n in zip(frame["size"], frame["n"], strict=True)]
        if table:
            runs = even_fit(table, bins) if bins is not None else best_fit(table, capacity)
            for start in range(0, len(runs), 100_000):
                yield pd.DataFrame(runs[start : start + 100_000], columns=["of", "first", "last", "bin"])

    runs = materialize(sizes.mapInPandas(decide, "of long, first long, last long, bin int"), "runs")
    met = (F.col("size") == F.col("of")) & F.col("place").between(F.col("first"), F.col("last"))
    return ranked.join(runs, met).select(F.col("key").alias(key), F.col("size").alias(size), "bin")


def shard_documents(docs: DataFrame, bins: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` for every row: documents of equal text share a shard.

    ``size`` is the UTF-8 length plus 8; a null text counts as empty, also for
    its checksum and its group. Shards have near-equal bytes; a group larger
    than an even share stays whole and alone. ``slot`` numbers a shard's rows
    from 0 in order of id (nulls first); repeated rows get slots of their own.
    The texts are read once and never shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = text.cast("binary")
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.unhex(F.sha2(raw, 256)).alias("same"),
        ),
        "sizes",
    )
    groups = materialize(rows.groupBy("same").agg(F.sum("size").alias("bytes")), "groups")
    bin_of = pack(groups, "same", "bytes", bins=bins).select("same", F.col("bin").alias("shard"))
    placed = materialize(rows.join(bin_of, "same").select("id", "size", "text_crc32", "shard"), "placed")
    ranked = global_rank(placed, [F.col("id"), F.col("text_crc32")], ["shard"], "slot")
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))
