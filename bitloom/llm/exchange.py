"""Counts and lookups between batches of rows that are too many to shuffle one by one.

A batch (a written row with arrays) asks for something about each of its
distinct 64-bit keys. Questions go to buckets by key, as arrays, so that a
shuffle moves eight bytes a key and no key, however frequent, is asked more
than once per batch. A bucket holds all questions about its keys and answers
each batch in the order in which it asked.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.plans.storage import new_path, remember_table

KEYS_PER_BUCKET = 2_000_000
U = np.uint64


def mix(values: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser (splitmix64) on an array."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def bucket_order(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of ``keys`` by bucket, and where each bucket starts in it."""
    # the high bits choose the bucket; the product needs 32 bits of them only
    bucket = ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def keep_bucketed(batches: DataFrame, label: str, buckets: int) -> DataFrame:
    """Write ``batches`` once, bucketed by ``batch``, so that later joins on it do not shuffle them."""
    spark = batches.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    writer = batches.write.bucketBy(buckets, "batch").option("path", new_path(spark, label)).option("compression", "zstd")
    writer.saveAsTable(name)
    remember_table(spark, name)
    return spark.table(name)


def batch_numbers() -> Callable[[], int]:
    """Numbers that are unique over the tasks of a job whose result is written once."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), -1

    def next_number() -> int:
        nonlocal n
        n += 1
        return (part << 33) + n

    return next_number


def answer(questions: DataFrame, solve: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, int]], answer_type: str) -> DataFrame:
    """``batch, kind, bucket, answers, found`` for ``batch, kind, bucket, keys array<long>, counts array<long>``.

    ``solve`` gets the kind, the keys of a bucket and their counts, those of all batches
    in a row, and returns an answer for each and one number on the bucket,
    which stands in ``found`` of a single row of the bucket.
    """

    def reply(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["keys"].map(len).to_numpy()
        keys = np.concatenate(group["keys"].to_list()).astype(np.int64).view(np.uint64)
        counts = np.concatenate(group["counts"].to_list())
        found, number = solve(int(group["kind"].iloc[0]), keys, counts)
        ends = np.cumsum(sizes)
        return pd.DataFrame({
            "batch": group["batch"], "kind": group["kind"], "bucket": group["bucket"],
            "answers": [found[e - n : e] for e, n in zip(ends, sizes, strict=True)],
            "found": [number] + [0] * (len(group) - 1),
        })

    schema = f"batch long, kind int, bucket int, answers array<{answer_type}>, found long"
    return questions.groupBy("kind", "bucket").applyInPandas(reply, schema)


def questions_of(rows: Iterator[tuple[int, int, np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Arrow rows for ``(batch, kind, keys, counts)``."""
    for batch, kind, keys, counts in rows:
        order, starts = bucket_order(keys, buckets)
        keys, counts = keys[order].view(np.int64), counts[order].astype(np.int64)
        some = np.flatnonzero(np.diff(starts)).astype(np.int32)
        offsets = pa.array(np.append(starts[some], starts[-1]).astype(np.int32))
        if len(some):
            yield pa.record_batch(
                [
                    pa.array(np.full(len(some), batch, np.int64)),
                    pa.array(np.full(len(some), kind, np.int32)),
                    pa.array(some),
                    pa.ListArray.from_arrays(offsets, pa.array(keys)),
                    pa.ListArray.from_arrays(offsets, pa.array(counts)),
                ],
                ["batch", "kind", "bucket", "keys", "counts"],
            )


QUESTION = "batch long, kind int, bucket int, keys array<long>, counts array<long>"


def answers_for(keys: np.ndarray, replies: pd.DataFrame, kind: int, buckets: int, dtype) -> np.ndarray:
    """The answers to ``keys`` in their own order, from the replies to one batch."""
    out = np.zeros(len(keys), dtype)
    order, _ = bucket_order(keys, buckets)
    mine = replies[replies["kind"] == kind].sort_values("bucket")
    if len(keys):
        out[order] = np.concatenate(mine["answers"].to_list())
    return out


def per_batch(batches: DataFrame, replies: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work(batch row, its replies)`` for every batch; only the replies are shuffled."""
    return batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(work, schema)


def buckets_for(keys: int) -> int:
    return int(max(64, -(-keys // KEYS_PER_BUCKET)))


def total(table: DataFrame, column: str) -> int:
    return int(table.agg(F.sum(column)).first()[0] or 0)
