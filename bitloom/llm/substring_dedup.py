"""Removing passages that an earlier document has, by a run-length index.

Every string of ``limit`` bytes has an anchor: the least hash among its 24-byte
parts. Equal strings have equal anchors, so consecutive strings with one anchor
form a segment that travels with that anchor. Anchors that a single document has
are settled by counting. The segments of the others are indexed, bucket by
bucket, in a run-compressed Burrows-Wheeler transform with sampled run ends;
their matching statistics mark the strings of ``limit`` bytes, and the least
document of every such string decides which bytes go.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import exchange as ex
from bitloom.llm.arrow import as_bytes
from bitloom.llm.run_index import SEPARATOR, RunIndex
from bitloom.plans.storage import materialize

BATCH = 4_000_000  # bytes of a batch; one document is never split
SLICE = 1 << 19  # string starts handled at a time
INDEXED = 1_500_000  # bytes of segments per bucket, on average
HOT = 20_000  # documents with one anchor beyond which its strings travel by their own hash
COPY, COPY_TOO, ANCHOR = 0, 1, 2
LAST = (1 << 63) - 1  # stands for a null id: after all others
ANSWERED = "batch long, kind int, bucket int, answers array<long>, found long"


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = ex.batch_numbers()

    def flush():
        columns = [
            pa.array([number()]), pa.array([carried], pa.list_(pa.string())), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
            pa.array([b"".join(texts)], pa.binary()), pa.array([size]),
        ]
        return pa.record_batch(columns, ["batch", "carried", "ids", "sizes", "text", "n"])

    ids, carried, texts, size = [], [], [], 0
    for batch in batches:
        for key, other, text in zip(
            batch.column("id").to_pylist(), batch.column("carried").to_pylist(), as_bytes(batch.column("text")), strict=True
        ):
            if ids and size + len(text) > BATCH:
                yield flush()
                ids, carried, texts, size = [], [], [], 0
            carried.append(other)
            ids.append(LAST if key is None else key)
            texts.append(text)
            size += len(text)
    if ids:
        yield flush()


class _Texts:
    """The documents of a batch in one buffer."""

    def __init__(self, row):
        self.ids = np.asarray(row["ids"], np.int64)
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.raw = row["text"]

    def copy_keys(self, seed: int) -> np.ndarray:
        view = memoryview(self.raw)
        spans = zip((self.ends - self.sizes).tolist(), self.ends.tolist(), strict=True)
        return np.array([xxhash.xxh64_intdigest(view[a:b], seed) for a, b in spans], np.uint64)

    def runs(self, limit: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First string start, number of strings and anchor of every segment, in order; ``skip`` marks documents to leave out."""
        part = 8 * (limit // 16)
        buffer = np.frombuffer(self.raw + bytes(limit + 16), np.uint8)
        begins = self.ends - self.sizes
        closed_from = np.where(skip, begins, np.maximum(begins, self.ends - limit + 1))
        found = []
        for start in range(0, len(self.raw), SLICE):
            stop = min(start + SLICE, len(self.raw))
            least = _window_minima(buffer[start : stop + limit + 8], stop - start, part, limit - part + 1)
            valid = np.ones(stop - start, bool)
            first, last = np.searchsorted(self.ends, start, side="right"), np.searchsorted(begins, stop, side="left")
            for low, high in zip(closed_from[first:last].tolist(), self.ends[first:last].tolist(), strict=True):
                valid[max(low - start, 0) : max(high - start, 0)] = False
            opens = valid.copy()
            opens[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
            at = np.flatnonzero(opens)
            closes = np.searchsorted(np.flatnonzero(~valid), at)
            gaps = np.append(np.flatnonzero(~valid), stop - start)
            until = np.minimum(np.append(at[1:], stop - start), gaps[closes])
            found.append((at + start, until - at, least[at]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def document_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")


def _window_minima(buffer: np.ndarray, n: int, part: int, width: int) -> np.ndarray:
    """For each of the first ``n`` places the least hash of the ``width`` parts that start from there on."""
    words = np.ndarray(len(buffer) - 7, dtype="<u8", buffer=np.ascontiguousarray(buffer), strides=(1,))
    count = n + width - 1
    x = words[:count] * ex.U(0x9E3779B97F4A7C15)
    for k in range(8, part, 8):
        x ^= x >> ex.U(32)
        x += words[k : k + count]
        x *= ex.U(0xBF58476D1CE4E5B9)
    x ^= x >> ex.U(29)
    x *= ex.U(0x94D049BB133111EB)
    x ^= x >> ex.U(32)
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(x[:n], x[rest : rest + n])


def _copies(texts: _Texts, replies: pd.DataFrame, buckets: int) -> np.ndarray:
    """True for documents whose whole text an earlier document has."""
    one, two = (ex.answers_for(texts.copy_keys(kind), replies, kind, buckets, np.int64) for kind in (COPY, COPY_TOO))
    return (one == two) & (one < texts.ids)


def _ask_copies(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    texts = _Texts(row)
                    for kind in (COPY, COPY_TOO):
                        yield row["batch"], kind, texts.copy_keys(kind), texts.ids

        yield from ex.questions_of(rows(), buckets)

    return ask


def _anchors(texts: _Texts, anchors: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of a batch and the number of documents that have each."""
    order = np.argsort(anchors, kind="stable")
    keys, docs = anchors[order], texts.document_of(starts)[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    other = new | np.append(True, docs[1:] != docs[:-1])[: len(keys)]
    first = np.flatnonzero(new)
    return keys[first], np.add.reduceat(other.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def _ask_anchors(limit: int, buckets: int):
    def ask(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        texts = _Texts(rows.iloc[0])
        starts, _, anchors = texts.runs(limit, _copies(texts, replies, buckets))
        keys, counts = _anchors(texts, anchors, starts)
        found = [b.to_pandas() for b in ex.questions_of(iter([(rows["batch"].iloc[0], ANCHOR, keys, counts)]), buckets)]
        return found[0] if found else pd.DataFrame({c: [] for c in ("batch", "kind", "bucket", "keys", "counts")})

    return ask


def _solve(kind: int, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The least id for copies; for anchors 0 (one document), 1 (shared) or 2 (hot)."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    group = np.empty(len(keys), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    if kind == ANCHOR:
        docs = np.add.reduceat(counts[order], first)
        return np.where(docs > HOT, 2, np.minimum(docs - 1, 1))[group], 0
    return np.minimum.reduceat(counts[order], first)[group], 0


def _segments(texts: _Texts, replies: pd.DataFrame, limit: int, buckets: int) -> tuple:
    """The shared segments of a batch: copies, string starts, string counts, hashes that deal them out, and their texts."""
    copies = _copies(texts, replies, buckets)
    starts, lengths, anchors = texts.runs(limit, copies)
    keys, _ = _anchors(texts, anchors, starts)
    codes = ex.answers_for(keys, replies, ANCHOR, buckets, np.int64)
    code = codes[np.searchsorted(keys, anchors)] if len(keys) else np.zeros(0, np.int64)
    shared, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
    spread = np.repeat(starts[hot], lengths[hot]) + np.arange(lengths[hot].sum()) - np.repeat(
        np.cumsum(lengths[hot]) - lengths[hot], lengths[hot]
    )
    raw = texts.raw
    alone = np.array([xxhash.xxh64_intdigest(raw[a : a + limit], 7) for a in spread.tolist()], np.uint64)
    starts = np.concatenate([starts[shared], spread])
    lengths = np.concatenate([lengths[shared], np.ones(len(spread), np.int64)])
    deal = np.concatenate([ex.mix(anchors[shared]), alone])
    order = np.argsort(starts, kind="stable")
    starts, lengths, deal = starts[order], lengths[order], deal[order]
    strings = [raw[a : a + n + limit - 1] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    return copies, starts, lengths, deal, strings


def _distinct(strings: list[bytes], ids: np.ndarray) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Number of each distinct string, the number of every string, and the least id of each distinct one."""
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(s, len(number)) for s in strings], np.int64)
    least = np.full(len(number), LAST, np.int64)
    np.minimum.at(least, which, ids)
    return number, which, least


def _ask_segments(limit: int, buckets: int, indexes: int):
    def ask(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        texts = _Texts(rows.iloc[0])
        _, starts, _, deal, strings = _segments(texts, replies, limit, buckets)
        number, which, least = _distinct(strings, texts.ids[texts.document_of(starts)])
        distinct = list(number)
        key = np.zeros(len(distinct), np.uint64)
        key[which] = deal
        order, at = ex.bucket_order(key, indexes)
        out = []
        for bucket in np.flatnonzero(np.diff(at)).tolist():
            mine = order[at[bucket] : at[bucket + 1]]
            parts = [distinct[i] for i in mine.tolist()]
            out.append((rows["batch"].iloc[0], bucket, b"".join(parts), np.array([len(p) for p in parts], np.int32), least[mine]))
        return pd.DataFrame(out, columns=["batch", "bucket", "data", "sizes", "ids"])

    return ask


def _index_segments(limit: int):
    def solve(group: pd.DataFrame) -> pd.DataFrame:
        strings, ids, counts = [], [], []
        for data, sizes, least in zip(group["data"], group["sizes"], group["ids"], strict=True):
            ends = np.cumsum(sizes).tolist()
            strings += [data[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)]
            ids.append(np.asarray(least))
            counts.append(len(sizes))
        number, which, least = _distinct(strings, np.concatenate(ids))
        sizes = np.array([len(s) for s in number], np.int64)
        text = np.frombuffer(bytes([SEPARATOR]).join(number) + bytes([SEPARATOR]), np.uint8)
        index = RunIndex(text, limit)
        per_interval = index.minima(np.repeat(least, sizes + 1))
        index.drop_construction()
        queries = text[text != SEPARATOR]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        length, row = index.matching_statistics(queries, offsets)
        earliest = np.where(length >= limit, per_interval[index.interval_of(row)], LAST)
        # per string its windows' earliest documents, as runs of equal values
        windows = np.repeat(offsets[:-1], sizes - limit + 1) + _within(sizes - limit + 1)
        owner, value = np.repeat(np.arange(len(sizes)), sizes - limit + 1), earliest[windows]
        change = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))[: len(value)]
        first = np.flatnonzero(change)
        run_value, run_size = value[first], np.diff(np.append(first, len(value)))
        run_of = np.searchsorted(owner[first], np.arange(len(sizes) + 1))
        out, at = [], 0
        for batch, bucket, n in zip(group["batch"], group["bucket"], counts, strict=True):
            wanted = which[at : at + n]
            at += n
            per = run_of[wanted + 1] - run_of[wanted]
            runs = np.repeat(run_of[wanted], per) + _within(per)
            out.append((batch, bucket, per.astype(np.int32), run_value[runs], run_size[runs].astype(np.int32)))
        return pd.DataFrame(out, columns=["batch", "bucket", "per", "value", "size"])

    return solve


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _remove(limit: int, buckets: int, indexes: int, characters: bool):
    def remove(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        texts = _Texts(row)
        marked = replies["kind"].isna()
        copies, starts, lengths, deal, strings = _segments(texts, replies[~marked], limit, buckets)
        doc = texts.document_of(starts)
        number, which, _ = _distinct(strings, texts.ids[doc])
        key = np.zeros(len(number), np.uint64)
        key[which] = deal
        order, _ = ex.bucket_order(key, indexes)
        cover = np.zeros(len(texts.raw) + 1, np.int64)
        if len(strings):
            found = replies[marked].sort_values("bucket")
            per, value, size = (np.concatenate(found[c].to_list()).astype(np.int64) for c in ("per", "value", "size"))
            first = np.empty(len(number), np.int64)
            first[order] = np.cumsum(per) - per
            n = np.empty(len(number), np.int64)
            n[order] = per
            runs = np.repeat(first[which], n[which]) + _within(n[which])
            segment = np.repeat(np.arange(len(starts)), n[which])
            before = np.cumsum(size[runs]) - size[runs]
            before -= np.repeat(before[np.cumsum(n[which]) - n[which]], n[which])
            hit = value[runs] < texts.ids[doc[segment]]
            low = starts[segment][hit] + before[hit]
            np.add.at(cover, low, 1)
            np.add.at(cover, low + size[runs][hit] + limit - 1, -1)
        gone = np.cumsum(cover[:-1]) > 0
        begins = texts.ends - texts.sizes
        whole = copies & (texts.sizes >= limit)
        for a, b in zip(begins[whole].tolist(), texts.ends[whole].tolist(), strict=True):
            gone[a:b] = True
        buffer = np.frombuffer(texts.raw, np.uint8)
        if characters and len(buffer):
            lead = np.flatnonzero((buffer & 0xC0) != 0x80)
            gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(buffer))))
        out = []
        for other, key_, a, b in zip(row["carried"], texts.ids.tolist(), begins.tolist(), texts.ends.tolist(), strict=True):
            here = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], here.view(np.int8), [0]])))
            out.append((other, key_, b - a, edges[::2].astype(np.int32), edges[1::2].astype(np.int32), buffer[a:b][~here].tobytes()))
        frame = pd.DataFrame(out, columns=["carried", "id", "n_bytes", "span_start", "span_stop", "kept"])
        frame["id"] = pd.arrays.IntegerArray(frame["id"].to_numpy(np.int64), frame["id"].to_numpy(np.int64) == LAST)
        return frame

    return remove


def remove_repeats(
    docs: DataFrame,
    limit: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    characters: bool = False,
) -> DataFrame:
    """``id_col, n_bytes, span_start, span_stop, kept`` and the columns in ``carry`` for every row.

    Removes each byte covered by a string of ``limit`` bytes (16 at least) that
    also starts in a row with a smaller id. Spans are the maximal removed runs,
    as arrays of byte offsets; ``kept`` holds the other bytes, joined. Null texts
    count as empty, a null id as larger than all others, and rows of equal id
    take nothing from each other; texts shorter than ``limit`` and empty tables
    stay as they are. With ``characters`` a character goes only if all its bytes
    do, so that ``kept`` stays valid UTF-8.

    The texts are written once, as batches bucketed by number, and answers come
    to them: who has a text first, which anchors are shared, and which strings
    an earlier document has. Only keys (8 bytes for some 13 bytes of text) and shared segments
    are shuffled. An anchor that many documents have is dealt out by the hash
    of each string, so a bucket stays near its average size.
    """
    if limit < 16:
        raise ValueError("limit must be at least 16")
    spark = docs.sparkSession
    others = F.to_json(F.struct(*carry)) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), others.alias("carried"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = ex.keep_bucketed(
        rows.mapInArrow(
            _text_batches, "batch long, carried array<string>, ids array<long>, sizes array<int>, text binary, n long"
        ),
        "text_batches",
        parts,
    )
    n = ex.total(batches, "n")
    buckets = ex.buckets_for(n // 13)
    whole, batches = batches.drop("n"), batches.select("batch", "ids", "sizes", "text")
    copies = materialize(ex.answer(batches.mapInArrow(_ask_copies(buckets), ex.QUESTION), _solve, "long"), "copies")
    asked = ex.per_batch(batches, copies, _ask_anchors(limit, buckets), ex.QUESTION)
    shared = materialize(ex.answer(asked, _solve, "tinyint"), "shared-anchors")
    known = copies.unionByName(shared.withColumn("answers", F.col("answers").cast("array<long>")))
    schema = "batch long, bucket int, data binary, sizes array<int>, ids array<long>"
    # as many buckets as if the whole text were shared: the segments of what is shared overlap
    indexes = max(64, -(-n // INDEXED))
    segments = ex.per_batch(batches, known, _ask_segments(limit, buckets, indexes), schema)
    marks = segments.groupBy("bucket").applyInPandas(
        _index_segments(limit), "batch long, bucket int, per array<int>, value array<long>, size array<int>"
    )
    marks = materialize(marks, "marks")
    every = known.unionByName(marks, allowMissingColumns=True)
    found = ex.per_batch(
        whole,
        every,
        _remove(limit, buckets, indexes, characters),
        "carried string, id long, n_bytes long, span_start array<int>, span_stop array<int>, kept binary",
    )
    back = [F.col("carried").getField(c).alias(c) for c in carry]
    if carry:
        found = found.withColumn("carried", F.from_json("carried", docs.select(*carry).schema))
    return found.select(F.col("id").alias(id_col), "n_bytes", "span_start", "span_stop", "kept", *back)
