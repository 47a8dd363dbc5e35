"""A bigram language model by deleted interpolation, and its scores of whole texts.

P(w | v) = λ2(b) c(v w) / c(v) + λ1(b) c(w) / N + λ0(b) / (V + 1)

where b is the frequency class of the context v. The weights are learned by
expectation-maximisation on held-out counts: every training token is scored with
itself taken out of all counts (the "deleted" estimate). Words are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm import exchange as ex
from bitloom.llm.arrow import as_bytes, lists_of
from bitloom.plans.storage import materialize

BATCH = 1_000_000  # tokens of a batch; one document is never split
CLASSES = 32  # context classes: unseen, then by powers of two
BIN = 0.05  # width in log10 of the cells in which held-out tokens are counted
UNIGRAM, BIGRAM = 0, 1
HELD, NO_ID = 1, 2  # flags of a document
END, START = b"\n", b"\t"  # white space, so no word


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``BATCH`` tokens: the words' hashes, and every token as a place in them."""
    number = ex.batch_numbers()

    def flush():
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in index], dtype=np.uint64).view(np.int64)
        columns = [
            pa.array([number()]),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([flags], pa.list_(pa.int8())),
            pa.array([lengths], pa.list_(pa.int32())),
            lists_of(hashes, np.array([len(hashes)])),
            lists_of(np.concatenate(tokens), np.array([sum(lengths)])),
            pa.array([sum(n for n, f in zip(lengths, flags, strict=True) if not f & HELD)]),
            pa.array([sum(lengths)]),
        ]
        return pa.record_batch(columns, ["batch", "ids", "flags", "lengths", "words", "tokens", "n_train", "n"])

    index, ids, flags, lengths, tokens, size = {START: 0, END: 1}, [], [], [], [], 0
    for batch in batches:
        for key, out, text in zip(
            batch.column("id").to_pylist(), batch.column("held").to_pylist(), as_bytes(batch.column("text")), strict=True
        ):
            put = index.setdefault
            places = [put(word, len(index)) for word in text.lower().split()]
            places.append(1)
            ids.append(key or 0)
            flags.append((HELD if out else 0) + (NO_ID if key is None else 0))
            lengths.append(len(places))
            tokens.append(np.array(places, np.int32))
            size += len(places)
            if size >= BATCH:
                yield flush()
                index, ids, flags, lengths, tokens, size = {START: 0, END: 1}, [], [], [], [], 0
    if ids:
        yield flush()


class _Batch:
    """A batch as arrays: tokens, their contexts, and the distinct pairs of both."""

    def __init__(self, lengths: np.ndarray, flags: np.ndarray, words: np.ndarray, tokens: np.ndarray):
        self.lengths = lengths
        self.hashes = words.astype(np.int64).view(np.uint64)
        self.tokens = tokens.astype(np.int64)
        first = np.cumsum(lengths) - lengths
        self.context = np.concatenate([[0], self.tokens[:-1]])
        self.context[first] = 0
        self.train = np.repeat((flags & HELD) == 0, lengths)
        pairs = self.context * len(words) + self.tokens
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)
        left, right = self.pairs // len(words), self.pairs % len(words)
        self.pair_keys = ex.mix(ex.mix(self.hashes[left]) + ex.U(0x9E3779B97F4A7C15) * (self.hashes[right] | ex.U(1)) + self.hashes[right])
        self.word_keys = ex.mix(self.hashes)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        words = np.bincount(self.tokens[self.train], minlength=len(self.hashes))
        starts = np.repeat(np.arange(len(self.lengths)), self.lengths)
        words[0] = np.unique(starts[self.train]).size  # the start stands before the first token of a text
        return words, np.bincount(self.pair[self.train], minlength=len(self.pairs))


def _arrays(row) -> _Batch:
    return _Batch(*(np.asarray(row[c]) for c in ("lengths", "flags", "words", "tokens")))


def _questions(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    get = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
                    found = _Batch(get("lengths"), get("flags"), get("words"), get("tokens"))
                    words, pairs = found.counts()
                    number = batch.column("batch")[i].as_py()
                    yield number, UNIGRAM, found.word_keys, words
                    yield number, BIGRAM, found.pair_keys, pairs

        yield from ex.questions_of(rows(), buckets)

    return ask


def _sums(_kind: int, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The sum over all batches for every key, and how many keys are known."""
    _, place = np.unique(keys, return_inverse=True)
    sums = np.bincount(place, weights=counts).astype(np.int64)
    return sums[place], int((sums > 0).sum())


def _classes(counts: np.ndarray) -> np.ndarray:
    return np.minimum(CLASSES - 1, np.ceil(np.log2(np.maximum(counts, 0.5))).astype(np.int64) + 1)


def _estimates(found: _Batch, replies: pd.DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """c(w), c(v) and c(v w) of every token."""
    words = ex.answers_for(found.word_keys, replies, UNIGRAM, buckets, np.int64)
    pairs = ex.answers_for(found.pair_keys, replies, BIGRAM, buckets, np.int64)
    return words[found.tokens], words[found.context], pairs[found.pair]


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _held_out_cells(buckets: int, n: int, v: int):
    """Counts of training tokens by context class and deleted estimates, in cells of ``BIN``."""

    def cells(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        found = _arrays(rows.iloc[0])
        word, context, pair = (c[found.train] - 1 for c in _estimates(found, replies, buckets))
        p2, p1 = _divide(pair, context) * (v + 1), word / max(n - 1, 1) * (v + 1)
        cell = lambda p: np.where(p > 0, 2 + np.round((np.log10(np.maximum(p, 1e-12)) + 12) / BIN), 0).astype(np.int64)
        key = (_classes(context) << 40) + (cell(p2) << 20) + cell(p1)
        keys, counts = np.unique(key, return_counts=True)
        return pd.DataFrame({"cell": keys, "n": counts.astype(np.int64)})

    return cells


def mixture_weights(cells: pd.DataFrame, rounds: int = 100) -> np.ndarray:
    """λ per context class by expectation-maximisation; a class nobody held out takes the weights of all."""
    key, n = cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64)
    value = lambda c: np.where(c > 0, 10.0 ** ((c - 2) * BIN - 12), 0.0)
    p = np.stack([value(key >> 20 & 0xFFFFF), value(key & 0xFFFFF), np.ones(len(key))], 1)

    def learn(rows: np.ndarray) -> np.ndarray:
        lam = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p[rows] * lam
            share /= share.sum(1, keepdims=True)
            lam = (share * n[rows, None]).sum(0) / n[rows].sum()
        lam = np.maximum(lam, 1e-6)
        return lam / lam.sum()

    if not len(key):
        return np.tile([0.0, 0.0, 1.0], (CLASSES, 1))
    general = learn(np.arange(len(key)))
    found = [learn(at) if len(at := np.flatnonzero(key >> 40 == c)) else general for c in range(CLASSES)]
    lam = np.array(found)
    lam[0] = np.array([0.0, *(lam[0][1:] / lam[0][1:].sum())])  # an unseen context has no pairs
    return lam


def _scores(buckets: int, n: int, v: int, weights: np.ndarray):
    def score(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        found, flags = _arrays(row), np.asarray(row["flags"])
        word, context, pair = _estimates(found, replies, buckets)
        lam = weights[_classes(context)]
        p = lam[:, 0] * _divide(pair, context) + lam[:, 1] * (word / max(n, 1)) + lam[:, 2] / (v + 1)
        base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
        text = np.repeat(np.arange(len(found.lengths)), found.lengths)
        add = lambda x: np.bincount(text, weights=x, minlength=len(found.lengths))
        return pd.DataFrame({
            "id": pd.arrays.IntegerArray(np.array(row["ids"], np.int64), (flags & NO_ID) > 0),
            "held_out": (flags & HELD) > 0,
            "n_tokens": found.lengths.astype(np.int64),
            "n_known": add(word > 0).astype(np.int64),
            "train_tokens": np.full(len(found.lengths), n, np.int64),
            "base_score": add(base),
            "score": add(np.log10(p)),
        })

    return score


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the rows where ``held_out`` is false (null counts as
    false) and scores all of them. Tokens are runs without ASCII white space,
    A-Z lower-cased, then one end; a null text is empty. ``base_score`` is the
    add-half unigram model, ``score`` the interpolated one, both log10. An
    unknown word gets the uniform share. Without training rows the base is
    uniform, and an empty table gives an empty result; repeated rows count as
    often as they occur.

    Tokens are kept as arrays in written batches, bucketed so that the answers
    come to them; the shuffle moves each distinct pair of a batch once. All
    counts cover all training rows. To the driver come N, V and the held-out
    counts in cells (at most classes x cells², whatever the data).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    schema = (
        "batch long, ids array<long>, flags array<tinyint>, lengths array<int>, words array<long>, tokens array<int>, "
        "n_train long, n long"
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = ex.keep_bucketed(rows.mapInArrow(_token_batches, schema), "lm_batches", parts)
    n, tokens = ex.total(batches, "n_train"), ex.total(batches, "n")
    buckets = ex.buckets_for(tokens)
    asked = batches.select("batch", "flags", "lengths", "words", "tokens").mapInArrow(_questions(buckets), ex.QUESTION)
    replies = materialize(ex.answer(asked, _sums, "long"), "lm-counts")
    v = max(0, ex.total(replies.filter(F.col("kind") == UNIGRAM), "found") - 1)  # without the start
    arrays = batches.select("batch", "ids", "flags", "lengths", "words", "tokens")
    cells = ex.per_batch(arrays, replies, _held_out_cells(buckets, n, v), "cell long, n long")
    weights = mixture_weights(cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas())
    scored = ex.per_batch(
        arrays,
        replies,
        _scores(buckets, n, v, weights),
        "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scored.withColumnRenamed("id", id_col)
