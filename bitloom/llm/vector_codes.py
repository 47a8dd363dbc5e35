"""Compressing vectors to a few bytes: codebooks trained on Hilbert-sorted blocks, in exact integers.

Vectors are kept in groups, one written row each, that hold some two million
components whatever the dimension. Inside a group the parts at one position are
sorted along a Hilbert curve and cut into flat blocks of 64; a block stores the
smallest and largest value of each component and their sums. A round bounds the
distance of every codebook entry to every block by the block's box: an entry
whose nearest corner is farther than another entry's farthest corner is none of
its points' nearest. What is left is the block's shortlist. A shortlist of one
settles the block by its stored sums; else a small integer kernel compares its
points with the shortlist only. Tasks return counts and sums for each entry, so
a round shuffles (entries x dimension) numbers a task and never a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.plans.storage import materialize

BLOCK = 64  # points of a flat block
GROUP = 2_000_000  # components of a group
LARGEST = 1 << 24  # components beyond it, up or down, count as it: all sums stay exact in 64 bits
STEP = 64  # blocks that meet their shortlists at a time


@dataclass(frozen=True)
class Codes:
    """``rows`` holds ``id, label, codes array<int>, error``; ``codebooks`` maps a dimension to (parts, entries, length)."""

    rows: DataFrame
    codebooks: dict[int, np.ndarray]


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """An order of integer points along a Hilbert curve (after Skilling, 2004), ties as they come.

    The curve runs through the first 63 components at most, with as many bits as
    then fit 63; an order decides how tight the boxes are, never a result.
    """
    n, dims = points.shape[0], min(points.shape[1], 63)
    if not n or not dims:
        return np.arange(n)
    bits = 63 // dims
    axes = points[:, :dims].astype(np.int64)
    axes -= axes.min(0)
    widest = max(int(axes.max()), 1)
    x = (axes >> max(0, widest.bit_length() - bits)).T.copy()
    for level in reversed(range(1, bits)):
        low = (1 << level) - 1
        for i in range(dims):
            inverted = x[i] >> level & 1 == 1
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swapped)
            x[i] ^= swapped
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.int64)
    for level in reversed(range(1, bits)):
        turn ^= np.where(x[-1] >> level & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    index = np.zeros(n, np.int64)
    for level in reversed(range(bits)):
        for i in range(dims):
            index = index << 1 | x[i] >> level & 1
    return np.argsort(index, kind="stable")


@dataclass
class Blocks:
    """The parts of a group at one position."""

    points: np.ndarray  # (blocks, BLOCK, length), the last point repeated to fill the last block
    size: np.ndarray  # points of each block
    low: np.ndarray  # (blocks, length)
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Blocks:
        """``points`` in their final order."""
        n, length = points.shape
        count = -(-n // BLOCK)
        padded = np.concatenate([points, np.repeat(points[-1:], count * BLOCK - n, 0)]).astype(np.int64)
        size = np.full(count, BLOCK)
        size[-1] -= count * BLOCK - n
        cut = padded.reshape(count, BLOCK, length)
        sums = cut.sum(1)
        sums[-1] -= points[-1].astype(np.int64) * (BLOCK - size[-1])
        return cls(cut, size, cut.min(1), cut.max(1), sums)


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each block and entry, whether the entry can be the nearest of one of the block's points."""
    above, below = low[:, None] - book, book - high[:, None]
    gap = np.maximum(np.maximum(above, below), 0)
    reach = np.maximum(book - low[:, None], high[:, None] - book)
    nearest, farthest = (gap * gap).sum(-1), (reach * reach).sum(-1)
    return nearest <= farthest.min(1, keepdims=True)


def _nearest(points: np.ndarray, wanted: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance for the points of some blocks; ties go to the lower index."""
    block, entry = np.nonzero(wanted)
    difference = points[block] - book[entry][:, None]
    distance = np.einsum("kpd,kpd->kp", difference, difference)
    starts = np.searchsorted(block, np.arange(len(points)))
    least = np.minimum.reduceat(distance, starts)
    index = np.where(distance == least[block], entry[:, None], len(book))
    return np.minimum.reduceat(index, starts), least


def assign(blocks: Blocks, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every point in block order, and its squared distance."""
    wanted = shortlists(blocks.low, blocks.high, book)
    found = [_nearest(blocks.points[a : a + STEP], wanted[a : a + STEP], book) for a in range(0, len(wanted), STEP)]
    n = int(blocks.size.sum())
    entries, distances = (np.concatenate([f[k] for f in found]).ravel()[:n] for k in range(2))
    return entries, distances


def totals(blocks: Blocks, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and componentwise sums of the points nearest to each entry."""
    count, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
    wanted = shortlists(blocks.low, blocks.high, book)
    sure = wanted.sum(1) == 1
    settled = wanted[sure].argmax(1)
    np.add.at(count, settled, blocks.size[sure])
    np.add.at(sums, settled, blocks.sums[sure])
    points, wanted, size = blocks.points[~sure], wanted[~sure], blocks.size[~sure]
    for a in range(0, len(points), STEP):
        some = points[a : a + STEP]
        entry, _ = _nearest(some, wanted[a : a + STEP], book)
        real = np.arange(BLOCK) < size[a : a + STEP, None]
        np.add.at(count, entry[real], 1)
        np.add.at(sums, entry[real], some[real])
    return count, sums


def _usable(vector: str) -> F.Column:
    """Whether a vector is there and holds finite numbers only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def _integers(vectors: pa.ListArray, dim: int, scale: int) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(values.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int32).reshape(len(vectors), dim)


def _groups(rows: DataFrame, parts: int, scale: int) -> DataFrame:
    """Groups of vectors of one length: ids and labels as they came, the parts sorted and cut into blocks."""
    types = {c: rows.schema[c].dataType for c in ("id", "label")}
    listed = ", ".join(f"{c} array<{t.simpleString()}>" for c, t in types.items())
    flat = ["points", "place", "low", "high", "sums"]
    schema = f"dim int, {listed}, {', '.join(f'{c} array<{"long" if c == "sums" else "int"}>' for c in flat)}"

    def group(ids: list, labels: list, vectors: list, dim: int) -> pa.RecordBatch:
        whole = _integers(pa.concat_arrays(vectors), dim, scale)
        cut: dict[str, list] = {c: [] for c in flat}
        for part in np.split(whole, parts, 1):
            order = hilbert_order(part)
            blocks = Blocks.of(part[order])
            for c, values in zip(flat, (part[order], order, blocks.low, blocks.high, blocks.sums), strict=True):
                cut[c].append(values.ravel())
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        arrays = [one(pa.array(np.concatenate(cut[c]), pa.int64() if c == "sums" else pa.int32())) for c in flat]
        kept = [one(pa.concat_arrays(x)) for x in (ids, labels)]
        return pa.record_batch([pa.array([dim], pa.int32()), *kept, *arrays], ["dim", "id", "label", *flat])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            sizes = batch["dim"].to_numpy()
            for dim in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == dim))
                room = max(1, GROUP // max(1, dim))
                at = 0
                while at < own.num_rows:
                    lists = waiting.setdefault(dim, ([], [], []))
                    held = sum(map(len, lists[0]))
                    some = own.slice(at, room - held)
                    for kept, column in zip(lists, ("id", "label", "vector"), strict=True):
                        kept.append(some[column])
                    at += some.num_rows
                    if held + some.num_rows >= room:
                        yield group(*waiting.pop(dim), dim)
        for dim, lists in waiting.items():
            yield group(*lists, dim)

    return rows.mapInArrow(gather, schema)


def _parts_of(row: dict, parts: int) -> Iterator[tuple[Blocks, np.ndarray]]:
    """The blocks of each part of a group, and the place of each sorted point among the group's vectors."""
    dim, n = row["dim"], len(row["id"])
    length, count = dim // parts, -(-n // BLOCK)
    points = row["points"].reshape(parts, n, length)
    place = row["place"].reshape(parts, n)
    low, high, sums = (row[c].reshape(parts, count, length).astype(np.int64) for c in ("low", "high", "sums"))
    size = np.full(count, BLOCK)
    size[-1] -= count * BLOCK - n
    for p in range(parts):
        padded = np.concatenate([points[p], np.repeat(points[p, -1:], count * BLOCK - n, 0)]).astype(np.int64)
        yield Blocks(padded.reshape(count, BLOCK, length), size, low[p], high[p], sums[p]), place[p]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch[c][k].values for c in batch.schema.names if c != "dim"}
            numbers = {c: v.to_numpy() for c, v in row.items() if c not in ("id", "label")}
            yield row | numbers | {"dim": batch["dim"][k].as_py()}


def _first_codebooks(rows: DataFrame, entries: int, parts: int, scale: int) -> dict[int, np.ndarray]:
    """Parts of the vectors with the smallest ids, at most ``entries`` vectors of each length."""
    by_id = Window.partitionBy("dim").orderBy(F.col("id").asc_nulls_last())
    first = rows.withColumn("_n", F.dense_rank().over(by_id)).filter(F.col("_n") <= entries)
    once = first.groupBy("dim", "_n").agg(F.min("vector").alias("vector")).orderBy("dim", "_n").toArrow()
    dims, vectors = once["dim"].to_numpy(), once["vector"].combine_chunks()
    books = {}
    for dim in np.unique(dims).tolist():
        whole = _integers(vectors.filter(pa.array(dims == dim)), dim, scale)
        books[dim] = np.stack(np.split(whole.astype(np.int64), parts, 1))
    return books


def _round(groups: DataFrame, books: dict[int, np.ndarray], parts: int) -> dict[int, np.ndarray]:
    """Codebooks whose used entries are the floored means of what is nearest to them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for row in _read(batches):
            book = books[row["dim"]]
            whole = found.setdefault(row["dim"], np.zeros((*book.shape[:2], book.shape[2] + 1), np.int64))
            for p, (blocks, _) in enumerate(_parts_of(row, parts)):
                count, sums = totals(blocks, book[p])
                whole[p, :, 0] += count
                whole[p, :, 1:] += sums
        for dim, whole in found.items():
            cell = np.arange(whole.size)
            yield pa.record_batch(
                [pa.array(np.full(whole.size, dim, np.int32)), pa.array(cell), pa.array(whole.ravel())],
                ["dim", "cell", "value"],
            )

    cells = groups.select("dim", "id", "label", "points", "place", "low", "high", "sums").mapInArrow(add, "dim int, cell long, value long")
    # entries x (dimension + parts) numbers for each length of a vector, whatever the number of vectors
    summed = cells.groupBy("dim", "cell").agg(F.sum("value").alias("value")).toArrow()
    new = {}
    for dim, book in books.items():
        whole = np.zeros((*book.shape[:2], book.shape[2] + 1), np.int64)
        own = summed.filter(pa.compute.equal(summed["dim"], dim))
        whole.ravel()[own["cell"].to_numpy()] = own["value"].to_numpy()
        count = whole[:, :, :1]
        new[dim] = np.where(count > 0, whole[:, :, 1:] // np.maximum(count, 1), book)
    return new


def compress(
    df: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> Codes:
    """Codes of all vectors, and the codebooks they point into.

    A component x counts as floor(scale * x), at most 2^24 up or down. The
    codebook of each part starts as that part of the vectors with the smallest
    ``entries`` ids; ``rounds`` times, every part goes to the nearest entry
    (squared distance, ties to the lower index) and entries become the floored
    means of their parts.

    Null vectors and vectors with a null, NaN or infinite component are
    dropped, and those whose length ``parts`` does not divide. Vectors of each
    length have codebooks of their own. Repeated rows are all coded; an id that
    occurs more than once starts one entry (its smallest vector), a null id
    comes last. Fewer ids than ``entries`` make smaller codebooks. Labels may
    be null; an empty table gives no rows and no codebooks.
    """
    named = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    rows = named.filter(_usable("vector")).withColumn("dim", F.size("vector")).filter(F.col("dim") % parts == 0)
    books = _first_codebooks(rows, entries, parts, scale)
    groups = materialize(_groups(rows, parts, scale), "vector-groups")
    for _ in range(rounds):
        books = _round(groups, books, parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _read(batches):
            n = len(row["id"])
            codes, error = np.zeros((n, parts), np.int32), np.zeros(n, np.int64)
            for p, (blocks, place) in enumerate(_parts_of(row, parts)):
                entry, distance = assign(blocks, books[row["dim"]][p])
                codes[place, p] = entry
                error[place] += distance
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * parts + 1, parts, dtype=np.int32)), pa.array(codes.ravel()))
            dims = pa.array(np.full(n, row["dim"], np.int32))
            yield pa.record_batch([row["id"], row["label"], dims, lists, pa.array(error)], ["id", "label", "dim", "codes", "error"])

    types = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    schema = f"id {types['id']}, label {types['label']}, dim int, codes array<int>, error long"
    return Codes(groups.mapInArrow(encode, schema), books)


def restore(rows: DataFrame, codebooks: dict[int, np.ndarray], scale: int = 256, out: str = "vector") -> DataFrame:
    """Add ``out``: the vector that ``dim`` and ``codes`` stand for."""

    @F.arrow_udf("array<double>")
    def vectors(dims: pa.Array, codes: pa.Array) -> pa.Array:
        made = []
        for dim, code in zip(dims.to_pylist(), codes.to_pylist(), strict=True):
            known = code is not None and dim is not None
            made.append((codebooks[dim][np.arange(len(code)), code].ravel() / scale).tolist() if known else None)
        return pa.array(made, pa.list_(pa.float64()))

    return rows.withColumn(out, vectors("dim", "codes"))


def with_label_error(rows: DataFrame) -> DataFrame:
    """Add ``label_error``: the sum of ``error`` over the rows of a label, null labels together; null beyond 64 bits."""
    # summed in part before it is shuffled; written, so that the join is planned by its size
    sums = materialize(rows.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    named = sums.withColumnRenamed("label", "_label")
    return rows.join(named, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def digest_text(book: np.ndarray) -> str:
    """All components of a codebook in decimal, by part, entry and position, with commas between them."""
    return ",".join(map(str, book.ravel().tolist()))
