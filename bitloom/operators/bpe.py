"""Byte-level BPE: training, encoding, decoding."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions.ids import add_boundaries, truncate_ids
from bitloom.plans.storage import fits, materialize

# Reserved pieces in id order, and the pre-token pattern of byte-level BPE.
SPECIALS = ["<s>", "<pad>", "</s>", "<unk>"]
BOS, PAD, EOS, UNK = range(4)
PRE_TOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# the same, for text that is read line by line with the line end kept on its line
PRE_TOKEN_IN_LINES = (
    r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
    r"|[\s&&[^\n]]*\n|[\s&&[^\n]]+(?!\S)|[\s&&[^\n]]+"
)

MAX_PIECES = 1_000_000
CACHED_WORDS = 500_000
SUMMING_TASKS = 4


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 stays, the rest moves up from U+0100."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = [b for b in range(256) if b not in set(kept)]
    letters = {b: chr(b) for b in kept}
    letters.update({b: chr(256 + i) for i, b in enumerate(moved)})
    return letters


@dataclass(frozen=True)
class BpeModel:
    """``vocab`` holds ``id, piece``; ``merges`` holds ``rank, left, right``."""

    vocab: DataFrame
    merges: DataFrame


def pre_token_counts(lines: DataFrame) -> DataFrame:
    """Frequency of every pre-token; each line counts with its line end."""
    text = F.concat(F.col("line"), F.lit("\n"))
    found = F.regexp_extract_all(text, F.lit(PRE_TOKEN_IN_LINES), F.lit(0))
    pre_tokens = lines.select(F.explode_outer(found).alias("pretoken")).filter(F.col("pretoken").isNotNull())
    return pre_tokens.groupBy("pretoken").agg(F.count("*").alias("freq"))


def _merge(symbols: list[int], ranks: dict[tuple[int, int], list[tuple[int, int]]]) -> list[int]:
    """Apply merges in the order in which they were learnt, each to all its places from left to right.

    ``ranks`` has the ranks of each pair, ascending, with the new id of each. A
    pair that comes up again after its turn waits for its next rank, if any. A
    queue of places keeps long words from taking quadratic time.
    """
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    symbols: list[int | None] = list(symbols)
    queue = [(ranks[pair][0], i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
    heapify(queue)
    while queue:
        (rank, new), i, pair = heappop(queue)
        j = after[i]
        if j >= len(symbols) or (symbols[i], symbols[j]) != pair:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = new, None
        after[i] = after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < len(symbols):
                pair = (symbols[left], symbols[right])
                later = next((turn for turn in ranks.get(pair, ()) if turn[0] > rank), None)
                if later:
                    heappush(queue, (later, left, pair))
    return [s for s in symbols if s is not None]


def _pair_changes(
    words: DataFrame,
    byte_ids: list[int],
    spelled: list[bytes],
    merges: list[tuple[int, int, int]],
    done: int,
) -> DataFrame:
    """``l, r, change``: how merges ``done`` and later alter the counts of neighbour pairs, given those before them.

    A word can change only if its text holds the two pieces of a merge side by
    side, which is looked for in its bytes first. With ``done = 0`` and no
    merges, the counts themselves.
    """

    def index(some: list[tuple[int, int, int]]) -> dict:
        ranks: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for rank, (left, right, new) in enumerate(some):
            ranks.setdefault((left, right), []).append((rank, new))
        return ranks

    old, new = index(merges[:done]), index(merges[done:])
    sought = "|".join("".join(f"\\x{b:02x}" for b in spelled[left] + spelled[right]) for left, right, _ in merges[done:])

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = defaultdict(int)
        for batch in batches:
            if sought:
                batch = batch.filter(pc.match_substring_regex(batch["word"], pattern=sought))
            for word, freq in zip(batch["word"].to_pylist(), batch["freq"].to_pylist(), strict=True):
                was = _merge([byte_ids[b] for b in word], old)
                if not sought:
                    for pair in zip(was, was[1:]):
                        found[pair] += freq
                    continue
                now = _merge(was, new)
                if len(now) < len(was):
                    for pair in zip(was, was[1:]):
                        found[pair] -= freq
                    for pair in zip(now, now[1:]):
                        found[pair] += freq
        left, right = zip(*found, strict=True) if found else ((), ())
        columns = [pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(list(found.values()), pa.int64())]
        yield pa.record_batch(columns, ["l", "r", "change"])

    # every task has summed its own: few tasks add up the changes of a round, which is all scheduling otherwise
    parts = SUMMING_TASKS if sought else words.sparkSession.sparkContext.defaultParallelism
    partial = words.mapInArrow(changes, "l int, r int, change long").repartition(parts, "l", "r")
    return partial.groupBy("l", "r").agg(F.sum("change").alias("change")).filter("change <> 0")


class _Ranking:
    """The pairs above a count, by count and smallest ids: exact for counts above ``floor``, which others do not reach.

    It holds at most twice ``size`` pairs, however many words there are. A merge
    that spells a new piece takes from counts of old pairs and adds to pairs of
    the new piece alone, so what lies at or below the floor stays there.
    """

    def __init__(self, counts: DataFrame, size: int):
        rows: dict[str, list] = {}
        while not rows:
            self.size, self.floor = size, 0
            rows = counts.orderBy(F.desc("change"), "l", "r").limit(size + 1).toArrow().to_pydict()
            self.counts = {(a, b): n for a, b, n in zip(rows["l"], rows["r"], rows["change"], strict=True)}
            self.queue = [(-n, pair) for pair, n in self.counts.items()]
            heapify(self.queue)
            self._trim(size)
            if rows["l"] and not self.counts:
                rows, size = {}, 2 * size  # all of one count: none is above the floor

    def _trim(self, most: int) -> None:
        if len(self.counts) > most:
            ordered = sorted(self.counts.values(), reverse=True)
            self.floor = max(self.floor, ordered[self.size])
            self.counts = {pair: n for pair, n in self.counts.items() if n > self.floor}
            self.queue = [(-n, pair) for pair, n in self.counts.items()]
            heapify(self.queue)

    def change(self, rows: dict[str, list]) -> None:
        for left, right, n in zip(rows["l"], rows["r"], rows["change"], strict=True):
            pair = (left, right)
            if n > 0 or pair in self.counts:
                total = self.counts.pop(pair, 0) + n
                if total > self.floor:
                    self.counts[pair] = total
                    heappush(self.queue, (-total, pair))
        self._trim(2 * self.size)

    def pop(self) -> tuple[int, int, int] | None:
        """Remove and return the first pair with its count."""
        while self.queue:
            n, pair = heappop(self.queue)
            if self.counts.get(pair) == -n:
                del self.counts[pair]
                return *pair, -n
        return None

    def put_back(self, left: int, right: int, n: int) -> None:
        self.counts[left, right] = n
        heappush(self.queue, (-n, (left, right)))


def train_bpe(
    lines: DataFrame,
    vocab_size: int = 8000,
    min_frequency: int = 2,
    merges_per_round: int | None = None,
    pairs_kept: int = 200_000,
) -> BpeModel:
    """Learn byte-level BPE merges from a ``line`` column, as one merge at a time would.

    Distinct words with their counts are written once and never changed: the
    merges so far say how a word is cut. The driver ranks the most frequent
    pairs, at most ``2 * pairs_kept`` of them. A round takes several merges from
    the front, then one Spark job finds the words that hold one of them, cuts
    these with and without the new merges, and sums by how much that changes
    the counts of pairs. Only those sums (at most two for each new merge and
    piece) reach the driver. All pairs are counted at the beginning, and again
    if fewer frequent ones are left than were ranked.

    Walk down the pairs by (count, smallest ids) and accept until one ends with
    the left side of an accepted pair, or begins with the right side of one.
    Up to there, accepted merges change no count of a later pair: merging (a, b)
    takes from pairs that end with a or begin with b alone. A pair that such a
    merge creates contains a new id and is no more frequent than the pair it
    grew from, which ranks lower than all accepted ones, so it cannot come
    first. If a merge spells a piece that exists already, its pairs gain
    counts, so the round ends with it.

    ``merges_per_round`` (null: no limit) and ``pairs_kept`` do not change the result.
    """
    spark = lines.sparkSession
    alphabet = byte_alphabet()
    pieces = SPECIALS + sorted(alphabet.values())
    ids = {piece: i for i, piece in enumerate(pieces)}
    byte_ids = [ids[alphabet[b]] for b in range(256)]
    spelled = [b""] * len(SPECIALS) + [bytes([b]) for _, b in sorted((ch, b) for b, ch in alphabet.items())]
    merges: list[tuple[int, int, int]] = []
    names: list[tuple[str, str]] = []

    longer = pre_token_counts(lines).filter(F.octet_length("pretoken") > 1)
    rows = longer.select(F.col("pretoken").cast("binary").alias("word"), "freq")
    spread = rows.repartition(spark.sparkContext.defaultParallelism, "word")
    words = materialize(spread, "bpe-words").persist(StorageLevel.MEMORY_AND_DISK)  # lost blocks are read again
    ranking = None
    while len(pieces) < vocab_size:
        if ranking is None:
            ranking = _Ranking(_pair_changes(words, byte_ids, spelled, merges, len(merges)), pairs_kept)
        done, lefts, rights, known = len(merges), set(), set(), False
        while len(pieces) < vocab_size and len(merges) - done != merges_per_round and not known:
            first = ranking.pop()
            if first is None:
                break
            left, right, freq = first
            if freq < min_frequency or right in lefts or left in rights:
                ranking.put_back(left, right, freq)
                break
            lefts.add(left)
            rights.add(right)
            joined = pieces[left] + pieces[right]
            known = joined in ids
            if not known:
                ids[joined] = len(pieces)
                pieces.append(joined)
                spelled.append(spelled[left] + spelled[right])
            merges.append((left, right, ids[joined]))
            names.append((pieces[left], pieces[right]))
        if len(merges) == done:
            if ranking.floor < min_frequency:
                break
            ranking = None  # what is above the floor is used up
        elif known and ranking.floor:
            ranking = None  # pairs below the floor may have gained
        elif len(pieces) < vocab_size:
            ranking.change(_pair_changes(words, byte_ids, spelled, merges, done).toArrow().to_pydict())
    words.unpersist()
    return bpe_model(spark, pieces, names)


def bpe_model(spark: SparkSession, pieces: list[str], merges: list[tuple[str, str]]) -> BpeModel:
    vocab = spark.createDataFrame(list(enumerate(pieces)), "id int, piece string")
    rules = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string")
    return BpeModel(vocab, rules)


def _rules(model: BpeModel):
    """Driver copy of a model, whose size is bounded by its vocabulary size."""
    if not (fits(model.vocab, MAX_PIECES) and fits(model.merges, MAX_PIECES)):
        raise ValueError(f"a BPE model may have at most {MAX_PIECES} pieces and merges")
    ids = {row["piece"]: row["id"] for row in model.vocab.collect()}
    byte_ids = [ids[ch] for _, ch in sorted(byte_alphabet().items())]
    merges = {
        (ids[row["left"]], ids[row["right"]]): (row["rank"], ids[row["left"] + row["right"]])
        for row in model.merges.collect()
    }
    return ids, byte_ids, merges


def _encode_word(word: str, byte_ids: list[int], merges: dict) -> list[int]:
    """Ids of one pre-token: always apply the earliest learned merge, leftmost first.

    A queue of mergeable places keeps long pre-tokens (text without spaces) from
    taking quadratic time.
    """
    symbols: list[int | None] = [byte_ids[b] for b in word.encode()]
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    queue = [
        (merges[pair][0], i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in merges
    ]
    heapify(queue)
    while queue:
        _, i, pair = heappop(queue)
        j = after[i]
        if j >= len(symbols) or (symbols[i], symbols[j]) != pair:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = merges[pair][1], None
        after[i] = after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < len(symbols) and (symbols[left], symbols[right]) in merges:
                new = (symbols[left], symbols[right])
                heappush(queue, (merges[new][0], left, new))
    return [s for s in symbols if s is not None]


def bpe_encode(
    df: DataFrame, model: BpeModel, text_col: str, max_len: int = 128, mode: str = "truncate", out: str = "ids"
) -> DataFrame:
    """Add ``out``: ids with boundaries.

    ``mode="truncate"`` keeps ``max_len`` ids, ``"filter"`` drops longer rows,
    ``"keep"`` does neither. Rows stay where they are: pre-tokens are found in
    the JVM, and each distinct one of an Arrow batch is encoded once, with a
    bounded cache across batches.
    """
    if mode not in ("truncate", "filter", "keep"):
        raise ValueError(f"unknown mode: {mode}")
    pieces, byte_ids, merges = _rules(model)
    shared = df.sparkSession.sparkContext.broadcast((byte_ids, merges))
    seen: dict[str, list[int]] = {}

    @F.arrow_udf("array<int>")
    def encode(lists: pa.Array) -> pa.Array:
        words = lists.values.dictionary_encode()
        if len(seen) > CACHED_WORDS:
            seen.clear()
        encoded = []
        for word in words.dictionary.to_pylist():
            if word not in seen:
                seen[word] = _encode_word(word, *shared.value)
            encoded.append(seen[word])
        sizes = np.array([len(e) for e in encoded], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.array([i for e in encoded for i in e], dtype=np.int32)
        which = words.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes[which])))
        shift = np.repeat(starts[which] - ends[:-1], sizes[which])
        rows = ends[lists.offsets.to_numpy()]
        return pa.ListArray.from_arrays(
            pa.array(rows, pa.int32()), pa.array(flat[shift + np.arange(ends[-1])], pa.int32())
        )

    pre_tokens = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(PRE_TOKEN), F.lit(0))
    if mode == "filter":
        encode = encode.asNondeterministic()  # or the filter below would encode a second time
    encoded = df.withColumn(out, encode(pre_tokens))
    bos, eos = pieces["<s>"], pieces["</s>"]
    if mode == "truncate":
        return encoded.withColumn(out, truncate_ids(out, max_len, bos, eos))
    whole = encoded.withColumn(out, add_boundaries(out, bos, eos))
    return whole.filter(F.size(out) <= max_len) if mode == "filter" else whole


def bpe_decode(df: DataFrame, model: BpeModel, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """Add ``out``: the text of the ids, without reserved and unknown ids."""
    if not fits(model.vocab, MAX_PIECES):
        raise ValueError(f"a BPE model may have at most {MAX_PIECES} pieces")
    to_byte = {ch: b for b, ch in byte_alphabet().items()}
    entries = [r for r in model.vocab.collect() if r["piece"] not in SPECIALS]
    known = pa.array([r["id"] for r in entries], pa.int32())
    spelled = pa.array([bytes(to_byte[ch] for ch in r["piece"]) for r in entries] + [b""], pa.binary())
    shared = df.sparkSession.sparkContext.broadcast((known, spelled))

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        known, spelled = shared.value
        places = pc.fill_null(pc.index_in(lists.values.cast(known.type), value_set=known), len(known))
        chunks = pa.ListArray.from_arrays(lists.offsets, spelled.take(places))
        joined = pc.binary_join(chunks, b"").to_pylist()
        nulls = lists.is_null().to_pylist()
        return pa.array(
            [None if n else t.decode(errors="replace") for t, n in zip(joined, nulls)], pa.string()
        )

    return df.withColumn(out, decode(F.col(ids_col)))
