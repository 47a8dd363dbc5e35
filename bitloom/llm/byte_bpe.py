"""Byte-level BPE encoding and decoding with a published vocabulary.

The bytes of a piece are read as Latin-1, so that an Aho-Corasick automaton over
all tokens lists the longest tokens one after another. Encoding follows that list
as long as each token is compatible with the one before it. Where one is not, it
takes the next shorter token, or steps back where none fits, and has the automaton
go on from there. Two tokens are compatible if merging would keep them apart,
which depends on the two alone and is remembered. Every prefix has one encoding,
so a place that had to be left is never tried again and the work is linear in the
piece. (The idea of deciding by adjacent pairs is that of the public `bpe` crate.)
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.arrow import lists_of, slices

REMEMBERED = 200_000  # words or pieces in a generation of a worker's memory; results do not depend on it
PAIRS = 400_000  # token pairs it keeps
DOOR = 1 << 21
MARKS = ".,;:!?"
OTHER_SCRIPTS = "\u0250"  # letters before it have been letters in every Unicode version
LONG_PIECE = 64  # characters beyond which a piece is not remembered
# fixed value: the published pattern of this family of vocabularies
LONE_SPACE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# a space at either end or beside white space; without one, every space starts a piece of that pattern
AROUND_SPACE = re.compile(r"\s | \s|^ | \Z").search


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a ``.tiktoken`` file in rank order.

    The file is read on the driver: a vocabulary is a parameter of some 100,000
    entries, not data. Ranks without gaps and all 256 bytes are required.
    """
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    tokens = [ranks[i] for i in range(len(ranks))]
    missing = {bytes([b]) for b in range(256)} - set(tokens)
    if missing:
        raise ValueError(f"the vocabulary has no token for {len(missing)} of the 256 bytes")
    return tokens


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens whose merge makes ``token``, None if merging never makes it."""
    own, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        merges = [ranks.get(a + b, own) for a, b in zip(parts, parts[1:], strict=False)]
        rank = min(merges)
        if rank >= own:
            return None
        i = merges.index(rank)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return ranks[parts[0]], ranks[parts[1]]


@functools.lru_cache(maxsize=4)
def merge_table(path: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Tokens, and the left and right part of each: -1 for bytes, -2 for tokens that no merge makes."""
    tokens = read_ranks(path)
    ranks = {token: rank for rank, token in enumerate(tokens)}
    left, right = np.full(len(tokens), -1, np.int32), np.full(len(tokens), -1, np.int32)
    for rank, token in enumerate(tokens):
        if len(token) > 1:
            left[rank], right[rank] = _last_merge(token, ranks) or (-2, -2)
    return tokens, left, right


class Memory:
    """Encodings of what was met twice or more, in two generations: when the younger is full it becomes the older."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.door = bytearray(DOOR)  # marks of what was met once

    def put(self, key: str, ids: bytes) -> None:
        place = hash(key) % DOOR
        if key not in self.old and not self.door[place]:
            self.door[place] = 1
            return
        if len(self.young) >= REMEMBERED:
            self.old, self.young, self.door = self.young, {}, bytearray(DOOR)
        self.young[key] = ids


class Encoder:
    """Encodes texts; one per Python worker."""

    def __init__(self, tokens: list[bytes], left: np.ndarray, right: np.ndarray, pattern: str):
        self.pieces = regex.compile(pattern).findall
        self.by_words = pattern == LONE_SPACE_PATTERN
        self.whole = {token.decode("latin-1"): rank for rank, token in enumerate(tokens)}
        self.made = {token: rank for token, rank in self.whole.items() if left[rank] != -2}  # by merging
        self.length = [len(token) for token in tokens]
        self.left, self.right = left.tolist(), right.tolist()
        self.merged = {(a, b): t for t, (a, b) in enumerate(zip(self.left, self.right, strict=True)) if a >= 0}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.made.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.shorter = [self._prefix(token) for token in self.whole]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known_pieces, self.known_words = Memory(), Memory()

    def _prefix(self, token: str) -> int:
        """The longest token that merging makes and that starts ``token``, -1 if there is none."""
        for end in range(len(token) - 1, 0, -1):
            rank = self.made.get(token[:end], -1)
            if rank >= 0:
                return rank
        return -1

    def _compatible(self, a: int, b: int) -> bool:
        """True if merging the bytes of both tokens ends with these two tokens.

        Undo merges from the latest back; if a token across the border could be
        made before the one just undone, merging would have made it.
        """
        limit = len(self.length)
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b:
                limit = a
                if self.left[a] >= 0:
                    a = self.right[a]
                    continue
                limit = b + 1
                if self.left[b] < 0:
                    return True
                b = self.left[b]
            else:
                limit = b + 1
                if self.left[b] >= 0:
                    b = self.left[b]
                    continue
                limit = a
                if self.left[a] < 0:
                    return True
                a = self.right[a]

    def _remember(self, pair: tuple[int, int]) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[pair] = self._compatible(*pair)
        return found

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of the bytes of ``piece``, given as Latin-1."""
        if piece in self.whole:
            return [self.whole[piece]]
        length, shorter, n = self.length, self.shorter, len(piece)
        longest, pairs, left_behind = self.automaton.iter_long, self.pairs, set()
        out: list[int] = []
        place, last = 0, -1
        ahead = longest(piece)  # longest tokens one after another, as long as each is taken
        token = next(ahead)[1]
        while True:
            end = place + length[token]
            if end not in left_behind:
                fits = last < 0 or pairs.get((last, token))
                if fits is None:
                    fits = self._remember((last, token))
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    place, last = end, token
                    if ahead is None:
                        ahead = longest(piece, place)
                    token = next(ahead)[1]
                    continue
            ahead, token = None, shorter[token]
            while token < 0:  # nothing fits here: step back
                left_behind.add(place)
                token = out.pop()
                place -= length[token]
                token = shorter[token]
                last = out[-1] if out else -1

    def _encode_pieces(self, text: str) -> bytes:
        """The ids of all pieces of ``text`` as 32-bit integers."""
        pieces = self.pieces(text)
        found = list(map(self.known_pieces.young.get, pieces))
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self._piece(pieces[i])
        return b"".join(found)

    def _piece(self, piece: str) -> bytes:
        known = self.known_pieces
        ids = known.young.get(piece)
        if ids is None:
            ids = known.old.get(piece)
            if ids is None:
                latin = piece if piece.isascii() else piece.encode().decode("latin-1")
                ids = array("i", self.encode_piece(latin)).tobytes()
            if len(piece) <= LONG_PIECE:
                known.put(piece, ids)
        return ids

    def _word(self, word: str) -> bytes:
        """A word after a lone space that is not among the younger ones."""
        known = self.known_words
        ids = known.old.get(word)
        if ids is None:
            ids = self._encode_word(word)
        if len(word) <= LONG_PIECE:
            known.put(word, ids)
        return ids

    def _start(self, word: str, space: str) -> bytes:
        """A word after ``space`` or a line end: letters are one piece, a mark after them another; anything else is cut by the pattern."""
        if word.isascii() or (word and max(word) < OTHER_SCRIPTS):
            if word.isalpha():
                return self._piece(space + word)
            if word[-1:] in MARKS and word[:-1].isalpha():
                return self._piece(space + word[:-1]) + self._piece(word[-1])
        return self._encode_pieces(space + word)

    def _encode_word(self, word: str) -> bytes:
        """A word after a lone space; a single line end within it is a piece, so what stands around it is encoded by itself."""
        if "\n" not in word:
            return self._start(word, " ")
        lines = word.split("\n")
        if not all(lines) or word.split() != lines:
            return self._encode_pieces(" " + word)
        known, first = self.known_words.young, lines[0]
        return self._piece("\n").join([known.get(first) or self._word(first), *[self._start(line, "") for line in lines[1:]]])

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers.

        Where the pattern is known to start a piece at every lone space, the
        words between lone spaces are remembered with all their pieces.
        """
        if not self.by_words or AROUND_SPACE(text):
            return self._encode_pieces(text)
        first, *words = text.split(" ")
        found = list(map(self.known_words.young.get, words))
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self._word(words[i])
        return self._encode_pieces(first) + b"".join(found)


def _encoding(shared) -> Callable[[pa.Array], pa.Array]:
    def encode(texts: pa.Array) -> pa.Array:
        known = shared.value
        if "encoder" not in known:
            known["encoder"] = Encoder(known["tokens"], known["left"], known["right"], known["pattern"])
        encoder = known["encoder"]
        found = [encoder.encode(text.as_py() or "") for text in texts]
        return lists_of(np.frombuffer(b"".join(found), np.int32), np.array([len(ids) // 4 for ids in found], np.int64))

    return encode


def _decoding(shared) -> Callable[[pa.Array], pa.Array]:
    def decode(lists: pa.Array) -> pa.Array:
        token = shared.value["tokens"].__getitem__
        return pa.array([b"".join(map(token, row.tolist())) for row in slices(lists)], pa.binary())

    return decode


class ByteBpe:
    """Encoding and decoding columns for one vocabulary file.

    ``path`` is a ``.tiktoken`` file on the driver, whose tokens (a bounded
    parameter) are broadcast; ``pattern`` cuts a text into the pieces that are
    encoded separately. Null texts count as empty and give no ids; texts are
    encoded whole, whatever their length, without special tokens.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        tokens, left, right = merge_table(path)
        # a worker adds its encoder to its own copy, so that later tasks find it with all it remembers
        self.shared = spark.sparkContext.broadcast({"tokens": tokens, "left": left, "right": right, "pattern": pattern})

    def encode(self, text: Column | str) -> Column:
        """``array<int>``: the token ids of a text."""
        encoded = _encoding(self.shared)
        encode = F.arrow_udf(lambda texts: encoded(texts), "array<int>")
        return encode(F.col(text) if isinstance(text, str) else text)

    def round_trip(self, text: Column | str) -> Column:
        """``struct<ids, decoded>``: the token ids of a text and the bytes that they decode to, each made once.

        Columns that build on `encode` and on `decode` of it would encode twice.
        """
        encoded, decoded = _encoding(self.shared), _decoding(self.shared)

        def both(texts: pa.Array) -> pa.Array:
            ids = encoded(texts)
            return pa.StructArray.from_arrays([ids, decoded(ids)], ["ids", "decoded"])

        column = F.col(text) if isinstance(text, str) else text
        return F.arrow_udf(lambda texts: both(texts), "struct<ids: array<int>, decoded: binary>")(column)

    def decode(self, ids: Column | str) -> Column:
        """``binary``: the bytes of token ids; null counts as no ids, an unknown id raises."""
        decoded = _decoding(self.shared)
        decode = F.arrow_udf(lambda lists: decoded(lists), "binary")
        return decode(F.col(ids) if isinstance(ids, str) else ids)
