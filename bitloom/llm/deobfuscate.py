"""Noisy-channel restoring of disguised words.

The writer meant a word; the channel wrote look-alikes for letters, put
separators between them or repeated them. A span that shows such signs becomes
a lattice of the letters it may stand for, and Viterbi search finds the path
with the best sum of channel cost and character language model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.arrow import as_bytes

# fixed values: letters that digits and signs commonly stand for
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "¡": "i", "£": "l", "*": "aeiou",
}
SIGNS = re.compile("[" + re.escape("".join(LOOKALIKES)) + "]")
SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?:([ .\-_*·])[^\W\d_])(?:\1[^\W\d_])+(?![^\W\d_]|[.\-_*·][^\W\d_])")
REPEATED = re.compile(r"([^\W\d_])\1\1+")
# log10 costs of the channel
COST_SIGN, COST_REPEAT, COST_DOUBLE = -0.7, -0.4, -1.5
LETTERS = 60  # classes of characters: 0 is no letter, then a-z, the Latin-1 letters, and any other letter
CHUNK = 1 << 21
VOWELS = "aeiouyàéèó"  # one-letter words
REMEMBERED = 200_000


def _class_table() -> np.ndarray:
    table = np.zeros(0x250, np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[0xDF:0x100] = np.arange(27, 27 + 33)
    table[0x100:] = LETTERS - 1
    table[0xF7] = 0
    return np.minimum(table, LETTERS - 1)


CLASSES = _class_table()


def letter_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return np.where(points < 0x250, CLASSES[np.minimum(points, 0x24F)], 0).astype(np.int64)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(LETTERS**3, np.int64)
    for batch in batches:
        waiting, size = [], 0
        for text in [*as_bytes(batch.column(0)), None]:
            if text is not None:
                for start in range(0, len(text), CHUNK):
                    waiting.append(text[start : start + CHUNK])
                    size += len(waiting[-1])
            if size >= CHUNK or (text is None and waiting):
                found = letter_classes("  ".join(t.decode(errors="ignore") for t in waiting) + "  ")
                code = (found[:-2] * LETTERS + found[1:-1]) * LETTERS + found[2:]
                counts += np.bincount(code, minlength=LETTERS**3)
                waiting, size = [], 0
    some = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(some), pa.array(counts[some])], ["code", "n"])


def train_letters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Character trigram model of all texts: log10 P(c | a b), interpolated with shorter contexts, as an array of 60³.

    Counts cover every text; the table that comes to the driver has at most
    60³ rows. Without texts all letters are equally likely.
    """
    counted = docs.select(text_col).mapInArrow(_count_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    counts = np.zeros(LETTERS**3)
    counts[table["code"].to_numpy(np.int64)] = table["n"].to_numpy(np.float64)
    three = counts.reshape(LETTERS, LETTERS, LETTERS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 0.5) / (one.sum() + 0.5 * LETTERS)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
    return np.log10(p3).astype(np.float32)


def _lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each written character, or run of one, what it may stand for and at what cost."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(span):
        j = i
        while j < len(span) and span[j] == span[i]:
            j += 1
        char, n = span[i], j - i
        meant = [char] if char.isalpha() else [*LOOKALIKES.get(char, "")]
        cost = 0.0 if char.isalpha() else COST_SIGN
        choices = [(m, cost + (0.0, COST_DOUBLE, COST_REPEAT)[min(n, 3) - 1]) for m in meant]
        if n > 1:
            choices += [(m * 2, cost) for m in meant]
        if not char.isalpha() and char not in LOOKALIKES:
            choices = [("", 0.0)]  # a separator
        out.append(choices)
        i = j
    return out


def decode(span: str, model: np.ndarray) -> str:
    """The likeliest lower-case word for a disguised span."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for choices in [*_lattice(span), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, word) in states.items():
            for letters, cost in choices:
                x, y, total = a, b, score + cost
                for z in letters:
                    k = ord(z)
                    c = int(CLASSES[k]) if k < 0x250 else 0
                    total += float(model[x, y, c])
                    x, y = y, c
                if (x, y) not in after or after[x, y][0] < total:
                    after[x, y] = (total, word + letters)
        states = after
    return max(states.values())[1].strip()


class Restorer:
    """Restores whole texts; remembers the spans it has decoded."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known: dict[str, str] = {}

    def _decode(self, span: str) -> str:
        found = self.known.get(span)
        if found is None:
            found = decode(span, self.model)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(span) <= 64:
                self.known[span] = found
        return found

    def _token(self, token: str) -> str:
        """A word with look-alikes or long repetitions; signs at its ends are punctuation if letters remain without them."""
        core = token.strip("!*|+.,;:?\"'()")
        letters = sum(c.isalpha() for c in core)
        if not letters or 3 * letters < len(core) or not 3 <= len(core) <= 40:
            return token
        if all(c.isalpha() or c in LOOKALIKES for c in core):
            return self._decode(core)
        return token

    def _spaced(self, found: re.Match) -> str:
        """Single letters with one separator; the first may be a word of its own, so the rest is added alone."""
        span = found.group()
        if len(span) < 7:
            return span
        rest = span[2:]
        return f"{self._decode(span)} {self._decode(rest)}" if span[0] in VOWELS and len(rest) >= 7 else self._decode(span)

    def __call__(self, text: str) -> str:
        """The text in lower case with disguised spans replaced."""
        low = text.lower()
        low = SPACED.sub(self._spaced, low)
        hits = sorted({found.start() for pattern in (SIGNS, REPEATED) for found in pattern.finditer(low)})
        out, at = [], 0
        for hit in hits:
            if hit < at:
                continue
            start = max(at, 1 + max(low.rfind(" ", at, hit), low.rfind("\n", at, hit), low.rfind("\t", at, hit)))
            found = SPACE.search(low, hit)
            stop = found.start() if found else len(low)
            out += [low[at:start], self._token(low[start:stop])]
            at = stop
        return "".join([*out, low[at:]]) if out else low


SPACE = re.compile(r"\s")
