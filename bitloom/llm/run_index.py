"""A run-length index (r-index): a run-compressed Burrows-Wheeler transform with sampled run ends.

Everything is an array, and queries advance together, one character per step,
so that numpy does the work. Matches are cut at ``cap`` characters, beyond which
lengths are not told apart.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 255  # no byte of UTF-8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of a byte array by prefix doubling."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):  # seven characters of nine bits
        key = (key << np.uint64(9)) | padded[i : i + n]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.append(True, sorted_key[1:] != sorted_key[:-1])[:n]
    # a suffix is ranked by the first place of those it is tied with, so only tied ones are ever sorted again
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    at = np.flatnonzero(~(new & np.append(new[1:], True)[:n]))
    width = 7
    while len(at):
        again = order[at]
        follows = again + width
        key = (rank[again] << 32) | np.where(follows < n, rank[np.minimum(follows, n - 1)] + 1, 0)
        sort = np.argsort(key)
        again, key = again[sort], key[sort]
        order[at] = again
        new = np.append(True, key[1:] != key[:-1])
        rank[again] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[~(new & np.append(new[1:], True))]
        width *= 2
    return order


class _Marks:
    """Which of ``n`` rows start a stretch, as bits with counts, so that a row finds its stretch in one step."""

    def __init__(self, starts: np.ndarray, n: int):
        flags = np.zeros(-(-n // 64) * 64, bool)
        flags[starts] = True
        self.bits = np.packbits(flags, bitorder="little").view("<u8")
        per_word = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(per_word) - per_word

    def stretch_of(self, rows: np.ndarray) -> np.ndarray:
        word = rows >> 6
        up_to = self.bits[word] << (63 - (rows & 63)).astype(np.uint64)
        return self.before[word] + np.bitwise_count(up_to) - 1


def _words(cap: int) -> list[tuple[int, int]]:
    """Offset and width of the integers that cover ``cap`` bytes; the last ones may overlap."""
    width = 8 if cap >= 8 else 1
    return [(k, width) for k in range(0, cap - width, width)] + [(cap - width, width)]


class RunIndex:
    """Index of a byte text of less than 2**31 characters."""

    def __init__(self, text: np.ndarray, cap: int):
        n = len(text)
        self.text = np.concatenate([text, np.full(cap + 8, SEPARATOR, np.uint8)])
        self.eight = np.ndarray(len(self.text) - 7, dtype="<u8", buffer=self.text, strides=(1,))  # at any place
        self.cap, self.n = cap, n
        order = suffix_array(text)
        bwt = text[order - 1]  # the character before the first is the last: it is a separator
        starts = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        self.starts, self.heads = starts, bwt[starts].astype(np.int64)
        ends = np.append(starts[1:], n) - 1
        self.sample_first, self.sample_last = order[starts], order[ends]
        self.first_row_sample = int(order[0])
        lengths = ends - starts + 1
        totals = np.bincount(self.heads, weights=lengths, minlength=256).astype(np.int64)
        smaller = np.cumsum(totals) - totals
        # runs by character, then place: where each one's rows go under the LF mapping
        self.by_char = np.lexsort((starts, self.heads))
        placed = lengths[self.by_char]
        self.goes = np.empty(len(starts), np.int64)
        within = np.cumsum(placed) - placed
        first_of_char = np.searchsorted(self.heads[self.by_char], np.arange(256))
        base = within[np.minimum(first_of_char, len(within) - 1)]
        chars = self.heads[self.by_char]
        self.goes[self.by_char] = smaller[chars] + within - base[chars]
        self.char_run_key = chars * len(starts) + self.by_char  # rising; a run's number orders it by place
        self.char_from = np.searchsorted(chars, np.arange(257))
        self.run_marks = _Marks(starts, n)
        self.last_of = ends
        # rows whose suffixes share fewer than ``cap`` characters with the row above start an interval
        above, below = order[:-1], order[1:]
        far = np.flatnonzero(self.text == SEPARATOR)
        inside = far[np.searchsorted(far, np.arange(n))] - np.arange(n) >= cap
        same = inside[above] & inside[below]
        for k, width in _words(cap):  # eight characters at a time
            open_rows = np.flatnonzero(same)
            part = np.ndarray(n, dtype=f"<u{width}", buffer=self.text, offset=k, strides=(1,))
            same[open_rows] = part[above[open_rows]] == part[below[open_rows]]
        self.interval_starts = np.flatnonzero(np.append(True, ~same))
        self.interval_marks = _Marks(self.interval_starts, n)
        self._order = order

    def minima(self, value_of_position: np.ndarray) -> np.ndarray:
        """The least value in each interval of suffixes that share ``cap`` characters."""
        return np.minimum.reduceat(value_of_position[self._order], self.interval_starts)

    def interval_of(self, rows: np.ndarray) -> np.ndarray:
        return self.interval_marks.stretch_of(rows)

    def drop_construction(self) -> None:
        """Forget the suffix array; what stays is proportional to the runs and intervals."""
        self._order = None

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the text at ``a`` and ``b``, up to ``most``; no separator lies within ``most`` of ``b``."""
        out = most.copy()
        alive = np.flatnonzero(most > 0)
        for k in range(0, self.cap, 8):  # eight characters at a time
            if not len(alive):
                break
            differ = self.eight[a[alive] + k] ^ self.eight[b[alive] + k]
            alike = np.bitwise_count((differ & -differ) - np.uint64(1)).astype(np.int64) >> 3
            out[alive] = np.minimum(out[alive], k + alike + np.where(alike == 8, self.cap, 0))
            alive = alive[(alike == 8) & (most[alive] > k + 8)]
        return out

    def matching_statistics(self, queries: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query position the longest match that starts there, up to ``cap``, and a row that has it.

        Queries are concatenated; all of them step from right to left together.
        A character that continues the match follows the LF mapping. Any other
        jumps to the nearest run of that character above or below, whichever
        shares more with the match: their sampled positions tell.
        """
        length_out, row_out = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        sizes, ends = sizes[order], offsets[1:][order]
        shorter_last = -sizes
        row = np.zeros(len(order), np.int64)
        place = np.full(len(order), self.first_row_sample, np.int64)
        length = np.zeros(len(order), np.int64)
        runs = len(self.starts)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            m = np.searchsorted(shorter_last, -step, side="left")  # queries longer than ``step``
            at = ends[:m] - 1 - step
            char = queries[at].astype(np.int64)
            run = self.run_marks.stretch_of(row[:m])
            miss = np.flatnonzero(self.heads[run] != char)
            if len(miss):
                c = char[miss]
                key = c * runs + run[miss]
                after = np.searchsorted(self.char_run_key, key)
                low, high = self.char_from[c], self.char_from[c + 1]
                has_up, has_down = after > low, after < high
                up = self.by_char[np.maximum(after - 1, 0)]
                down = self.by_char[np.minimum(after, runs - 1)]
                up_at, down_at = self.sample_last[up], self.sample_first[down]
                now, most = place[miss], length[miss]
                up_n = np.where(has_up, self._common(up_at, now, np.where(has_up, most, 0)), -1)
                down_n = np.where(has_down, self._common(down_at, now, np.where(has_down, most, 0)), -1)
                take_up = up_n >= down_n
                none = ~(has_up | has_down)
                run[miss] = np.where(take_up, up, down)
                row[miss] = np.where(take_up, self.last_of[up], self.starts[down])
                place[miss] = np.where(take_up, up_at, down_at)
                length[miss] = np.maximum(up_n, down_n)
                lost = miss[none]
            else:
                lost = miss
            row[:m] = self.goes[run] + row[:m] - self.starts[run]
            place[:m] = np.where(place[:m] > 0, place[:m] - 1, self.n - 1)
            length[:m] = np.minimum(length[:m] + 1, self.cap)
            if len(lost):
                row[lost], place[lost], length[lost] = 0, self.first_row_sample, 0
            length_out[at], row_out[at] = length[:m], row[:m]
        return length_out, row_out
