"""Small helpers for functions on Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [text or b"" for text in texts.cast(pa.binary()).to_pylist()]


def lists_of(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def slices(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The numpy array of each row of a list column; a null row is empty, its elements are not null."""
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    for start, stop in zip(offsets[:-1], offsets[1:], strict=True):
        yield values[start:stop]
