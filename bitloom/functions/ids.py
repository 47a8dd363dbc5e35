"""Functions on id sequences (``array<int>`` columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def add_boundaries(ids: Column | str, bos: int, eos: int) -> Column:
    """``[bos] + ids + [eos]``."""
    return F.concat(F.array(F.lit(bos)), _col(ids), F.array(F.lit(eos)))


def truncate_ids(ids: Column | str, max_len: int, bos: int, eos: int) -> Column:
    """Add both boundaries and keep at most ``max_len`` ids including them."""
    return add_boundaries(F.slice(_col(ids), 1, max_len - 2), bos, eos)


def mask_labels(ids: Column | str, pad: int, ignore: int = -100) -> Column:
    """Replace padding by the label value that the loss ignores."""
    return F.transform(_col(ids), lambda x: F.when(x == pad, F.lit(ignore)).otherwise(x))


def unmask_labels(ids: Column | str, pad: int, ignore: int = -100) -> Column:
    """Replace the ignored label value by padding, before decoding."""
    return F.transform(_col(ids), lambda x: F.when(x == ignore, F.lit(pad)).otherwise(x))


def shift_targets(ids: Column | str) -> Column:
    """Struct of decoder input ``ids[:-1]`` and decoder output ``ids[1:]``."""
    ids = _col(ids)
    rest = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.struct(F.slice(ids, 1, rest).alias("tgt_in"), F.slice(ids, 2, rest).alias("tgt_out"))


def pad_mask(ids: Column | str, pad: int) -> Column:
    """True where the id is padding."""
    return F.transform(_col(ids), lambda x: x == pad)


def strip_generated(ids: Column | str, bos: int, eos: int, pad: int) -> Column:
    """Cut at the first ``eos``, then drop ``bos`` and ``pad``."""
    ids = _col(ids)
    end = F.array_position(ids, eos)
    cut = F.when(end > 0, F.slice(ids, F.lit(1), (end - 1).cast("int"))).otherwise(ids)
    return F.array_remove(F.array_remove(cut, bos), pad)
