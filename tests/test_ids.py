from hypothesis import given, settings
from hypothesis import strategies as st

from bitloom.functions import ids as idf

ROWS = [[5, 6], [], [7], [4, 0, 9, 2, 5], [2, 8], list(range(10, 20))]


def apply(spark, values, column):
    df = spark.createDataFrame([(v,) for v in values], "x array<int>").coalesce(1)
    return [r[0] for r in df.select(column).collect()]


def test_boundaries_and_truncation(spark):
    assert apply(spark, ROWS, idf.add_boundaries("x", 1, 2)) == [[1, *r, 2] for r in ROWS]
    for max_len in (4, 11, 12, 13):
        cut = apply(spark, ROWS, idf.truncate_ids("x", max_len, 1, 2))
        assert cut == [[1, *r[: max_len - 2], 2] for r in ROWS]


def test_labels(spark):
    masked = apply(spark, ROWS, idf.mask_labels("x", 0))
    assert masked == [[-100 if i == 0 else i for i in r] for r in ROWS]
    assert apply(spark, masked, idf.unmask_labels("x", 0)) == ROWS


def test_shift_and_mask(spark):
    shifted = apply(spark, ROWS, idf.shift_targets("x"))
    assert [(list(s.tgt_in), list(s.tgt_out)) for s in shifted] == [(r[:-1], r[1:]) for r in ROWS]
    assert apply(spark, ROWS, idf.pad_mask("x", 0)) == [[i == 0 for i in r] for r in ROWS]


def walk(ids, bos, eos, pad):
    kept = []
    for i in ids:
        if i == eos:
            break
        if i not in (bos, pad):
            kept.append(i)
    return kept


@settings(max_examples=5, deadline=None)
@given(rows=st.lists(st.lists(st.integers(0, 6), max_size=12), min_size=1, max_size=30))
def test_strip_generated(spark, rows):
    assert apply(spark, rows, idf.strip_generated("x", 1, 2, 0)) == [walk(r, 1, 2, 0) for r in rows]
    content = [[i + 3 for i in r] for r in rows]
    bounded = apply(spark, content, idf.add_boundaries("x", 1, 2))
    assert apply(spark, bounded, idf.strip_generated("x", 1, 2, 0)) == content
