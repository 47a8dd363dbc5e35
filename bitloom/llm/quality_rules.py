"""Quality rules whose thresholds are certified on labelled documents.

A rule compares one ratio of a document with a cutoff. Its candidate cutoffs are
fixed, from lax to strict; what is learnt is how far each stratum may go. For a
stratum and a rule, the number of good labelled texts that a cutoff rejects is
binomial, so a cutoff is certified when rejecting that few would be improbable
if the true rate were above the rule's share of ``max_rejection``: the exact
binomial tail is at most the rule's share of ``1 - confidence``. Shares are equal
over rules (a document is rejected if any rule says so) and over strata
(Bonferroni); within a rule, candidates are tested in order and testing ends at
the first that fails (fixed-sequence testing), which needs no further correction.
With the given confidence, no stratum loses more than ``max_rejection`` of its
good texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.plans.storage import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


@dataclass(frozen=True)
class Rule:
    """``share`` of a document is compared with cutoffs, from lax to strict; ``above`` rejects what is larger."""

    name: str
    top: str
    bottom: str
    above: bool
    cutoffs: Sequence[float]

    def value(self) -> Column:
        """Null where the denominator is 0; then the rule rejects nothing."""
        return F.when(F.col(self.bottom) > 0, F.col(self.top) / F.col(self.bottom))

    def steps(self) -> Column:
        """How many of the cutoffs, counted from the strict end, reject the document: it falls at the laxest of these."""
        value, cuts = self.value(), F.array(*[F.lit(float(c)) for c in self.cutoffs])
        return F.coalesce(F.size(F.filter(cuts, lambda c: value > c if self.above else value < c)), F.lit(0))

    def rejects(self, cutoff: Column) -> Column:
        """False without a certified cutoff."""
        return F.coalesce(self.value() > cutoff if self.above else self.value() < cutoff, F.lit(False))


def falling(start: float, stop: float, step: float) -> list[float]:
    return [round(start - k * step, 6) for k in range(int(round((start - stop) / step)) + 1)]


RULES = [
    Rule("symbols", "n_symbols", "n_words", True, falling(3, 0.55, 0.05) + falling(0.5, 0.02, 0.02)),
    Rule("repeated_words", "n_repeat_words", "n_words", True, falling(0.98, 0.02, 0.02)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", True, falling(0.98, 0.02, 0.02)),
    Rule("long_words", "word_chars", "n_words", True, falling(20, 5.25, 0.25)),
    Rule("short_words", "word_chars", "n_words", False, [round(1 + 0.1 * k, 6) for k in range(40)]),
]


def counts_of(text: str | None) -> tuple[int, ...]:
    """The numbers of ``COUNTS`` for one text; those of a null text are 0."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    number: dict[str, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    repeated = 0
    if len(number) < n and n > 3:
        # a window's number is exact: word numbers are below 2**21, or a window is a tuple
        small = len(number) < 1 << 21
        a = np.array(ids, np.int64)
        windows = (a[:-2] << 42 | a[1:-1] << 21 | a[2:]) if small else list(zip(ids, ids[1:], ids[2:], strict=False))
        if small:
            _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
            twice = times[which] > 1
        else:
            seen = Counter(windows)
            twice = np.array([seen[w] > 1 for w in windows])
        inside = np.zeros(n, bool)
        for shift in range(3):
            inside[shift : n - 2 + shift] |= twice
        repeated = int(inside.sum())
    symbols = sum(text.count(s) for s in SYMBOLS)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated, len(lines)


def _counts(text: str) -> Column:
    @F.arrow_udf(f"struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>")
    def counts(texts: pa.Array) -> pa.Array:
        rows = [counts_of(t) for t in texts.to_pylist()]
        columns = zip(*rows, strict=True) if rows else [()] * len(COUNTS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS)

    return counts(text)


def text_counts(df: DataFrame, id_col: str, text_col: str, stratum: Column) -> DataFrame:
    """``id, stratum, text_key`` and ``COUNTS`` of every row, written once; texts are neither shuffled nor kept."""
    counted = df.select(
        F.col(id_col).alias("id"), stratum.alias("stratum"), F.xxhash64(text_col).alias("text_key"), _counts(text_col).alias("_c")
    )
    return materialize(counted.select("id", "stratum", "text_key", *[F.col(f"_c.{c}").alias(c) for c in COUNTS]), "text-counts")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), by the continued fraction of the incomplete beta function."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    # P(X <= k) = I_{1-p}(n - k, k + 1)
    a, b, x = n - k, k + 1, 1 - p
    if k < 10_000:  # differences of large log-gammas would lose digits
        ways = math.fsum(math.log(n - i) for i in range(k + 1)) - math.lgamma(b)
    else:
        ways = math.lgamma(n + 1) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(ways + a * math.log1p(-p) + b * math.log(p))
    if x * (a + b + 2) < a + 1:
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: int, b: int, x: float) -> float:
    """Lentz's evaluation of the fraction that belongs to I_x(a, b)."""
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    value = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return value


def certify(
    counts: DataFrame, labels: DataFrame, rules: Sequence[Rule], max_rejection: float, confidence: float, label: str = "quality"
) -> DataFrame:
    """``stratum`` and a cutoff for each rule (null: none is certified), written; one row for each labelled stratum.

    ``labels(id, good)`` says which documents are good; a document with labels
    that contradict each other is not used, and neither are documents that fail
    the base. A text that occurs several times in a stratum counts once, since
    copies are no independent evidence; it is good if all its labels say so.
    Of the certified cutoffs of a rule, the one with the largest number of
    rejected bad texts less rejected good ones is taken, at a tie the laxest.
    """
    one = labels.filter(F.col("id").isNotNull() & F.col("good").isNotNull()).groupBy(F.col("id").alias("_id")).agg(
        F.min("good").alias("good"), F.max("good").alias("_most")
    )
    marked = counts.filter(~base_failed()).join(one.filter("good = _most"), F.col("id") == F.col("_id"))
    steps = F.array(*[F.struct(F.lit(k).alias("rule"), r.steps().alias("steps")) for k, r in enumerate(rules)])
    texts = marked.groupBy("stratum", "text_key").agg(F.min("good").alias("good"), F.first(steps).alias("steps"))
    # at most (cutoffs + 1) rows for each stratum and rule, whatever the number of documents
    bins = materialize(
        texts.select("stratum", "good", F.inline("steps")).groupBy("stratum", "rule", "steps").agg(
            F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("bad")
        ),
        "rule-bins",
    )
    strata = bins.select("stratum").distinct().count()
    share, level = max_rejection / len(rules), (1 - confidence) / max(1, strata * len(rules))

    @F.arrow_udf("double")
    def tail(rejected: pa.Array, of: pa.Array) -> pa.Array:
        pairs = zip(rejected.to_pylist(), of.to_pylist(), strict=True)
        return pa.array([binomial_tail(k, n, share) if n else 1.0 for k, n in pairs], pa.float64())

    # every candidate, those at which nothing new falls too: cutoff c rejects what `steps` cutoffs or more do
    lengths = F.array(*[F.lit(len(r.cutoffs)) for r in rules])
    candidates = bins.groupBy("stratum", "rule").agg(
        F.sum("good").alias("of"), F.collect_list(F.struct("steps", "good", "bad")).alias("bins")
    ).withColumn("index", F.explode(F.sequence(F.lit(0), lengths[F.col("rule")] - 1)))
    least = lengths[F.col("rule")] - F.col("index")  # steps of what the candidate rejects, at least

    def rejected(name: str) -> Column:
        return F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + F.when(b["steps"] >= least, b[name]).otherwise(0))

    tested = candidates.select(
        "stratum", "rule", "index", "of", rejected("good").alias("lost"), rejected("bad").alias("caught")
    ).withColumn("certified", tail("lost", "of") <= level)
    so_far = Window.partitionBy("stratum", "rule").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    valid = tested.withColumn("valid", F.min("certified").over(so_far)).filter("valid")
    best = valid.groupBy("stratum", "rule").agg(F.max(F.struct(F.col("caught") - F.col("lost"), -F.col("index"))).alias("_best"))
    index = -F.col("_best")["col2"]
    cutoff = F.element_at(
        F.array(*[F.array(*[F.lit(float(c)) for c in r.cutoffs]) for r in rules])[F.col("rule")], (index + 1).cast("int")
    )
    chosen = best.select("stratum", "rule", cutoff.alias("cutoff"))
    wide = bins.select("stratum").distinct().withColumnRenamed("stratum", "_s").join(
        chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == k, F.col("cutoff"))).alias(r.name) for k, r in enumerate(rules)]),
        F.col("_s").eqNullSafe(F.col("stratum")), "left",
    )
    return materialize(wide.select(F.col("_s").alias("stratum"), *[r.name for r in rules]), "rule-cutoffs")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum: str = "lang",
    label_col: str = "quality",
    rules: Sequence[Rule] = tuple(RULES),
    max_rejection: float = 0.1,
    confidence: float = 0.95,
) -> DataFrame:
    """``id, stratum``, ``COUNTS``, ``base_failed, rejected_by array<string>, kept`` of every row of ``docs``.

    Documents of a stratum without labels, or with too few to certify a cutoff,
    are rejected by the base only. Labels other than null are good when 1.
    Null and empty texts have no words and fail the base; null ids have no
    label; null strata are a stratum. Repeated rows all come back, with the
    same verdict. Empty tables give empty results; without labels the base
    decides alone. Other columns are not read.
    """
    counts = text_counts(docs, id_col, text_col, F.col(stratum))
    marks = labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("good"))
    cutoffs = certify(counts, marks, rules, max_rejection, confidence)
    renamed = cutoffs.withColumnsRenamed({"stratum": "_stratum"} | {r.name: f"_cut_{r.name}" for r in rules})
    joined = counts.join(renamed, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    reasons = F.array_compact(F.array(*[F.when(r.rejects(F.col(f"_cut_{r.name}")), F.lit(r.name)) for r in rules]))
    found = joined.withColumn("base_failed", base_failed()).withColumn("rejected_by", reasons)
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    return found.select("id", "stratum", *COUNTS, "base_failed", "rejected_by", kept.alias("kept"))
