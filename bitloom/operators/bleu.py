"""Corpus BLEU and the alignment of hypotheses with references."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from bitloom.functions.ngrams import tokenize_13a

ORDER = 4
TOKENS_AT_ONCE = 200_000


def align_hyp_ref(hyp: DataFrame, ref: DataFrame, key: str = "sent_id", strict: bool = True) -> DataFrame:
    """Pair hypotheses and references by key (``key, hyp, ref``).

    A row without partner raises an error; with ``strict=False`` it is left out.
    """
    if not strict:
        return hyp.select(key, "hyp").join(ref.select(key, "ref"), key)
    left = hyp.select(key, "hyp", F.lit(True).alias("_h"))
    right = ref.select(key, "ref", F.lit(True).alias("_r"))
    problem = F.raise_error(F.concat(F.lit("no partner for "), F.col(key).cast("string")))
    paired = F.col("_h") & F.col("_r")
    return left.join(right, key, "full").select(
        key,
        F.when(paired, F.col("hyp")).otherwise(problem.cast("string")).alias("hyp"),
        F.when(paired, F.col("ref")).otherwise(problem.cast("string")).alias("ref"),
    )


def _gram_ids(tokens: np.ndarray, n: int, below: np.ndarray | None) -> np.ndarray:
    """Number the n-grams that start at each position, from those one token shorter."""
    if n == 1:
        return tokens
    pairs = below[: len(tokens) - n + 1] * (tokens.max(initial=0) + 1) + tokens[n - 1 :]
    return pd.factorize(pairs)[0]


def _matches(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """Clipped n-gram matches of each row, for n = 1 to ORDER.

    The columns are taken in runs of rows with some ``TOKENS_AT_ONCE`` tokens, so
    that memory depends on the tokens of a run or of one row, not of a batch.
    """
    tokens = np.cumsum(sum(pc.list_value_length(side).fill_null(0).to_numpy().astype(np.int64) for side in (hyp, ref)))
    cuts = np.flatnonzero(np.diff(tokens // TOKENS_AT_ONCE, prepend=0)) if len(hyp) else np.array([], np.int64)
    ends = [*cuts[cuts > 0].tolist(), len(hyp)]
    runs = [_run_matches(hyp[a:b], ref[a:b]) for a, b in zip([0, *ends], ends)]
    return pa.concat_arrays(runs)


def _run_matches(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """The matches of some rows, on whole columns."""
    rows = len(hyp)
    sizes = np.concatenate([pc.list_value_length(side).fill_null(0).to_numpy() for side in (hyp, ref)])
    tokens = pa.concat_arrays([hyp.flatten(), ref.flatten()]).dictionary_encode().indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(2 * rows), sizes)  # hypotheses first, then references
    found, grams = [], None
    for n in range(1, ORDER + 1):
        grams = _gram_ids(tokens, n, grams)
        whole = text[: len(grams)] == text[n - 1 :]  # the gram does not run into the next text
        owner, gram = text[: len(grams)][whole], grams[whole]
        width = grams.max(initial=0) + 1
        code, key = pd.factorize(owner % rows * width + gram)
        in_hyp = np.bincount(code[owner < rows], minlength=len(key))
        in_ref = np.bincount(code[owner >= rows], minlength=len(key))
        found.append(np.bincount(key // width, weights=np.minimum(in_hyp, in_ref), minlength=rows))
    flat = np.stack(found, axis=1).astype(np.int64).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * ORDER, pa.int32()), pa.array(flat))


def bleu_counts(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Matched and total n-grams and both lengths, summed per group.

    Both sides of a sentence are in one row, so its n-grams are matched where it
    lies; nothing but ten sums per task and group is shuffled.
    """
    by = list(by)
    matches = F.arrow_udf(_matches, ArrayType(LongType()))
    tokens = pairs.select(
        *by,
        tokenize_13a(F.coalesce("hyp", F.lit(""))).alias("_h"),
        tokenize_13a(F.coalesce("ref", F.lit(""))).alias("_r"),
    )
    sizes = tokens.select(
        *by, matches("_h", "_r").alias("_m"), F.size("_h").alias("_hyp"), F.size("_r").alias("_ref")
    )

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).alias(name)

    orders = range(1, ORDER + 1)
    return sizes.groupBy(*by).agg(
        *[total(F.col("_m")[n - 1], f"correct{n}") for n in orders],
        *[total(F.greatest(F.col("_hyp") - (n - 1), F.lit(0)), f"total{n}") for n in orders],
        total(F.col("_hyp"), "hyp_len"),
        total(F.col("_ref"), "ref_len"),
    )


def corpus_bleu(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """BLEU-4 on 13a tokens, case-sensitive, one reference, score 0 to 100.

    Smoothing is exponential: the k-th order without a match counts as
    1 / 2**k matches. Orders beyond the longest hypothesis have precision 0.
    """
    by = list(by)
    sums = bleu_counts(pairs, by)
    precisions = []
    for i in range(1, ORDER + 1):
        correct, total = F.col(f"correct{i}"), F.col(f"total{i}")
        misses = sum(
            (F.when((F.col(f"correct{j}") == 0) & (F.col(f"total{j}") > 0), 1).otherwise(0) for j in range(1, i + 1)),
            F.lit(0),
        )
        smoothed = F.lit(100.0) / (F.pow(F.lit(2.0), misses) * total)
        precisions.append(
            F.when(total == 0, 0.0).when(correct == 0, smoothed).otherwise(100.0 * correct / total).alias(f"p{i}")
        )
    any_match = sum((F.col(f"correct{i}") for i in range(1, ORDER + 1)), F.lit(0)) > 0
    brevity = (
        F.when(F.col("hyp_len") >= F.col("ref_len"), 1.0)
        .when(F.col("hyp_len") == 0, 0.0)
        .otherwise(F.exp(1.0 - F.col("ref_len") / F.col("hyp_len")))
    )
    parts = sums.select(*by, brevity.alias("bp"), "hyp_len", "ref_len", *precisions, any_match.alias("_any"))
    complete = F.least(*[F.col(f"p{i}") for i in range(1, ORDER + 1)]) > 0
    mean_log = sum((F.log(F.col(f"p{i}")) for i in range(1, ORDER + 1)), F.lit(0.0)) / ORDER
    score = F.when(F.col("_any") & complete, F.col("bp") * F.exp(mean_log)).otherwise(0.0)
    return parts.select(*by, score.alias("score"), "bp", "hyp_len", "ref_len", "p1", "p2", "p3", "p4")
