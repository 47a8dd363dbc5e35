"""Token counts and vocabularies."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.plans.ranking import global_rank
from bitloom.plans.storage import materialize

# The reserved vocabulary entries, ids 0 to 3.
SPECIALS = ["<pad>", "<sos>", "<eos>", "<unk>"]
PAD, SOS, EOS, UNK = range(4)


def token_counts(
    df: DataFrame,
    tokens: str = "tokens",
    lang: str = "lang",
    key: str | None = None,
) -> DataFrame:
    """Frequency of every token per language.

    With ``key`` (the row id that fixes the reading order) the result also has
    ``first_pos``, a number that orders tokens by their first occurrence. It is
    one decimal, not a struct, so the hash aggregation keeps its partial step.
    The outer explode keeps the optimizer from tokenising twice, once to find
    rows without tokens.
    """
    if key is None:
        seen = df.select(F.col(lang).alias("lang"), F.explode_outer(tokens).alias("token"))
        seen = seen.filter(F.col("token").isNotNull())
        return seen.groupBy("lang", "token").agg(F.count("*").alias("freq"))
    seen = df.select(
        F.col(lang).alias("lang"), F.col(key).alias("_key"), F.posexplode_outer(tokens).alias("_pos", "token")
    ).filter(F.col("token").isNotNull())
    place = F.col("_key").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("_pos")
    return seen.groupBy("lang", "token").agg(
        F.count("*").alias("freq"), F.min(place.cast("decimal(32,0)")).alias("first_pos")
    )


def count_of_counts(counts: DataFrame) -> DataFrame:
    """How many tokens share each frequency, with running totals from the top.

    One row per language and distinct frequency. N tokens have at most
    sqrt(2N) distinct frequencies, so the window below stays small whatever the
    size of the vocabulary.
    """
    down = Window.partitionBy("lang").orderBy(F.desc("freq"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("lang")
    mass = F.col("n_types") * F.col("freq")
    return (
        counts.groupBy("lang", "freq")
        .agg(F.count("*").alias("n_types"))
        .select(
            "lang",
            "freq",
            "n_types",
            F.coalesce(F.sum("n_types").over(before), F.lit(0)).alias("types_above"),
            F.coalesce(F.sum(mass).over(before), F.lit(0)).alias("tokens_above"),
            F.sum(mass).over(whole).alias("total"),
            F.sum("n_types").over(whole).alias("types"),
        )
    )


def _tie_order(tie: str):
    if tie not in ("token", "first_seen"):
        raise ValueError(f"unknown tie rule: {tie}")
    return F.col("token" if tie == "token" else "first_pos").asc()


def _frequent(counts: DataFrame, top: int) -> DataFrame:
    """The tokens whose frequency reaches the first ``top`` ranks of their language, ties at the last one included."""
    reached = count_of_counts(counts).filter(F.col("types_above") < top)
    # one row per language; written, so that the join is planned by its size
    least = materialize(reached.groupBy(F.col("lang").alias("_of")).agg(F.min("freq").alias("_least")), "cuts")
    same = F.col("lang").eqNullSafe(F.col("_of")) & (F.col("freq") >= F.col("_least"))
    return counts.join(least, same).select(*counts.columns)


def ranked_tokens(
    counts: DataFrame, tie: str = "token", top: int | None = None, running: Mapping[str, str] | None = None
) -> DataFrame:
    """Add the 1-based ``rank`` by frequency per language; ``top`` keeps the first ranks.

    With ``top`` only the tokens that can have such a rank are sorted: the table
    of distinct frequencies tells where to cut. ``counts`` is then read twice, so
    give it as a written table. ``running`` is that of `global_rank`.
    """
    order = [F.desc("freq"), _tie_order(tie)]
    if top is None:
        return global_rank(counts, order, by=["lang"], running=running)
    return global_rank(_frequent(counts, top), order, by=["lang"], running=running).filter(F.col("rank") <= top)


def build_vocab(
    counts: DataFrame, min_freq: int = 3, max_size: int | None = None, tie: str = "token"
) -> DataFrame:
    """Vocabulary per language: reserved entries, then tokens by falling frequency.

    The vocabulary is written once, as it is usually read several times.
    ``max_size`` counts the reserved entries. A corpus token that looks like a
    reserved entry is not counted. Frequency ties go by token, or by first
    occurrence with ``tie="first_seen"``.
    """
    counts = materialize(counts, "counts")  # read twice below; far smaller than the text
    eligible = counts.filter((F.col("freq") >= min_freq) & ~F.col("token").isin(SPECIALS))
    top = None if max_size is None else max(max_size - len(SPECIALS), 0)
    words = ranked_tokens(eligible, tie, top).select(
        "lang", (F.col("rank") + len(SPECIALS) - 1).cast("int").alias("id"), "token", "freq"
    )
    reserved = counts.select("lang").distinct().select(
        "lang", F.posexplode(F.array(*[F.lit(s) for s in SPECIALS])).alias("id", "token")
    )
    entries = reserved.withColumn("freq", F.lit(0).cast("long")).unionByName(words)
    return materialize(entries, "vocab")


def vocab_stats(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sizes of the vocabulary against all token types, per language."""
    seen = counts.filter(~F.col("token").isin(SPECIALS)).groupBy("lang").agg(F.count("*").alias("unique_types"))
    size = vocab.groupBy("lang").agg(F.count("*").alias("vocab_size"))
    kept = F.col("vocab_size") - len(SPECIALS)
    return seen.join(size, "lang").select(
        "lang",
        "unique_types",
        "vocab_size",
        kept.alias("kept"),
        F.try_divide(kept, "unique_types").alias("type_coverage"),
        (F.col("unique_types") - kept).alias("discarded"),
    )


def top_tokens(counts: DataFrame, k: int = 20, tie: str = "token") -> DataFrame:
    """The ``k`` most frequent tokens per language."""
    return ranked_tokens(materialize(counts, "counts"), tie, k).select("lang", "rank", "token", "freq")


def oov_report(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tokens that a vocabulary turns into ``<unk>``, with their share of all tokens.

    Works on counts, so a token is shuffled once however often it occurs.
    """
    # written, so that the join below is planned by its true size
    total = materialize(counts.groupBy("lang").agg(F.sum("freq").alias("_total")), "totals")
    return (
        counts.join(vocab.select("lang", "token"), ["lang", "token"], "left_anti")
        .join(total, "lang")
        .select("lang", "token", "freq", (F.col("freq") / F.col("_total")).alias("oov_rate"))
    )
