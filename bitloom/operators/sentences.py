"""Sentence ends without labels, after Kiss and Strunk (2006).

Three aggregates over word types: how often a type is followed by a full stop
(abbreviations nearly always are), which words follow such stops more often than
chance allows (collocations, across which no sentence ends), and which words
begin sentences. Each is judged by a log-likelihood ratio. The model is trained
on text as it is written and holds what is needed to split text of any case.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.plans.storage import fits, materialize

# The published thresholds of the method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
STOP_SHARE = 0.99
WORD = r"[\p{L}\p{N}](?:[\p{L}\p{N}.'’\-]*[\p{L}\p{N}])?\.*|[?!]+"
_LAST_WORD = re.compile(r"[^\W_][\w.'’\-]*$")
_FIRST_WORD = re.compile(r"[^\W_](?:[\w.'’\-]*[^\W_])?")
_STOP = re.compile(r"(?<!\S)(\S*[^\s.])\.([\])}>\"'»”’]*)(?=\s+(\S+))")


@dataclass(frozen=True)
class SentenceModel:
    """``types`` holds ``type, abbreviation, starter, lower_start`` (types of which one is true); ``collocations`` ``left, right``."""

    types: DataFrame
    collocations: DataFrame


def _log_odds(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of ``k`` of ``n`` at probability ``p``."""
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)


def _ratio(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's ratio for ``ab`` joint occurrences of what occurs ``a`` and ``b`` times in ``n``."""
    p = b / n
    alone = _log_odds(ab, a, p) + _log_odds(b - ab, n - a, p)
    together = _log_odds(ab, a, ab / a) + _log_odds(b - ab, n - a, (b - ab) / (n - a))
    return -2 * (alone - together)


def _words(text_col: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))


def _is_mark(word: Column) -> Column:
    return word.startswith("?") | word.startswith("!")


def _kind(word: Column) -> Column:
    """The word in lower case without its stops."""
    return F.lower(F.rtrim(word, F.lit(".")))


def _stopped(word: Column) -> Column:
    """One full stop follows; more are an ellipsis."""
    return word.endswith(".") & ~word.endswith("..")


def _word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``word, next, n``: the words as written, with the word that follows where a sentence may end, else null."""
    rows = df.select(_words(text_col).alias("w"))
    pairs = rows.select(F.inline(F.arrays_zip(F.col("w").alias("word"), F.slice("w", 2, F.size("w")).alias("next"))))
    may_end = (_stopped(F.col("word")) | _is_mark(F.col("word"))) & ~_is_mark(F.col("next"))
    return pairs.groupBy("word", F.when(may_end, F.col("next")).alias("next")).agg(F.count("*").alias("n"))


def _of_types(words: DataFrame) -> DataFrame:
    word, first = F.col("word"), F.substring("word", 1, 1)
    number = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    return words.filter(~_is_mark(word)).groupBy(_kind(word).alias("type")).agg(
        number(_stopped(word)).alias("stopped"), number(~_stopped(word)).alias("bare"), number(first != F.lower(first)).alias("upper")
    )


def type_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``type, stopped, bare, upper`` of every word type: with and without a full stop, and with a first capital."""
    words = df.select(F.explode(_words(text_col)).alias("word"))
    return _of_types(words.groupBy("word").agg(F.count("*").alias("n")))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``type, stopped, bare, score`` of the types with a letter and a stop; an abbreviation scores 0.3 or more.

    The ratio compares the chance of any stop with 0.99, and is scaled down for
    long types and for each time that the type has no stop, up for inner stops.
    """
    words, stops = counts.agg(F.sum(F.col("stopped") + F.col("bare")), F.sum("stopped")).first()
    candidates = counts.filter((F.col("stopped") > 0) & F.col("type").rlike(r"\p{L}"))
    n, k = F.col("stopped") + F.col("bare"), F.col("stopped")
    ratio = -2 * (_log_odds(k, n, F.lit((stops or 0) / (words or 1))) - _log_odds(k, n, F.lit(STOP_SHARE)))
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    inner = F.length("type") - letters
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -F.col("bare").cast("double"))
    return candidates.select("type", "stopped", "bare", score.alias("score"))


def train_sentence_model(df: DataFrame, text_col: str) -> SentenceModel:
    """A model of the texts of ``text_col``, in the case in which they are written.

    Null and empty texts add nothing. The texts are read once; only tables of
    words and of the pairs around a stop are kept.
    """
    words = materialize(_word_counts(df, text_col), "words")
    counts = materialize(_of_types(words), "word-types")
    scored = abbreviation_scores(counts)
    short = materialize(scored.filter(F.col("score") >= ABBREVIATION).select("type"), "abbreviations")
    total = counts.agg(F.sum(F.col("stopped") + F.col("bare"))).first()[0] or 0

    following = F.substring("next", 1, 1)
    lower = (following == F.lower(following)) & (following != F.upper(following))
    around = materialize(
        words.filter(F.col("next").isNotNull())
        .groupBy(_kind(F.col("word")).alias("left"), _kind(F.col("next")).alias("right"))
        .agg(F.sum("n").alias("n"), F.sum(F.when(lower, F.col("n")).otherwise(0)).alias("lower")),
        "words-around-stops",
    )
    marked = around.join(short.withColumn("_short", F.lit(True)), F.col("left") == F.col("type"), "left").drop("type")
    doubtful = F.col("_short").isNotNull() | F.col("left").rlike(r"^\p{L}$|^\p{N}[\p{N}.,]*$")

    # words that begin sentences: those after a stop that surely ends one
    sure = marked.filter(~doubtful)
    breaks = sure.agg(F.sum("n")).first()[0] or 0
    begins = sure.groupBy("right").agg(F.sum("n").alias("at_break"), F.sum("lower").alias("lower"))
    known = begins.join(counts, F.col("right") == F.col("type"))
    n, a, b, ab = F.lit(total), F.lit(breaks), F.col("stopped") + F.col("bare"), F.col("at_break")
    starter = (_ratio(a, b, ab, n) >= STARTER) & (n / a > b / ab) if breaks else F.lit(False)
    begun = materialize(
        known.select("type", starter.alias("starter"), ((F.col("lower") > 0) & (F.col("upper") == 0)).alias("lower_start")),
        "sentence-starts",
    )
    types = (
        short.withColumn("abbreviation", F.lit(True)).join(begun, "type", "full")
        .select("type", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("abbreviation", "starter", "lower_start")])
        .filter("abbreviation or starter or lower_start")
    )

    left, right = (counts.select(F.col("type").alias(side), (F.col("stopped") + F.col("bare")).alias(f"n_{side}")) for side in ("left", "right"))
    starts = begun.filter("starter").select(F.col("type").alias("right"))
    joined = marked.filter(doubtful & (F.col("n") > 1)).join(left, "left").join(right, "right").join(starts, "right", "left_anti")
    a, b, ab = F.col("n_left"), F.col("n_right"), F.col("n")
    together = (ab <= F.least(a, b)) & (_ratio(a, b, ab, n) >= COLLOCATION) & (n / a > b / ab)
    return SentenceModel(
        materialize(types, "sentence-types"), materialize(joined.filter(together).select("left", "right"), "collocations")
    )


def is_end(word: str, following: str, abbreviations: set, starters: set, lower_starts: set, collocations: set) -> bool:
    """Whether the stop after ``word`` ends a sentence, given the word after it.

    An abbreviation, an initial or a word with inner stops ends none, unless the
    next word has a capital and is known to begin sentences (not after an
    initial). A number ends none before a word in small letters, unless that
    word has begun sentences and never has a capital. No sentence ends within a
    collocation of such a word.
    """
    kind, after = word.lower(), following.lower()
    initial = len(kind) == 1 and kind.isalpha()
    number = kind[:1].isdigit() and not any(c.isalpha() for c in kind)
    short = initial or kind in abbreviations or ("." in kind and not number)
    if (short or number) and (kind, after) in collocations:
        return False
    capital = following[:1] != following[:1].lower()
    if short:
        return capital and not initial and after in starters
    small = following[:1].isalpha() and not capital
    return not (number and small) or after in lower_starts


def sentence_ends(model: SentenceModel, max_types: int = 1_000_000) -> Callable[[Column], Column]:
    """Function from a text column to the text with its inner sentence ends set apart, ``word .`` for ``word.``.

    The model goes to every executor, so it is counted first: more than
    ``max_types`` types or collocations raise.
    """
    if not (fits(model.types, max_types) and fits(model.collocations, max_types)):
        raise ValueError(f"a sentence model may have at most {max_types} types and collocations")
    types = model.types.toArrow().to_pylist()
    sets = [{r["type"] for r in types if r[c]} for c in ("abbreviation", "starter", "lower_start")]
    sets.append({(r["left"], r["right"]) for r in model.collocations.toArrow().to_pylist()})
    shared = model.types.sparkSession.sparkContext.broadcast(sets)

    @F.arrow_udf("string")
    def apart(texts: pa.Array) -> pa.Array:
        found = shared.value

        def replaced(match: re.Match) -> str:
            word, following = _LAST_WORD.search(match[1]), _FIRST_WORD.search(match[3])
            if word and not is_end(word[0], following[0] if following else "", *found):
                return match[0]
            return f"{match[1]} . {match[2]}"

        return pa.array([t if t is None else _STOP.sub(replaced, t) for t in texts.to_pylist()], pa.string())

    return apart
