"""Text to text and text to tokens, as column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _clean(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if not text.isprintable():
        for ch in set(text):
            if not ch.isprintable():
                text = text.replace(ch, "")
    return text.strip()


def _clean_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _clean(t) if isinstance(t, str) else "")


_clean_udf = F.pandas_udf(_clean_all, StringType())


def _clean_once(text: Column) -> Column:
    # made anew: a used function holds a handle of the JVM, and this module travels to the workers by value
    return F.pandas_udf(_clean_all, StringType()).asNondeterministic()(text)


def normalize_text(col: Column | str, once: bool = False) -> Column:
    """NFKC, then drop every non-printable character, then strip; null gives ''.

    Line breaks and tabs are deleted, not turned into spaces. A later filter on
    the result makes the optimizer evaluate it a second time below the filter;
    ``once`` prevents that, but then filters on other columns stay above it too.
    """
    clean = _clean_once if once else _clean_udf
    text = F.col(col) if isinstance(col, str) else col
    # ASCII only needs its control characters dropped and its spaces cut, and does not travel to Python
    other = F.rlike(text, F.lit(r"[^\x00-\x7F]"))
    plain = F.trim(F.regexp_replace(text, r"[\x00-\x1F\x7F]+", ""))
    return F.when(other, clean(F.when(other, text))).otherwise(F.coalesce(plain, F.lit("")))


def normalize_text_basic(col: Column | str) -> Column:
    """`normalize_text` without NFKC, for text known to be in that form already."""
    text = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    return F.trim(F.regexp_replace(text, r"[\p{C}\p{Z}&&[^ ]]", ""))


def _words(text: Column) -> Column:
    # after normalisation the only whitespace left is U+0020
    return F.array_remove(F.split(text, " "), "")


def tokenize_ws(col: Column | str, once: bool = False) -> Column:
    """Normalise, lower-case, split on spaces; empty text gives an empty array."""
    return _words(F.lower(normalize_text(col, once)))


def _chain(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


# A full stop ends a sentence if white space follows and its word has two characters without a
# stop before it (not "J." or "e.g.") and is none of these. Common abbreviations.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "st", "vs", "jr", "sr", "etc", "fig", "inc")
_CLOSERS = r"\]\)}>\"'»”’"
_TEXT_END = rf"(?<=[^.]\.)([{_CLOSERS} ]*)$"
_SENTENCE_END = (
    rf"(?<=[^\s.]{{2}}\.)(?<!(?<![\p{{L}}\p{{N}}])(?:{'|'.join(ABBREVIATIONS)})\.)([{_CLOSERS}]*)(?=\s)"
)
_MARKS = r"([:,])([:,])|([:,](?=\D|$)|\.{2,}|[;@#$%&?!])"

# The published Penn Treebank word rules for text in small letters whose only white space is the
# space. Rules without effect on one another share a pass, and a pass begins with a class of characters that are
# rare in text, so that the others are looked at once.
_PTB_OPENING = [
    (r"(?=[\"'])(?:\"(?<=^\"|[ (\[{<«“‘„`]\"|^\"\")|''(?<=[ (\[{<«“‘„`]''|^\"''))", " `` "),
    (r"(?U)(?=['`«‘-„])(?:(')(?=(?!re|ve|ll|m|t|s|d|n)\w\b)|([«“‘„]|``|`))", r"$1 $2 "),
]
# the last stop of the text, colons and commas (of two in a row the second stays with what follows), other marks
_PTB_MARKS = (rf"(?=[.,:;@#$%&?!])(?:(\.){_TEXT_END}|{_MARKS})", r" $1$3$5 $2$4")
_PTB_STOPS_AND_MARKS = (rf"(?=[.,:;@#$%&?!])(?:(\.)(?:{_TEXT_END}|{_SENTENCE_END})|{_MARKS})", r" $1$4$6 $2$3$5")
_PTB_CLOSING = [
    (r"'(?<=[^']')(?= )", r" '"),
    (r"(?=[*\]\[(){}<>»'\-’-”])([*\]\[(){}<>»”’]|--|'')", r" $1 "),
]
_PTB_CLITICS = [
    # a clitic may have been parted from one that follows
    (r"(?=['n])('(?<=[^' ]')(?:(?:ll|re|ve)(?=(?:'[smd]?)? )|[smd]?(?= ))|n't(?<=[^' ]n't)(?=(?:'[smd]?)? ))", r" $1"),
    (
        r"(?U)(?=[cdglmw])\b(can(?=not\b)|d(?='ye\b)|g[iı]m(?=me\b)|gon(?=na\b)|got(?=ta\b)|lem(?=me\b)"
        r"|more(?='n\b)|wan(?=na\s))(not|'ye|me|na|ta|'n)",
        r" $1 $2 ",
    ),
    (r"(?U) ('t)(?:([iı]s)\b(?:('t)(was)\b)?|(was)\b)", r" $1 $2$5 $3 $4 "),
]

# The published inverse rules that re-attach punctuation and clitics.
_DETOKENIZE_RULES = [
    (r"(?iU)([ ]'t)\s(is)\b", r"$1$2"),
    (r"(?iU)([ ]'t)\s(was)\b", r"$1$2"),
    (r"(?iU)\b(can)\s(not)\b", r"$1$2"),
    (r"(?iU)\b(d)\s('ye)\b", r"$1$2"),
    (r"(?iU)\b(gim)\s(me)\b", r"$1$2"),
    (r"(?iU)\b(gon)\s(na)\b", r"$1$2"),
    (r"(?iU)\b(got)\s(ta)\b", r"$1$2"),
    (r"(?iU)\b(lem)\s(me)\b", r"$1$2"),
    (r"(?iU)\b(more)\s('n)\b", r"$1$2"),
    (r"(?iU)\b(wan)\s(na)\b", r"$1$2"),
    (r"([^' ])\s('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"$1$2 "),
    (r"([^' ])\s('[sS]|'[mM]|'[dD]|') ", r"$1$2 "),
    (r"(\S)\s('')", r"$1$2"),
    (r"('')\s([.,:)\]>};%])", r"$1$2"),
    (r"''", r'"'),
    (r"^\s+|\s+$", r""),
    (r" -- ", r"--"),
    (r"([\[\(\{<])\s", r"$1"),
    (r"\s([\]\)\}>])", r"$1"),
    (r"([\]\)\}>])\s([:;,.])", r"$1$2"),
    (r"([^'])\s'\s", r"$1' "),
    (r"\s([?!])", r"$1"),
    (r"([^\.])\s(\.)([\]\)}>\"']*)\s*$", r"$1$2$3"),
    (r"([#$])\s", r"$1"),
    (r"\s([;%])", r"$1"),
    (r"\s([&*])\s", r" $1 "),
    (r"\s\.\.\.\s", r"..."),
    (r"\s([:,])\s", r"$1 "),
    (r"([ (\[{<])\s``", r"$1``"),
    (r"(``)\s", r"$1"),
    (r"``", r'"'),
]


def tokenize_ptb(col: Column | str, sentence_ends: Callable[[Column], Column] | None = None) -> Column:
    """Normalise, lower-case, split by the Penn Treebank word rules; a text may hold several sentences.

    ``sentence_ends`` sets the stops of inner sentences apart (`sentences.sentence_ends` of
    a trained model); without it, a short list of abbreviations decides.
    """
    text = F.lower(normalize_text(col))
    text = _chain(text, _PTB_OPENING)
    marks = [_PTB_STOPS_AND_MARKS] if sentence_ends is None else [_PTB_MARKS]
    text = _chain(text if sentence_ends is None else sentence_ends(text), marks)
    text = F.replace(_chain(text, _PTB_CLOSING), F.lit('"'), F.lit(" '' "))
    return _words(_chain(F.concat(F.lit(" "), text, F.lit(" ")), _PTB_CLITICS))


def detokenize(tokens: Column | str) -> Column:
    """Join Treebank tokens to text, re-attaching punctuation and clitics."""
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return F.trim(_chain(joined, _DETOKENIZE_RULES))


def tokenize(
    col: Column | str,
    lang: Column | str,
    tokenizers: Mapping[str, Callable[[Column], Column]] | None = None,
    unsupported: str = "error",
) -> Column:
    """Dispatch on the language of each row.

    ``tokenizers`` maps a language to a function from text column to token
    array; only ``en`` is set by default (Chinese takes a dictionary, see
    `zh_tokenizer`). A tokenizer sees null for the rows of other languages. With ``unsupported="ws"`` other languages split on spaces,
    otherwise they raise an error.
    """
    text = F.col(col) if isinstance(col, str) else col
    lang = F.col(lang) if isinstance(lang, str) else lang
    chosen = None
    for name, split in (tokenizers or {"en": tokenize_ws}).items():
        hit = lang == F.lit(name)
        own = split(F.when(hit, text))  # Python functions run on every row, whatever the branch
        chosen = F.when(hit, own) if chosen is None else chosen.when(hit, own)
    if unsupported == "ws":
        return chosen.otherwise(tokenize_ws(text))
    problem = F.concat(F.lit("Unsupported language: "), F.coalesce(lang, F.lit("null")))
    return chosen.otherwise(F.raise_error(problem).cast("array<string>"))


def seq_length(tokens: Column | str) -> Column:
    """Number of tokens (0 for null)."""
    return F.coalesce(F.array_size(tokens), F.lit(0))


def add_prefix(col: Column | str, prefix: str) -> Column:
    """Put a task prefix before the text."""
    return F.concat(F.lit(prefix), F.col(col) if isinstance(col, str) else col)
