"""N-grams and the tokens on which BLEU counts them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public 13a rules, in order. The space is left out of the first
# class: padding a space with spaces changes no token, and spaces are the commonest match.
_RULES_13A = [
    (r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]
_ENTITIES_13A = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def tokenize_13a(col: Column | str) -> Column:
    """Tokens of the ``13a`` scheme, case kept."""
    text = F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"(?U)\s+$", "")
    text = F.replace(text, F.lit("<skipped>"), F.lit(""))
    text = F.replace(F.replace(text, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for entity, plain in _ENTITIES_13A:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, replacement in _RULES_13A:
        text = F.regexp_replace(text, pattern, replacement)
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def ngrams(tokens: Column | str, n: int) -> Column:
    """All n-grams in order, each as one space-joined string.

    Each order is zipped from the one below and the shifted tokens, so the array
    is not sliced once per element.
    """
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    if n == 1:
        return tokens
    rest = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    heads = F.slice(ngrams(tokens, n - 1), F.lit(1), rest)
    tails = F.slice(tokens, F.lit(n), rest)
    return F.zip_with(heads, tails, lambda head, tail: F.concat(head, F.lit(" "), tail))


def repeated_ngrams(tokens: Column | str, n: int = 2) -> Column:
    """True if some n-gram occurs twice."""
    grams = ngrams(tokens, n)
    return F.size(grams) > F.size(F.array_distinct(grams))
