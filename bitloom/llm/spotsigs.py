"""SpotSigs: signatures of the content words after common words, and their similarity."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.plans.ranking import global_rank
from bitloom.plans.storage import materialize

# fixed values: frequent function words of English, German, French and Spanish
COMMON = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine im ist mit nicht sich und von zu "
    "au avec dans de du elle en est et il la le les pas pour que qui sur un une "
    "como con del el es las los no por se su y"
).split()
SKIPPED = 8  # common words in a row up to which one look-ahead finds a chain
SPACE = r"\x20\x09-\x0D"


def _alternatives(words: Sequence[str]) -> str:
    """A pattern for any of the words that reads each letter once: words are grouped by their first letter, again and again."""
    tails: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        tails.setdefault(word[:1], []).append(word[1:])
    found = [re.escape(first) + _alternatives(rest) for first, rest in tails.items() if first]
    return "" if not found else "(?:" + "|".join(found) + ")" + ("?+" if "" in tails else "")


def _pattern(common: Sequence[str], chain: int) -> str:
    """A look-ahead at every common word: the word, then ``chain`` content words, common words between them skipped.

    Possessive groups keep the match linear and free of recursion.
    """
    word = _alternatives(common) + r"(?![^\x20\x09-\x0D])"
    skip = rf"(?:{word}[\x20\x09-\x0D]++){{0,{SKIPPED}}}+"
    content = rf"(?!{word})[^\x20\x09-\x0D]++"
    return rf"(?<![^\x20\x09-\x0D])(?=({word}[\x20\x09-\x0D]++" + r"[\x20\x09-\x0D]++".join([skip + content] * chain) + "))"


def _long_runs(low: Column, common: Sequence[str], chain: int) -> Column:
    """Hashes of the signatures of a text with more than ``SKIPPED`` common words in a row.

    The text is read once as runs of common words, each with the content word
    that ends it; all anchors of a run begin the same chain. Linear in the text,
    whatever the runs.
    """
    word = _alternatives(common) + rf"(?![^{SPACE}])"
    block = F.lit(rf"(?<![^{SPACE}])((?:{word}[{SPACE}]++)*+)((?!{word})[^{SPACE}]++)")
    contents = F.regexp_extract_all(low, block, 2)
    later = [F.slice(contents, k + 1, F.size(contents)).alias(f"c{k}") for k in range(1, chain)]
    rows = F.arrays_zip(F.regexp_extract_all(low, block, 1).alias("run"), contents.alias("c0"), *later)

    def of_run(row: Column) -> Column:
        anchors = F.array_distinct(F.filter(F.split(row["run"], rf"[{SPACE}]+"), lambda a: a != ""))
        made = F.transform(anchors, lambda a: F.hash(F.concat_ws(" ", a, *[row[f"c{k}"] for k in range(chain)])))
        return F.when(row[f"c{chain - 1}"].isNotNull(), made).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(rows, of_run))


def signatures(text: Column | str, common: Sequence[str] = COMMON, chain: int = 2) -> Column:
    """``array<int>``: the sorted distinct hashes of a text's signatures.

    A signature is a common word and the ``chain`` content words after it, in
    lower case, common words between them left out. A text without any (also a
    null or empty one) has a single signature, that of its whole lower-cased
    text, so that different texts do not become equal for want of common words.
    """
    text = F.col(text) if isinstance(text, str) else text
    low = F.lower(F.coalesce(text, F.lit("")))
    word = _alternatives(common)
    found = F.regexp_extract_all(low, F.lit(_pattern(common, chain)), 1)
    inner = rf"[\x20\x09-\x0D]+(?:{word}[\x20\x09-\x0D]+)*"
    hashes = F.transform(found, lambda s: F.hash(F.regexp_replace(s, inner, " ")))
    long_run = low.rlike(rf"(?<![^{SPACE}])(?:{word}[{SPACE}]++){{{SKIPPED + 1}}}")
    distinct = F.array_sort(F.array_distinct(F.when(long_run, _long_runs(low, common, chain)).otherwise(hashes)))
    whole = F.array(F.hash(F.concat(F.lit("\n"), low)))
    # a name of its own, or the condition and the value would each read the text
    return F.transform(F.array(distinct), lambda d: F.when(F.size(d) > 0, d).otherwise(whole))[0]


def fingerprint(signature_hashes: Column | str) -> Column:
    """The signatures as a string: eight hexadecimal digits each, in order."""
    hashes = F.col(signature_hashes) if isinstance(signature_hashes, str) else signature_hashes
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), " ")


def pruned_jaccard(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard similarity of two distinct arrays; 0 where their lengths alone keep it below ``threshold``."""
    smaller, larger = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    exact = shared / (F.size(a) + F.size(b) - shared)
    return F.when(smaller < F.lit(threshold) * larger, 0.0).otherwise(exact).cast("double")


def near_pairs(rows: DataFrame, id_col: str = "doc_id", signature_col: str = "signatures", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: similar signature sets and who has them.

    ``members`` (``id, rep``) maps every id to the smallest id with equal
    signatures; ``pairs`` (``left, right, jaccard``) are between those. Sets are partitioned by
    length so that partners lie in the same or the next partition; within one,
    sets meet on the rarest signatures of each (a prefix as long as the
    threshold demands), so frequent signatures never gather pairs. Null ids
    are left out.
    """
    keyed = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(signature_col).alias("sigs"))
    keyed = materialize(keyed, "signatures")
    sets = keyed.groupBy("sigs").agg(F.min("id").alias("rep"))
    sets = materialize(sets, "signature-sets")
    members = keyed.join(sets, "sigs").select("id", "rep")
    frequency = sets.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    n = F.size("sigs")
    part = F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    ranked = sets.select("rep", n.alias("n"), part.alias("part"), F.explode("sigs").alias("sig")).join(frequency, "sig")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "sig"))
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    rare = materialize(ranked.withColumn("place", place).filter(F.col("place") <= prefix).select("rep", "n", "part", "sig"), "rare")
    other = rare.select(F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("sig").alias("sig2"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part2"))
    later = (F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("rep2") > F.col("rep")))
    near = rare.join(other, (F.col("sig") == F.col("sig2")) & (F.col("part") == F.col("part2"))).filter(
        later & (F.col("n") >= F.col("n2") * F.lit(threshold) - 1e-9)
    )
    near = near.select("rep", "rep2").distinct()
    left = sets.select(F.col("rep"), F.col("sigs").alias("a"))
    right = sets.select(F.col("rep").alias("rep2"), F.col("sigs").alias("b"))
    scored = near.join(left, "rep").join(right, "rep2").withColumn("jaccard", pruned_jaccard(F.col("a"), F.col("b"), threshold))
    pairs = scored.filter(F.col("jaccard") >= threshold - 1e-12).select(
        F.least("rep", "rep2").alias("left"), F.greatest("rep", "rep2").alias("right"), "jaccard"
    )
    return pairs, members


def next_ids(ids: DataFrame) -> DataFrame:
    """``id, next``: the next lower id, after the lowest the highest; ``ids`` holds distinct ``id`` values, a null is the lowest."""
    ranked = global_rank(ids.select("id"), [F.desc_nulls_last("id")], name="place")
    ranked = materialize(ranked, "order")
    n = ranked.count()
    after = ranked.select((F.when(F.col("place") == 1, n).otherwise(F.col("place") - 1)).alias("place"), F.col("id").alias("next"))
    return ranked.join(after, "place").select("id", "next")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text beside an edited one: its last third replaced by the start of the next document.

    Returns ``id_col, n_chars, own, own_edited, next`` (signature arrays) and
    ``edited`` (text). A third is rounded down; a shorter next document gives
    all it has. The texts are shuffled once, by id, for both of their parts
    (the exchange is reused), and the donated starts once. Null texts count as
    empty.
    Rows that share an id are all edited with the same next id, and where the
    next id has several rows, its first text in code-point order donates.
    """
    key = F.struct(F.col(id_col).alias("id"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(key.alias("key"), text.alias("text"), F.length(text).alias("n"))
    ids = materialize(base.groupBy("key.id").agg(F.max("n").alias("n")), "ids")
    order = next_ids(ids).join(ids.select(F.col("id").alias("_id"), "n"), F.col("id").eqNullSafe(F.col("_id")))
    order = materialize(order.select("id", "next", F.floor(F.col("n") / 3).cast("int").alias("need")), "next-ids")
    own = base.select(F.col("key.id").alias("id"), "text", "n", signatures(F.col("text")).alias("own"))
    needed = order.select(F.col("id").alias("for"), F.col("next").alias("_next"), "need")
    given = own.join(needed.hint("merge"), F.col("id").eqNullSafe(F.col("_next"))).select(
        "for", F.struct(F.left("text", F.least("need", "n")).alias("start"), F.col("own").alias("sigs")).alias("given")
    )
    third = F.floor(F.col("n") / 3).cast("int")
    # one donor per id: equal ids give several, of which the least is taken
    several = docs.groupBy(id_col).count().filter("count > 1").take(1)
    donors = given.groupBy("for").agg(F.min("given").alias("given")) if several else given
    both = own.join(donors.hint("merge"), F.col("id").eqNullSafe(F.col("for")))
    edited = F.concat(F.left("text", F.col("n") - third), F.left("given.start", third))
    return both.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), "own", edited.alias("edited"), F.col("given.sigs").alias("next")
    ).withColumn("own_edited", signatures(F.col("edited")))
