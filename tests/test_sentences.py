"""Sentence ends: scores against brute force, and precision and recall on labelled text."""

import math
import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from bitloom.functions.text import tokenize_ptb
from bitloom.operators import sentences

SHORT = ["approx", "dept", "gov", "hon", "univ", "capt", "e.g", "no", "u.s.a"]


def labelled(seed, n=400):
    """Texts as lists of ``(word, ends a sentence)``, with abbreviations, initials, numbers and rare words at ends."""
    rng = random.Random(seed)
    syllables = ["ra", "to", "mi", "sel", "dor", "ban", "que", "lin", "or", "fe"]
    common = ["".join(rng.choices(syllables, k=rng.randrange(2, 4))) for _ in range(250)]
    starts = ["The", "When", "Many", "It", "Our"]
    texts = []
    for _ in range(n):
        text = []
        for _ in range(rng.randrange(1, 6)):
            body = [rng.choice(starts)] + [rng.choice(common) for _ in range(rng.randrange(4, 12))]
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(1, len(body))
                body[at:at] = [rng.choice(SHORT) + ".", rng.choice(["Lindor", "Ranto", "Banque", rng.choice(common)])]
            if rng.random() < 0.3:
                body[2:2] = ["J.", "Selfe"]
            if rng.random() < 0.2:
                body.append(str(rng.randrange(1900, 2000)))
            end = rng.choice([".", ".", ".", "?", "!"])
            text += [(w, False) for w in body[:-1]] + [(body[-1] + end, True)]
        texts.append(text)
    return texts


def decided(model, texts):
    """Whether each inner stop was taken for an end, with its label."""
    ends = sentences.sentence_ends(model)
    spark = model.types.sparkSession
    rows = spark.createDataFrame([(i, " ".join(w for w, _ in t)) for i, t in enumerate(texts)], "i long, t string")
    for row in rows.select("i", ends("t").alias("s")).collect():
        words, at = row.s.split(), 0
        for k, (word, label) in enumerate(texts[row.i]):
            apart = word.endswith(".") and words[at] == word[:-1] and words[at + 1 : at + 2] == ["."]
            assert apart or words[at] == word
            if word.endswith(".") and k + 1 < len(texts[row.i]):
                yield apart, label
            at += 2 if apart else 1


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame([(" ".join(w for w, _ in t), 1) for t in labelled(1)] + [(None, 1), ("", 1)], "text string, type int")
    return sentences.train_sentence_model(rows.repartition(3), "text")


@pytest.mark.parametrize("lower", [False, True])
def test_precision_and_recall(model, lower):
    """On text that the model has not seen, as written and in small letters."""
    texts = [[(w.lower() if lower else w, e) for w, e in t] for t in labelled(2, 200)]
    pairs = Counter(decided(model, texts))
    precision = pairs[True, True] / (pairs[True, True] + pairs[True, False])
    recall = pairs[True, True] / (pairs[True, True] + pairs[False, True])
    # a year at the end is no end before a small letter: text in small letters loses those
    assert precision > 0.99 and recall > (0.78 if lower else 0.98)


def test_abbreviations(model):
    found = {r.type for r in model.types.filter("abbreviation").collect()}
    assert set(SHORT) <= found | {"no"} and all(len(t) < 7 for t in found)
    assert {r.type for r in model.types.filter("starter").collect()} == {"the", "when", "many", "it", "our"}


def brute_scores(texts):
    counts = {}
    for text in texts:
        for word in regex.findall(sentences.WORD, text or ""):
            if word[0] not in "?!":
                kind = regex.sub(r"\.+$", "", word).lower()
                stopped = word.endswith(".") and not word.endswith("..")
                counts.setdefault(kind, [0, 0])[not stopped] += 1
    total = sum(map(sum, counts.values()))
    share = sum(c[0] for c in counts.values()) / total
    for kind, (stopped, bare) in counts.items():
        if stopped and regex.search(r"\p{L}", kind):
            odds = lambda p: stopped * math.log(p) + bare * math.log(1 - p)  # noqa: B023, E731
            letters = len(kind.replace(".", ""))
            scale = math.exp(-letters) * (len(kind) - letters + 1) * float(letters) ** -bare
            yield kind, stopped, bare, -2 * (odds(share) - odds(0.99)) * scale


def test_scores_equal_brute_force(spark):
    texts = [" ".join(w for w, _ in t) for t in labelled(3, 60)] + ["Wait... really?! E.g. 3.5 x. 12. O'Neil. naïve. a.b.c.", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {tuple(r)[:3]: r.score for r in sentences.abbreviation_scores(sentences.type_counts(rows, "t")).collect()}
    expected = {x[:3]: x[3] for x in brute_scores(texts)}
    assert found.keys() == expected.keys() and all(found[k] == pytest.approx(v, rel=1e-9, abs=1e-15) for k, v in expected.items())


def test_collocations_and_numbers(spark):
    filler = ["The bird sings.", "Many trees grow tall.", "It rains now.", "When will it stop?"] * 40
    texts = ["We met on 3. december again."] * 30 + ["Of rooms he has approx. ten rooms. The end."] * 90 + filler
    texts += ["iPods came in 1990.", "It ended. iPods were gone."] * 5
    model = sentences.train_sentence_model(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert ("3", "december") in {tuple(r) for r in model.collocations.collect()}
    asked = ["On 3. december it fell", "in 1990. the wall fell", "in 1990. The wall fell", "in 1990. ipods sold", "approx. the same", "approx. The same", "J. smith. \"Yes.\" he said"]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, t string")
    got = [" ".join(r[0].split()) for r in rows.orderBy("i").select(sentences.sentence_ends(model)("t")).collect()]
    assert got == ["On 3. december it fell", "in 1990. the wall fell", "in 1990 . The wall fell", "in 1990 . ipods sold", "approx. the same", "approx . The same", "J. smith . \"Yes . \" he said"]


def test_no_text(spark):
    model = sentences.train_sentence_model(spark.createDataFrame([], "t string"), "t")
    assert model.types.count() == model.collocations.count() == 0
    rows = spark.createDataFrame([("mr. smith went. home (again.) now",), (None,), ("",)], "t string")
    found = [r[0] for r in rows.select(tokenize_ptb("t", sentences.sentence_ends(model))).collect()]
    assert found[0] == ["mr", ".", "smith", "went", ".", "home", "(", "again", ".", ")", "now"] and found[1:] == [[], []]
    with pytest.raises(ValueError, match="at most"):
        sentences.sentence_ends(sentences.SentenceModel(spark.range(3).selectExpr("string(id) AS type", "true AS abbreviation", "false AS starter", "false AS lower_start"), model.collocations), max_types=2)


def test_training_reads_the_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    texts = [" ".join(w for w, _ in t) for t in labelled(4, 50)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(counted.asNondeterministic()("t").alias("t"))
    sentences.train_sentence_model(rows, "t")
    assert read.value == len(texts)
