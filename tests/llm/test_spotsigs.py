"""Signatures with any number of common words between content words, against brute force."""

import random
import time

from pyspark.sql import functions as F

from bitloom.llm import spotsigs

COMMON = set(spotsigs.COMMON)


def chains(text):
    words = text.lower().split()
    content = [k for k, w in enumerate(words) if w not in COMMON]
    found = set()
    for k, word in enumerate(words):
        after = [c for c in content if c > k][:2]
        if word in COMMON and len(after) == 2:
            found.add(" ".join([word, *[words[c] for c in after]]))
    return found


def test_no_run_of_common_words_is_too_long(spark):
    rng = random.Random(7)
    words = ["river", "Stone", "theory", "anderes", "x", "é"]
    texts = ["the " * n + "river " + "of " * m + "stone" for n in (1, 8, 9, 10, 40) for m in (0, 7, 8, 9, 30)]
    for _ in range(120):
        parts = [" ".join(rng.choices(["the", "of", "Und", "la", "is"], k=rng.choice([0, 1, 2, 7, 8, 9, 10, 25]))) for _ in range(8)]
        texts.append("\n".join(f"{p} {rng.choice(words)}\t" for p in parts) + " the of" * rng.randrange(8))
    texts += ["the " * 50, "the " * 50 + "end", " " + "a " * 12 + "b c", "a " * 9 + "b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r.i: r.s for r in rows.select("i", spotsigs.signatures("t").alias("s")).collect()}
    made = sorted({c for t in texts for c in chains(t)})
    codes = {r.c: r.h for r in spark.createDataFrame([(c,) for c in made], "c string").select("c", F.hash("c").alias("h")).collect()}
    whole = {r.i: r.h for r in rows.select("i", F.hash(F.concat(F.lit("\n"), F.lower("t"))).alias("h")).collect()}
    for i, text in enumerate(texts):
        assert found[i] == sorted({codes[c] for c in chains(text)} or {whole[i]}), text


def test_very_long_runs_take_linear_time(spark):
    text = "the " * 400_000 + "river runs " + "of the " * 100_000 + "home now"
    rows = spark.createDataFrame([(text,)], "t string")
    start = time.time()
    assert rows.select(F.size(spotsigs.signatures("t"))).first()[0] == 3
    assert time.time() - start < 60


def test_text_is_searched_once(spark):
    found = spark.createDataFrame([("the river runs",)], "t string").select(spotsigs.signatures("t").alias("s"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("array_sort(") == 1
