"""Certified quality rules: counts and thresholds against brute force."""

import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  functions travel by value
from bitloom.llm import quality_rules as qr
from bitloom.llm import queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, kept string, n_words string, stratum string, id string"
SPACE = " \t\n\v\f\r"


def words_of(text):
    found, word = [], ""
    for c in text or "":
        if c in SPACE:
            found, word = found + [word] * bool(word), ""
        else:
            word += c
    return found + [word] * bool(word)


def brute_counts(text):
    words = words_of(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    dup = sum(line in lines[:k] for k, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), len(lines)


def failed(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def exact_tail(k, n, p):
    p = Fraction(p)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def brute_cutoffs(rows, labels, rules, max_rejection, confidence):
    known = {}
    for i, q in labels:
        if i is not None and q is not None:
            known.setdefault(i, set()).add(q == 1)
    texts = {}
    for i, text, stratum in rows:
        if not failed(brute_counts(text)) and len(known.get(i, ())) == 1:
            texts.setdefault(stratum, {}).setdefault(text, []).append(next(iter(known[i])))
    found = {}
    for stratum, own in texts.items():
        good = [dict(zip(qr.COUNTS, brute_counts(t), strict=True)) for t, marks in own.items() if all(marks)]
        bad = [dict(zip(qr.COUNTS, brute_counts(t), strict=True)) for t, marks in own.items() if not all(marks)]
        found[stratum] = []
        for rule in rules:
            fails = lambda c, cut, rule=rule: bool(c[rule.bottom]) and (
                c[rule.top] / c[rule.bottom] > cut if rule.above else c[rule.top] / c[rule.bottom] < cut
            )
            best = None
            for k, cut in enumerate(rule.cutoffs):
                lost = sum(fails(c, cut) for c in good)
                if not good or exact_tail(lost, len(good), max_rejection / len(rules)) > (1 - confidence) / (len(texts) * len(rules)):
                    break
                gain = (sum(fails(c, cut) for c in bad) - lost, -k)
                best = max(best, (gain, cut)) if best else (gain, cut)
            found[stratum].append(best and best[1])
    return found


@pytest.fixture(scope="module")
def made():
    rng = random.Random(6)
    vocabulary = ["river", "stone", "evening", "walk", "house", "green", "über", "漢字", "people", "bridge"]
    rows, labels = [], []
    for i in range(700):
        words = [rng.choice(vocabulary) + rng.choice(["", str(rng.randrange(40))]) for _ in range(rng.randrange(45, 120))]
        bad = i % 5 == 0
        if bad and i % 2:
            words = [w + rng.choice(["###", "$$", "|"]) for w in words]
        text = rng.choice([" ", "\t", "\n"]).join(words)
        if bad and not i % 2:
            line = " ".join(words[:6])
            text = "\n".join([text] + [line + f"{k // 3}" for k in range(12)])
        rows.append((i, text, [None, "en", "en", "de"][i % 4]))
        if i % 6:
            labels.append((i, 0 if bad else 1))
    rows += [(900 + k, rows[11][1], rows[11][2]) for k in range(40)]
    labels += [(900 + k, 1) for k in range(40)] + [(3, 0), (3, 1), (None, 1), (13, None), (5000, 1)]
    rows += [(None, rows[2][1], "en"), (950, None, "en"), (951, "", None), (952, "\n \n", "fr"), (953, "a b c " * 4000, "de"), rows[4], rows[4]]
    return rows, labels


def test_counts(made):
    texts = [r[1] for r in made[0]] + ["x", "a b", "a a a", "a a a a", "b\n b\nb\n\nb", " \x1c\x85  #*$%&|<> ", "q w e r q w e", "dup\r\ndup\r\ndup"]
    assert [qr.counts_of(t) for t in texts] == [brute_counts(t) for t in texts]


def test_binomial_tail():
    for n in (1, 7, 60, 400):
        for k in {0, 1, n // 10, n // 2, n - 1, n}:
            for p in (0.001, 0.02, 0.3, 0.9):
                assert qr.binomial_tail(k, n, p) == pytest.approx(exact_tail(k, n, p), rel=1e-9, abs=1e-12)
    assert qr.binomial_tail(0, 10**9, 1e-9) == pytest.approx(math.exp(-1), rel=1e-6)


@pytest.mark.parametrize("max_rejection,confidence", [(0.1, 0.95), (0.4, 0.9), (0.9, 0.5)])
def test_verdicts_equal_brute_force(spark, made, max_rejection, confidence):
    rows, labels = made
    docs = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    found = qr.judge(docs, marks, max_rejection=max_rejection, confidence=confidence).collect()
    cutoffs = brute_cutoffs(rows, labels, qr.RULES, max_rejection, confidence)
    assert max_rejection < 0.4 or any(c is not None for own in cutoffs.values() for c in own)
    expected = []
    for i, text, stratum in rows:
        c = brute_counts(text)
        named = dict(zip(qr.COUNTS, c, strict=True))
        by = []
        for rule, cut in zip(qr.RULES, cutoffs.get(stratum, [None] * len(qr.RULES)), strict=True):
            value = named[rule.top] / named[rule.bottom] if named[rule.bottom] else None
            if cut is not None and value is not None and (value > cut if rule.above else value < cut):
                by.append(rule.name)
        expected.append((i, stratum, *c, failed(c), by, not failed(c) and not by))
    assert sorted((tuple(r) for r in found), key=repr) == sorted(expected, key=repr)


def test_certified_rules_catch_and_keep(spark):
    """Held-out check: rules certified on one half lose few good texts of the other."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows = []
    for i in range(6000):
        bad = i % 6 == 0
        rows.append((i, " ".join(word() + ("##" if bad and rng.random() < 0.6 else "") for _ in range(60)), "en", int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    found = qr.judge(docs, docs.filter("doc_id % 4 < 2"), max_rejection=0.05, confidence=0.95).select("id", "kept")
    other = found.join(docs, F.col("id") == F.col("doc_id")).filter("doc_id % 4 >= 2")
    shares = {r.quality: r.kept for r in other.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[1] > 0.95 and shares[0] < 0.05


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert qr.judge(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "w " * 60, "en"), (2, " ".join(f"w{k}" for k in range(60)), "en")], docs.schema)
    assert {(r.id, r.kept) for r in qr.judge(some, labels).collect()} == {(1, False), (2, True)}


def test_query(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    cutoffs = brute_cutoffs(docs, labels, qr.RULES, 0.1, 0.95)
    found = queries.op12_certified_rules(spark, SMALL)
    assert found.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]
    assert all(c is None for own in cutoffs.values() for c in own)  # too few labels here to certify anything
    expected = {(i, *(c := brute_counts(t))[:5], failed(c), not failed(c)) for i, t, _ in docs}
    assert {tuple(r)[:8] for r in found.collect()} == expected
