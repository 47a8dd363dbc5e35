import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import counting, coverage
from bitloom.plans.lookup import skew_safe_left_join
from bitloom.plans.ranking import global_rank


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(6000)] + ["<unk>", "<pad>", "<unk>"]
    rng.shuffle(words)
    rows = [("en", i, words[i * 20 : (i + 1) * 20]) for i in range(len(words) // 20 + 1)]
    return rows + [("fr", 10_000, ["le", "la", "le", "un"]), ("fr", 10_001, [])]


@pytest.fixture(scope="module")
def tokens(spark, corpus):
    return spark.createDataFrame(corpus, "lang string, id long, tokens array<string>").repartition(5)


def counters(corpus):
    found = {}
    for lang, _, words in corpus:
        found.setdefault(lang, Counter()).update(words)
    return found


def test_token_counts(corpus, tokens):
    rows = counting.token_counts(tokens).collect()
    expected = {(lang, t): n for lang, c in counters(corpus).items() for t, n in c.items()}
    assert {(r.lang, r.token): r.freq for r in rows} == expected


@pytest.mark.parametrize("min_freq, max_size", [(1, None), (3, None), (2, 50), (2, 5000), (1, 4)])
def test_build_vocab_in_first_seen_order(corpus, tokens, min_freq, max_size):
    vocab = counting.build_vocab(counting.token_counts(tokens, key="id"), min_freq, max_size, tie="first_seen")
    rows = vocab.collect()
    for lang, counter in counters(corpus).items():
        expected = list(counting.SPECIALS)
        for word, n in counter.most_common():
            if n < min_freq or word in counting.SPECIALS:
                continue
            if max_size is not None and len(expected) >= max_size:
                break
            expected.append(word)
        assert [r.token for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r.id)] == expected


def test_vocab_stats_and_oov(corpus, tokens):
    counts = counting.token_counts(tokens)
    vocab = counting.build_vocab(counts, 2, 60)
    stats = {r.lang: r for r in counting.vocab_stats(counts, vocab).collect()}
    types = len([w for w in counters(corpus)["en"] if w not in counting.SPECIALS])
    assert (stats["en"].unique_types, stats["en"].vocab_size, stats["en"].kept) == (types, 60, 56)
    assert stats["en"].discarded == types - 56 and stats["en"].type_coverage == pytest.approx(56 / types)
    known = {(r.lang, r.token) for r in vocab.collect()}
    report = {(r.lang, r.token): (r.freq, r.oov_rate) for r in counting.oov_report(counts, vocab).collect()}
    for lang, counter in counters(corpus).items():
        total = sum(counter.values())
        for word, n in counter.items():
            if (lang, word) in known:
                assert (lang, word) not in report
            else:
                assert report[lang, word] == (n, pytest.approx(n / total))


def test_coverage_reports(corpus, tokens):
    counts = counting.token_counts(tokens)
    sizes = {(r.lang, r.threshold): r.n_types for r in coverage.coverage_size(counts).collect()}
    guides = {(r.lang, r.threshold): r.idx0 for r in coverage.coverage_guides(counts, limit=200).collect()}
    sweep = {(r.lang, r.min_freq): (r.vocab_size, r.token_coverage) for r in coverage.min_freq_sweep(counts).collect()}
    for lang, counter in counters(corpus).items():
        freq = np.array([n for _, n in counter.most_common()])
        share = np.cumsum(freq) / freq.sum()
        for t in coverage.THRESHOLDS:
            assert sizes[lang, t] == np.searchsorted(share, t) + 1
        for t in coverage.GUIDES:
            at = np.searchsorted(share, t)
            assert guides.get((lang, t)) == (at if at < min(200, len(freq)) else None)
        for m in coverage.MIN_FREQS:
            assert sweep[lang, m] == (np.sum(freq >= m), pytest.approx(freq[freq >= m].sum() / freq.sum()))


def test_curve_and_ranks(corpus, tokens):
    counts = counting.token_counts(tokens)
    curve = coverage.coverage_curve(counts).orderBy("lang", "rank").collect()
    zipf = {(r.lang, r.rank0): r for r in coverage.rank_frequency(counts).collect()}
    for lang, counter in counters(corpus).items():
        rows = [r for r in curve if r.lang == lang]
        expected = sorted(counter.items(), key=lambda kv: (-kv[1], kv[0]))
        assert [(r.token, r.freq) for r in rows] == expected
        assert [r.cum for r in rows] == list(np.cumsum([n for _, n in expected]))
        assert rows[-1].coverage == 1.0
        assert zipf[lang, 0].log_rank is None and zipf[lang, 1].log_rank == 0.0
    short = coverage.coverage_curve(counts, limit=7).filter("lang = 'en'").collect()
    assert sorted(r.rank for r in short) == list(range(1, 8))
    top = counting.top_tokens(counts, 3).filter("lang = 'fr'").orderBy("rank").collect()
    assert [r.token for r in top] == ["le", "la", "un"]


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "lang string, token string, freq long")
    assert counting.build_vocab(none).count() == 0
    assert coverage.coverage_size(none).count() == 0
    assert coverage.min_freq_sweep(none).count() == 0


def test_global_rank_splits_a_hot_group(spark):
    rows = [("hot" if i % 10 else f"g{i % 7}", (i * 7919) % 5003) for i in range(5003)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(6)
    ranked = global_rank(df, [F.desc("v")], by=["g"]).collect()
    groups = {}
    for r in ranked:
        groups.setdefault(r.g, []).append((r.rank, r.v))
    assert sum(map(len, groups.values())) == 5003
    for g, found in groups.items():
        values = sorted((v for name, v in rows if name == g), reverse=True)
        assert sorted(found) == list(enumerate(values, 1))
    alone = global_rank(df.select("v"), [F.col("v")]).collect()
    assert {r.v: r.rank for r in alone} == {v: i for i, v in enumerate(sorted(v for _, v in rows), 1)}


def test_skew_safe_join_equals_plain_join(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(4000)] + [(4001, None), (4002, "absent"), (4003, "absent")]
    big = spark.createDataFrame(rows, "id long, k string").repartition(4)
    table = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 4000, 6)]], "k string, v long")
    found = {(r.id, r.k, r.v) for r in skew_safe_left_join(big, table, "k", ["id"]).collect()}
    assert found == {(r.id, r.k, r.v) for r in big.join(table, "k", "left").collect()}
    assert len(found) == len(rows)


def test_global_rank_carries_sums_and_null_groups(spark):
    rows = [("a", 3, 1), ("a", 1, 10), ("a", 2, 100), (None, 1, 5), (None, 2, 7)]
    df = spark.createDataFrame(rows, "g string, k int, n int").repartition(4)
    ranked = global_rank(df, [F.col("k")], ["g"], running={"before": "n"}).collect()
    assert {(r.g, r.k, r["rank"], r.before) for r in ranked} == {
        ("a", 1, 1, 0), ("a", 2, 2, 10), ("a", 3, 3, 110), (None, 1, 1, 0), (None, 2, 2, 5)
    }
