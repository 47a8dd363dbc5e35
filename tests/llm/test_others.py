"""Embeddings, urls, run-length index, toxicity and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitloom.llm import embedding_dedup, host_trust, queries
from bitloom.llm.components import components
from bitloom.llm.deobfuscate import Restorer, train_letters
from bitloom.llm.run_index import RunIndex, suffix_array
from bitloom.llm.toxicity import score, train

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("tile", [2048, 16])
def test_embeddings(spark, tile, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 12)) * np.linspace(3, 0.2, 12)
    vectors = [base[i % 30] + rng.normal(size=12) * (0.25 if i % 3 else 0) for i in range(120)]
    rows = [(i, v.astype(float).tolist(), i % 2, "x") for i, v in enumerate(vectors)]
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0] * 12, [None] * 12, [inf] * 12, [nan] + [1.0] * 11, vectors[0].tolist(), [2 * x for x in vectors[0].tolist()], [1.0, 2.0]]
    rows += [(200 + k, v, 0, "y") for k, v in enumerate(odd)] + [(300, vectors[0].tolist(), None, "z"), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, tile string").repartition(3)
    valid = {i: (np.array(v), y) for i, v, y, _ in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    near = {
        (a, b)
        for a in valid
        for b in valid
        if a < b and valid[a][1] == valid[b][1] and len(valid[a][0]) == len(valid[b][0])
        and valid[a][0] @ valid[b][0] / (np.linalg.norm(valid[a][0]) * np.linalg.norm(valid[b][0])) >= 0.98
    }
    root = {i: i for i, *_ in rows}
    for _ in rows:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    links = {i: sum(i in p for p in near) for i in root}
    found = embedding_dedup.near_duplicate_vectors(df, 0.98).collect()
    assert near and len(found) == len(rows)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in found} == {(i, links[i], root[i], root[i] == i) for i in root}
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e if None not in e and e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a in root and b in root and a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert found == root
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_run_index():
    rng = random.Random(2)
    for trial in range(60):
        letters = b"ab" if trial % 2 else b"abcdef"
        make = lambda n: bytes(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        parts = [make(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 10))]
        parts += [parts[0][:5] + parts[-1], parts[0]]
        raw = b"".join(p + b"\xff" for p in parts)
        text = np.frombuffer(raw, np.uint8)
        assert suffix_array(text).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        cap = rng.choice([3, 8, 20])
        index = RunIndex(text, cap)
        asked = [make(rng.randrange(30)) + b"z" + make(5), *parts, parts[0] + parts[-1]]
        offsets = np.concatenate([[0], np.cumsum([len(q) for q in asked])])
        length, row = index.matching_statistics(np.frombuffer(b"".join(asked), np.uint8), offsets)
        values = np.arange(len(raw))[::-1].copy()
        least = index.minima(values)
        for k, q in enumerate(asked):
            for i in range(len(q)):
                best = max([0] + [n for n in range(1, min(cap, len(q) - i) + 1) if q[i : i + n] in raw])
                assert length[offsets[k] + i] == best
                if best == cap:
                    at = [p for p in range(len(raw)) if raw[p : p + cap] == q[i : i + cap]]
                    assert least[index.interval_of(row[offsets[k] + i : offsets[k] + i + 1])[0]] == min(values[at])


def test_urls(spark):
    def page(url, *links):
        return (url, "".join(f'<a class="x" href="{u}">t</a>' for u in links))

    rows = [
        page("http://Good.org/fr/1", "https://friend.com/x", "/local"),
        page("https://friend.com/a?x=://b", "//FAR.com/y"),
        page("http://bad.net/x", "http://victim.com/"),
        page("http://spam.com/p#q", "http://bad.net/x", "http://www.bad.net/"),
        page("http://far.com"),
        page("http://victim.com/"),
        page("http://a.example.net/en/1"),
        page("http://example.net/en"),
        page("http://bad.net"),
        page("no host"),
        (None, None),
    ]
    df = spark.createDataFrame([(i, *r, "h") for i, r in enumerate(rows)] + [(0, *rows[0], "h")], "page_id long, url string, html string, host string")
    found = {r.page_id: r for r in host_trust.judge_urls(df, queries.RULES).collect()}
    assert [(found[i].host, found[i].path, found[i].rule, found[i].verdict) for i in range(len(rows))] == [
        ("good.org", "/fr/1", "org/fr/", "allow"),
        ("friend.com", "/a", None, "allow"),
        ("bad.net", "/x", "net/", "block"),
        ("spam.com", "/p", None, "block"),
        ("far.com", "", None, "allow"),
        ("victim.com", "/", None, "allow"),
        ("a.example.net", "/en/1", "example.net/en/", "allow"),
        ("example.net", "/en", "net/", "block"),
        ("bad.net", "", None, "allow" if found[8].trust >= found[8].distrust else "block"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
    ]
    assert found[1].trust > 0 and found[4].trust > 0 and found[3].distrust > 0 == found[5].distrust
    assert host_trust.judge_urls(df, queries.RULES).count() == len(rows) + 1
    assert host_trust.judge_urls(df.limit(0), queries.RULES).count() == 0


def test_page_rank_equals_brute_force(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(9), rng.randrange(9)): rng.randrange(1, 5) for _ in range(25)}
    edges = {(a, b): w for (a, b), w in edges.items() if a != b}
    seeds = {1: 2.0, 4: 1.0}
    start = np.array([seeds.get(i, 0) / 3 for i in range(9)])
    move = np.zeros((9, 9))
    for (a, b), w in edges.items():
        move[a, b] = w / sum(x for (c, _), x in edges.items() if c == a)
    score_ = start.copy()
    for _ in range(4):
        moved = 0.85 * score_ @ move
        score_ = moved + (1 - moved.sum()) * start
    frame = spark.createDataFrame([("w", str(a), str(b), w) for (a, b), w in edges.items()], "walk string, src string, dst string, weight long")
    seed = spark.createDataFrame([("w", str(k), m) for k, m in seeds.items()], "walk string, host string, mass double")
    found = {int(r.host): r.score for r in host_trust.spread(frame, seed, rounds=4).collect()}
    assert all(found.get(i, 0.0) == pytest.approx(score_[i], abs=1e-12) for i in range(9))


def test_walks_reach_the_end_of_a_long_chain(spark):
    n = 13
    frame = spark.createDataFrame([("w", str(i), str(i + 1), 1) for i in range(n - 1)], "walk string, src string, dst string, weight long")
    seed = spark.createDataFrame([("w", "0", 1.0)], "walk string, host string, mass double")
    score_ = np.eye(n)[0]
    for _ in range(2000):
        moved = 0.3 * np.r_[0, score_[:-1]]
        score_ = moved + (1 - moved.sum()) * np.eye(n)[0]
    found = {int(r.host): r.score for r in host_trust.spread(frame, seed, damping=0.3).collect()}
    assert found[n - 1] > 0 and all(found[i] == pytest.approx(score_[i], abs=1e-12) for i in range(n))


def test_toxicity(spark):
    rng = random.Random(9)
    plain = "the river runs over the stone and under the bridge while people walk home in the evening".split()
    rude = ["idiot", "loser", "pathetic"]
    disguised = ["1d1ot", "l0ser", "p a t h e t i c", "i-d-i-o-t", "looooser"]
    rows, labels = [], []
    for i in range(160):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words += rng.sample(rude, 2)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(i % 4 == 0)))
    rows += [(500 + k, " ".join([*plain, d, disguised[(k + 1) % 5]]), "x") for k, d in enumerate(disguised)]
    rows += [(600, None, "x"), (601, "", "x"), (602, " ".join(plain) * 50, "x"), (None, "home", "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int")
    model = train(docs, marks, F.lit(True))
    found = {r.doc_id: r.s for r in score(docs, model, out="s").collect()}
    assert all(0 <= s <= 1 for s in found.values()) and len(found) == len(rows) - 1
    assert all((found[i] >= 0.3) == (i % 4 == 0) for i in range(160))
    restore = Restorer(train_letters(docs))
    assert [restore(d).split()[0] for d in disguised] == ["idiot", "loser", "pathetic", "idiot", "loser"]
    assert all(found[500 + k] >= 0.3 for k in range(5)) and max(found[600], found[601], found[602]) < 0.3
    none = train(docs.limit(0), marks.limit(0), F.lit(True))
    assert score(docs.limit(0), none, out="s").count() == 0 and score(docs, none, out="s").count() == len(rows)
    assert restore("you 1d1ot at 12:30 2024") == "you idiot at 12:30 2024"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL).cache()
        seen[name] = out
        if name != "byte_bpe":
            assert out.columns == docs.columns
            docs = out
        empty = stage(spark, spark.read.parquet(f"{SMALL}/documents.parquet").limit(0), SMALL)
        assert empty.count() == 0
    ids = {name: {r.doc_id for r in frame.collect()} for name, frame in seen.items()}
    assert ids["simhash_near_dedup"] <= ids["toxicity"] and ids["suffix_dedup"] == ids["simhash_near_dedup"]
    assert seen["byte_bpe"].filter("not round_trip").count() == 0
    assert seen["byte_bpe"].count() == seen["mix_sources"].count() > 0
