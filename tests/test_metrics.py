"""Metrics by group, ranking of very many candidates, and counter-based noise."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import bleu, bpe, metrics, selection, vectors


def spread_metric():
    """Mean and variance of a column, merged by the pairwise update of moments."""

    def part(rows):
        x = rows["value"].dropna().to_numpy(float)
        return {"n": len(x), "mean": float(x.mean()) if len(x) else 0.0, "m2": float(((x - x.mean()) ** 2).sum()) if len(x) else 0.0}

    def merge(a, b):
        n = a["n"] + b["n"]
        if not n:
            return a
        gap = b["mean"] - a["mean"]
        return {"n": n, "mean": a["mean"] + gap * b["n"] / n, "m2": a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n}

    def finish(state):
        return {"n": state["n"], "mean": state["mean"], "variance": state["m2"] / max(1, state["n"])}

    return metrics.MergeableMetric(part, merge, finish, "n long, mean double, m2 double", "n long, mean double, variance double")


@pytest.mark.parametrize("held", [10_000, 1])
def test_mergeable_metric_by_group(spark, monkeypatch, held):
    monkeypatch.setattr(metrics, "HELD_GROUPS", held)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i % 2, rng.gauss(5, 2) if i % 11 else None) for i in range(900)]
    frame = spark.createDataFrame(rows, "run string, half int, value double").repartition(6)
    metrics.register_metric("spread", spread_metric())
    for by in (["run", "half"], ["run"], []):
        found = {tuple(r[c] for c in by): r for r in metrics.compute_metric("spread", frame, by).collect()}
        keys = {tuple(r[["run", "half"].index(c)] for c in by) for r in rows}
        assert found.keys() == keys
        for key, r in found.items():
            own = [v for *group, v in rows if v is not None and tuple(group[["run", "half"].index(c)] for c in by) == key]
            assert (r.n, r["mean"], r.variance) == (len(own), pytest.approx(np.mean(own)), pytest.approx(np.var(own)))
            assert r.metric == "spread"


def test_bleu_by_group(spark):
    model = bpe.bpe_model(spark, bpe.SPECIALS + sorted(bpe.byte_alphabet().values()), [])
    pairs = spark.createDataFrame([(i, f"g{i % 2}", f"a b c d e{i % 3}", f"a b c d e{i % 5}") for i in range(20)], "sent_id long, split string, hyp string, ref string")
    rows = bpe.bpe_encode(bpe.bpe_encode(pairs, model, "hyp", mode="keep", out="preds"), model, "ref", mode="keep", out="labels")
    metrics.register_metric("bleu", metrics.bleu_metric(model))
    found = metrics.compute_metric("bleu", rows.select("sent_id", "split", "preds", "labels"), ["split"]).drop("metric")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in bleu.corpus_bleu(pairs, ["split"]).collect()}


def test_topk_of_a_source_with_all_rows(spark):
    rng = random.Random(1)
    scores = [rng.randrange(4000) / 7 for _ in range(20_000)]
    rows = [(7, i, s) for i, s in enumerate(scores)] + [(None, 1, 2.0), (8, 1, 1.0)]
    frame = spark.createDataFrame(rows, "pair_id long, cand long, score double").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = selection.topk_candidates(frame, 5000)
        own = found.filter("pair_id = 7").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "Window [row_number" not in found._jdf.queryExecution().toString() and own > 1
    best = sorted(range(20_000), key=lambda i: (-scores[i], i))[:5000]
    expected = {(7, c, k) for k, c in enumerate(best, 1)} | {(None, 1, 1), (8, 1, 1)}
    assert {(r.pair_id, r.cand, r["rank"]) for r in found.collect()} == expected
    assert found.schema["rank"].dataType == selection.topk_candidates(frame, 3).schema["rank"].dataType


def test_noise_is_normal_and_depends_on_every_argument():
    rows = np.arange(3000) + (1 << 33)
    cells = vectors.noise(1, rows, 101)
    assert cells.shape == (3000, 101) and np.isfinite(cells).all()
    assert abs(cells.mean()) < 0.01 and abs(cells.std() - 1) < 0.01 and abs((cells**4).mean() - 3) < 0.1
    assert abs(np.corrcoef(cells[:, 0], cells[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(cells[:-1, 5], cells[1:, 5])[0, 1]) < 0.08
    shares = np.histogram(cells, [-9, -1.96, -0.6745, 0, 0.6745, 1.96, 9])[0] / cells.size
    assert np.allclose(shares, [0.025, 0.225, 0.25, 0.25, 0.225, 0.025], atol=0.004)
    assert (vectors.noise(1, rows[5:6], 101) == cells[5]).all() and (vectors.noise(1, rows, 40) == cells[:, :40]).all()
    assert not np.isclose(vectors.noise(2, rows, 101), cells).any(1).all() and not np.isclose(vectors.noise(1, rows - (1 << 33), 4), cells[:, :4]).all()
