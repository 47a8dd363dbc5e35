import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitloom.operators import bleu, metrics, selection


def tokens(text):
    text = text.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, ch in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(entity, ch)
    text = f" {text} "
    text = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", text)
    text = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", text)
    text = re.sub(r"([\.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def brute_bleu(pairs):
    correct, total, hyp_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for hyp, ref in pairs:
        h, r = tokens(hyp), tokens(ref)
        hyp_len, ref_len = hyp_len + len(h), ref_len + len(r)
        for n in range(4):
            a = Counter(tuple(h[i : i + n + 1]) for i in range(len(h) - n))
            b = Counter(tuple(r[i : i + n + 1]) for i in range(len(r) - n))
            correct[n] += sum((a & b).values())
            total[n] += sum(a.values())
    if not any(correct):
        return 0.0
    smooth, precisions = 1, []
    for c, t in zip(correct, total):
        if t == 0:
            return 0.0
        if c == 0:
            smooth *= 2
            precisions.append(100 / (smooth * t))
        else:
            precisions.append(100 * c / t)
    bp = 1 if hyp_len >= ref_len else math.exp(1 - ref_len / hyp_len)
    return bp * math.exp(sum(map(math.log, precisions)) / 4)


CASES = [
    [("the cat sat on the mat", "the cat sat on the mat")],
    [("a b c d", "e f g h")],
    [("", "some words here now")],
    [("one two", "one two")],
    [("one two three x y", "one two z w v u")],
    [("the the the the the", "the cat the dog runs")],
    [("Tom &amp; Jerry, 3.5-4 times.", "Tom & Jerry, 3.5 - 4 times .")],
    [("", ""), ("a b c d e", "a b c d e f g")],
]


@pytest.mark.parametrize("pairs", CASES)
def test_small_cases(spark, pairs):
    df = spark.createDataFrame(pairs, "hyp string, ref string")
    assert bleu.corpus_bleu(df).first().score == pytest.approx(brute_bleu(pairs))


def test_random_groups(spark):
    rng = random.Random(7)

    def text():
        return " ".join(rng.choice("a b c d e . , 1-2 3.4 &lt;".split()) for _ in range(rng.randrange(25)))

    rows = []
    for i in range(400):
        ref = text()
        rows.append((rng.choice("xyz"), ref[: rng.randrange(len(ref) + 1)] + text()[:9], ref))
    df = spark.createDataFrame(rows, "g string, hyp string, ref string").repartition(4)
    found = {r.g: r.score for r in bleu.corpus_bleu(df, ["g"]).collect()}
    assert found == {g: pytest.approx(brute_bleu([(h, r) for k, h, r in rows if k == g])) for g in "xyz"}


def test_empty_corpus(spark):
    row = bleu.corpus_bleu(spark.createDataFrame([], "hyp string, ref string")).first()
    assert (row.score, row.hyp_len, row.ref_len) == (0.0, 0, 0)


def test_align_hyp_ref(spark):
    hyp = spark.createDataFrame([(1, "a"), (2, "b")], "sent_id long, hyp string")
    ref = spark.createDataFrame([(2, "y"), (1, "x")], "sent_id long, ref string")
    assert {tuple(r) for r in bleu.align_hyp_ref(hyp, ref).collect()} == {(1, "a", "x"), (2, "b", "y")}
    with pytest.raises(Exception, match="no partner for 2"):
        bleu.align_hyp_ref(hyp, ref.filter("sent_id = 1")).collect()
    assert bleu.align_hyp_ref(hyp, ref.filter("sent_id = 1"), strict=False).count() == 1


def test_topk_and_samples(spark):
    rows = [(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.9), (2, 0, 0.1)]
    df = spark.createDataFrame(rows, "pair_id long, cand long, score double")
    assert {(r.pair_id, r.cand, r["rank"]) for r in selection.topk_candidates(df, 2).collect()} == {(1, 1, 1), (1, 2, 2), (2, 0, 1)}
    many = spark.range(5000).withColumnRenamed("id", "sent_id")
    sample = selection.sample_predictions(many, 0.1, seed=4)
    assert 400 < sample.count() < 600
    assert {r.sent_id for r in sample.collect()} == {r.sent_id for r in selection.sample_predictions(many.repartition(7), 0.1, seed=4).collect()}
    assert selection.first_prediction(many.repartition(3)).first().sent_id == 0


def test_running_best(spark):
    # validation scores of a recorded run
    scores = [11.19, 13.81, 15.13, 16.32, 16.45, 16.22, 16.40, 16.46, 16.29, 16.19]
    rows = [("run", i, v) for i, v in enumerate(scores, 1)] + [("low", 1, -3.0), ("low", 9000, 0.0), ("low", 9001, 0.0)]
    df = spark.createDataFrame(rows, "run_id string, epoch long, value double")
    found = metrics.running_best(df).collect()
    assert sorted(r.epoch for r in found if r.run_id == "run" and r.is_new_best) == [1, 2, 3, 4, 5, 8]
    low = {r.epoch: (r.best_so_far, r.is_new_best) for r in found if r.run_id == "low"}
    assert low == {1: (-1.0, False), 9000: (0.0, True), 9001: (0.0, False)}
    assert {r.run_id: r.epoch for r in metrics.best_epoch(df).collect()} == {"run": 8, "low": 9000}


def test_epoch_metrics_and_hooks(spark):
    log = spark.createDataFrame([("r", 1, 2.0), ("r", 1, 4.0), ("r", 2, 1.0)], "run_id string, epoch long, loss double")
    assert {tuple(r) for r in metrics.epoch_metrics(log).collect()} == {("r", 1, 3.0, 2), ("r", 2, 1.0, 1)}
    metrics.register_metric("rows", lambda df: df.agg(F.count("*").alias("value")))
    assert tuple(metrics.compute_metric("rows", log).first()) == (3, "rows")
    with pytest.raises(KeyError):
        metrics.compute_metric("absent", log)


def test_matches_do_not_depend_on_the_tokens_taken_at_once(monkeypatch):
    rng = random.Random(3)
    lists = [[[rng.choice("abcd") for _ in range(rng.choice([0, 1, 3, 9, 60]))] for _ in range(50)] for _ in range(2)]
    sides = [pa.array([None if k % 11 == 5 else row for k, row in enumerate(side)], pa.list_(pa.string())) for side in lists]
    whole, taken, run = bleu._matches(*sides), [], bleu._run_matches
    monkeypatch.setattr(bleu, "TOKENS_AT_ONCE", 40)
    monkeypatch.setattr(bleu, "_run_matches", lambda *run_sides: taken.append(sum(len(s.flatten()) for s in run_sides)) or run(*run_sides))
    assert bleu._matches(*sides) == whole and len(taken) > 10 and max(taken) <= 40 + 120
    assert len(bleu._matches(*[s[:0] for s in sides])) == 0
