"""Toxicity of whole texts, scored on what their disguised words mean."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.deobfuscate import Restorer, train_letters

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7)  # letters of a word's beginning that count as features too


def features(restored: str) -> set[str]:
    """The words of a restored text and their beginnings, marked by a hyphen."""
    words = set(WORD.findall(restored))
    found = set(words)
    for n in STEMS:
        found.update([w[:n] + "-" for w in words if len(w) > n])
    return found


class ToxicityModel:
    """A character model, weights of features, and a bias."""

    def __init__(self, letters: np.ndarray, weights: dict[str, float], bias: float):
        self.letters, self.weights, self.bias = letters, weights, bias
        self.stems = {n: {f[:-1]: w for f, w in weights.items() if f[-1] == "-" and len(f) == n + 1} for n in STEMS}

    def logit(self, restored: str) -> float:
        words = set(WORD.findall(restored))
        total = self.bias + sum(self.weights[w] for w in sorted(words & self.weights.keys()))
        for n, known in self.stems.items():
            total += sum(known[s] for s in sorted({w[:n] for w in words if len(w) > n} & known.keys()))
        return total


def _feature_rows(shared) -> callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for batch in batches:
            ids, found = [], []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                here = sorted(features(restore(text or "")))
                ids += [key] * len(here)
                found += here
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["id", "feature"])

    return rows


def _place_rows(letters, places) -> callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, known = Restorer(letters.value), places.value
        for batch in batches:
            here = [sorted(known[f] for f in features(restore(text or "")) & known.keys()) for text in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(here, pa.list_(pa.int32()))], ["id", "places"])

    return rows


def _informative(counts: DataFrame, toxic: int, clean: int, most: int) -> list[str]:
    """Features with the largest log-likelihood ratio that are commoner in toxic texts; only ``most`` names leave Spark."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    part = lambda x, n, p: x * F.log(F.greatest(p, F.lit(1e-12))) + (n - x) * F.log(F.greatest(1 - p, F.lit(1e-12)))
    of_toxic, of_clean, of_all = a / toxic, b / clean, (a + b) / (toxic + clean)
    ratio = part(a, toxic, of_toxic) + part(b, clean, of_clean) - part(a, toxic, of_all) - part(b, clean, of_all)
    table = counts.filter(of_toxic > of_clean).select("feature", ratio.alias("ratio")).filter("ratio > 6")
    best = table.orderBy(F.desc("ratio"), "feature").limit(most)
    return [r["feature"] for r in best.collect()]


def _logistic(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, n: int, decay: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features, by accelerated gradient steps."""
    size = np.array([len(r) for r in rows])
    item = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    w, bias = np.zeros(n), float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    step_w, step_b, total = np.zeros(n), 0.0, weight.sum()
    rate = 4.0
    for _ in range(steps):
        z = np.bincount(row, weights=w[item], minlength=len(rows)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total
        grad = np.bincount(item, weights=error[row], minlength=n) + decay / total * w * n**0.5
        step_w, step_b = 0.9 * step_w - rate * grad, 0.9 * step_b - rate * error.sum()
        w, bias = w + step_w, bias + step_b
    return w, bias


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = 8_000,
    most_features: int = 4_000,
) -> ToxicityModel:
    """Character model from all texts, classifier from labelled rows where ``usable`` holds.

    The classifier is fitted on at most ``sample`` labelled documents of each
    class, the first by hash of the id (a documented bound); classes are
    weighted back to their shares among all usable labels. Null labels and null
    ids are ignored; an id labelled twice counts as toxic if one label says so.
    Without both classes the score is the share of toxic labels.
    """
    spark = docs.sparkSession
    letters = train_letters(docs, text_col)
    marked = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable)
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("y"))
    )
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        share = min(max(toxic / max(toxic + clean, 1), 1e-3), 1 - 1e-3)
        return ToxicityModel(letters, {}, float(np.log(share / (1 - share))))
    order = F.xxhash64(F.lit("toxicity sample"), "id")
    chosen = marked.filter("y = 1").orderBy(order, "id").limit(sample).unionByName(
        marked.filter("y = 0").orderBy(order, "id").limit(sample)
    ).toPandas()  # 2 x sample rows of two numbers
    picked = spark.createDataFrame(chosen[["id", "y"]])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked.select("id")), "id")
    shared = spark.sparkContext.broadcast(letters)
    found = texts.mapInArrow(_feature_rows(shared), "id long, feature string")
    by_class = found.join(F.broadcast(picked), "id").groupBy("feature").agg(
        F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("clean")
    )
    n_toxic, n_clean = int((chosen["y"] == 1).sum()), int((chosen["y"] == 0).sum())
    names = _informative(by_class.filter("toxic >= 3 and toxic > clean"), n_toxic, n_clean, most_features)
    if not names:
        return ToxicityModel(letters, {}, float(np.log(toxic / clean)))
    # a row per sampled document, with at most ``most_features`` numbers; a repeated row names them again
    place = spark.sparkContext.broadcast({name: i for i, name in enumerate(names)})
    marks = texts.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(_place_rows(shared, place), "id long, places array<int>")
    held = marks.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"))
    collected = held.toArrow()
    places = dict(zip(collected.column("id").to_pylist(), collected.column("places"), strict=True))
    none = np.zeros(0, np.int64)
    rows = [places[key].values.to_numpy().astype(np.int64) if key in places else none for key in chosen["id"].tolist()]
    y = chosen["y"].to_numpy(np.float64)
    weight = np.where(y == 1, toxic / n_toxic, clean / n_clean)
    w, bias = _logistic(rows, y, weight, len(names))
    return ToxicityModel(letters, dict(zip(names, w.tolist(), strict=True)), bias)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``: the probability (0 to 1) that a whole text is toxic; null texts count as empty.

    The model (60³ numbers and at most some thousand weights) is broadcast, as
    plain arrays and names: executors may lack the classes.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.letters, model.weights, model.bias))
    made: list[tuple[ToxicityModel, Restorer]] = []

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        if not made:
            made.append((ToxicityModel(*shared.value), Restorer(shared.value[0])))
        known, restore = made[0]
        # as_py one by one: a batch holds megabytes of text
        z = np.array([known.logit(restore(text.as_py() or "")) for text in texts])
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())

    return docs.withColumn(out, scores(F.col(text_col)))
