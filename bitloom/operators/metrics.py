"""Run metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.functions.ids import unmask_labels
from bitloom.operators.bleu import corpus_bleu
from bitloom.operators.bpe import BpeModel, bpe_decode

CHUNK = 4096
HELD_GROUPS = 10_000


def epoch_metrics(batch_log: DataFrame, loss: str = "loss") -> DataFrame:
    """Mean of the batch losses per run and epoch (each batch weighs the same)."""
    return batch_log.groupBy("run_id", "epoch").agg(
        F.avg(loss).alias("mean_loss"), F.count("*").alias("n_batches")
    )


def running_best(metrics: DataFrame, value: str = "value", order: str = "epoch") -> DataFrame:
    """Best value so far per run, and whether a row is a new best (strictly above, from -1).

    Runs are cut into chunks of consecutive order values: each chunk takes the
    best of the earlier ones from a small table, so a long run is spread out.
    """
    rows = metrics.select("run_id", F.col(order).alias("_at"), F.col(value).alias("value")).withColumn(
        "_chunk", F.floor(F.col("_at") / CHUNK)
    )
    earlier = (
        Window.partitionBy("run_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        rows.groupBy("run_id", "_chunk")
        .agg(F.max("value").alias("_top"))
        .select("run_id", "_chunk", F.max("_top").over(earlier).alias("_carried"))
    )
    inside = (
        Window.partitionBy("run_id", "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.greatest(F.max("value").over(inside), F.col("_carried")), F.lit(-1.0))
    return (
        rows.join(carried, ["run_id", "_chunk"])
        .withColumn("_before", before)
        .select(
            "run_id",
            F.col("_at").alias(order),
            "value",
            F.greatest("_before", "value").alias("best_so_far"),
            (F.col("value") > F.col("_before")).alias("is_new_best"),
        )
    )


def best_epoch(metrics: DataFrame, value: str = "value", order: str = "epoch") -> DataFrame:
    """The epoch a run is tested with: the first one that holds the best value.

    As in `running_best`, only values above -1 count.
    """
    best = F.struct(F.col(value).alias("value"), (-F.col(order)).alias("at"))
    return (
        metrics.filter(F.col(value) > -1)
        .groupBy("run_id")
        .agg(F.max(best).alias("_best"))
        .select("run_id", (-F.col("_best.at")).alias(order), F.col("_best.value").alias("value"))
    )


@dataclass(frozen=True)
class MergeableMetric:
    """A user's metric in parts, so that rows are summed up where they lie.

    ``part`` turns some rows (a pandas frame, without the group's columns) into a
    state, ``merge`` two states into one, ``finish`` a state into results; states
    and results are dictionaries with the columns of ``state`` and ``result``.
    ``merge`` must not depend on the order of its arguments.
    """

    part: Callable[[pd.DataFrame], dict]
    merge: Callable[[dict, dict], dict]
    finish: Callable[[dict], dict]
    state: str
    result: str

    def __call__(self, predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        by, part, merge, finish = list(by), self.part, self.merge, self.finish
        keys = "".join(f"{predictions.schema[c].name} {predictions.schema[c].dataType.simpleString()}, " for c in by)

        def rows_of(states: dict[tuple, dict]) -> pd.DataFrame:
            return pd.DataFrame([{**dict(zip(by, key)), **state} for key, state in states.items()])

        def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            states: dict[tuple, dict] = {}
            for frame in frames:
                groups = frame.groupby(by, dropna=False, sort=False) if by else [((), frame)]
                for key, rows in groups:
                    key = tuple(None if pd.isna(k) else k for k in key)
                    state = part(rows.drop(columns=by))
                    states[key] = merge(states[key], state) if key in states else state
                if len(states) > HELD_GROUPS:
                    yield rows_of(states)
                    states = {}
            if states:
                yield rows_of(states)

        def whole(states: pd.DataFrame) -> pd.DataFrame:
            merged = reduce(merge, states.drop(columns=by).to_dict("records"))
            first = {c: states[c].iloc[0] for c in by}
            return pd.DataFrame([{**first, **finish(merged)}])

        states = predictions.mapInPandas(parts, keys + self.state)
        return states.groupBy(*by).applyInPandas(whole, keys + self.result)


_METRICS: dict[str, Callable[..., DataFrame]] = {}


def register_metric(name: str, fn: Callable[..., DataFrame]) -> None:
    """Register a metric: a function from a prediction table to a one-row table, or a `MergeableMetric`.

    A function that takes a second argument, the names of grouping columns, and
    returns a row for each group serves `compute_metric` with ``by`` too.
    """
    _METRICS[name] = fn


def compute_metric(name: str, predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Apply a registered metric, to each value of ``by`` if given, and add its name as a column."""
    if name not in _METRICS:
        raise KeyError(f"no metric named {name}")
    scored = _METRICS[name](predictions, by) if by else _METRICS[name](predictions)
    return scored.withColumn("metric", F.lit(name))


def bleu_metric(model: BpeModel, pad: int = 1, ignore: int = -100) -> Callable[..., DataFrame]:
    """Metric on id sequences: put padding back, decode, strip, score.

    The prediction table holds ``sent_id, preds, labels``.
    """

    def score(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        text = predictions.select(
            "sent_id", *by, unmask_labels("preds", pad, ignore).alias("p"), unmask_labels("labels", pad, ignore).alias("l")
        )
        text = bpe_decode(bpe_decode(text, model, "p", out="hyp"), model, "l", out="ref")
        strip = r"(?U)^\s+|\s+$"
        return corpus_bleu(
            text.select(
                "sent_id",
                *by,
                F.regexp_replace("hyp", strip, "").alias("hyp"),
                F.regexp_replace("ref", strip, "").alias("ref"),
            ),
            by,
        )

    return score


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """Metric records of a trainer log: the lines that hold one record, single or double quotes."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter(
        F.col("line").startswith("{") & F.col("line").endswith("}")
    )
    fields = F.from_json("line", "map<string,double>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    return lines.select(fields.alias("record")).filter(F.col("record").isNotNull())
