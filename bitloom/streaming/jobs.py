"""Structured Streaming forms of encoding, counting and request preparation."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from bitloom.functions.ids import add_boundaries
from bitloom.functions.text import add_prefix, tokenize_ws
from bitloom.operators.bpe import BpeModel, bpe_encode
from bitloom.operators.counting import EOS, SOS, token_counts
from bitloom.operators.encoding import numericalize
from bitloom.operators.lengths import drop_blank_sources, filter_by_length
from bitloom.sources.files import bitext_from_lines


def stream_bitext(spark: SparkSession, path: str, src: str = "zh", tgt: str = "en", **options) -> DataFrame:
    """Pairs from JSON-lines files as they arrive in a folder."""
    return bitext_from_lines(spark.readStream.text(path), src, tgt, **options)


def encode_pairs(
    pairs: DataFrame,
    src_vocab: DataFrame,
    tgt_vocab: DataFrame,
    max_len: int = 128,
    tokenizer: Callable[[Column], Column] = partial(tokenize_ws, once=True),
) -> DataFrame:
    """Tokenise, drop long pairs, number the tokens, add boundaries; batch or stream.

    Every step works on a row by itself, so a stream needs no state. The
    vocabularies must fit a broadcast (see `numericalize`).
    """
    tokens = pairs.withColumns(
        {"src_tokens": tokenizer(F.col("src")), "tgt_tokens": tokenizer(F.col("tgt"))}
    )
    kept = filter_by_length(tokens, max_len)
    numbered = numericalize(kept, src_vocab, "src_tokens", out="src_ids")
    numbered = numericalize(numbered, tgt_vocab, "tgt_tokens", out="tgt_ids")
    return numbered.withColumns(
        {"src_ids": add_boundaries("src_ids", SOS, EOS), "tgt_ids": add_boundaries("tgt_ids", SOS, EOS)}
    ).drop("src_tokens", "tgt_tokens")


def stream_encode(
    stream: DataFrame, src_vocab: DataFrame, tgt_vocab: DataFrame, sink: str, checkpoint: str, max_len: int = 128
) -> DataStreamWriter:
    """Writer of encoded pairs to Parquet, each input row exactly once."""
    return (
        encode_pairs(stream, src_vocab, tgt_vocab, max_len)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def stream_token_counts(stream: DataFrame, tokens: str = "tokens", lang: str = "lang") -> DataFrame:
    """Running token counts; start it in update or complete mode."""
    return token_counts(stream, tokens, lang)


def publish_counts(
    counts: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame], DataFrame] | None = None
) -> DataStreamWriter:
    """Writer that stores the complete counts (or ``then`` of them, such as a
    vocabulary) of each micro-batch in its own folder below ``path``."""

    def publish(table: DataFrame, batch: int) -> None:
        (then(table) if then else table).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return counts.writeStream.foreachBatch(publish).outputMode("complete").option("checkpointLocation", checkpoint)


def publish_changes(
    counts: DataFrame, path: str, checkpoint: str, value: str = "freq", compact_every: int = 16
) -> DataStreamWriter:
    """Writer that stores, for each micro-batch, only the keys whose counts it has changed; `read_published` reads them.

    Every column but ``value`` is a key. A batch's folder is overwritten when the
    batch is run again, so a restart changes nothing. After ``compact_every``
    batches the latest values are gathered in one folder, in a single pass over
    what has changed since the last one; what an earlier gathering has replaced
    is deleted then, a cycle later, for the sake of running readers.
    """

    def publish(table: DataFrame, batch: int) -> None:
        spark = table.sparkSession
        table.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")
        if (batch + 1) % compact_every == 0:
            whole = _latest(spark, path, value, batch)
            whole.write.mode("overwrite").parquet(f"{path}/whole/batch={batch}")
            for kind, number in _published(spark, path):
                if number < batch - compact_every or (kind == "changes" and number <= batch - compact_every):
                    _delete(spark, f"{path}/{kind}/batch={number}")

    return counts.writeStream.foreachBatch(publish).outputMode("update").option("checkpointLocation", checkpoint)


def read_published(spark: SparkSession, path: str, value: str = "freq") -> DataFrame:
    """The latest ``value`` of every key that `publish_changes` has stored."""
    return _latest(spark, path, value, None)


def _latest(spark: SparkSession, path: str, value: str, until: int | None) -> DataFrame:
    found = [(kind, n) for kind, n in _published(spark, path) if until is None or n <= until]
    start = max((n for kind, n in found if kind == "whole"), default=-1)
    used = [(kind, n) for kind, n in found if (n == start if kind == "whole" else n > start)]
    if not used:
        raise FileNotFoundError(f"nothing has been published below {path}")
    tables = [spark.read.parquet(f"{path}/{kind}/batch={n}").withColumn("_batch", F.lit(n)) for kind, n in sorted(used, key=lambda x: x[1])]
    rows = tables[0]
    for table in tables[1:]:
        rows = rows.unionByName(table)
    keys = [c for c in rows.columns if c not in (value, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(value, "_batch").alias(value))


def _file_system(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _published(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Kind and batch of every finished folder."""
    finished = []
    for kind in ("changes", "whole"):
        folder, system = _file_system(spark, f"{path}/{kind}/batch=*/_SUCCESS")
        for status in system.globStatus(folder) or []:
            finished.append((kind, int(status.getPath().getParent().getName().split("=")[1])))
    return finished


def _delete(spark: SparkSession, path: str) -> None:
    folder, system = _file_system(spark, path)
    system.delete(folder, True)


def publish_summaries(
    stream: DataFrame, path: str, checkpoint: str, summary: Callable[[DataFrame], DataFrame]
) -> DataStreamWriter:
    """Writer that stores one mergeable summary (`operators.sketches`) per micro-batch; the stream keeps no state.

    Read the folder below ``path`` and merge: a batch that is run again replaces its own summary.
    """

    def publish(table: DataFrame, batch: int) -> None:
        summary(table).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)


def stream_requests(stream: DataFrame, prefix: str, model: BpeModel, max_len: int = 128) -> DataFrame:
    """Prepared requests: blank sources dropped, prefix added, encoded and cut. Batch or stream."""
    asked = drop_blank_sources(stream)
    stripped = F.regexp_replace("src", r"(?U)^\s+|\s+$", "")
    return bpe_encode(asked.withColumn("request", add_prefix(stripped, prefix)), model, "request", max_len)
