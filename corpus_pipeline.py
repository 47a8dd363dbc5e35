"""From raw documents to token ids: five stages, each on all that the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import bitloom
from bitloom.llm import byte_bpe, mixing, simhash, substring_dedup, toxicity
from bitloom.llm.queries import WEIGHTS, remainder
from bitloom.plans.storage import materialize

cloudpickle.register_pickle_by_value(bitloom)  # the package need not be installed where tasks run

TOXIC = 0.3  # score from which a document is rejected


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below the threshold; learns from the labels that `op4` learns from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, F.coalesce(remainder(4) != 2, F.lit(False)))
    return toxicity.score(docs, model, out="_score").filter(F.col("_score") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of `op5`: sequences of three words, fingerprints within two bits."""
    return simhash.keep_one(docs, shingle=3, budget=2)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that an earlier document has, cut at whole characters.

    A document keeps its row even if nothing of its text is left.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = substring_dedup.remove_repeats(docs, 50, carry=others, characters=True)
    text = found.withColumn("text", F.col("kept").cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    return text.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, as often as it takes them."""
    plan = mixing.mix(docs, WEIGHTS, share=1.5, most=2.0)
    return mixing.drawn_documents(docs, plan).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids beside the document's names, and whether they decode to the text."""
    bpe = byte_bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = docs.withColumn("_both", bpe.round_trip("text"))
    rows = rows.withColumns({"ids": F.col("_both.ids"), "_decoded": F.col("_both.decoded")})
    whole = F.col("_decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return rows.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_tokens"), whole.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_dedup", drop_passages),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

ORACLE_SQL = None  # classifier, hashes and tokenizer have no SQL form; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
