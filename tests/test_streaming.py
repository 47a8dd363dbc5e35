import json

import pytest
from pyspark.sql import functions as F

from bitloom.functions import text as tx
from bitloom.operators import bpe, counting
from bitloom.sources import files
from bitloom.streaming import jobs

PAIRS = [(f"w{i % 7} w{i % 3} x", f"v{i % 5} y") for i in range(60)] + [("  ", "blank")]


@pytest.fixture()
def folder(tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    for part in range(3):
        lines = [json.dumps({"zh": s, "en": t}) for s, t in PAIRS[part::3]]
        (path / f"{part}.jsonl").write_text("\n".join([*lines, "broken {"]) + "\n")
    return str(path)


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def test_stream_encode_equals_batch(spark, folder, tmp_path):
    lines = files.corpus_lines(files.read_bitext_jsonl(spark, folder))
    tokens = lines.select(F.col("side").alias("lang"), tx.tokenize_ws("line").alias("tokens"))
    vocab = counting.build_vocab(counting.token_counts(tokens), 2)
    src, tgt = vocab.filter("lang = 'src'"), vocab.filter("lang = 'tgt'")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # a restart adds nothing
        run(jobs.stream_encode(jobs.stream_bitext(spark, folder), src, tgt, out, state))
    batch = jobs.encode_pairs(files.read_bitext_jsonl(spark, folder).drop("pair_id"), src, tgt)
    streamed = spark.read.parquet(out)
    assert sorted(map(repr, streamed.collect())) == sorted(map(repr, batch.collect()))
    assert streamed.count() == len(PAIRS)


def test_stream_counts_equal_batch(spark, folder, tmp_path):
    def tokens(pairs):
        return pairs.select(F.lit("zh").alias("lang"), tx.tokenize_ws("src").alias("tokens"))

    stream = jobs.stream_bitext(spark, folder)
    out = str(tmp_path / "counts")
    run(jobs.publish_counts(jobs.stream_token_counts(tokens(stream)), out, str(tmp_path / "s")))
    streamed = {(r.token, r.freq) for r in spark.read.parquet(f"{out}/batch=0").collect()}
    batch = counting.token_counts(tokens(files.read_bitext_jsonl(spark, folder)))
    assert streamed == {(r.token, r.freq) for r in batch.collect()}
    sized = jobs.publish_counts(
        jobs.stream_token_counts(tokens(stream)), str(tmp_path / "vocab"), str(tmp_path / "s2"),
        lambda counts: counting.build_vocab(counts, 1, 8),
    )
    run(sized)
    assert spark.read.parquet(str(tmp_path / "vocab/batch=0")).count() == 8


def test_stream_requests(spark, folder, tmp_path):
    model = bpe.bpe_model(spark, bpe.SPECIALS + sorted(bpe.byte_alphabet().values()), [])
    requests = jobs.stream_requests(jobs.stream_bitext(spark, folder), "go: ", model, 10)
    out = str(tmp_path / "requests")
    run(requests.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "s")))
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 60 and all(r.request.startswith("go: w") and len(r.ids) == 10 for r in rows)
