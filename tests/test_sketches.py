"""Mergeable summaries against exact results, in batches and on streams; published changes."""

import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bitloom.functions import text as tx
from bitloom.operators import counting, lengths, sketches
from bitloom.sources import files
from bitloom.streaming import jobs


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    made = [(f"s{i % 3}", int(rng.lognormvariate(3, 1)) if i % 50 else None) for i in range(30_000)]
    return spark.createDataFrame(made, "split string, len long").repartition(5).cache()


def test_merged_length_summaries_are_within_the_rank_error(spark, rows):
    parts = sketches.length_summary(rows, "len", ["split"])
    whole = sketches.merge_length_summaries(parts).collect()
    assert len(whole) == 1 and len(whole[0].sketch) < 10_000
    for frame, own, by in ((parts, rows, ["split"]), (sketches.merge_length_summaries(parts), rows, [])):
        report = sketches.length_report(frame, by).collect()
        exact = {tuple(r[c] for c in by): r for r in lengths.length_stats(own, "len", by).collect()}
        for r in report:
            e = exact[tuple(r[c] for c in by)]
            assert (r.n, r.min, r.max) == (e.n, e.min, e.max) and r["mean"] == pytest.approx(e["mean"])
            values = sorted(x.len for x in own.filter("len is not null").collect() if not by or x.split == r.split)
            for name, q in {"median": 0.5, **lengths.PERCENTILES}.items():
                below, upto = sum(v < r[name] for v in values), sum(v <= r[name] for v in values)
                assert below / len(values) - 0.015 <= q <= upto / len(values) + 0.015
    assert sketches.length_summary(rows.limit(0), "len").count() == 0
    both = sketches.suggest_max_len(parts, 0.99).first()
    assert both.global_max == max(r.max for r in parts.collect()) and both.suggested <= both.global_max


def token_rows(spark):
    rng = random.Random(4)
    texts = [[f"t{min(int(rng.paretovariate(0.7)), 40_000)}" for _ in range(12)] for _ in range(4000)]
    return texts, spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "half int, tokens array<string>").repartition(4)


def test_merged_token_summaries_are_within_the_bound(spark):
    texts, frame = token_rows(spark)
    parts = sketches.token_summary(frame, by=["half"], counters=512)
    whole = sketches.merge_token_summaries(parts, counters=512)
    counts = Counter(t for text in texts for t in text)
    n = sum(counts.values())
    top = sketches.frequent_tokens(whole, 20).orderBy("rank").collect()
    assert all(abs(r.freq - counts[r.token]) <= 3.5 * n / 512 for r in top)
    assert {t for t, c in counts.items() if c > 3.5 * n / 512 + min(r.freq for r in top)} <= {r.token for r in top}
    assert [r["rank"] for r in top] == list(range(1, 21))
    types = sketches.distinct_tokens(whole).first()
    assert types.n == n and types.types == pytest.approx(len(counts), rel=0.06)


def folder_of(tmp_path, pairs, parts):
    path = tmp_path / "in"
    path.mkdir()
    for part in range(parts):
        lines = [json.dumps({"zh": s, "en": t}) for s, t in pairs[part::parts]]
        (path / f"{part}.jsonl").write_text("\n".join(lines) + "\n")
    return str(path)


def tokens(pairs):
    return pairs.select(F.lit("zh").alias("lang"), tx.tokenize_ws("src").alias("tokens"))


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_published_changes_equal_batch(spark, tmp_path):
    pairs = [(f"w{i % 7} only{i // 20}", "y") for i in range(100)]
    folder, out, state = folder_of(tmp_path, pairs[:60], 3), str(tmp_path / "out"), str(tmp_path / "state")
    one = lambda: spark.readStream.option("maxFilesPerTrigger", 1).text(folder)
    stream = lambda: jobs.stream_token_counts(tokens(files.bitext_from_lines(one())))
    run(jobs.publish_changes(stream(), out, state, compact_every=2))
    more = "\n".join(json.dumps({"zh": s, "en": t}) for s, t in pairs[60:])
    (Path(folder) / "more.jsonl").write_text(more)
    for _ in range(2):  # a restart goes on, and then adds nothing
        run(jobs.publish_changes(stream(), out, state, compact_every=2))
    batch = counting.token_counts(tokens(files.read_bitext_jsonl(spark, folder)))
    assert {tuple(r) for r in jobs.read_published(spark, out).collect()} == {tuple(r) for r in batch.collect()}
    last = spark.read.parquet(f"{out}/changes/batch=3")
    changed = {w for s, _ in pairs[60:] for w in s.split()}
    assert {r.token for r in last.collect()} == changed and len(changed) < batch.count()
    kept = {p.name for p in (tmp_path / "out/changes").iterdir()}
    assert "batch=0" not in kept and (tmp_path / "out/whole/batch=3/_SUCCESS").exists()
    with pytest.raises(FileNotFoundError):
        jobs.read_published(spark, str(tmp_path / "absent"))


def test_stream_summaries_equal_batch(spark, tmp_path):
    pairs = [(" ".join(f"w{i * k % 97}" for k in range(i % 9)), "y") for i in range(200)]
    folder, out, state = folder_of(tmp_path, pairs, 4), str(tmp_path / "out"), str(tmp_path / "state")
    rows = spark.readStream.option("maxFilesPerTrigger", 1).text(folder)
    run(jobs.publish_summaries(tokens(files.bitext_from_lines(rows)), out, state, lambda t: sketches.token_summary(t, by=["lang"], counters=256)))
    stored = spark.read.parquet(out)
    assert stored.count() == 4
    merged = sketches.merge_token_summaries(stored, ["lang"], counters=256)
    counts = Counter(w for s, _ in pairs for w in s.split())
    found = {r.token: r.freq for r in sketches.frequent_tokens(merged, 200, ["lang"]).collect()}
    assert found == dict(counts)
