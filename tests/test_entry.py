import re
import unicodedata
from pathlib import Path

import duckdb
import pytest
import tokenizers

import __spark_entry__ as entry
from bitloom.operators.bpe import SPECIALS
from registered.queries import BPE_SIZE, HAN, LATIN, documents
from tools.check_queries import TABLES, fingerprint

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
CHECKED = [
    "tokenize_ws", "token_counts", "build_vocab", "coverage_size", "coverage_curve", "length_histogram", "numericalize",
    "pad_batch", "make_batches_shuffled", "corpus_bleu", "tokenize_ptb", "detokenize", "word_evaluation", "bpe_decode", "align_vectors",
    "abbreviation_scores", "vocab_file", "stream_count_changes", "register_metric_by", "read_rejects", "running_best",
]


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    names = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline", n)}
    assert names - set(entry.oracle_sql()) == {
        "save_bpe", "segment_zh", "segment_zh_unseen", "tokenize_ptb_trained", "bpe_encode", "bpe_encode_truncated", "train_bpe",
        "stream_requests", "export_bpe", "length_sketches", "frequent_tokens", "bpe_length_stats", "bpe_suggest_max_len",
    }


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    frame = entry.queries()[name](spark, SMALL)
    result = db.sql(entry.oracle_sql()[name])
    mine = fingerprint(frame.columns, [tuple(r) for r in frame.collect()])
    assert mine[:3] == fingerprint(result.columns, result.fetchall())[:3]


def test_registered_bpe_equals_library(spark, tmp_path):
    merges = entry.queries()["train_bpe"](spark, SMALL).orderBy("rank").collect()
    lines = [r.line for r in entry.queries()["corpus_lines"](spark, SMALL).collect()]
    corpus = tmp_path / "corpus.txt"
    corpus.write_text("".join(line + "\n" for line in lines), encoding="utf-8", newline="")
    library = tokenizers.ByteLevelBPETokenizer()
    library.train(
        files=[str(corpus)], vocab_size=BPE_SIZE, min_frequency=2, show_progress=False, special_tokens=SPECIALS
    )
    library.save_model(str(tmp_path))
    expected = (tmp_path / "merges.txt").read_text(encoding="utf-8").split("\n")[1:]
    assert [f"{r.left} {r.right}" for r in merges] == [m for m in expected if m]
    plain = tokenizers.ByteLevelBPETokenizer(str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt"))
    texts = {r.doc_id: r.text for r in documents(spark, SMALL).collect()}
    for row in entry.queries()["bpe_encode"](spark, SMALL).collect():
        assert row.ids == ",".join(map(str, [0, *plain.encode(texts[row.doc_id]).ids, 2]))


@pytest.mark.parametrize("name", ["segment_zh", "segment_zh_unseen"])
def test_registered_segmentation_keeps_every_character(spark, name):
    def written(text):
        solid = "".join(text.lower().translate(str.maketrans(LATIN, HAN)).split())
        return "".join(c for c in unicodedata.normalize("NFKC", solid) if c.isprintable() and not c.isspace())

    rows = entry.queries()[name](spark, SMALL).collect()
    expected = {r.doc_id: written(r.text) for r in documents(spark, SMALL).collect()}
    assert {r.doc_id: r.tokens.replace(" ", "") for r in rows} == expected


def test_bpe_lengths_are_those_of_the_ids(spark):
    ids = entry.queries()["bpe_encode_truncated"](spark, SMALL).collect()
    stats = {r.side: r for r in entry.queries()["bpe_length_stats"](spark, SMALL).collect()}
    best = entry.queries()["bpe_suggest_max_len"](spark, SMALL).first()
    lengths = [min(128, r.ids.count(",") + 1) for r in ids]
    assert stats["src"].n == len(ids) and min(128, stats["src"].max) == max(lengths) and stats["src"].min == min(lengths)
    assert best.global_max == max(r.max for r in stats.values()) >= best.suggested


def test_summaries_equal_exact_results(spark):
    """The documents of a small folder are few enough for exact summaries of frequent tokens."""
    exact = {(r.lang, r.token): r.freq for r in entry.queries()["token_counts"](spark, SMALL).collect()}
    found = entry.queries()["frequent_tokens"](spark, SMALL).collect()
    assert found and all(abs(r.freq - exact[r.lang, r.token]) <= 0.01 * exact[r.lang, r.token] for r in found)
    stats = {r.lang: r for r in entry.queries()["length_stats"](spark, SMALL).collect()}
    sketched = {r.lang: r for r in entry.queries()["length_sketches"](spark, SMALL).collect()}
    assert sketched["all"].n == sum(r.n for r in stats.values()) and sketched.keys() == {*stats, "all"}
    assert all((sketched[k].n, sketched[k].min, sketched[k].max) == (r.n, r.min, r.max) for k, r in stats.items())


@pytest.mark.parametrize("name", ["tokenize_ws", "token_counts", "numericalize", "make_batches", "pad_batch", "corpus_bleu"])
def test_tables_are_not_dealt_anew(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().toString()
    assert "RoundRobinPartitioning" not in plan


def test_rules_of_the_house():
    """No local checkpoints, and no cross joins."""
    for path in (ROOT / "bitloom").rglob("*.py"):
        assert not re.search(r"localCheckpoint|crossJoin", path.read_text(encoding="utf-8")), path
