import json

import pytest

from bitloom.operators import counting, metrics
from bitloom.operators import batching
from bitloom.sources import files

LINES = [
    '{"zh": "甲", "en": "a"}',
    "",
    '{"zh": "乙", "en": "b"',
    '{"zh": 1, "en": "c"}',
    '{"zh": null, "en": "d"}',
    "[1]",
    '[{"zh": "x", "en": "y"}, {"zh": "x", "en": "y"}]',
    '{"en": "e"}',
    '{"zh": "丙", "en": "f", "more": 1}',
    "   ",
    '  {"zh": "丁", "en": "g"}  ',
    '{"zh": "戊", "en": "h"} tail',
    "{'zh': 'q', 'en': 'q'}",
    '{"zh": "a", "en": "b"},{"zh": "c", "en": "d"}',
]


@pytest.fixture()
def bitext(tmp_path):
    path = tmp_path / "pairs.jsonl"
    path.write_text("\n".join(LINES) + "\n", encoding="utf-8")
    return str(path)


def test_read_bitext(spark, bitext):
    rows = files.read_bitext_jsonl(spark, bitext).orderBy("pair_id").collect()
    assert [(r.src, r.tgt) for r in rows] == [("甲", "a"), ("1", "c"), ("丙", "f"), ("丁", "g")]
    loose = files.read_bitext_jsonl(spark, bitext, require_both=False).collect()
    assert [r.tgt for r in loose] == ["a", "c", "d", "e", "f", "g"]
    filled = [line for line in LINES if line.strip()]
    assert files.read_rejects(spark, bitext).count() == len(filled) - 4
    assert files.read_rejects(spark, bitext, require_both=False).count() == len(filled) - 6
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_bitext_jsonl(spark, bitext + ".absent")


def test_splits_lines_and_sinks(spark, bitext, tmp_path):
    both = files.read_splits(spark, {"train": bitext, "test": bitext})
    assert {(r.split, r["count"]) for r in both.groupBy("split").count().collect()} == {("train", 4), ("test", 4)}
    lines = files.corpus_lines(files.read_bitext_jsonl(spark, bitext))
    assert sorted(r.line for r in lines.collect()) == sorted(["甲", "a", "1", "c", "丙", "f", "丁", "g"])
    files.write_lines(lines, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 8
    files.write_encoded(both, str(tmp_path / "encoded"))
    assert spark.read.parquet(str(tmp_path / "encoded")).filter("split = 'test'").count() == 4
    files.write_bitext_jsonl(both, str(tmp_path / "again"))
    assert files.read_bitext_jsonl(spark, str(tmp_path / "again")).count() == 8


def test_vocab_files(spark, tmp_path):
    counts = spark.createDataFrame([("en", "b", 3), ("en", "é", 5), ("fr", "c", 4)], "lang string, token string, freq long")
    vocab = counting.build_vocab(counts)
    files.save_vocab(vocab, str(tmp_path / "v"))
    assert sorted(map(tuple, files.load_vocab(spark, str(tmp_path / "v")).collect())) == sorted(map(tuple, vocab.collect()))
    files.export_vocab_json(vocab.filter("lang = 'en'"), "English", str(tmp_path / "j"))
    document = json.loads(next((tmp_path / "j").glob("part-*")).read_text(encoding="utf-8"))
    assert document == {"name": "English", "word2idx": {"<pad>": 0, "<sos>": 1, "<eos>": 2, "<unk>": 3, "é": 4, "b": 5}}
    assert list(document["word2idx"]) == ["<pad>", "<sos>", "<eos>", "<unk>", "é", "b"]
    rows = files.import_vocab_json(spark, str(tmp_path / "j")).collect()
    assert {(r.lang, r.token, r.id) for r in rows} == {("English", t, i) for t, i in document["word2idx"].items()}


def test_plain_files(spark, tmp_path):
    tokens = ["b", 'quo"te', "é\\", "line\nend", "\u2028", " ", "a,b"] + [f"t{i}" for i in range(3000)]
    counts = spark.createDataFrame([("en", t, 9000 - i) for i, t in enumerate(tokens)], "lang string, token string, freq long").repartition(5)
    vocab = counting.build_vocab(counts)
    path = tmp_path / "vocab.json"
    files.export_vocab_file(vocab, "English", str(path))
    document = json.loads(path.read_text(encoding="utf-8"))
    assert path.is_file() and document["name"] == "English" and list(document["word2idx"])[4:] == tokens
    assert document["word2idx"] == {r.token: r.id for r in vocab.collect()}
    assert {(r.token, r.id) for r in files.import_vocab_json(spark, str(path)).collect()} == set(document["word2idx"].items())
    with pytest.raises(FileExistsError):
        files.export_vocab_file(vocab, "English", str(path))
    files.export_vocab_file(vocab.limit(0), "none", str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == {"name": "none", "word2idx": {}}
    assert sorted(p.name for p in tmp_path.iterdir() if p.suffix != ".crc") == ["none.json", "vocab.json"]


def test_word_vectors(spark, tmp_path):
    path = tmp_path / "words.vec"
    path.write_bytes(b"3 2\nthe 0.5 -1\nshort 1\nlong 1 2 3\nba\xffd 1 2\nlast 3 4  \n")
    rows = files.read_word_vectors(spark, str(path), 2).orderBy("line_no").collect()
    assert [(r.token, r.vector) for r in rows] == [("the", [0.5, -1.0]), ("bad", [1.0, 2.0]), ("last", [3.0, 4.0])]


def test_metrics_files(spark, tmp_path):
    table = spark.createDataFrame([("r", 1, 2.5)], "run_id string, epoch long, value double")
    files.write_metrics(table, str(tmp_path / "m"))
    files.write_metrics(table, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    log = tmp_path / "run.log"
    log.write_text("starting\n{'loss': 3.5, 'epoch': 0.1}\nnoise {x}\n{'eval_bleu': 11.2, 'epoch': 1.0}\n")
    records = [r.record for r in metrics.read_metric_log(spark, str(log)).collect()]
    assert records == [{"loss": 3.5, "epoch": 0.1}, {"eval_bleu": 11.2, "epoch": 1.0}]


@pytest.mark.parametrize("sent", [files.SENT_BLOCKS, 1])
def test_line_ids_do_not_depend_on_splits(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(files, "SENT_BLOCKS", sent)
    folder, lines = tmp_path / "in", {}
    folder.mkdir()
    for k, name in enumerate(["b.txt", "a.txt", "c.txt", "empty.txt"]):
        lines[name] = [] if k == 3 else [f"{name} {i} {'é' * (i % 50)}" if i % 7 else "" for i in range(400 - 100 * k)]
        (folder / name).write_text("\n".join(lines[name]) + "\n" * bool(lines[name] and k), encoding="utf-8")
    expected = {((k << files.LINE_BITS) + i, line) for k, name in enumerate(["a.txt", "b.txt", "c.txt"]) for i, line in enumerate(lines[name])}
    # a last line that is empty and has no line end is no line
    expected = {x for x in expected if x[1] or x[0] != (1 << files.LINE_BITS) + 399}
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for bytes_ in ("512", "3000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
            rows = files.numbered_lines(spark, str(folder))
            assert rows.rdd.getNumPartitions() >= (1 if bytes_ == "128m" else 10)
            assert {tuple(r) for r in rows.collect()} == expected
            assert {r.line_id for r in rows.filter("value like 'c.txt%'").collect()} == {k for k, v in expected if v.startswith("c.txt")}
        old = files.numbered_lines(spark, str(folder))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
        with pytest.raises(Exception, match="have changed since"):
            old.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    both = files.numbered_lines(spark, str(folder / "c.txt"), str(folder / "a.txt"), path_number="p").collect()
    assert [r.value for r in sorted(both)] == lines["c.txt"] + lines["a.txt"] and {r.p for r in both} == {0, 1}


def test_batches_straight_from_the_reader(spark, tmp_path):
    path = str(tmp_path / "in")
    files.write_bitext_jsonl(spark.range(900).selectExpr("'s' || id AS src", "'t' AS tgt").repartition(5), path)
    batches = batching.make_batches(files.read_bitext_jsonl(spark, path), 16)
    assert batches.select("src").distinct().count() == batches.count() == 900


def test_split_ids_are_unique_and_stay(spark, tmp_path):
    paths = {}
    for name in ("train", "test"):
        paths[name] = str(tmp_path / name)
        files.write_bitext_jsonl(spark.range(500).selectExpr(f"'{name}' || id AS src", "'x' AS tgt").repartition(4), paths[name])
    pairs = files.read_splits(spark, paths)
    before = {(r.src, r.pair_id) for r in pairs.collect()}
    assert len({key for _, key in before}) == 1000
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        assert {(r.src, r.pair_id) for r in pairs.collect()} == before
        assert batching.make_batches(pairs, 16).count() == 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    with pytest.raises(ValueError, match="not unique"):
        batching.make_batches(pairs.unionByName(pairs), 16)


def test_vectors_with_a_broken_number_are_skipped(spark, tmp_path):
    (tmp_path / "v.vec").write_text("2 2\na 1 2\nb 1 x\nc 3 4\n", encoding="utf-8")
    assert {r.token for r in files.read_word_vectors(spark, str(tmp_path / "v.vec"), 2).collect()} == {"a", "c"}
