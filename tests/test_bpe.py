import json
import random

import pytest
import tokenizers

from bitloom.operators import bpe
from bitloom.sources import files

FIXTURE = ["low low lower", "newest newest widest"] * 5
WORDS = "the of and to in is that for it was on are as with his they at be this café naïve 中文 句子 it's don't 123 4567 😀 a".split()


def corpus(seed, rows=120):
    rng = random.Random(seed)
    ends = ["", "\n", "  ", " \n x", "!", "...", "\t"]
    return [" ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", ",", "  "]) for _ in range(rng.randrange(1, 15))) + rng.choice(ends) for _ in range(rows)]


def reference(lines, size, folder):
    path = folder / "corpus.txt"
    path.write_text("".join(line + "\n" for line in lines), encoding="utf-8", newline="")
    tok = tokenizers.ByteLevelBPETokenizer()
    tok.train(files=[str(path)], vocab_size=size, min_frequency=2, special_tokens=bpe.SPECIALS, show_progress=False)
    tok.save_model(str(folder))
    vocab = json.loads((folder / "vocab.json").read_text(encoding="utf-8"))
    merges = [tuple(m.split(" ")) for m in (folder / "merges.txt").read_text(encoding="utf-8").split("\n")[1:] if m]
    return tok, sorted(vocab, key=vocab.get), merges


def lines_frame(spark, lines):
    return spark.createDataFrame([(line,) for line in lines], "line string").repartition(3)


def contents(model):
    pieces = [r.piece for r in model.vocab.orderBy("id").collect()]
    return pieces, [(r.left, r.right) for r in model.merges.orderBy("rank").collect()]


def test_fixture(spark):
    pieces, merges = contents(bpe.train_bpe(lines_frame(spark, FIXTURE), 300))
    assert len(pieces) == 275
    assert merges[:4] == [("e", "s"), ("l", "o"), ("es", "t"), ("lo", "w")]


def test_no_room_for_merges(spark):
    pieces, merges = contents(bpe.train_bpe(lines_frame(spark, FIXTURE), 260))
    assert len(pieces) == 260 and merges == []


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    lines = corpus(1)
    model = bpe.train_bpe(lines_frame(spark, lines), 340)
    return model, reference(lines, 340, tmp_path_factory.mktemp("ref")), lines


def test_training_equals_library(trained):
    model, (_, pieces, merges), _ = trained
    assert contents(model) == (pieces, merges)


def test_encoding_equals_library(spark, trained):
    model, (tok, _, _), lines = trained
    texts = [*corpus(8, 60), *lines, "", " ", "<s> inside </s>", "\n\n a", "x" * 300, "tab\t\tend ", "thethatthis" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3)
    whole = {r.i: r.ids for r in bpe.bpe_encode(df, model, "t", mode="keep").collect()}
    # a tokenizer loaded from files does not know the reserved pieces as such
    folder_vocab = {p: i for i, p in enumerate(contents(model)[0])}
    loaded = tokenizers.ByteLevelBPETokenizer(folder_vocab, contents(model)[1])
    expected = {i: [0, *loaded.encode(t).ids, 2] for i, t in enumerate(texts)}
    assert whole == expected
    cut = {r.i: r.ids for r in bpe.bpe_encode(df, model, "t", 12).collect()}
    assert cut == {i: [0, *ids[1:-1][:10], 2] for i, ids in expected.items()}
    kept = {r.i for r in bpe.bpe_encode(df, model, "t", 12, "filter").collect()}
    assert kept == {i for i, ids in expected.items() if len(ids) <= 12}


def test_decoding_gives_the_text_back(spark, trained):
    model, _, _ = trained
    texts = [*corpus(3, 40), "", "😀é中"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    back = bpe.bpe_decode(bpe.bpe_encode(df, model, "t", mode="keep"), model)
    assert all(r.t == r.text for r in back.collect())
    odd = spark.createDataFrame([([0, 1, 2, 3, 99_999],), ([4 + 188],), (None,)], "ids array<int>")
    rows = [r.text for r in bpe.bpe_decode(odd, model).collect()]
    assert rows[0] == "" and rows[2] is None and isinstance(rows[1], str)


def test_result_does_not_depend_on_merges_per_round(spark):
    lines = corpus(5, 60)
    one, many = (contents(bpe.train_bpe(lines_frame(spark, lines), 300, merges_per_round=m)) for m in (1, None))
    assert one == many


def test_result_does_not_depend_on_pairs_kept(spark):
    lines = corpus(6, 80)
    few, many = (contents(bpe.train_bpe(lines_frame(spark, lines), 420, pairs_kept=k)) for k in (7, 200_000))
    assert few == many


@pytest.mark.parametrize("seed", range(3))
def test_many_merges_equal_library(spark, tmp_path, seed):
    """Short words over few letters: merges overlap, tie, and spell pieces that exist already."""
    rng = random.Random(seed)
    lines = [" ".join("".join(rng.choices("abc" if seed else "aab", k=rng.randrange(1, 12))) for _ in range(9)) for _ in range(60)]
    _, pieces, merges = reference(lines, 500, tmp_path)
    assert contents(bpe.train_bpe(lines_frame(spark, lines), 500)) == (pieces, merges)


def test_merges_in_their_order():
    """A pair that comes up again after its turn stays, and is merged at its next turn only."""
    first, second = {(1, 2): [(0, 9)], (3, 4): [(1, 1)]}, {(1, 2): [(0, 9), (2, 8)], (3, 4): [(1, 1)]}
    assert bpe._merge([1, 2, 3, 4, 2], first) == [9, 1, 2]
    assert bpe._merge([1, 2, 3, 4, 2], second) == [9, 8]
    assert bpe._merge([5, 5, 5, 5, 5], {(5, 5): [(0, 6)], (6, 6): [(1, 7)]}) == [7, 5]


def test_exported_files_load_in_the_library(spark, trained, tmp_path):
    model, (_, pieces, merges), lines = trained
    files.export_bpe(model, str(tmp_path / "m"))
    assert (tmp_path / "m/merges.txt").read_text(encoding="utf-8").split("\n") == ["#version: 0.2", *map(" ".join, merges), ""]
    loaded = tokenizers.ByteLevelBPETokenizer(str(tmp_path / "m/vocab.json"), str(tmp_path / "m/merges.txt"))
    assert loaded.get_vocab() == {p: i for i, p in enumerate(pieces)}
    rows = bpe.bpe_encode(lines_frame(spark, lines[:30]), model, "line", mode="keep").collect()
    assert {r.line: r.ids for r in rows} == {t: [0, *loaded.encode(t).ids, 2] for t in lines[:30]}
    imported = files.import_bpe(spark, str(tmp_path / "m/vocab.json"), str(tmp_path / "m/merges.txt"))
    assert contents(imported) == contents(model)


def test_files_round_trip(spark, trained, tmp_path):
    model, _, _ = trained
    files.save_bpe(model, str(tmp_path / "m"))
    assert contents(files.load_bpe(spark, str(tmp_path / "m"))) == contents(model)
    imported = files.import_bpe(spark, str(tmp_path / "m/vocab.json"), str(tmp_path / "m/merges.txt"))
    assert contents(imported) == contents(model)
    part = next((tmp_path / "m/merges.txt").glob("part-*"))
    assert part.read_text(encoding="utf-8").startswith("#version: 0.2\n")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.load_bpe(spark, str(tmp_path / "absent"))


def test_changes_of_a_round_are_added_up_by_few_tasks(spark):
    words = spark.createDataFrame([(b"abab", 3), (b"cab", 2)], "word binary, freq long")
    spelled = [bytes([b]) for b in range(256)]
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        changes = bpe._pair_changes(words, list(range(256)), spelled + [b"ab"], [(97, 98, 256)], 0)
        plan = changes._jdf.queryExecution().executedPlan().toString()
        found = {(r.l, r.r): r.change for r in changes.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert plan.count("Exchange") == 1 and ", 64)" not in plan
    assert found == {(97, 98): -8, (98, 97): -3, (256, 256): 3, (99, 97): -2, (99, 256): 2}
