import random

import pytest

from bitloom.operators import batching, encoding, vectors
from bitloom.operators.counting import SPECIALS


@pytest.fixture(scope="module")
def vocab(spark):
    entries = list(enumerate([*SPECIALS, *[f"w{i}" for i in range(40)]]))
    return spark.createDataFrame(entries, "id int, token string")


@pytest.fixture(scope="module")
def sentences():
    rng = random.Random(2)
    rows = [(i, [f"w{min(int(rng.expovariate(0.05)), 60)}" for _ in range(rng.randrange(12))]) for i in range(300)]
    return [*rows, (300, []), (301, None), (302, ["nope", "nope"]), (303, ["<unk>", "<pad>"])]


@pytest.mark.parametrize("bound", [100, 10])
def test_numericalize_and_back(spark, vocab, sentences, bound):
    df = spark.createDataFrame(sentences, "pair_id long, tokens array<string>").repartition(3)
    ids = {r.token: r.id for r in vocab.collect()}
    numbered = encoding.numericalize(df, vocab, broadcast_entries=bound)
    found = {r.pair_id: r.ids for r in numbered.collect()}
    assert found == {k: None if t is None else [ids.get(w, 3) for w in t] for k, t in sentences}
    back = encoding.lookup_tokens(numbered.drop("tokens"), vocab, broadcast_entries=bound)
    words = {r.pair_id: r.tokens for r in back.collect()}
    assert words == {k: None if t is None else [w if w in ids else "<unk>" for w in t] for k, t in sentences}


@pytest.mark.parametrize("route", ["broadcast", "join"])
def test_routes_agree_on_repeats(spark, vocab, route):
    repeated = vocab.unionByName(vocab.filter("id >= 10").selectExpr("id + 100 AS id", "token")).union(spark.createDataFrame([(7, None)], "id int, token string"))
    rows = [(1, ["w0", "w9"]), (1, ["w1"]), (1, None), (1, []), (None, ["w2", "no", None]), (None, ["w2"])]
    df = spark.createDataFrame(rows, "pair_id long, tokens array<string>").repartition(3)
    found = encoding.numericalize(df, repeated, route=route)
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(
        map(repr, [(k, t, None if t is None else [int(w[1:]) + 4 if w and w != "no" else 3 for w in t]) for k, t in rows])
    )
    back = encoding.lookup_tokens(found.drop("tokens"), vocab.union(vocab.selectExpr("id", "concat(token, '~')")), route=route).collect()
    plain = lambda t: None if t is None else [w if w and w != "no" else "<unk>" for w in t]
    assert sorted(map(repr, [(r.pair_id, r.tokens) for r in back])) == sorted(map(repr, [(k, plain(t)) for k, t in rows]))


def test_a_stream_is_looked_up_beyond_the_bound(spark, vocab, tmp_path):
    rows = spark.createDataFrame([(1, ["w0", "no"]), (1, None)], "pair_id long, tokens array<string>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = encoding.numericalize(stream, vocab, broadcast_entries=10)
    writer = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    ids = [r.ids for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(ids, key=str) == sorted([[4, 3], None], key=str)
    with pytest.raises(ValueError):
        encoding.numericalize(stream, vocab, route="join")


def test_lookup_of_unknown_ids(spark, vocab):
    df = spark.createDataFrame([(1, [0, 99, -1, 4])], "pair_id long, ids array<int>")
    assert encoding.lookup_tokens(df, vocab).first().tokens == ["<pad>", "<unk>", "<unk>", "w0"]


@pytest.mark.parametrize("n, size", [(3, 5), (5, 5), (6, 5), (1001, 16)])
@pytest.mark.parametrize("shuffle", [False, True])
def test_make_batches(spark, n, size, shuffle):
    df = spark.range(n).withColumnRenamed("id", "pair_id").repartition(4)
    rows = batching.make_batches(df, size, shuffle, seed=3).collect()
    places = sorted((r.batch_id, r.pos_in_batch) for r in rows)
    assert places == [(i // size, i % size) for i in range(n)]
    order = [r.pair_id for r in sorted(rows, key=lambda r: (r.batch_id, r.pos_in_batch))]
    again = batching.make_batches(df.repartition(2), size, shuffle, seed=3).collect()
    assert order == [r.pair_id for r in sorted(again, key=lambda r: (r.batch_id, r.pos_in_batch))]
    assert (order == list(range(n))) == (not shuffle) or n <= 6


def test_length_bucketed_batches(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.randrange(100)) for i in range(500)], "pair_id long, src_len int")
    rows = batching.length_bucketed_batches(df, 10, mega=5, seed=2).collect()
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r.src_len)
    assert sorted(batches) == list(range(50)) and all(len(b) == 10 for b in batches.values())
    spread = sum(max(b) - min(b) for b in batches.values()) / 50
    assert spread < 30  # random batches of ten spread over about 80
    for first in range(0, 50, 5):
        assert min(batches[first]) >= max(batches[first + 4])


def test_pad_batch_and_waste(spark):
    rows = [(0, [1, 5, 2], [1, 2]), (0, [1, 2], [1, 6, 7, 2]), (1, [1, 2], [1, 2])]
    df = spark.createDataFrame(rows, "batch_id long, src_ids array<int>, tgt_ids array<int>")
    padded = sorted(map(tuple, batching.pad_batch(df, 9).select("src_padded", "tgt_padded", "src_len").collect()))
    assert padded == [([1, 2], [1, 2], 2), ([1, 2, 9], [1, 6, 7, 2], 2), ([1, 5, 2], [1, 2, 9, 9], 3)]
    waste = batching.padding_waste(df)
    assert {r.batch_id: (r.cells, r.pad_cells) for r in waste.collect()} == {0: (14, 3), 1: (4, 0)}
    total = batching.total_padding_waste(waste).first()
    assert (total.n_batches, total.cells, total.pad_cells) == (2, 18, 3)


def test_align_vectors(spark, vocab):
    lines = [(0, "w1", [1.0, 2.0]), (1, "w2", [3.0]), (2, "w1", [5.0, 6.0]), (3, "other", [7.0, 8.0]), (4, "<pad>", [9.0, 9.0])]
    table = spark.createDataFrame(lines, "line_no long, token string, vector array<float>")
    rows = {r.token: r for r in vectors.align_vectors(vocab, table, 2, seed=5).collect()}
    assert len(rows) == 44
    assert rows["w1"].vector == [5.0, 6.0] and rows["w1"].hit
    assert rows["<pad>"].vector == [0.0, 0.0] and not rows["w2"].hit
    again = vectors.align_vectors(vocab.repartition(3), table, 2, seed=5).collect()
    assert {r.token: r.vector for r in again} == {t: r.vector for t, r in rows.items()}
    assert tuple(vectors.vector_hit_stats(vocab, table, 2).first())[:2] == (44, 2)
    assert vectors.vector_hit_stats(vocab, table, 2, count_repeats=True).first().hits == 3


def test_noise_has_the_asked_spread(spark):
    many = spark.range(4, 404).selectExpr("cast(id AS int) AS id", "concat('w', id) AS token")
    none = spark.createDataFrame([], "line_no long, token string, vector array<float>")
    numbers = [x for r in vectors.align_vectors(many, none, 50).collect() for x in r.vector]
    mean = sum(numbers) / len(numbers)
    spread = (sum((x - mean) ** 2 for x in numbers) / len(numbers)) ** 0.5
    assert abs(mean) < 0.02 and abs(spread - 0.6) < 0.02
