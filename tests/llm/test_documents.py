"""The operators on documents against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from bitloom.llm import byte_bpe, interpolated_lm, mixing, packing, simhash, spotsigs, substring_dedup

SCHEMA = "doc_id long, text string, source string, id int, size int, row string, batch string"
WORDS = "the of and casa blanche größe night river stone and der apple run is long was cat é 漢字 on by".split()


def _texts():
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randrange(99))]) for _ in range(n))
    passage = make(20)
    texts = [None, "", " \n\t ", "the", "A b", make(6000)]
    for i in range(24):
        text = make(rng.randrange(5, 60))
        texts.append(text + " " + passage if i % 4 == 0 else text)
    return texts + [texts[8], texts[8], texts[9].upper(), texts[10] + " x", "é" * 60, "xé" * 60]


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, [None, "b", "a", "ß"][i % 4] if i % 7 else "a") for i, t in enumerate(_texts())]
    return found + [found[12], found[12]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _fingerprint(text, shingle):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, rows, docs, empty):
    found = simhash.near_duplicates(docs, shingle=3, budget=2).collect()
    prints = {i: _fingerprint(t, 3) for i, t, _ in rows}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = _components(prints, linked)
    assert Counter((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in found) == Counter(
        (i, prints[i], roots[i]) for i, *_ in rows
    )
    kept = simhash.keep_one(docs, shingle=3, budget=2)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in prints if roots[i] == i)
    assert simhash.near_duplicates(empty).count() == 0


def test_trie_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 40)
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    monkeypatch.setattr(simhash, "SMALL", 4)
    rng = random.Random(1)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:60]:
        for _ in range(3):
            for _ in range(rng.randrange(1, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values |= {0, 2**64 - 1, 1, 3, 2**63}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = simhash.hamming_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), 2).collect()
    pairs = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) % 2**64).bit_count() <= 2}
    mine = {(min(r.u, r.v), max(r.u, r.v)) for r in links}
    assert mine <= pairs
    assert _components(signed, mine) == _components(signed, pairs)


@pytest.mark.parametrize("leaf", [8, 30_000])
def test_near_copies_with_changed_words_go(spark, docs, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(40, 160))] for _ in range(40)]
    for words in texts[:25]:
        copy = list(words)
        for at in rng.sample(range(len(copy)), rng.randrange(1, 4)):
            copy[at] = "changed"
        texts.append(copy)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    bits = [_fingerprint(" ".join(w), 5) for w in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    far = lambda a, b: (bits[a] ^ bits[b]).bit_count()
    alike = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and far(a, b) <= 15]
    assert len(alike) > 10 and sum(far(a, b) > 3 for a, b in alike) > 5
    roots = _components(range(len(texts)), alike)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    copies, nameless = frame.selectExpr("doc_id + 100", "concat(' ', upper(text))"), frame.limit(3).selectExpr("cast(null AS long)", "text")
    twice = frame.union(copies).union(nameless)
    kept = [r.doc_id for r in simhash.keep_dissimilar(twice).collect()]
    assert kept.count(None) == 3 and sorted(k for k in kept if k is not None) == sorted(i for i in roots if roots[i] == i)
    assert simhash.keep_dissimilar(docs).columns == docs.columns


def test_shards(rows, docs, empty):
    found = packing.shard_documents(docs, 5).collect()
    expected = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == expected
    text, shards, slots, load = dict((i, t or "") for i, t, _ in rows), defaultdict(set), defaultdict(list), Counter()
    for r in found:
        shards[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    rest = sorted(load.values())[:-1]  # the long text is larger than an even share and has a shard of its own
    assert len(load) == 5 and max(rest) - min(rest) < 400
    assert packing.shard_documents(empty, 5).count() == 0


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(100):
        items = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 60))]
        capacity = rng.randrange(20, 100)
        bins: list[int] = []
        for size in sorted(items, reverse=True):
            fitting = [(left, k) for k, left in enumerate(bins) if left >= size]
            if fitting:
                bins[min(fitting)[1]] -= size
            else:
                bins.append(max(capacity, size) - size)
        runs = packing.best_fit(sorted(Counter(items).items(), reverse=True), capacity)
        load = Counter()
        for size, first, last, k in runs:
            load[k] += size * (last - first + 1)
        assert len(load) == len(bins) and sum(load.values()) == sum(items)


def test_mix(rows, docs, empty):
    found = mixing.mix(docs, [3, 1, 2], block=16).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"], r.source) for r in found) == Counter((i, size(t), s) for i, t, s in rows)
    total, taken = Counter(), Counter()
    for r in found:
        total[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.passes * r["size"] + r.part
    goal, level = {}, 0.0
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    free = set(total)
    while True:  # water filling, source by source
        level = (1.5 * sum(total.values()) - sum(2 * total[s] for s in total if s not in free)) / sum(weight[s] for s in free)
        full = {s for s in free if 2 * total[s] <= level * weight[s]}
        if not full:
            break
        free -= full
    goal = {s: level * weight[s] if s in free else 2.0 * total[s] for s in total}
    for r in found:
        assert r.source_size == total[r.source] and r.target == pytest.approx(goal[r.source])
    assert all(goal[s] - 1 < taken[s] <= goal[s] for s in total)
    again = mixing.mix(docs.repartition(2), [3, 1, 2], block=16).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in found)
    drawn = mixing.drawn_documents(docs, mixing.mix(docs, [3, 1, 2], block=16))
    assert drawn.columns == docs.columns
    assert Counter({s: sum(size(r.text) for r in drawn.collect() if r.source == s) for s in total}) == taken
    assert mixing.mix(empty, [3, 1, 2]).count() == 0


def _removed(rows, limit):
    first: dict[bytes, int] = {}
    for i, t, _ in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - limit + 1):
            w = raw[p : p + limit]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t, _ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - limit + 1):
            if first[raw[p : p + limit]] < i:
                gone[p : p + limit] = True
        out.append((i, len(raw), bytes(np.frombuffer(raw, np.uint8)[~gone]), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())))
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_passages(rows, docs, empty, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "BATCH", 3000)
    monkeypatch.setattr(substring_dedup, "SLICE", 700)
    found = substring_dedup.remove_repeats(docs, 50, carry=["source", "batch"]).collect()
    assert Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.span_start)) for r in found) == Counter(_removed(rows, 50))
    assert {(r.doc_id, r.source, r.batch) for r in found} == {(i, s, "y") for i, _, s in rows}
    if hot == 1:
        whole = substring_dedup.remove_repeats(docs, 50, characters=True).collect()
        assert all(bytes(r.kept).decode() is not None for r in whole)
        assert substring_dedup.remove_repeats(empty, 50).count() == 0


def test_language_model(rows, docs, empty):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    found = interpolated_lm.score_texts(docs, held).collect()
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b"\n"]
    out = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 1}
    counts = Counter(w for i, t, _ in rows if i not in out for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows) and {r.doc_id for r in found if r.held_out} == out
    text = {i: t for i, t, _ in rows}
    for r in found:
        words = tokens(text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
    assert interpolated_lm.score_texts(empty, held).count() == 0


def test_language_model_beats_the_base_on_held_out_texts(spark):
    # texts with an order of words; those of the rows above are drawn word by word, where pairs tell nothing
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = interpolated_lm.score_texts(documents, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).collect()
    for part in (True, False):
        assert sum(r.score - r.base_score for r in found if r.held_out == part) > 0


def test_language_model_probabilities_add_up(spark):
    text = "a b a c a b b c a b"
    words = ["a", "b", "c", "zzz"]
    rows = [(0, text)] + [(k + 1, f"{text} {w}") for k, w in enumerate(words)] + [(9, "a b a c a b b c a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score for r in interpolated_lm.score_texts(docs, F.col("doc_id") > 0).collect()}
    # after the same words: each known word, the end, or an unknown word; each score also holds the end after the last word
    singles = spark.createDataFrame([(0, text), (1, "a"), (2, "b"), (3, "c"), (4, "")], "doc_id long, text string")
    alone = {r.doc_id: 10**r.score for r in interpolated_lm.score_texts(singles, F.col("doc_id") > 0).collect()}
    assert all(0 < p <= 1 for p in alone.values()) and sum(alone.values()) < 1
    assert all(s < 0 for s in found.values())


def test_em_learns_the_weights():
    cell = lambda p: int(2 + round((np.log10(p) + 12) / interpolated_lm.BIN)) if p > 0 else 0
    # 70 % of the tokens are only explained by the pairs, 30 % only by the uniform share
    table = pd.DataFrame({"cell": [(3 << 40) + (cell(1e6) << 20), 3 << 40], "n": [700, 300]})
    weights = interpolated_lm.mixture_weights(table)
    assert weights[3][0] == pytest.approx(0.7, abs=0.01) and np.allclose(weights.sum(1), 1)


def test_spotsigs(spark, rows, docs, empty):
    found = spotsigs.edited_pairs(docs).collect()
    text = {i: t or "" for i, t, _ in rows}
    order = sorted(text, reverse=True)
    after = {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}
    common = set(spotsigs.COMMON)

    def signatures(t):
        words, out = [w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w], set()
        for i, word in enumerate(words):
            chain, j = [], i + 1
            for _ in range(2):
                skipped = 0
                while j < len(words) and words[j] in common and skipped < spotsigs.SKIPPED:
                    j, skipped = j + 1, skipped + 1
                if j < len(words) and words[j] not in common:
                    chain.append(words[j])
                    j += 1
            if word in common and len(chain) == 2:
                out.add((word, *chain))
        return out or {t.lower()}

    assert len(found) == len(rows)
    for r in found:
        t, other = text[r.doc_id], text[after[r.doc_id]]
        assert r.n_chars == len(t) and r.edited == t[: len(t) - len(t) // 3] + other[: len(t) // 3]
        assert (len(r.own), len(r.own_edited), len(r.next)) == tuple(len(signatures(x)) for x in (t, r.edited, other))
    equal = {}
    for r in found:
        assert equal.setdefault(text[r.doc_id], r.own) == r.own
    assert spotsigs.edited_pairs(empty).count() == 0
    sigs = docs.select("doc_id", spotsigs.signatures("text").alias("signatures"))
    pairs, members = spotsigs.near_pairs(sigs, threshold=0.5)
    sets = {i: frozenset(signatures(t)) for i, t in text.items()}
    rep = {i: min(k for k in sets if sets[k] == sets[i]) for i in sets}
    near = {(a, b) for a in set(rep.values()) for b in set(rep.values()) if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert {(r.left, r.right) for r in pairs.collect()} == near
    assert {(r.id, r.rep) for r in members.collect()} == set(rep.items())


def test_byte_bpe(spark, rows, docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.ByteBpe(spark, path, public_tokenizers.PATTERN)
    found = docs.select("doc_id", bpe.encode("text").alias("ids")).withColumn("raw", bpe.decode("ids")).collect()
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(path))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {i: t or "" for i, t, _ in rows}
    assert len(found) == len(rows)
    for r in found:
        assert r.ids == library.encode_ordinary(text[r.doc_id]) and bytes(r.raw) == text[r.doc_id].encode()
    assert empty.select(bpe.encode("text")).count() == 0
    rng, encoder = random.Random(3), byte_bpe.Encoder(*byte_bpe.merge_table(path), public_tokenizers.PATTERN)
    for _ in range(3000):
        s = "".join(rng.choice("aeiostnr  \n\t,.!éß漢字🎉01'stll") for _ in range(rng.randrange(60)))
        assert np.frombuffer(encoder.encode(s), np.int32).tolist() == library.encode_ordinary(s)
    for s in ("ab" * 30_000, "é" * 30_000, " " * 5000, "x" * 20_000 + " y"):
        assert np.frombuffer(encoder.encode(s), np.int32).tolist() == library.encode_ordinary(s)

