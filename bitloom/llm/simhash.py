"""SimHash fingerprints and near-duplicate groups by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.arrow import as_bytes
from bitloom.llm.components import components
from bitloom.plans.storage import materialize

BITS = 64
STRIDE = 4  # levels of the trie that one round of the distributed traversal descends
LEAF = 30_000  # fingerprints below a node pair that one task compares
FRONTIER = 200_000  # node pairs a task holds at a time
QUARTER = BITS // 4
WIDE_FRONTIER = 30_000  # the same where a wide budget leaves many leaf pairs
SMALL = 64  # below this many leaf pairs a node pair is compared outright


def _fingerprint(text: bytes, shingle: int, seed: int) -> int:
    words = text.lower().split()  # on bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    space = b" ".join
    hashes = [xxhash.xxh64_intdigest(space(words[i : i + shingle]), seed) for i in range(n)]
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, 1 << 15):
        chunk = np.array(hashes[start : start + (1 << 15)], dtype="<u8")
        ones += np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(text: Column | str, shingle: int = 5, seed: int = 42) -> Column:
    """``long`` whose 64 bits are the SimHash of a whole text.

    Words are runs without ASCII white space after lower-casing A-Z, shingles
    are ``shingle`` words joined by a space (all words if there are fewer),
    repeats count, and a bit is set if it is set in over half of the XXH64
    values. Null texts and texts without words give 0.
    """

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        found = np.array([_fingerprint(t, shingle, seed) for t in as_bytes(texts)], dtype=np.uint64)
        return pa.array(found.view(np.int64))

    return fingerprints(F.col(text) if isinstance(text, str) else text)


def _prefix(fingerprint: str, level: int) -> Column:
    """The first ``level`` bits as a non-negative number."""
    return F.shiftrightunsigned(fingerprint, BITS - level) if level else F.lit(0).cast("long")


def _masks(bits: int, most: int) -> list[int]:
    return [m for m in range(1 << bits) if m.bit_count() <= most]


def _node_pairs(prints: DataFrame, budget: int) -> list[tuple[int, DataFrame]]:
    """Per level the pairs of trie nodes that tasks compare: ``a <= b``, prefixes that differ in ``budget`` bits at most.

    The trie is descended from the root, a pair of nodes at a time: a pair with
    few fingerprints below goes to a task, any other is replaced by the pairs of
    its children whose prefixes stay within the budget. Children are met by an
    equi-join on the allowed prefix of the partner, so a crowded part of the
    trie is cut further while the rest is not.
    """
    done, level = [], 0
    total = prints.count()
    schema = "a long, b long, used int, n long"
    pairs = prints.sparkSession.createDataFrame([(0, 0, 0, 2 * total)], schema)
    while True:
        last = level + STRIDE > BITS
        ready = pairs if last else pairs.filter(F.col("n") <= 2 * LEAF)
        if ready.take(1):
            done.append((level, ready.select("a", "b")))
        crowded = pairs.limit(0) if last else pairs.filter(F.col("n") > 2 * LEAF)
        if not crowded.take(1):
            return done
        level += STRIDE
        nodes = materialize(prints.groupBy(_prefix("fingerprint", level).alias("node")).agg(F.count("*").alias("n")), "nodes")
        child_a = nodes.select(F.shiftright("node", STRIDE).alias("a"), F.col("node").alias("ca"), F.col("n").alias("na"))
        masks = F.array(*[F.lit(m) for m in _masks(STRIDE, budget)])
        # the low bits of the partner are those of the child of a with at most the remaining budget flipped
        wanted = (
            crowded.select("a", "b", "used")
            .join(child_a, "a")
            .withColumn("mask", F.explode(masks))
            .withColumn("used", F.col("used") + F.bit_count("mask").cast("int"))
            .filter(F.col("used") <= budget)
            .withColumn(
                "cb", F.shiftleft("b", STRIDE).bitwiseOR(F.col("ca").bitwiseAND(F.lit((1 << STRIDE) - 1)).bitwiseXOR(F.col("mask").cast("long")))
            )
            .filter("ca <= cb")
        )
        child_b = nodes.select(F.col("node").alias("cb"), F.col("n").alias("nb"))
        pairs = materialize(
            wanted.join(child_b, "cb").select(
                F.col("ca").alias("a"), F.col("cb").alias("b"), "used", (F.col("na") + F.col("nb")).alias("n")
            ),
            "node-pairs",
        )


def _traverse(
    a: np.ndarray, b: np.ndarray, same: bool, level: int, budget: int, lead: int | None = None, frontier: int | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) with at most ``budget`` differing bits, a batch at a time.

    ``a`` and ``b`` are sorted; a node is a range of places. Node pairs descend
    bit by bit together; a pair dies when the bits that differ on the way exceed
    the budget, or ``lead`` within the first quarter of the bits.
    """
    frontier = frontier or FRONTIER
    stack = [(level, np.array([[0, len(a), 0, len(b), 0 if same else _differing(a, b, level)]], dtype=np.int64))]
    while stack:
        level, nodes = stack.pop()
        if len(nodes) > frontier:
            stack += [(level, nodes[i : i + frontier]) for i in range(0, len(nodes), frontier)]
            continue
        size = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        small = (size <= SMALL) | (level >= BITS)
        if small.any():
            leaf = nodes[small]
            counts = size[small]
            pair = np.repeat(np.arange(len(leaf)), counts)
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            width = (leaf[:, 3] - leaf[:, 2])[pair]
            i, j = leaf[pair, 0] + within // width, leaf[pair, 2] + within % width
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        nodes = nodes[~small]
        if not len(nodes):
            continue
        bit = np.uint64(BITS - 1 - level)
        cut_a, cut_b = _cut(a, nodes[:, 0], nodes[:, 1], bit), _cut(b, nodes[:, 2], nodes[:, 3], bit)
        a0, a1, b0, b1, used = nodes.T
        twin = (a0 == b0) & (a1 == b1) if same else np.zeros(len(nodes), bool)
        children = np.concatenate([
            np.stack([a0, cut_a, b0, cut_b, used], 1),
            np.stack([cut_a, a1, cut_b, b1, used], 1),
            np.stack([a0, cut_a, cut_b, b1, used + 1], 1),
            np.stack([cut_a, a1, b0, cut_b, used + 1], 1)[~twin],
        ])
        most = budget if lead is None or level >= QUARTER else lead
        alive = (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3]) & (children[:, 4] <= most)
        stack.append((level + 1, children[alive]))


def _differing(a: np.ndarray, b: np.ndarray, level: int) -> int:
    return int(a[0] ^ b[0]) >> (BITS - level) and (int(a[0] ^ b[0]) >> (BITS - level)).bit_count()


def _cut(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First place of each range whose bit is set; the ranges share all higher bits."""
    high_part = values[np.minimum(low, len(values) - 1)] >> (bit + np.uint64(1)) if bit < 63 else np.zeros(len(low), np.uint64)
    first = ((high_part << np.uint64(1)) | np.uint64(1)) << bit
    return np.clip(np.searchsorted(values, first), low, high)


class _Forest:
    """Union-find over places; keeps the links that join two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _links_of(level: int, budget: int):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        prints = group["fingerprint"].to_numpy().view(np.uint64)
        side = group["side"].to_numpy()
        a, b = np.sort(prints[side == 0]), np.sort(prints[side == 1])
        same = group["a"].iloc[0] == group["b"].iloc[0]
        if same:
            b = a
        forest, found = _Forest(len(a) + (0 if same else len(b))), []
        offset = 0 if same else len(a)
        for i, j in _traverse(a, b, same, level, budget) if len(a) and len(b) else ():
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if forest.join(x, y + offset):
                    found.append((a[x], b[y]))
        out = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": out[:, 0], "v": out[:, 1]})

    return links


def hamming_links(prints: DataFrame, budget: int) -> DataFrame:
    """``u, v``: links that connect distinct ``fingerprint`` values at ``budget`` or fewer differing bits.

    Not all pairs: each compared node pair returns a spanning forest of its
    links, which has the same components and is linear in the fingerprints.
    """
    links = None
    for level, pairs in _node_pairs(prints, budget):
        sides = pairs.select("a", "b", F.col("a").alias("node"), F.lit(0).alias("side")).unionByName(
            pairs.filter("a <> b").select("a", "b", F.col("b").alias("node"), F.lit(1).alias("side"))
        )
        rows = prints.select("fingerprint", _prefix("fingerprint", level).alias("node")).join(sides, "node").drop("node")
        found = rows.groupBy("a", "b").applyInPandas(_links_of(level, budget), "u long, v long")
        links = found if links is None else links.unionByName(found)
    return links


def _roots(rows: DataFrame, budget: int) -> DataFrame:
    """``fingerprint, root`` of the fingerprints of ``rows``, equal fingerprints being one node; written."""
    prints = materialize(rows.select("fingerprint").distinct(), "prints")
    links = hamming_links(prints, budget)
    if links is None:
        return prints.withColumn("root", F.col("fingerprint"))
    member = components(links).withColumnRenamed("node", "fingerprint")
    return materialize(prints.join(member, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")), "rooted")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, budget: int = 3) -> DataFrame:
    """``id_col, fingerprint (long), component_id``: groups of documents whose fingerprints are linked.

    One row per input row. Equal fingerprints are one node, so copies are never
    compared; documents without words share fingerprint 0 and are linked like
    any other. ``component_id`` is the smallest id of the component; null ids
    are ignored by that minimum (null if there is no other). An empty table
    gives an empty result; other columns are not read.
    """
    rows = materialize(docs.select(F.col(id_col).alias("id"), simhash(text_col, shingle).alias("fingerprint")), "fingerprints")
    least = rows.groupBy("fingerprint").agg(F.min("id").alias("least"))
    rooted = materialize(_roots(rows, budget).join(least, "fingerprint"), "least")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = materialize(rooted.join(smallest, "root").select("fingerprint", "component_id"), "groups")
    return rows.join(found, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, budget: int = 3) -> DataFrame:
    """One row of each group of documents whose fingerprints are linked; all columns stay.

    The row with the smallest id stays, among equal ids the one with the
    smallest hash of its text (128 bits). Rows that repeat both id and text give
    one. Different texts under one id are documents of their own. A null id
    comes after all others. An empty table stays empty. Whole rows are shuffled
    once; what decides is a table of ids and hashes.
    """
    key = {"_h": F.xxhash64(F.lit(1), text_col), "_g": F.xxhash64(F.lit(2), text_col)}
    rows = docs.select(F.col(id_col).alias("_id"), *[c.alias(n) for n, c in key.items()], simhash(text_col, shingle).alias("fingerprint"))
    rows = materialize(rows, "fingerprints")
    named = F.struct(F.col("_id").isNull(), "_id", "_h", "_g")
    first = rows.join(_roots(rows, budget), "fingerprint").groupBy("root").agg(F.min(named).alias("_first")).select("_first.*")
    leaders = materialize(first.select(F.col("_id"), "_h", "_g"), "leaders")
    same = (F.col(id_col).eqNullSafe(F.col("_id"))) & (F.col("_own_h") == F.col("_h")) & (F.col("_own_g") == F.col("_g"))
    marked = docs.withColumns({f"_own{n}": c for n, c in key.items()})
    kept = marked.join(leaders, same, "left_semi").dropDuplicates([id_col, "_own_h", "_own_g"])
    return kept.select(*docs.columns)


def _words(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def _shingles(text: bytes, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles that `_fingerprint` counts."""
    words = text.lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle])) for i in range(n)], np.uint64))


def _described(text: Column, shingle: int, with_set: bool) -> Column:
    """``copy`` (128-bit hash of the words) beside the fingerprint and the number of shingles, or beside their set."""
    schema = "copy binary, " + ("shingles array<long>" if with_set else "fingerprint long, n int")

    @F.arrow_udf(f"struct<{schema.replace(' ', ':').replace(',:', ',')}>")
    def describe(texts: pa.Array) -> pa.Array:
        held = as_bytes(texts)
        copies = pa.array([xxhash.xxh3_128_digest(_words(t)) for t in held], pa.binary())
        if with_set:
            sets = pa.array([_shingles(t, shingle).view(np.int64) for t in held], pa.list_(pa.int64()))
            return pa.StructArray.from_arrays([copies, sets], ["copy", "shingles"])
        prints = np.array([_fingerprint(t, shingle, 42) for t in held], np.uint64).view(np.int64)
        sizes = pa.array([len(_shingles(t, shingle)) for t in held], pa.int32())
        return pa.StructArray.from_arrays([copies, pa.array(prints), sizes], ["copy", "fingerprint", "n"])

    return describe(text)


def _lane_pairs(prints: DataFrame, budget: int) -> list[tuple[int, DataFrame]]:
    """`_node_pairs` in every lane of ``prints`` (``lane, side, fingerprint``): ``lane, other, a, b`` per level.

    Pairs lie within side 0 (``other`` 0) or between side 0 and side 1. In the
    first quarter of the bits a fourth of the budget may differ.
    """
    done, level = [], 0
    sizes = materialize(prints.groupBy("lane").pivot("side", [0, 1]).count().na.fill(0).toDF("lane", "n0", "n1"), "lanes")
    side = lambda k, n: F.struct(F.lit(k).alias("other"), n.alias("n"))
    sides = F.explode(F.array(side(0, F.col("n0") * 2), side(1, F.col("n0") + F.col("n1"))))
    root = F.lit(0).cast("long")
    pairs = sizes.filter("n0 > 0").select("lane", "n1", sides.alias("_s")).select(
        "lane", "_s.other", root.alias("a"), root.alias("b"), F.lit(0).alias("used"), "_s.n", "n1"
    )
    pairs = pairs.filter("other = 0 or n1 > 0").drop("n1")
    while True:
        last = level + STRIDE > BITS
        ready = pairs if last else pairs.filter(F.col("n") <= 2 * LEAF)
        if ready.take(1):
            done.append((level, ready.select("lane", "other", "a", "b")))
        crowded = pairs.limit(0) if last else pairs.filter(F.col("n") > 2 * LEAF)
        if not crowded.take(1):
            return done
        level += STRIDE
        most = budget // 4 if level <= QUARTER else budget
        nodes = prints.groupBy("lane", "side", _prefix("fingerprint", level).alias("node")).agg(F.count("*").alias("n"))
        nodes = materialize(nodes, "nodes")
        child_a = nodes.filter("side = 0").select("lane", F.shiftright("node", STRIDE).alias("a"), F.col("node").alias("ca"), F.col("n").alias("na"))
        masks = F.array(*[F.lit(m) for m in _masks(STRIDE, min(most, STRIDE))])
        flipped = F.col("ca").bitwiseAND(F.lit((1 << STRIDE) - 1)).bitwiseXOR(F.col("mask").cast("long"))
        wanted = (
            crowded.drop("n")
            .join(child_a, ["lane", "a"])
            .withColumn("mask", F.explode(masks))
            .withColumn("used", F.col("used") + F.bit_count("mask").cast("int"))
            .filter(F.col("used") <= most)
            .withColumn("cb", F.shiftleft("b", STRIDE).bitwiseOR(flipped))
            .filter("other = 1 or ca <= cb")
        )
        child_b = nodes.select("lane", F.col("side").alias("other"), F.col("node").alias("cb"), F.col("n").alias("nb"))
        met = wanted.join(child_b, ["lane", "other", "cb"])
        pairs = materialize(
            met.select("lane", "other", F.col("ca").alias("a"), F.col("cb").alias("b"), "used", (F.col("na") + F.col("nb")).alias("n")),
            "node-pairs",
        )


def _candidates_of(level: int, budget: int, similarity: float):
    def candidates(group: pd.DataFrame) -> pd.DataFrame:
        first, out = group.iloc[0], []
        same = first["other"] == 0 and first["a"] == first["b"]
        sides = []
        for side in (0, 1):
            rows = group[group["place"] == side]
            prints = rows["fingerprint"].to_numpy().view(np.uint64)
            order = np.argsort(prints, kind="stable")
            sides.append([prints[order], rows["node"].to_numpy()[order], rows["n"].to_numpy()[order]])
        (a, node_a, n_a), (b, node_b, n_b) = sides[0], sides[0] if same else sides[1]
        found = _traverse(a, b, same, level, budget, budget // 4, WIDE_FRONTIER) if len(a) and len(b) else ()
        for i, j in found:
            near = np.minimum(n_a[i], n_b[j]) >= similarity * np.maximum(n_a[i], n_b[j]) - 1e-9
            out.append(np.stack([node_a[i[near]], node_b[j[near]]], 1))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"u": pairs.min(1) if len(pairs) else [], "v": pairs.max(1) if len(pairs) else []}, dtype=np.int64)

    return candidates


def candidate_pairs(texts: DataFrame, budget: int, similarity: float) -> DataFrame:
    """``u, v``: all pairs of ``node`` within ``budget`` bits whose set sizes ``n`` allow the similarity.

    Two fingerprints within the budget differ in a fourth of it at most in one
    of their quarters. The trie self-join runs on four rotations, each with
    another quarter in front, and leaves out what exceeds that fourth there. A
    lane is a rotation and a class of sizes, with the next class as its other side.
    """
    class_of = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / similarity)) + 1e-9).cast("int")
    turned = lambda k: F.shiftleft("fingerprint", k).bitwiseOR(F.shiftrightunsigned("fingerprint", BITS - k)) if k else F.col("fingerprint")
    turns = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), turned(QUARTER * r).alias("f")) for r in range(4)]))
    side = lambda c, k: F.struct(c.alias("c"), F.lit(k).alias("side"))
    sides = F.explode(F.array(side(F.col("_class"), 0), side(F.col("_class") - 1, 1)))
    prints = texts.filter("n > 0").select("node", "n", class_of.alias("_class"), turns.alias("_t")).withColumn("_s", sides)
    prints = prints.select((F.col("_s.c") * 4 + F.col("_t.r")).alias("lane"), "_s.side", F.col("_t.f").alias("fingerprint"), "node", "n")
    prints = materialize(prints, "lanes")
    pairs = prints.sparkSession.createDataFrame([], "u long, v long")
    for level, met in _lane_pairs(prints, budget):
        places = met.select("lane", "other", "a", "b", F.lit(0).alias("side"), F.col("a").alias("at"), F.lit(0).alias("place")).unionByName(
            met.filter("other = 1 or a <> b").select(
                "lane", "other", "a", "b", F.col("other").alias("side"), F.col("b").alias("at"), F.lit(1).alias("place")
            )
        )
        rows = prints.withColumn("at", _prefix("fingerprint", level)).join(places, ["lane", "side", "at"])
        rows = rows.select("lane", "other", "a", "b", "place", "fingerprint", "node", "n")
        found = rows.groupBy("lane", "other", "a", "b").applyInPandas(_candidates_of(level, budget, similarity), "u long, v long")
        pairs = pairs.unionByName(found)
    return pairs.distinct()


def keep_dissimilar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, budget: int = 15, similarity: float = 0.8
) -> DataFrame:
    """The rows of ``docs`` whose id leads its group of near copies; all columns stay.

    Documents of equal words are copies. Others are linked if their
    fingerprints are within ``budget`` bits and the Jaccard similarity of their
    sets of shingles, which is computed for each such pair, is ``similarity`` or
    more; groups are the components of the links. Nulls and repeated ids are
    treated as by `keep_one`.
    """
    named = docs.filter(F.col(id_col).isNotNull())
    seen = named.select(F.col(id_col).alias("id"), _described(F.col(text_col), shingle, False).alias("_d"))
    grouped = seen.groupBy("_d.copy").agg(F.min("id").alias("least"), F.min("_d.fingerprint").alias("fingerprint"), F.min("_d.n").alias("n"))
    texts = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "texts")
    pairs = materialize(candidate_pairs(texts, budget, similarity), "candidates")
    asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    asked = materialize(texts.join(asked, "node", "left_semi").select("node", "copy", "least"), "asked")
    read = named.join(asked.select(F.col("least").alias(id_col)).distinct(), id_col, "left_semi")
    sets = read.select(_described(F.col(text_col), shingle, True).alias("_d")).select("_d.copy", "_d.shingles")
    sets = sets.join(asked, "copy").dropDuplicates(["node"]).select("node", "shingles")
    sets = materialize(sets, "shingles")
    shared = F.size(F.array_intersect("s", "t"))
    confirmed = (
        pairs.join(sets.toDF("u", "s"), "u")
        .join(sets.toDF("v", "t"), "v")
        .filter(shared >= F.lit(similarity) * (F.size("s") + F.size("t") - shared) - 1e-9)
        .select("u", "v")
    )
    member = components(materialize(confirmed, "confirmed"))
    rooted = texts.join(member, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    leaders = rooted.groupBy("root").agg(F.min("least").alias(id_col)).select(id_col).distinct()
    kept = named.join(leaders, id_col, "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
