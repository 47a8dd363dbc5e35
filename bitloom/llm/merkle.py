"""A Merkle manifest of a table, and what its root becomes when rows are tampered with.

Leaves are hashed in the JVM and ranked within their group by range
partitioning, so a group of any size is spread. An aligned block of 4,096
consecutive nodes is one task's tree of three levels; its root is a node of the
next tree, until each group has one subroot, and the subroots make a last tree.
Trees are small against what lies below them: one node in 4,096 goes up, and one
path (the siblings up to the root) comes down to each block.

The tree is persistent. A tampered leaf makes a version: its ancestors are
copied, first those inside its block, then those along the block's path through
the upper, distributed trees; every other node is shared with the first version.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.plans.ranking import global_rank
from bitloom.plans.storage import materialize

FAN = 16
HEIGHT = 3
BLOCK = FAN**HEIGHT

PATH = "array<string>"  # for each level up to the root: the siblings before a node, those after it


def digest(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def leaf_hash(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields in order: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    written = []
    for field in fields:
        value = field.cast("string")
        written.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*written).cast("binary"), 256)


def levels_of(nodes: list[str], root: bool) -> list[list[str]]:
    """The nodes of a block level by level; ``root`` ends at a single node, else all levels of a block are hashed."""
    levels = [nodes]
    while len(levels) <= HEIGHT and not (root and len(levels[-1]) == 1):
        below = levels[-1]
        levels.append([digest(*below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return levels


def siblings(levels: list[list[str]]) -> list[list[list[str]]]:
    """For each level but the last and each node of it: what the node's run holds before it and after it."""
    found = []
    for nodes in levels[:-1]:
        runs = (nodes[i : i + FAN] for i in range(0, len(nodes), FAN))
        found.append([["".join(run[:k]), "".join(run[k + 1 :])] for run in runs for k in range(len(run))])
    return found


def copied(node: str, path: Sequence[str]) -> list[str]:
    """The ancestors that a version copies when a node of it is new, from the node's parent to the root."""
    made = []
    for before, after in zip(path[::2], path[1::2], strict=True):
        node = digest(before, node, after)
        made.append(node)
    return made


def _lists(values: list[list[str]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.string()))


def _paths(levels: list[list[str]], upper: Sequence[str]) -> list[list[str]]:
    """The path from each node of a block to the root, given the path of the block's own root."""
    near = siblings(levels)
    above = [list(upper)] * len(levels[-1])
    for level in reversed(near):
        above = [[*pair, *above[k // FAN]] for k, pair in enumerate(level)]
    return above


def _in_blocks(nodes: DataFrame, blocks: DataFrame, work: Callable[[pa.Table, dict], dict], schema: str) -> DataFrame:
    """``work`` on the nodes of each block, ascending, and on the block's row; it returns columns."""

    def both(rows: pa.Table, block: pa.Table) -> pa.Table:
        return pa.table(work(rows.sort_by("place"), block.to_pylist()[0]))

    placed = nodes.withColumn("block", F.expr(f"place div {BLOCK}"))
    own = blocks.select(*[F.col(c).alias(c) for c in blocks.columns])  # columns of its own, if it came from the nodes
    return placed.groupBy("tree", "block").cogroup(own.groupBy("tree", "block")).applyInArrow(both, schema)


def _blocks(nodes: DataFrame) -> DataFrame:
    """``tree, block, root``: whether the block is the whole tree. One row for 4,096 nodes."""
    held = nodes.groupBy("tree", F.expr(f"place div {BLOCK}").alias("block")).count()
    many = nodes.groupBy(F.col("tree").alias("_tree")).agg((F.max("place") < BLOCK).alias("root"))
    return held.join(many, F.col("tree").eqNullSafe(F.col("_tree"))).select("tree", "block", "root")


def _rise(nodes: DataFrame, tree: str) -> list[tuple[DataFrame, DataFrame]]:
    """Nodes and blocks of each storey; the last storey's blocks are whole trees. Blocks hold their root's hash."""
    storeys = []
    schema = f"tree {tree}, block long, root boolean, hash string"

    def summit(rows: pa.Table, block: dict) -> dict:
        top = levels_of(rows["hash"].to_pylist(), block["root"])[-1][0]
        return {"tree": rows["tree"][:1], "block": [block["block"]], "root": [block["root"]], "hash": [top]}

    while True:
        blocks = materialize(_in_blocks(nodes, _blocks(nodes), summit, schema), "merkle-blocks")
        storeys.append((nodes, blocks))
        more = blocks.filter(~F.col("root"))
        if more.isEmpty():
            return storeys
        nodes = more.select("tree", F.col("block").alias("place"), "hash")


def _descend(storeys: list[tuple[DataFrame, DataFrame]], tops: DataFrame, tree: str) -> DataFrame:
    """``tree, block, root, path, top`` of the lowest storey's blocks. ``tops``: ``tree, path`` of whole trees."""
    schema = f"tree {tree}, block long, path {PATH}"

    def spread(rows: pa.Table, block: dict) -> dict:
        paths = _paths(levels_of(rows["hash"].to_pylist(), block["root"]), block["path"])
        return {"tree": rows["tree"], "block": rows["place"], "path": _lists(paths)}

    def same(a: str, b: str) -> Column:
        return F.col(a).eqNullSafe(F.col(b))

    below = None
    renamed = tops.select(F.col("tree").alias("_tree"), F.col("path").alias("_path"))
    for nodes, blocks in reversed(storeys):
        whole = blocks.filter("root").join(renamed, same("tree", "_tree")).select("tree", "block", "root", F.col("_path").alias("path"))
        if below is not None:
            inner = below.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), F.col("path").alias("_path"))
            part = blocks.filter(~F.col("root")).join(inner, same("tree", "_tree") & same("block", "_block"))
            whole = whole.unionByName(part.select("tree", "block", "root", F.col("_path").alias("path")))
        whole = materialize(whole, "merkle-paths")
        if nodes is storeys[0][0]:
            return whole
        below = materialize(_in_blocks(nodes, whole, spread, schema), "merkle-paths")
    raise AssertionError("a tree has a storey")


def manifest(
    df: DataFrame,
    fields: Sequence[str],
    id_col: str,
    by: str,
    tampered: Mapping[str, Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """One row per row of ``df``: ``id, tree, place, leaf, subroot, root, proof, copied, folded_root, verified``.

    A leaf hashes ``fields``. The leaves of one value of ``by`` ascend by
    ``id_col`` and make a tree of fan-out 16, their subroots (null first, then by
    UTF-8 bytes) another. ``proof`` is the SHA-256 of all siblings up to the root.

    Where ``where`` holds, the fields named in ``tampered`` have the given value
    instead, each row by itself: ``copied`` lists the nodes of its version that
    are new, from the leaf itself to the root, and ``folded_root`` is the last
    of them. A version without a changed leaf has all nodes in common with the
    first; its root is that of its block, recomputed and carried up the block's
    path. ``verified`` says whether ``folded_root`` is the root.

    Null ids come first and are leaves like others; repeated ids go by leaf hash,
    so repeated rows are leaves side by side. A lone leaf is its tree's subroot,
    and a lone subroot the root. Null fields, empty and long texts hash as the
    rule says. An empty table gives an empty one. Columns of ``df`` that are
    not named are not read.
    """
    spark = df.sparkSession
    tree = df.schema[by].dataType.simpleString()
    now = {f: F.col(f) for f in fields}
    changed = leaf_hash([(tampered or {}).get(f, now[f]) for f in fields])
    touched = F.coalesce(where, F.lit(False)) if where is not None else F.lit(bool(tampered))
    hashed = df.select(
        F.col(id_col).alias("id"),
        F.col(by).alias("tree"),
        leaf_hash(list(now.values())).alias("hash"),
        F.when(touched, changed).alias("changed"),
    )
    # written first: the range partitioning below reads its input twice
    leaves = materialize(hashed, "merkle-leaves")
    order = [F.col("id").asc_nulls_first(), F.col("hash"), F.col("changed")]
    placed = materialize(
        global_rank(leaves, order, ["tree"], "place").withColumn("place", F.col("place") - 1), "merkle-places"
    )
    storeys = _rise(placed, tree)

    whole = [blocks.filter("root").select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "hash") for _, blocks in storeys]
    subroots = whole[0]
    for more in whole[1:]:
        subroots = subroots.unionByName(more)
    named = materialize(
        global_rank(subroots, [F.col("name").asc_nulls_first()], [], "place").withColumn("place", F.col("place") - 1),
        "merkle-subroots",
    )
    upper = _rise(named, "int")
    summit = upper[-1][1].filter("root").select("hash").first()
    root = summit["hash"] if summit else ""
    above = _descend(upper, spark.createDataFrame([(0, [])], f"tree int, path {PATH}"), "int")

    def to_trees(rows: pa.Table, block: dict) -> dict:
        paths = _paths(levels_of(rows["hash"].to_pylist(), block["root"]), block["path"])
        return {"tree": rows["name"], "path": _lists(paths), "subroot": rows["hash"]}

    tops = materialize(_in_blocks(named, above, to_trees, f"tree {tree}, path {PATH}, subroot string"), "merkle-trees")
    blocks = _descend(storeys, tops, tree)
    subroot = tops.select(F.col("tree").alias("_tree"), "subroot")
    blocks = blocks.join(subroot, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")

    def versions(rows: pa.Table, block: dict) -> dict:
        levels = levels_of(rows["hash"].to_pylist(), block["root"])
        outer, n = block["path"], len(rows)
        shared = [levels[-1][0], *copied(levels[-1][0], outer)][-1]
        near = siblings(levels)
        proofs, made = [], []
        for k, new in enumerate(rows["changed"].to_pylist()):
            path, at = [], k
            for level in near:
                path += level[at]
                at //= FAN
            path += outer
            proofs.append(digest(*path))
            made.append([] if new is None else [new, *copied(new, path)])
        folded = [nodes[-1] if nodes else shared for nodes in made]
        return {
            "id": rows["id"], "tree": rows["tree"], "place": rows["place"], "leaf": rows["hash"],
            "subroot": [block["subroot"]] * n, "root": [root] * n, "proof": proofs, "copied": _lists(made),
            "folded_root": folded, "verified": [f == root for f in folded],
        }

    id_type = df.schema[id_col].dataType.simpleString()
    schema = (
        f"id {id_type}, tree {tree}, place long, leaf string, subroot string, root string, proof string, "
        "copied array<string>, folded_root string, verified boolean"
    )
    return _in_blocks(placed, blocks, versions, schema)
