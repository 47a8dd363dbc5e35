"""Near-duplicate embeddings by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.components import components
from bitloom.plans.ranking import global_rank
from bitloom.plans.storage import materialize

TILE = 2048  # vectors of a tile; a task compares two tiles
STRIP = 256  # rows of a tile compared at a time
STEPS = (0.125, 0.375)  # shares of the dimensions after which pairs are pruned
SLACK = 1e-9  # rounding of the rotated bound; whoever passes is compared exactly


def _unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Places and double vectors of a batch, by dimension."""
    column = batch.column("vector")
    sizes = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, values[starts[at][:, None] + np.arange(dim)]


def _rotation(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """The most frequent dimension and its principal axes, by falling variance.

    Sums of coordinates and of their products are added up over all vectors;
    dim² + dim + 1 numbers come to the driver.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, matrix in _matrices(batch):
                unit = _unit(matrix)
                found = np.concatenate([[len(unit)], unit.sum(0), (unit.T @ unit).ravel()])
                sums[dim] = sums.get(dim, 0) + found
        for dim, found in sums.items():
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([found.tolist()], pa.list_(pa.float64()))], ["dim", "sums"])

    common = vectors.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return 0, np.eye(0)
    dim = common["dim"]
    parts = vectors.filter(F.size("vector") == dim).select("vector").mapInArrow(moments, "dim int, sums array<double>")
    rows = parts.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    numbers = np.array([r["x"] for r in rows])
    mean = numbers[1 : dim + 1] / numbers[0]
    spread = numbers[dim + 1 :].reshape(dim, dim) / numbers[0] - np.outer(mean, mean)
    values, axes = np.linalg.eigh(spread)
    return dim, axes[:, np.argsort(-values)]


def _near(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs at or above ``threshold``; ``a`` and ``b`` are as given, in double.

    The dot product of the rotated unit vectors grows by leading dimensions; a
    pair stops as soon as the product of the norms of what is left cannot lift
    it to the threshold. Pairs that reach the end are compared exactly.
    """
    ra, rb = _unit(a) @ axes, _unit(b) @ axes
    dim = ra.shape[1]
    cuts = sorted({0, *(min(dim, max(1, int(dim * s))) for s in STEPS), dim})
    left = lambda r: {c: np.sqrt(np.einsum("ij,ij->i", r[:, c:], r[:, c:])) for c in cuts}
    left_a, left_b = left(ra), left(rb)
    norm_a, norm_b = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    least = threshold - SLACK
    for start in range(0, len(a), STRIP):
        stop = min(start + STRIP, len(a))
        first = cuts[1]
        dots = ra[start:stop, :first] @ rb[:, :first].T
        alive = dots + left_a[first][start:stop, None] * left_b[first][None, :] >= least
        if same:
            alive &= np.arange(start, stop)[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(alive)
        dot = dots[i, j]
        i += start
        for low, high in zip(cuts[1:], cuts[2:], strict=False):
            for_now = [
                dot[k : k + (1 << 18)]
                + np.einsum("ij,ij->i", ra[i[k : k + (1 << 18)], low:high], rb[j[k : k + (1 << 18)], low:high])
                for k in range(0, len(i), 1 << 18)
            ]
            dot = np.concatenate(for_now) if for_now else dot
            keep = dot + left_a[high][i] * left_b[high][j] >= least
            i, j, dot = i[keep], j[keep], dot[keep]
        if len(i):
            exact = np.einsum("ij,ij->i", a[i], b[j]) / (norm_a[i] * norm_b[j])
            keep = exact >= threshold
            if keep.any():
                yield i[keep], j[keep]


def _compare(threshold: float, dim: int, axes: np.ndarray):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        from bitloom.llm.simhash import _Forest

        vectors = np.array([np.asarray(v, np.float64) for v in group["vector"]])
        uid, copies, side = (group[c].to_numpy() for c in ("uid", "copies", "side"))
        same = group["i"].iloc[0] == group["j"].iloc[0]
        at_a, at_b = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        turn = axes if vectors.shape[1] == dim else np.eye(vectors.shape[1])
        links, forest, edges = np.zeros(len(group), np.int64), _Forest(len(group)), []
        scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        for i, j in _near(scaled[at_a], scaled[at_b], turn, threshold, same):
            i, j = at_a[i], at_b[j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            edges += [(uid[x], uid[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(x, y)]
        some = np.flatnonzero(links)
        return pd.DataFrame({
            "u": np.concatenate([uid[some], np.array([e[0] for e in edges], np.int64)]),
            "v": np.concatenate([np.full(len(some), -1), np.array([e[1] for e in edges], np.int64)]).astype(np.int64),
            "n": np.concatenate([links[some], np.zeros(len(edges), np.int64)]),
        })

    return compare


def near_duplicate_vectors(
    rows: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row.

    Vectors of the same non-null label and the same length are linked if their
    cosine, in double precision, is at least ``threshold``; vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing.
    Equal vectors are one node with a number of ids, so copies are never
    compared. Nodes are ordered by their first principal coordinate and cut
    into tiles of ``TILE``; two tiles meet unless their ranges lie further apart than
    linked unit vectors can. A task compares two tiles and returns link counts
    and a spanning forest, never all pairs. ``n_links`` counts other ids linked
    directly, ``component_id`` is the smallest id reachable, ``kept`` says
    whether that is the row's own. Rows that repeat an id are one vector if
    they are equal and several vectors of that id otherwise; null ids link but
    never name a component. An empty table gives an empty result.
    """
    finite = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    moving = F.exists(vector_col, lambda x: x != 0)
    valid = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite & moving
    base = rows.select(
        F.col(id_col).alias("id"),
        F.when(F.coalesce(valid, F.lit(False)), F.col(label_col)).alias("label"),
        F.when(F.coalesce(valid, F.lit(False)), F.col(vector_col)).alias("vector"),
    )
    base = materialize(base, "vectors")
    ids = base.filter("vector is not null").groupBy("label", "vector", "id").agg(F.lit(1).alias("one"))
    nodes = ids.groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    nodes = materialize(nodes.withColumn("uid", F.monotonically_increasing_id()), "nodes")
    dim, axes = _rotation(nodes)

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = np.zeros(batch.num_rows)
            for size, at, matrix in _matrices(batch):
                lead[at] = _unit(matrix) @ (axes[:, 0] if size == dim else np.eye(size)[:, 0])
            yield pa.record_batch([batch.column("uid"), batch.column("label"), batch.column("size"), pa.array(lead)], ["uid", "label", "size", "lead"])

    label_type = nodes.schema["label"].dataType.simpleString()
    sized = nodes.select("uid", "label", F.size("vector").alias("size"), "vector")
    placed = sized.mapInArrow(leading, f"uid long, label {label_type}, size int, lead double")
    ranked = global_rank(materialize(placed, "leading"), [F.col("lead"), F.col("uid")], ["label", "size"], "place")
    tiles = materialize(ranked.withColumn("tile", F.floor((F.col("place") - 1) / TILE)).select("uid", "label", "size", "lead", "tile"), "tiles")
    spans = tiles.groupBy("label", "size", "tile").agg(F.min("lead").alias("low"), F.max("lead").alias("high"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    later = spans.select(F.col("label").alias("_label"), F.col("size").alias("_size"), F.col("tile").alias("j"), F.col("low").alias("_low"))
    met = (F.col("label") == F.col("_label")) & (F.col("size") == F.col("_size"))
    pairs = spans.withColumnRenamed("tile", "i").join(later, met).filter((F.col("j") >= F.col("i")) & (F.col("_low") <= F.col("high") + reach))
    pairs = materialize(pairs.select("label", "size", "i", "j"), "tile-pairs")
    sides = pairs.withColumn("tile", F.col("i")).withColumn("side", F.lit(0)).unionByName(
        pairs.filter("i <> j").withColumn("tile", F.col("j")).withColumn("side", F.lit(1))
    )
    dealt = tiles.select("uid", "label", "size", "tile").join(sides, ["label", "size", "tile"])
    dealt = dealt.join(nodes.select("uid", "vector", "copies"), "uid")
    found = dealt.groupBy("label", "size", "i", "j").applyInPandas(_compare(threshold, dim, axes), "u long, v long, n long")
    found = materialize(found, "links")
    member = components(found.filter("v >= 0").select("u", "v")).withColumnRenamed("node", "uid")
    counted = found.filter("v < 0").groupBy(F.col("u").alias("uid")).agg(F.sum("n").alias("n"))
    full = nodes.join(member, "uid", "left").join(counted, "uid", "left")
    full = materialize(
        full.select("label", "vector", "least", F.coalesce("root", "uid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "linked",
    )
    smallest = full.groupBy("root").agg(F.min("least").alias("component_id"))
    full = full.join(smallest, "root").select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), "n_links", "component_id")
    back = base.join(full, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left")
    component = F.when(F.col("vector").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return back.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
