"""Near-duplicate vectors by the epsilon grid order join (Boehm et al., 2001).

Unit vectors are sorted by the cells of a grid of side epsilon on their leading principal
dimensions. Runs of that order are blocks; two blocks are joined only if their boxes come within
epsilon, and inside a pair of blocks both runs are halved as long as their boxes allow.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, table
from tallyforge.llm.components import connected_components

#: Vectors in a block, vectors compared at once, and grid dimensions.
BLOCK, LEAF, LEADING = 1024, 128, 8
#: Added to epsilon against rounding of projections; the cosine alone decides.
SLACK = 1e-6


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny components stay above zero
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, dim)


def principal_directions(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector its leading principal directions, (length, up to LEADING)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array(batch.column(0).to_pylist(), int)
            for dim in np.unique(dims).tolist():
                x = np.pad(_unit(_matrix(batch.column(1).filter(pa.array(dims == dim)), dim)), ((0, 0), (1, 0)), constant_values=1.0)
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, total in sums.items():
            i, j = np.indices(total.shape)
            columns = [pa.array(np.full(total.size, dim)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "i", "j", "total"])

    parts = vectors.select("dim", "vector").mapInArrow(moments, "dim long, i long, j long, total double")
    totals: dict[int, np.ndarray] = {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect():  # (length + 1)^2 numbers
        totals.setdefault(r.dim, np.zeros((r.dim + 1, r.dim + 1)))[r.i, r.j] = r.total
    out = {}
    for dim, t in totals.items():
        mean = t[0, 1:] / t[0, 0]
        _, directions = np.linalg.eigh(t[1:, 1:] / t[0, 0] - np.outer(mean, mean))
        out[dim] = directions[:, ::-1][:, :LEADING]
    return out


def grid_blocks(vectors: DataFrame, epsilon: float, directions: dict[int, np.ndarray], block: int = BLOCK) -> DataFrame:
    """Blocks of at most `block` vectors, consecutive in epsilon grid order, of one label and length.

    (block, label, dim, lo, hi, nodes, counts, vectors): lo and hi bound the projections; the last
    three are packed arrays. Sorting is Spark's, by range, so a label of any size is spread out.
    """
    handed = vectors.sparkSession.sparkContext.broadcast(directions)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist(), int)
            out: list[list[int]] = [[] for _ in dims]
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                x = _unit(_matrix(batch.column("vector").filter(pa.array(dims == dim)), dim)) @ handed.value[dim]
                for row, cell in zip(rows.tolist(), np.floor(x / epsilon).astype(np.int64).tolist()):
                    out[row] = cell
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "cell"])

    celled = vectors.select("node", "label", "dim", "n", "vector").mapInArrow(
        cells, "node long, label string, dim int, n long, vector array<float>, cell array<long>"
    )
    ordered = celled.repartitionByRange("label", "dim", "cell", "node").sortWithinPartitions("label", "dim", "cell", "node")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "node", "label", "dim", "n", "vector")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        held: list[tuple] = []
        key = None

        def packed() -> pa.RecordBatch:
            part, label, dim = key
            x = np.array([h[2] for h in held], np.float32)
            projected = _unit(x.astype(np.float64)) @ handed.value[dim]
            values = [
                (part << 32) + number, label, dim, projected.min(0).tolist(), projected.max(0).tolist(),
                np.array([h[0] for h in held], "<i8").tobytes(), np.array([h[1] for h in held], "<i8").tobytes(), x.tobytes(),
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, BLOCK_FIELDS)], schema=BLOCK_FIELDS)

        for batch in batches:
            for part, node, label, dim, n, vector in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (key != (part, label, dim) or len(held) == block):
                    yield packed()
                    number += 1
                    held = []
                key = (part, label, dim)
                held.append((node, n, vector))
        if held:
            yield packed()

    return ordered.mapInArrow(blocks, BLOCK_SCHEMA)


BLOCK_SCHEMA = "block long, label string, dim int, lo array<double>, hi array<double>, nodes binary, counts binary, vectors binary"
BLOCK_FIELDS = pa.schema(
    [
        ("block", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())),
        ("hi", pa.list_(pa.float64())), ("nodes", pa.binary()), ("counts", pa.binary()), ("vectors", pa.binary()),
    ]
)


def close_blocks(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (a, b), a <= b, of blocks whose boxes come within epsilon.

    Blocks meet through the cells of the first dimension that they cover; the other dimensions are
    compared for those that meet.
    """
    slim = blocks.select("block", "label", "dim", "lo", "hi")
    first, last = F.floor(F.col("lo")[0] / epsilon), F.floor(F.col("hi")[0] / epsilon)
    a = slim.select(F.col("block").alias("a"), "label", "dim", F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence(first - 1, last + 1)).alias("cell"))
    b = slim.select(F.col("block").alias("b"), "label", "dim", F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.explode(F.sequence(first, last)).alias("cell"))
    apart = F.aggregate(
        F.arrays_zip("alo", "ahi", "blo", "bhi"),
        F.lit(0.0),
        lambda t, x: t + F.pow(F.greatest(x["alo"] - x["bhi"], x["blo"] - x["ahi"], F.lit(0.0)), 2),
    )
    near = a.join(b, ["label", "dim", "cell"]).where("a <= b").where(apart <= epsilon * epsilon)
    return near.select("a", "b").distinct()


def _adjacent(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, raw: tuple, cosine: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of x and y that reach the cosine; runs whose boxes are further apart than epsilon are skipped."""
    found: list[np.ndarray] = [np.empty((0, 2), np.int64)]
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        gap = np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0))
        gap = np.maximum(gap, 0)
        if gap @ gap > epsilon * epsilon:
            continue
        if b - a > LEAF or d - c > LEAF:
            if b - a >= d - c:
                m = (a + b) // 2
                todo += [(a, m, c, d), (m, b, c, d)]
            else:
                m = (c + d) // 2
                todo += [(a, b, c, m), (a, b, m, d)]
            continue
        value = x[a:b] @ y[c:d].T
        near = np.argwhere(value >= cosine - 1e-12)
        close = value[near[:, 0], near[:, 1]] < cosine + 1e-12
        if close.any():  # rounding could decide these
            kept = ~close
            for k in np.flatnonzero(close).tolist():
                u, v = raw[0][a + near[k, 0]].tolist(), raw[1][c + near[k, 1]].tolist()
                exact = fsum(s * t for s, t in zip(u, v)) / (sqrt(fsum(s * s for s in u)) * sqrt(fsum(t * t for t in v)))
                kept[k] = exact >= cosine
            near = near[kept]
        if len(near):
            found.append(near + (a, c))
    pairs = np.concatenate(found)
    return pairs[:, 0], pairs[:, 1]


def _pair_links(left: pa.Table, right: pa.Table, directions: dict[int, np.ndarray], cosine: float, epsilon: float) -> pa.Table:
    """Of one pair of blocks: (node, links, root), how many rows each linked node gains, and a node of its component."""
    a, b = left.slice(0, 1).to_pylist()[0], right.slice(0, 1).to_pylist()[0]
    unpack = lambda r: (np.frombuffer(r["nodes"], "<i8"), np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["vectors"], np.float32).reshape(-1, r["dim"]).astype(np.float64))
    (na, ca, xa), (nb, cb, xb) = unpack(a), unpack(b)
    ua, ub, base = _unit(xa), _unit(xb), directions[a["dim"]]
    i, j = _adjacent(ua, ub, ua @ base, ub @ base, (xa, xb), cosine, epsilon)
    if a["a"] == a["b"]:
        i, j = i[i != j], j[i != j]
    # rows of both blocks are numbered through; each takes the smallest node that its component has shown so far
    node, ends, others = np.concatenate([na, nb]), np.concatenate([i, j + len(na)]), np.concatenate([j + len(na), i])
    links = np.zeros(len(node), np.int64)
    np.add.at(links, ends, np.concatenate([ca, cb])[others])
    root = node.copy()
    if a["a"] == a["b"]:  # one block on both sides: a row's two numbers are one node
        ends, others = i, j
        node, links, root = na, links[: len(na)], na.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, ends, root[others])
        if (new == root).all():
            break
        root = new
    met = links > 0
    return pa.table({"node": node[met], "links": links[met], "root": root[met]})


def vector_links(vectors: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """Distinct vectors (node long, label string, dim int, n long, vector array<float>) -> (node, links, root).

    links counts the rows (n of each other vector) linked to a node in one pair of blocks; root is
    a node that the pair connects it with. A node may have several rows. Links themselves are not
    listed, so a large group of vectors that all link stays linear.
    """
    epsilon = sqrt(2 - 2 * cosine) + SLACK
    directions = principal_directions(vectors)
    blocks = cut(grid_blocks(vectors, epsilon, directions, block), "blocks")
    pairs = cut(close_blocks(blocks, epsilon), "block-pairs")
    payload = blocks.select("block", "dim", "nodes", "counts", "vectors")
    left = pairs.join(payload.withColumnRenamed("block", "a"), "a").select("a", "b", "dim", "nodes", "counts", "vectors")
    again = payload.toDF("b", "dim2", "nodes2", "counts2", "vectors2")
    right = pairs.toDF("a2", "b").join(again, "b").toDF("b", "a", "dim", "nodes", "counts", "vectors")
    handed = vectors.sparkSession.sparkContext.broadcast(directions)

    def joined(x: pa.Table, y: pa.Table) -> pa.Table:
        return _pair_links(x, y, handed.value, cosine, epsilon)

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(joined, "node long, links long, root long")


def vector_classes(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98
) -> DataFrame:
    """(id, n_links, component) for every row.

    Rows link when their labels are equal and not null, their vectors are of one length and the
    cosine in double precision is at least `cosine`. Vectors without a direction (null, zero, or with
    a null or non-finite component) link with nothing and are their own component. Equal vectors are
    one node, so copies cost nothing. A null id links like any other; a component's id is its smallest
    id that is not null.
    """
    source = rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<float>").alias("vector"),
    )
    source = source.withColumn("ok", F.coalesce(usable(F.col("vector")) & F.col("label").isNotNull(), F.lit(False)))
    linkable = source.where("ok")
    distinct = linkable.groupBy("label", "vector").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    distinct = distinct.select(
        F.monotonically_increasing_id().alias("node"), "label", F.size("vector").alias("dim"), "n", "vector", "least"
    )
    distinct = cut(distinct, "vectors")
    links = cut(vector_links(distinct.drop("least"), cosine), "vector-links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(links.selectExpr("node AS a", "root AS b"))
    nodes = distinct.join(counts, "node", "left").join(classes, "node", "left")
    nodes = nodes.select(
        "label", "vector", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")
    )
    nodes = cut(nodes, "vector-nodes")
    smallest = nodes.groupBy("root").agg(F.min("least").alias("component"))
    labelled = nodes.join(smallest, "root").select("label", "vector", "n_links", "component")
    found = linkable.join(labelled, ["label", "vector"]).select("id", "n_links", "component")
    alone = source.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return found.unionAll(alone)


def op3_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings at a cosine of 0.98 within a label.

    Repeated rows are all returned. An empty table gives no rows; other columns are not read. A row
    with a null vec_id is not kept.
    """
    found = vector_classes(table(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)"""
