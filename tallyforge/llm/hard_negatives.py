"""Hard negatives by an orthogonal rotation onto principal directions.

Vectors of whole numbers are rotated so that their leading components carry most of every inner product.
Blocks of anchors meet streams of rows: partial products over the leading components, plus and minus the product of
the norms of what is left and a slack for rounding, bound each score. A row whose bounds cannot enter an anchor's list
is discarded early; whoever survives is decided by the product of whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, table

#: Anchors of a cell, and rows that a cell may stream past them.
ANCHORS, ROWS = 2048, 1 << 20
#: Anchors and rows bounded at once, and numbers multiplied at once when survivors are verified.
TILE, CHUNK, GATHERED = 128, 2048, 1 << 21
#: Squared norm from which a score times 100 could leave a long.
MOST_SQUARED = float(2**55)
NONE, NO_ID = -(2**63) + 1, 2**63 - 1

CELL = ["bucket", "block", "line"]
OUT = "node long, own long, goal long, id long, score long"


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """(id, label, dim, vector array<long>, anchor) of the rows that take part, equal rows once."""
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(vector, lambda x: x * scale)
    squared = F.aggregate(scaled, F.lit(0.0), lambda t, x: t + (F.abs(x) + 1) * (F.abs(x) + 1))
    usable = F.col(id_col).isNotNull() & label.isNotNull() & vector.isNotNull() & ~bad & (squared < MOST_SQUARED)
    out = rows.where(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.size(vector).alias("dim"),
        F.transform(scaled, lambda x: F.floor(x)).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    return out.groupBy("id", "label", "dim", "vector").agg(F.bool_or("anchor").alias("anchor"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector an orthogonal matrix, its columns by falling second moment (products are not centred)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                x = _matrix(batch.filter(pa.array(dims == dim)), dim).astype(np.float64)
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, total in sums.items():
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, dim)), *[pa.array(v.ravel()) for v in (i, j, total)]], ["dim", "i", "j", "total"])

    parts = rows.select("dim", "vector").mapInArrow(moments, "dim long, i long, j long, total double")
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).collect():  # length squared numbers
        out.setdefault(r.dim, np.zeros((r.dim, r.dim)))[r.i, r.j] = r.total
    return {dim: np.linalg.eigh((t + t.T) / 2)[1][:, ::-1] for dim, t in out.items()}


class _Side:
    """Vectors of whole numbers, their rotation, and the norms of what lies beyond each stage."""

    def __init__(self, whole: np.ndarray, rotation: np.ndarray, stages: list[int]):
        self.whole, self.turned = whole, whole.astype(np.float64) @ rotation
        squares = self.turned * self.turned
        self.rest = {k: np.sqrt(squares[:, k:].sum(1)) for k in stages}
        self.norm = np.sqrt(squares.sum(1))

    def rows(self, at: slice) -> _Side:
        part = object.__new__(_Side)
        part.whole, part.turned, part.norm = self.whole[at], self.turned[at], self.norm[at]
        part.rest = {k: v[at] for k, v in self.rest.items()}
        return part


class _Cell:
    """Anchors of one cell with the best rows found so far for each of their windows."""

    def __init__(self, batches: list[pa.RecordBatch], rotation: np.ndarray, keep: int, same: bool, window: Callable):
        held = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        dim = len(rotation)
        self.stages = sorted({k for k in (dim // 4, dim // 2) if 0 < k < dim}) or [dim]
        self.rotation, self.keep, self.same = rotation, keep, same
        self.slack = 8 * (dim + 8) * 2.0**-52
        self.side = _Side(_matrix(held, dim), rotation, self.stages)
        self.node, self.id = (held.column(c).to_numpy() for c in ("node", "id"))
        codes = pc.dictionary_encode(held.column("label"))
        self.labels, self.code = codes.dictionary, codes.indices.to_numpy()
        goals = held.column("goals").to_pylist()
        wide = max(map(len, goals))
        self.goal = np.array([g + [0] * (wide - len(g)) for g in goals], np.int64)
        self.low, self.high = window(self.goal)
        unused = np.arange(wide)[None, :] >= np.array([len(g) for g in goals])[:, None]
        self.low[unused], self.high[unused] = 2**62, -(2**62)
        self.best = np.full((self.goal.size, keep), NONE)
        self.best_id = np.full((self.goal.size, keep), NO_ID)

    def meet(self, batch: pa.RecordBatch) -> None:
        side = _Side(_matrix(batch, len(self.rotation)), self.rotation, self.stages)
        ids = batch.column("id").to_numpy()
        code = pc.fill_null(pc.index_in(batch.column("label"), value_set=self.labels), -1).to_numpy()
        for b in range(0, len(ids), CHUNK):
            rows = slice(b, b + CHUNK)
            part = side.rows(rows)
            for a in range(0, len(self.id), TILE):
                self._tile(slice(a, a + TILE), part, ids[rows], code[rows])

    def _tile(self, at: slice, rows: _Side, ids: np.ndarray, code: np.ndarray) -> None:
        mine = self.side.rows(at)
        able = (self.code[at, None] == code) == self.same
        able &= self.id[at, None] != ids
        wide = self.goal.shape[1]
        first = self.stages[0]
        partial = mine.turned[:, :first] @ rows.turned[:, :first].T
        margin = np.outer(mine.rest[first], rows.rest[first]) + self.slack * np.outer(mine.norm, rows.norm)
        upper, lower = partial + margin, partial - margin
        worst = self.best.reshape(-1, wide, self.keep)[at, :, -1]
        floors = np.nextafter(np.maximum(worst, self.low[at]).astype(np.float64), -np.inf)
        tops = np.nextafter(self.high[at].astype(np.float64), np.inf)
        alive = np.zeros_like(able)
        for w in range(wide):
            floor, top = floors[:, w, None], tops[:, w, None]
            if len(ids) >= self.keep and (worst[:, w] == NONE).any():
                # rows sure to lie in the window: the last of the best of them is a floor for all others
                sure = np.where(able & (upper <= top) & (lower >= floor), lower, -np.inf)
                floors[:, w] = np.maximum(floors[:, w], np.partition(sure, len(ids) - self.keep, axis=1)[:, len(ids) - self.keep])
            alive |= (upper >= floor) & (lower <= top)
        i, j = np.nonzero(alive & able)
        step = max(1, GATHERED // max(1, len(self.rotation)))
        for s in range(0, len(i), step):
            self._verify(at.start, i[s : s + step], j[s : s + step], partial, mine, rows, ids, floors, tops)

    def _verify(self, start: int, i: np.ndarray, j: np.ndarray, partial: np.ndarray, mine: _Side, rows: _Side, ids: np.ndarray, floors: np.ndarray, tops: np.ndarray) -> None:
        value = partial[i, j]
        for before, k in zip(self.stages, self.stages[1:]):
            value = value + np.einsum("nk,nk->n", mine.turned[i, before:k], rows.turned[j, before:k])
            margin = mine.rest[k][i] * rows.rest[k][j] + self.slack * mine.norm[i] * rows.norm[j]
            alive = (((value + margin)[:, None] >= floors[i]) & ((value - margin)[:, None] <= tops[i])).any(1)
            i, j, value = i[alive], j[alive], value[alive]
        score = np.einsum("nk,nk->n", mine.whole[i], rows.whole[j])
        anchor = i + start
        wide = self.goal.shape[1]
        for w in range(wide):
            in_window = (score >= self.low[anchor, w]) & (score <= self.high[anchor, w]) & (score >= self.best[anchor * wide + w, -1])
            self._merge(anchor[in_window] * wide + w, score[in_window], ids[j[in_window]])

    def _merge(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(key)
        if not len(touched):
            return
        keys = np.concatenate([key, np.repeat(touched, self.keep)])
        scores = np.concatenate([score, self.best[touched].ravel()])
        names = np.concatenate([ids, self.best_id[touched].ravel()])
        order = np.lexsort((names, -scores, keys))
        place = order[np.searchsorted(keys[order], touched)[:, None] + np.arange(self.keep)]
        self.best[touched], self.best_id[touched] = scores[place], names[place]

    def found(self) -> pa.RecordBatch:
        key, k = np.nonzero(self.best != NONE)
        a = key // self.goal.shape[1]
        columns = [self.node[a], self.id[a], self.goal.ravel()[key], self.best_id[key, k], self.best[key, k]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in OUT.split(", ")])


def _searched(handed, keep: int, same: bool, window: Callable):
    """Rows sorted by cell, anchors first -> the best rows of each anchor's windows; one cell's anchors are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, cell = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in (*CELL, "kind")])
            ends = [*(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            begin = 0
            for end in ends:
                if end == begin:
                    continue
                part, now, kind = batch.slice(begin, end - begin), tuple(marks[:3, begin].tolist()), marks[3, begin]
                if now != key:
                    if cell is not None:
                        yield cell.found()
                    key, waiting, cell = now, [], None
                if kind == 0:
                    waiting.append(part)
                elif waiting or cell is not None:
                    if cell is None:
                        cell = _Cell(waiting, handed.value.get(part.column("dim")[0].as_py(), np.zeros((0, 0))), keep, same, window)
                        waiting = []
                    cell.meet(part)
                begin = end
        if cell is not None:
            yield cell.found()

    return run


def _best(rows: DataFrame, anchors: DataFrame, bucket: list[str], handed, keep: int, same: bool, window: Callable) -> DataFrame:
    """The `keep` best rows of each anchor and goal (OUT), out of the rows of its bucket.

    A bucket's anchors lie in blocks and its rows in lines, both dealt by hash, and each block streams each line past
    itself. So a bucket of any size is spread out, a task holds one block, and nothing is sent to all tasks.
    """
    spark = rows.sparkSession
    a, b = anchors.groupBy(*bucket).agg(F.count("*").alias("a")), rows.groupBy(*bucket).agg(F.count("*").alias("n"))
    sizes = cut(a.join(b, bucket).select(F.monotonically_increasing_id().alias("bucket"), *bucket, "a", "n"), "buckets")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = 4 * spark.sparkContext.defaultParallelism
    blocks = F.ceil(F.col("a") / ANCHORS)
    lines = F.greatest(F.ceil(F.col("n") / ROWS), F.ceil(F.col("n") * wanted / F.lit(max(1, total)) / blocks))
    sizes = sizes.select("bucket", *bucket, blocks.cast("int").alias("blocks"), lines.cast("int").alias("lines"))
    cells = sizes.agg(F.coalesce(F.sum(F.col("blocks") * F.col("lines")), F.lit(1))).first()[0]
    common = ["dim", "label", "vector"]
    left = anchors.join(sizes, bucket).select(
        "bucket", F.expr("pmod(xxhash64(node), blocks)").cast("int").alias("block"), F.explode(F.expr("sequence(0, lines - 1)")).alias("line"),
        F.lit(0).alias("kind"), "node", "id", *common, "goals",
    )
    right = rows.join(sizes, bucket).select(
        "bucket", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.expr("pmod(xxhash64(id), lines)").cast("int").alias("line"),
        F.lit(1).alias("kind"), F.lit(None).cast("long").alias("node"), "id", *common, F.lit(None).cast("array<long>").alias("goals"),
    )
    dealt = left.unionAll(right).repartition(int(min(cells, 100_000)), *CELL).sortWithinPartitions(*CELL, "kind")
    return dealt.mapInArrow(_searched(handed, keep, same, window), OUT)


def hard_negatives(
    rows: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores between floor(scale * vector).

    Positives of an anchor are its best rows of the same label and another id; negatives of a positive the best rows of
    other labels whose score lies between low and high percent of the positive's, both ends included. The higher score
    comes first, then the smaller id. Rows with a null id, label or vector, with a null or non-finite component, or of a
    squared norm of MOST_SQUARED and more (scores would leave a long) take no part; equal rows count once, and rows of
    one id with different vectors are rows of their own. Vectors of different lengths do not meet.
    """
    source = whole_vectors(rows, id_col, vector_col, label, anchor, scale)
    source = cut(source, "whole-vectors")
    # of equal vectors of one label only the smallest ids can be listed, one of which may be the anchor itself
    copies = W.partitionBy("label", "dim", "vector").orderBy("id")
    slim = source.withColumn("__n", F.row_number().over(copies)).where(F.col("__n") <= max(positives, negatives) + 1).drop("__n", "anchor")
    slim = cut(slim, "slim-vectors")
    anchors = cut(source.where("anchor").select(F.monotonically_increasing_id().alias("node"), "id", "label", "dim", "vector"), "anchors")
    handed = rows.sparkSession.sparkContext.broadcast(rotations(slim))

    # labels of few rows share buckets, others have their own
    per_label = slim.groupBy("dim", "label").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") >= ROWS // 64, F.concat(F.lit("own:"), "label")).otherwise(F.concat(F.lit("shared:"), F.expr("pmod(xxhash64(label), 64)")))
    groups = cut(per_label.select("dim", "label", own.alias("group")), "label-groups")
    everything = lambda goal: (np.full(goal.shape, -(2**62)), np.full(goal.shape, 2**62))
    grouped = [df.join(groups, ["dim", "label"]) for df in (slim, anchors.withColumn("goals", F.array(F.lit(0).cast("long"))))]
    found = _best(*grouped, ["dim", "group"], handed, positives, True, everything)
    first = W.partitionBy("node").orderBy(F.desc("score"), "id")
    chosen = found.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= positives)
    chosen = cut(chosen.select("node", F.col("own").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("goal")), "positives")

    goals = chosen.where("goal >= 0").groupBy("node").agg(F.collect_set("goal").alias("goals"))  # no score lies between the bounds of one below zero
    percent = lambda goal: (-(-low * goal // 100), high * goal // 100)
    found = _best(slim, anchors.join(goals, "node"), ["dim"], handed, negatives, False, percent)
    best = W.partitionBy("node", "goal").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).drop("own")
    out = chosen.join(ranked, ["node", "goal"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("goal").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_pca_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every row of embeddings whose vec_id is divisible by 50; labels are moved on where vec_id is divisible by 7.

    An empty table gives no rows; columns other than vec_id, embedding and label are not read.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


ORACLE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
n AS (
  SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 3"""
