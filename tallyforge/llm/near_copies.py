"""Near copies by exact shingle similarity: covering SimHash proposes pairs, MinHash bands what it cannot reach.

At a shingle similarity of 0.8 fingerprints of 64 bits differ in 10 bits on average and often in 17, for which
covering needs 2^18 - 1 tables a row. Covering therefore finds the closest copies only; the bands find the rest. Each band is
the hash of ROWS minima of the shingle set; a pair of similarity s misses all bands with probability
(1 - s^ROWS)^BANDS, 0.0006 at 0.8 and 1e-6 at 0.85. Pairs whose minima agree in too few of their last two bits are not compared;
at a similarity of 0.8 that is 0.0001 of all. Every other pair that shares a bucket is decided on its whole shingle sets.

Texts that share buckets, directly or through others, are a unit if comparing all of them is no more work than bucket by
bucket, else each bucket is one. A unit's texts lie in blocks, and tasks compare pairs of blocks, with each text's set sent
once for every block of its unit. A task hands on a tree of links for each group that it finds connected, never pairs. So there is one
round of comparisons whatever the groups look like, and what moves grows with the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import collect_garbage, cut, small_batches
from tallyforge.llm.components import connected_components
from tallyforge.llm.simhash import fingerprint_classes, fingerprint_of, shingle_hashes

SHINGLE, SEED, RADIUS = 5, 42, 2
#: Least similarity as a fraction, so that the decision is one of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 40, 8
#: Minima that must agree in their last two bits: 3.7 standard deviations below what 0.8 gives.
AGREE = 248
#: Texts of a block; rows up to which texts are picked out by a broadcast list of their hashes, 24 bytes a row.
BLOCK, LISTED = 512, 500_000
#: Shingles permuted at a time, so that a very long text needs no more memory than this; shingles in a batch handed on.
STEP, HANDED = 1 << 11, 1 << 17
_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1)
FLIPS = _random.integers(0, 2**32, BANDS * ROWS, np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; A-Z is lower-cased, fewer words than SHINGLE are one shingle."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, SHINGLE)]))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the set under each permutation; hashes are not empty."""
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), STEP):
        permuted = short[at : at + STEP, None] ^ FLIPS
        permuted *= FACTORS
        least = np.minimum(least, permuted.min(0))
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)), np.uint64, BANDS).view(np.int64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed long a band; none for a text without words."""
    return bands_of(minima(hashes)) if len(hashes) else np.empty(0, np.int64)


def sketch_of(least: np.ndarray) -> np.ndarray:
    """The last two bits of each minimum, 32 to a signed long."""
    pairs = (least & np.uint32(3)).astype(np.uint64).reshape(-1, 32)
    return (pairs << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(1, dtype=np.uint64).view(np.int64)


LONGS = BANDS * ROWS // 32


MARKS = "id long, h1 long, h2 long, node long, size long, fp long, bands array<long>, sketch array<long>"


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash, size, fingerprint, bands and sketch of each text's shingle set."""
    types = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 2
    for batch in batches:
        rows = []
        for key, h1, h2, text in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
            parts = list(shingle_hashes(text.as_py(), SHINGLE))
            own = np.unique(np.concatenate([np.empty(0, np.uint64), *parts]))
            node, fp = np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED), fingerprint_of(parts)], np.uint64).view(np.int64).tolist()
            least = minima(own) if len(own) else None
            rows.append((key, h1, h2, node, len(own), fp, [] if least is None else bands_of(least), [0] * LONGS if least is None else sketch_of(least)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in MARKS.split(", ")])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, set) of each text; batches out are bounded by their shingles."""
    rows: list[tuple] = []
    held = 0
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.int64())))], ["node", "set"])
    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows.append((node, shingles(text.as_py()).view(np.int64)))
            held += len(rows[-1][1])
            if held > HANDED:
                yield batch_of()
                rows, held = [], 0
    if rows:
        yield batch_of()


def _sets_of(nodes: DataFrame, source: DataFrame) -> DataFrame:
    """(node, set) of the nodes (node, first) given; each text is read once more, and of equal sets one."""
    wanted = cut(nodes.select("node", "first.h1", "first.h2"), "wanted")
    if wanted.count() <= LISTED:
        wanted = F.broadcast(wanted)
    texts = source.select("h1", "h2", "text").join(wanted, ["h1", "h2"]).select("node", "text").dropDuplicates(["node"])
    return cut(texts.mapInArrow(_sets, "node long, set array<long>"), "sets")


def _units(entries: DataFrame) -> DataFrame:
    """(bucket, node) of buckets with several nodes -> (unit, node) distinct, so that nodes of one bucket share a unit.

    Nodes that buckets connect are one unit, unless comparing them bucket by bucket takes fewer pairs.
    """
    sizes = entries.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("n"))
    edges = entries.join(sizes, "bucket").select(F.col("node").alias("a"), F.col("least").alias("b"))
    joined = cut(connected_components(edges), "joined")
    per_bucket = sizes.join(joined, F.col("least") == F.col("node")).select("bucket", "component", F.col("n").cast("double").alias("n"))
    by_bucket = per_bucket.groupBy("component").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    whole = joined.groupBy("component").agg(F.count("*").cast("double").alias("m")).join(by_bucket, "component")
    whole = cut(whole.select("component", (F.col("m") * F.col("m") <= F.col("pairs")).alias("together")), "components")
    together = joined.join(whole.where("together"), "component").select(F.col("component").alias("unit"), F.lit(0).alias("kind"), "node")
    apart = entries.join(per_bucket.join(whole.where("NOT together"), "component").select("bucket"), "bucket")
    return together.unionAll(apart.select(F.col("bucket").alias("unit"), F.lit(1).alias("kind"), "node"))


CELL = ["kind", "unit", "i", "j"]


def _links(entries: DataFrame, nodes: DataFrame, source: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly what similar pairs of nodes that share a bucket connect."""
    units = cut(_units(entries), "units")
    collect_garbage(entries.sparkSession)
    counts = units.groupBy("kind", "unit").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.expr("pmod(xxhash64(node), blocks)").cast("int")
    dealt = units.join(counts, ["kind", "unit"]).select("kind", "unit", "node", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = dealt.select("kind", "unit", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block")
    members = units.select("node").distinct()
    sets = _sets_of(nodes.select("node", "first").join(members, "node"), source)
    payload = nodes.select("node", "sketch").join(sets, "node")
    full = cells.join(payload, "node").repartition(*CELL).sortWithinPartitions(*CELL)
    return full.select(*CELL, "node", "block", "sketch", "set").mapInArrow(_compared, "a long, b long")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell -> links of each cell's connected groups to their roots."""
    key, held = None, []
    for batch in batches:
        marks = np.stack([batch.column(c).to_numpy() for c in CELL])
        ends = [*(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        begin = 0
        for end in ends:
            if end > begin:
                now = tuple(marks[:, begin].tolist())
                if now != key and held:
                    yield from _cell_links(held)
                    held = []
                key = now
                held.append(batch.slice(begin, end - begin))
                begin = end
    if held:
        yield from _cell_links(held)


def _cell_links(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, block = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("node", "block"))
    if len(node) < 2:
        return
    sketch = np.concatenate([p.column("sketch").flatten().to_numpy() for p in parts]).reshape(len(node), LONGS).view(np.uint64)
    lengths = np.concatenate([p.column("set").value_lengths().to_numpy() for p in parts]).astype(np.int64)
    values = np.concatenate([p.column("set").flatten().to_numpy() for p in parts]).view(np.uint64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    root = similar_groups(block, sketch, values, starts)
    met = root != np.arange(len(node))
    if met.any():
        yield pa.RecordBatch.from_arrays([pa.array(node[met]), pa.array(node[root[met]])], ["a", "b"])


PAIRED = np.uint64(0x5555555555555555)


def similar_groups(block: np.ndarray, sketch: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text the first text of its group; groups are what pairs of similar sets connect, of different blocks if there are two.

    A text is compared with those behind it that are not in its group yet, all at once.
    """
    p, q = LEAST
    n, two = len(block), block.min() != block.max()
    sizes = np.diff(starts)
    root = np.arange(n)
    for i in range(n - 1):
        behind = np.arange(i + 1, n)
        behind = behind[(root[behind] != root[i]) & (sizes[behind] * q >= sizes[i] * p) & (sizes[i] * q >= sizes[behind] * p)]
        if two:
            behind = behind[block[behind] != block[i]]
        if not len(behind):
            continue
        other = sketch[behind] ^ sketch[i]
        differ = np.bitwise_count((other | (other >> np.uint64(1))) & PAIRED).sum(1, dtype=np.int64)
        behind = behind[BANDS * ROWS - differ >= AGREE]
        if not len(behind):
            continue
        own = values[starts[i] : starts[i + 1]]
        spans = sizes[behind]
        first = np.cumsum(spans) - spans
        places = np.repeat(starts[behind] - first, spans) + np.arange(spans.sum())
        at = np.searchsorted(own, values[places])
        hits = own[np.minimum(at, len(own) - 1)] == values[places]
        both = np.add.reduceat(hits, first, dtype=np.int64)
        linked = behind[both * q >= (sizes[i] + spans - both) * p]
        if len(linked):
            groups = np.unique(root[np.append(linked, i)])
            root[np.isin(root, groups)] = groups[0]
    return root


def _row_of_each(docs: DataFrame, first: DataFrame, marks: DataFrame, id_col: str, h1: Column, h2: Column) -> DataFrame:
    """The rows of docs with id, h1 and h2 as in first; of several the one with the least hash of all columns."""
    names = docs.columns
    rows = docs.withColumns({"__1": h1, "__2": h2, "__key": F.col(id_col).cast("long")})

    def those(df: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
        wanted = wanted.toDF("__i", "__a", "__b")
        return df.join(wanted, F.col("__key").eqNullSafe(F.col("__i")) & (F.col("__1") == F.col("__a")) & (F.col("__2") == F.col("__b")), how)

    kept = those(rows, first, "left_semi")
    again = marks.groupBy("id", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("id", "h1", "h2")
    again = cut(again, "repeated-rows")
    if again.isEmpty():
        return kept.select(names)
    several = those(kept, again, "left_semi").groupBy("__key", "__1", "__2").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("__row"))
    return those(kept, again, "left_anti").select(names).unionAll(several.select("__row.*"))


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class of near copies the row with the smallest id (nulls first), with all of its columns.

    Texts link when the Jaccard similarity of their sets of SHINGLE words in a row is at least LEAST; texts
    of equal sets are one node first, texts without words one class. Rows of one id and one class are
    told apart by their text, rows of one id and text by the hash of all their columns; equal rows are one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h1, h2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    source = docs.select(F.col(id_col).cast("long").alias("id"), h1.alias("h1"), h2.alias("h2"), text.alias("text"))
    small_batches(docs.sparkSession)
    marks = cut(source.mapInArrow(_marked, MARKS), "marks")
    least = F.min(F.struct("id", "node", "h1", "h2")).alias("first")
    one = [F.first(c).alias(c) for c in ("bands", "sketch")]  # the same in all rows of a node
    nodes = cut(marks.groupBy("node").agg(least, F.max("size").alias("size"), F.min("fp").alias("fp"), *one), "nodes")

    # nodes of one class of fingerprints within the radius share a bucket, as those with a band in common do
    prints = nodes.where("size > 0").select("node", "fp")
    classes = fingerprint_classes(prints.select("fp"), RADIUS)
    covered = prints.join(classes, "fp").select(F.xxhash64(F.lit("fingerprint"), "root").alias("bucket"), "node")
    spread = nodes.select(F.explode("bands").alias("bucket"), "node").unionAll(covered)
    shared = spread.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    entries = cut(spread.join(shared.select("bucket"), "bucket"), "entries")
    collect_garbage(docs.sparkSession)
    links = cut(_links(entries, nodes, source), "links")
    collect_garbage(docs.sparkSession)

    classes = connected_components(links).withColumnRenamed("component", "joined")
    roots = nodes.join(classes, "node", "left").select("first", F.coalesce("joined", "node").alias("root"))
    first = roots.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.h1", "first.h2")
    return _row_of_each(docs, first, marks, id_col, h1, h2)
