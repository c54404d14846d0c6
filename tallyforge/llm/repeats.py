"""Removal of repeated byte strings by distributed prefix doubling.

A suffix array by prefix doubling ranks positions by ever longer strings: Spark sorts pairs of ranks at a
growing offset, equal pairs get one new rank, and positions whose pair is unique drop out. Here the lengths
grow from ANCHOR bytes over the cores of step 2 to the threshold, 64, 166 and 200 bytes:

1. Anchors prune the positions of the first length. Every threshold-long window picks the ANCHOR-byte gram
   with the least hash inside it (winnowing). Equal windows pick the same gram at the same place, so windows
   need comparing only where anchors are equal. Spark sorts the pairs (gram, hull), the hull being the
   bytes of all windows that picked the anchor. A gram that is alone drops out; equal hulls settle all of
   their windows at once.
2. What is left are unlike hulls around equal grams. Their windows are dealt into blocks by where they hold
   the anchor. Spark sorts the pairs (core, hull) of the blocks, the core being the bytes that all windows of
   a block share, all but a quarter of what the threshold adds to the gram. Cores that are alone drop
   out; equal hulls are settled.
3. The windows that stay are ranked at the threshold: Spark sorts the pairs (first half, second half) of
   their names. What occurs again is past the threshold, and repeated.

Each sort breaks ties by position and goes by range, so equal pairs of any number are dealt over partitions;
neighbours are compared within a partition and at most two rows of each partition across them. The rank of a
string is its 64-bit name, the same in all partitions; names are compared in pairs of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, drop_cut, table

#: Bytes of an anchor; windows of a text handled at a time.
ANCHOR, STEP = 64, 1 << 20

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64; the tables are made once and again only for more bytes."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(17, n.bit_length())
        ups, downs = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        ups[0] = downs[0] = 1
        _powers[:] = np.multiply.accumulate(ups), np.multiply.accumulate(downs)
    return _powers[0][:n], _powers[1][:n]


def gram_names(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit name for the `length` bytes that start at each position."""
    count = len(data) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    ups, downs = _power_tables(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * ups)])
    out = (sums[length:] - sums[:count]) * downs[:count]
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(factor)
    return out ^ (out >> np.uint64(32))


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(name, first window, number of windows, place of the anchor in the first window) of one text's anchors, in text order.

    The least name in a window wins, the first of equal ones; both depend on the window alone.
    """
    total = len(data) - length + 1
    found = []
    for at in range(0, total, STEP):
        names, picked = _picked(data[at : at + STEP + length - 1], length)
        starts = np.flatnonzero(np.r_[True, picked[1:] != picked[:-1]])
        found.append((names[picked[starts]], starts + at, np.diff(np.r_[starts, len(picked)]), picked[starts] - starts))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def _picked(piece: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The names of all grams, and the place of the one that each window picks."""
    span, windows = length - ANCHOR + 1, len(piece) - length + 1
    names = gram_names(piece, ANCHOR)
    keyed = (names & ~np.uint64(0x1FFFFF)) | np.arange(len(names), dtype=np.uint64)
    blocks = np.concatenate([keyed, np.full(-len(keyed) % span, 2**64 - 1, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return names, (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & np.uint64(0x1FFFFF)).astype(np.int64)


def anchors_of_several(data: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchors()...) of texts that lie end to end in data, cut at edges: the same rows as text by text.

    Windows that reach into the next text are left out. What a window picks lies in its own text, so picks change with the text.
    """
    if len(data) > 1 << 21:
        raise ValueError("more bytes than places have bits for")
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    names, picked = _picked(data, length)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[: len(picked)]
    whole = np.flatnonzero(np.arange(len(picked)) + length <= edges[1:][text])
    picked = picked[whole]
    starts = np.flatnonzero(np.r_[len(picked) > 0, picked[1:] != picked[:-1]])
    first = whole[starts]
    return text[first], names[picked[starts]], first - edges[text[first]], np.diff(np.r_[starts, len(picked)]), picked[starts] - first


#: Bytes of texts that are handled together; a longer text is handled alone.
TOGETHER = 1 << 17


def _parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes end to end, edges of the rows in them) of a column of binaries without nulls."""
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + TOGETHER, "right")) - 1)
        yield a, b, data[edges[a] : edges[b]], edges[a : b + 1] - edges[a]
        a = b


ROWS = "key long, seg long, t1 long, t2 long, s long, n int, o int"


def _batch(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, named)], [name for name, _ in named])


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """Name of the anchor and of its hull, the text, first window, number of windows, place of the anchor in the first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(i).to_numpy() for i in range(2))
            for a, b, data, edges in _parts(batch.column(2).fill_null(b"")):
                if b - a > 1:
                    text, names, first, count, place = anchors_of_several(data, edges, length)
                else:
                    names, first, count, place = anchors(data, length)
                    text = np.zeros(len(names), np.int64)
                if not len(names):
                    continue
                raw, at = data.tobytes(), first + edges[text]
                hulls = np.array([xxhash.xxh64_intdigest(raw[x:y]) for x, y in zip(at.tolist(), (at + count + length - 1).tolist())], np.uint64)
                yield _batch([names.view(np.int64), hulls.view(np.int64), t1[a + text], t2[a + text], first, count, place], ROWS)

    return docs.select("t1", "t2", "data").mapInArrow(rows, ROWS)


SETTLED, SINGLE, SAMPLE, EDGE = 0, 1, 2, 3
#: Added to EDGE: the run has more than one row here; its gram has other segments here.
AGAIN, OTHERS = 1, 2


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare sorted neighbours of a partition, a bounded share of all rows; drop grams that are alone.

    SETTLED: the segment occurs again. SINGLE: the gram does, in other segments only. SAMPLE: one or
    two rows of a settled segment whose gram has other segments too. Rows are sorted by gram and segment,
    so only the first and the last run of equal segments may go on in other partitions: one row of each
    is EDGE with what is known of it here, and a run of several rows is settled all the same.
    """
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    key, seg = (rows.column(c).to_numpy() for c in ("key", "seg"))
    same_key = np.r_[False, key[1:] == key[:-1], False]
    same_seg = np.r_[False, (seg[1:] == seg[:-1]), False] & same_key
    settled = same_seg[:-1] | same_seg[1:]
    other = (same_key[:-1] & ~same_seg[:-1]) | (same_key[1:] & ~same_seg[1:])
    firsts = np.flatnonzero(~same_seg[:-1])
    inner = np.zeros(len(key), bool)
    inner[(firsts[1] if len(firsts) > 1 else len(key)) : firsts[-1]] = True
    for kind, chosen in ((SETTLED, settled), (SINGLE, ~settled & other & inner), (SAMPLE, settled & other & inner)):
        some = rows.filter(pa.array(chosen))
        if kind == SETTLED:  # names are not needed any more
            for i, name in enumerate(("key", "seg")):
                some = some.set_column(i, name, pa.array(np.zeros(some.num_rows, np.int64)))
        yield from some.append_column("kind", pa.array(np.full(some.num_rows, kind, np.int32))).to_batches()
    edges = np.unique([0, firsts[-1]])
    ends = [firsts[1], len(key)] if len(firsts) > 1 else [len(key)]
    known = [EDGE + AGAIN * bool(settled[a]) + OTHERS * bool(other[a:b].any()) for a, b in zip(edges, ends)]
    yield from rows.take(pa.array(edges)).append_column("kind", pa.array(known, pa.int32())).to_batches()


def classed(rows: DataFrame) -> DataFrame:
    """Rows (key, seg, t1, t2, s, ...) whose key occurs again, with kind SETTLED, SINGLE or SAMPLE: one step of doubling."""
    rows = cut(rows, "pairs")
    order = ["key", "seg", "t1", "t2", "s"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", kind int"
    found = cut(ordered.mapInArrow(_classed, schema), "classed")
    drop_cut(rows)
    # at most two rows of each partition, whatever a gram's share of all rows
    bits = F.col("kind") - EDGE
    edges = found.where(F.col("kind") >= EDGE)
    edges = edges.withColumns({"again": bits.bitwiseAND(AGAIN) > 0, "others": bits.bitwiseAND(OTHERS) > 0})
    place = F.struct("t1", "t2", "s")
    segments = edges.groupBy("key", "seg").agg((F.max("again") | (F.count("*") > 1)).alias("repeats"), F.max("others").alias("others"), F.min(place).alias("rep"))
    keys = segments.groupBy("key").agg((F.max("others") | (F.count("*") > 1)).alias("others"))
    known = edges.drop("others").join(segments.drop("others"), ["key", "seg"]).join(keys, "key")
    settled = known.where("repeats AND NOT again").withColumn("kind", F.lit(SETTLED))  # the others are among the rows already
    single = known.where("NOT repeats AND others").withColumn("kind", F.lit(SINGLE))
    sample = known.where("repeats AND others").where(place == F.col("rep")).withColumn("kind", F.lit(SAMPLE))
    names = found.columns
    return found.where(F.col("kind") < EDGE).unionAll(settled.select(names)).unionAll(single.select(names)).unionAll(sample.select(names))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows with a pair (a, b) those equal to a neighbour (kind 0), a batch at a time with one row held back.

    The first and the last row of the partition have kind 1, or 2 if equal to a neighbour here.
    """
    held: pa.RecordBatch | None = None
    before, first = False, True  # whether the held row equals the one before it; whether it is the partition's first

    def out(rows: pa.RecordBatch, again: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
        kinds = np.where(kinds > 0, kinds + again, 0).astype(np.int32)
        kept = pa.array(again | (kinds > 0))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(kinds)], [*rows.schema.names, "kind"]).filter(kept)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        a, b = rows.column("a").to_numpy(), rows.column("b").to_numpy()
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        again = np.r_[before, same[:-1]] | same if len(a) > 1 else np.zeros(0, bool)
        kinds = np.zeros(len(again), np.int32)
        if first and len(kinds):
            kinds[0], first = 1, False
        if len(again):
            yield out(rows.slice(0, len(again)), again, kinds)
        held, before = rows.slice(len(again)), bool(same[-1]) if len(same) else before
    if held is not None:
        yield out(held, np.array([before]), np.array([1]))


def repeated_pairs(rows: DataFrame) -> DataFrame:
    """Rows (a long, b long, t1, t2, s, ...) whose pair (a, b) occurs in another row: one step of doubling.

    Sorted by range with the position as tie-breaker, so a pair of any number of rows is spread over partitions.
    """
    order = ["a", "b", "t1", "t2", "s"]
    rows = cut(rows, "pairs")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", kind int"
    found = cut(ordered.mapInArrow(_neighbours, schema), "repeated-pairs")
    drop_cut(rows)
    edges = found.where("kind > 0")  # at most two rows of each partition
    shared = edges.groupBy("a", "b").agg((F.max("kind") > 1).alias("here"), F.count("*").alias("n")).where("here OR n > 1")
    return found.where("kind = 0").unionAll(edges.join(shared.select("a", "b"), ["a", "b"], "left_semi").select(found.columns)).drop("kind")


def _with_texts(docs: DataFrame, rows: DataFrame, schema: str, named) -> DataFrame:
    """Rows (t1, t2, s, n, o, sample) next to the bytes of their texts.

    named(bytes of several texts, first byte of each row's text, {s, n, o}) yields (row, two names, further columns), rows by number.
    """
    wanted = cut(rows.groupBy("t1", "t2").agg(F.collect_list(F.struct("s", "n", "o", "sample")).alias("wanted")), "wanted")
    texts = docs.join(wanted.select("t1", "t2"), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("data").alias("data"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(c).to_numpy() for c in ("t1", "t2"))
            for a, b, data, edges in _parts(batch.column("data")):
                lists = batch.column("wanted").slice(a, b - a)
                flat = lists.flatten()
                w = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("s", "n", "o", "sample")}
                text = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy())
                for row, first, second, *others in named(data, edges[text], w):
                    yield _batch([first.view(np.int64), second.view(np.int64), t1[a + text[row]], t2[a + text[row]], *others, w["sample"][row]], schema)

    return texts.join(wanted, ["t1", "t2"]).mapInArrow(made, schema)


def block_size(length: int) -> int:
    """Places of an anchor in a window that make a block, about a quarter of all."""
    return -(-(length - ANCHOR + 1) // 4)


def _blocks(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """The windows of each row in blocks: (key, seg) are the names of core and hull, s and n the block's windows.

    Blocks are cut at places of the anchor that are multiples of block_size; the core is common to all
    windows that a block could have. Equal windows hold their anchors at equal places, so they fall into blocks
    of equal cores.
    """
    size = block_size(length)

    def named(data: np.ndarray, base: np.ndarray, w: dict) -> Iterator[tuple[np.ndarray, ...]]:
        raw, out = data.tobytes(), []
        for i, (at, s, n, o) in enumerate(zip(base.tolist(), w["s"].tolist(), w["n"].tolist(), w["o"].tolist())):
            p = at + s + o
            for block in range((o - n + 1) // size, o // size + 1):
                low, high = block * size, min(block * size + size, length - ANCHOR + 1) - 1
                first, last = p - min(high, o), p - max(low, o - n + 1)
                core = xxhash.xxh64_intdigest(raw[p - low : p - high + length], block)
                hull = xxhash.xxh64_intdigest(raw[first : last + length], p - first)
                out.append((i, core, hull, first - at, last - first + 1, p - first))
        if out:
            row, cores, hulls, *others = zip(*out)
            yield np.array(row), np.array(cores, np.uint64), np.array(hulls, np.uint64), *(np.array(x) for x in others)

    return _with_texts(docs, rows, f"{ROWS}, sample boolean", named)


def _windows(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(a, b, t1, t2, s, sample): names of both halves of each window."""
    half = length // 2

    def named(data: np.ndarray, base: np.ndarray, w: dict) -> Iterator[tuple[np.ndarray, ...]]:
        n = w["n"].astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        s = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + w["s"][row]
        at = base[row] + s
        for begin in range(0, len(data), STEP):
            own = np.flatnonzero((at >= begin) & (at < begin + STEP))
            if len(own):
                piece, place = data[begin : begin + STEP + length - 1], at[own] - begin
                yield row[own], gram_names(piece, half)[place], gram_names(piece, length - half)[place + half], s[own]

    return _with_texts(docs, rows, "a long, b long, t1 long, t2 long, s long, sample boolean", named)


def repeated_ranges(docs: DataFrame, length: int) -> DataFrame:
    """(t1, t2, data) -> (t1, t2, lo, hi): windows lo to hi of a text start a string that occurs elsewhere too."""
    settled = []
    found = classed(_anchor_rows(docs, length).withColumn("sample", F.lit(False)))
    for step in (_blocks, _windows):
        is_settled = F.col("kind") == SETTLED
        settled.append(found.where(is_settled & ~F.col("sample")).select("t1", "t2", F.col("s").alias("lo"), (F.col("s") + F.col("n") - 1).alias("hi")))
        rows = step(docs, found.where(~is_settled).withColumn("sample", F.col("sample") | (F.col("kind") == SAMPLE)), length)
        found = classed(rows) if step is _blocks else repeated_pairs(rows)
    windows = found.where("NOT sample").select("t1", "t2", F.col("s").alias("lo"), F.col("s").alias("hi"))
    return settled[0].unionAll(settled[1]).unionAll(windows)


def merged(lists: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of windows (lo, hi) -> the number of maximal spans of each list, and all their starts and ends, in order."""
    counts = lists.value_lengths().fill_null(0).to_numpy()
    flat = lists.flatten()
    lo, hi = (flat.field(i).to_numpy() for i in range(2))
    row = np.repeat(np.arange(len(lists), dtype=np.int64), counts)
    order = np.lexsort((lo, row))
    row, lo = row[order], lo[order]
    # rows lie far apart on one line, so that one running maximum serves all of them
    reached = np.maximum.accumulate((row << 40) + hi[order] + length)
    opens = np.r_[len(lo) > 0, (row[1:] << 40) + lo[1:] > reached[:-1]] if len(lo) else np.zeros(0, bool)
    firsts = np.flatnonzero(opens)
    ends = reached[np.r_[firsts[1:], len(lo)] - 1] if len(lo) else lo
    return np.bincount(row[firsts], minlength=len(lists)), lo[firsts], ends - (row[firsts] << 40)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(id, data, spans, kept) for every row: bytes of the text, removed spans and the bytes that stay.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else in any text, the
    same text included; matches never cross texts. spans are maximal, half-open and in order. Null text
    counts as empty. Rows with equal texts of `length` bytes or more lose them all. Ids are carried along
    and play no part. Columns other than these two are not read.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be at least {2 * ANCHOR}")
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    source = docs.select(F.col(id_col).cast("long").alias("id"), data.alias("data"))
    source = source.withColumn("t1", F.xxhash64("data")).withColumn("t2", F.xxhash64(F.lit(1), "data"))
    ranges = repeated_ranges(source.select("t1", "t2", "data").where(F.octet_length("data") >= length), length)
    lists = ranges.distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = source.join(lists, ["t1", "t2"], "left").select("id", "data", "ranges")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, edges in _parts(batch.column(1)):
                part = batch.slice(a, b - a)
                counts, start, end = merged(part.column(2), length)
                raw, offsets = data.tobytes(), np.r_[0, np.cumsum(counts)]
                kept = []
                for k, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    own = slice(offsets[k], offsets[k + 1])
                    cuts = [lo, *(np.stack([start[own], end[own]], 1).ravel() + lo).tolist(), hi]
                    kept.append(b"".join([raw[x:y] for x, y in zip(cuts[::2], cuts[1::2])]))
                spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])
                columns = [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "data", "spans", "kept"])

    return joined.mapInArrow(removed, "id long, data binary, spans array<struct<start: long, end: long>>, kept binary")


def op7_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 200 bytes that occur again.

    Null and empty texts have 0 bytes, nothing removed and the digest of nothing. Repeated rows are all
    returned. An empty table gives no rows.
    """
    found = without_repeats(table(spark, sf_dir, "documents"))
    length = F.octet_length("data").cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        length.alias("n_bytes"),
        (length - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
