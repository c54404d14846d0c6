"""SimHash near-duplicate classes by covering locality-sensitive hashing.

Covering hashing (Pagh, 2016): bit i of a fingerprint carries a vector phi(i) over
GF(2) of radius + 1 bits, and table v != 0 keeps the bits with <phi(i), v> = 1. The
vectors of any `radius` bits span at most `radius` dimensions, so some v is orthogonal
to all of them: its table ignores every differing bit and the pair collides there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, table
from tallyforge.llm.components import connected_components

BITS = 64
SEED = 42
#: Shingles hashed at a time, so that a very long text needs no more memory than this.
STEP = 1 << 16


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of one whole text in order, with their repeats, at most STEP at a time.

    A-Z is lower-cased, words are runs of other bytes than ASCII white space. Fewer words than
    `shingle` are one shingle; no word (null and empty texts too) gives none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
    size = min(shingle, len(words))
    firsts = starts[: len(words) - size + 1].tolist()
    ends = (starts + lengths)[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(firsts), STEP):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(firsts[at : at + STEP], ends[at : at + STEP])], np.uint64)


def fingerprint_of(parts: Iterable[np.ndarray]) -> int:
    """The bits set in over half of the hashes; none gives 0."""
    votes, total = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


def simhash64(text: str | None, shingle: int) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp long) for every row; fp holds the 64 bits as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((simhash64(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(hashed, "id long, fp long")


def cover(radius: int, bits: int = BITS) -> list[int]:
    """The masks of the 2^(radius+1) - 1 tables. phi deals the non-zero vectors out evenly."""
    vectors = 2 ** (radius + 1)
    phi = [1 + i % (vectors - 1) for i in range(bits)]
    return [sum(((p & v).bit_count() & 1) << i for i, p in enumerate(phi)) for v in range(1, vectors)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprint_links(prints: DataFrame, radius: int) -> DataFrame:
    """(fp long) distinct -> (a, b) links that connect exactly what lies within `radius` bits.

    `radius` is even. Each mask gives every fingerprint one bucket; only fingerprints that share
    a bucket go on. A pair within the radius meets at a point half-way: both differ from it in at
    most radius / 2 bits, all of which the mask ignores. Whatever meets at one point lies within
    the radius of each other, so the smallest there stands for the rest and links stay linear
    in a bucket of any size. A point is met by no more fingerprints than its Hamming ball holds.
    """
    if radius < 2 or radius % 2:
        raise ValueError("radius must be even and at least 2")
    masks = cover(radius)
    buckets = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])
    spread = prints.select("fp", F.posexplode(buckets).alias("v", "bucket"))
    shared = spread.groupBy("v", "bucket").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi")
    together = spread.join(shared.select("v", "bucket"), ["v", "bucket"])
    free = [[0] + [_signed(1 << i) for i in range(BITS) if not m >> i & 1] for m in masks]
    flips = F.element_at(F.array(*[F.array(*[F.lit(x) for x in row]) for row in free]), F.col("v") + 1)
    near = together.select("fp", "v", F.col("fp").alias("point"))
    for _ in range(radius // 2):
        near = near.withColumn("bit", F.explode(flips)).select("fp", "v", F.expr("point ^ bit").alias("point"))
    met = near.groupBy("point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return met.select("a", F.explode("all").alias("b")).where("a <> b").distinct()


def simhash_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """(id, fp, component) for every row, component the smallest id reachable by links.

    Rows link when their fingerprints differ in `radius` bits or fewer. Equal fingerprints are
    one node, so a group of copies of any size adds no links. Null, empty and blank texts have
    fingerprint 0 and link like any other. Rows with a null id keep a component, the smallest
    id of their class (null if the class has none). Other columns of docs are not read.
    """
    prints = cut(with_fingerprint(docs, id_col, text_col, shingle), "fingerprints")
    roots = fingerprint_classes(prints.select("fp"), radius)
    members = prints.groupBy("fp").agg(F.min("id").alias("least")).join(roots, "fp")
    members = cut(members, "members")
    smallest = members.groupBy("root").agg(F.min("least").alias("component"))
    labelled = members.join(smallest, "root").select("fp", "component")
    return prints.join(labelled, "fp").select("id", "fp", "component")


def fingerprint_classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fp) with repeats -> (fp, root) distinct: fingerprints of one class share a root."""
    distinct = cut(prints.distinct(), "distinct")
    classes = connected_components(fingerprint_links(distinct, radius))
    return distinct.join(classes, distinct.fp == classes.node, "left").select("fp", F.coalesce("component", "fp").alias("root"))


def op6_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 3-word shingles, links at 2 or fewer differing bits.

    Null, empty and blank texts have fingerprint 0. Repeated rows are all returned. An empty
    table gives no rows; columns other than doc_id and text are not read.
    """
    found = simhash_classes(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
