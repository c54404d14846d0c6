"""Hierarchical weighted hash tree: region, rack and shard are drawn level by level.

Every node draws a number for a key that depends on the key and the node alone,
-ln(u) / weight, and the smallest draw among siblings wins. A node therefore wins
with a probability in proportion to its weight, and when one weight changes the
only rows that move are those that the changed node wins or loses: movement
stays in the subtrees whose weights change.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, table

#: Number of parts in which the rows of a shard are numbered; a task numbers one part.
PARTS = 4096


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple[Node, ...] = field(default=())
    shard: int = -1


def uniform_tree(shards: int, base: int = 24, per_rack: int = 4, racks: int = 3) -> tuple[Node, ...]:
    """Regions of a tree with `shards` equal shards.

    The first `base` shards fill regions of `racks` racks with `per_rack` shards each.
    Every later shard comes with a region and a rack of its own, so that it takes rows
    from the others and no row moves between those.
    """
    regions = []
    width = per_rack * racks
    for first in range(0, min(shards, base), width):
        rack_nodes = []
        for start in range(first, min(first + width, shards, base), per_rack):
            leaves = tuple(Node(f"shard{s}", 1.0, (), s) for s in range(start, min(start + per_rack, first + width, shards, base)))
            rack_nodes.append(Node(f"rack{start}", float(len(leaves)), leaves))
        regions.append(Node(f"region{first}", sum(r.weight for r in rack_nodes), tuple(rack_nodes)))
    regions += [Node(f"region{s}", 1.0, (Node(f"rack{s}", 1.0, (Node(f"shard{s}", 1.0, (), s),)),)) for s in range(max(base, 0), shards)]
    return tuple(regions)


def draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight with u in (0, 1) from the first 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(node.name + ":"), key).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**52))) / F.lit(node.weight)


def _winner(key: Column, nodes: tuple[Node, ...]) -> Column:
    """Index of the sibling with the smallest draw; weights of zero or less never win."""
    open_nodes = [(i, n) for i, n in enumerate(nodes) if n.weight > 0]
    if not open_nodes:
        raise ValueError("no sibling has a positive weight")
    if len(open_nodes) == 1:
        return F.lit(open_nodes[0][0])
    return F.array_min(F.array(*[F.struct(draw(key, n).alias("d"), F.lit(i).alias("i")) for i, n in open_nodes]))["i"]


def _choose(column: str, branches: list[tuple[int, Column]]) -> Column:
    out = None
    for i, value in branches:
        out = F.when(F.col(column) == i, value) if out is None else out.when(F.col(column) == i, value)
    return out


def assign_shards(df: DataFrame, key: Column, regions: tuple[Node, ...], name: str = "shard") -> DataFrame:
    """Add `name`, `name`_region and `name`_rack; only the siblings on a row's own path are drawn.

    A null key is placed like an empty string. The columns added replace columns of those names.
    """
    region, rack, own = f"{name}_region", f"{name}_rack", "__key"
    out = df.withColumn(own, F.coalesce(key.cast("string"), F.lit("")))
    out = out.withColumn(region, _winner(F.col(own), regions))
    out = out.withColumn(rack, _choose(region, [(i, _winner(F.col(own), r.children)) for i, r in enumerate(regions)]))
    paths = [
        (i, _choose(rack, [(j, _leaf(F.col(own), k.children)) for j, k in enumerate(r.children)]))
        for i, r in enumerate(regions)
    ]
    return out.withColumn(name, _choose(region, paths)).drop(own)


def _leaf(key: Column, leaves: tuple[Node, ...]) -> Column:
    if len(leaves) == 1:
        return F.lit(leaves[0].shard)
    return F.element_at(F.array(*[F.lit(n.shard) for n in leaves]), _winner(key, leaves) + 1)


def number_in_shards(df: DataFrame, shard: str, order: list[str], slot: str = "slot", parts: int = PARTS) -> DataFrame:
    """Number the rows of each shard from 0 without a gap.

    Equal rows are counted before anything is shuffled. The rows of a shard are
    dealt to `parts` parts by a hash of `order`; parts are numbered by themselves
    and start after the rows of the parts before them, so no task holds a shard.
    `order` must name every column of df but the shard.
    """
    counted = df.groupBy(shard, *order).agg(F.count("*").alias("__n"))
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
    part = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % parts
    counted = cut(counted.withColumn("__part", part), "shard-rows")
    sizes = counted.groupBy(shard, "__part").agg(F.sum("__n").alias("__size"))
    before = W.partitionBy(shard).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(shard, "__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    within = W.partitionBy(shard, "__part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("__at", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(starts, [shard, "__part"])
    first = F.col("__start") + F.col("__at")
    placed = placed.withColumn(slot, F.explode(F.sequence(first, first + F.col("__n") - 1)))
    return placed.drop("__n", "__part", "__start", "__at")


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """Put all documents into shards by doc_id under the law `key`.

    Null texts have 8 bytes and no checksum (null); empty texts have 8 bytes and checksum 0.
    Repeated rows share a shard and take slots of their own. A null doc_id is placed
    like an empty key. An empty table gives no rows; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    key = F.col("doc_id").cast("string")
    placed = assign_shards(docs, key, uniform_tree(shards, shards))
    placed = assign_shards(placed, key, uniform_tree(shards + 1, shards), "grown_shard")
    placed = placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard")
    numbered = number_in_shards(placed, "shard", ["doc_id", "size", "text_crc32", "grown_shard"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def _sql_draw(name: str, weight: float) -> str:
    return f"-ln((CAST('0x' || substr(md5('{name}:' || k), 1, 13) AS BIGINT)::DOUBLE + 0.5) / {float(2**52)!r}) / {weight!r}"


def _sql_winner(nodes: tuple[Node, ...]) -> str:
    if len(nodes) == 1:
        return "0"
    return f"list_position([{', '.join(_sql_draw(n.name, n.weight) for n in nodes)}], list_min([{', '.join(_sql_draw(n.name, n.weight) for n in nodes)}])) - 1"


def _sql_shard(regions: tuple[Node, ...]) -> str:
    def leaf(rack: Node) -> str:
        return f"[{', '.join(str(n.shard) for n in rack.children)}][({_sql_winner(rack.children)}) + 1]"

    def rack(region: Node) -> str:
        return "CASE " + _sql_winner(region.children) + " " + " ".join(f"WHEN {j} THEN {leaf(k)}" for j, k in enumerate(region.children)) + " END"

    return "CASE " + _sql_winner(regions) + " " + " ".join(f"WHEN {i} THEN {rack(r)}" for i, r in enumerate(regions)) + " END"


def oracle_sql(shards: int = 24) -> str:
    """DuckDB SQL for op1. The CRC table is built by a recursive rule, and texts are folded byte by byte."""
    return f"""
WITH RECURSIVE steps AS (
  SELECT i::BIGINT AS byte, i::BIGINT AS x, 0 AS s FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, s + 1 FROM steps WHERE s < 8),
crc AS (SELECT list(x ORDER BY byte) AS t FROM steps WHERE s = 8),
d AS (SELECT doc_id, text, coalesce(CAST(doc_id AS VARCHAR), '') AS k FROM documents),
p AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 8 AS size,
    CASE WHEN text IS NULL THEN NULL ELSE xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(text)) + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))),
      lambda a, b: xor(a // 256, t[(xor(a, b) % 256) + 1])), 4294967295) END AS text_crc32,
    {_sql_shard(uniform_tree(shards, shards))} AS shard,
    {_sql_shard(uniform_tree(shards + 1, shards))} AS grown_shard
  FROM (SELECT *, hex(encode(text)) AS h FROM d), crc),
q AS (
  SELECT *, CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR), coalesce(CAST(text_crc32 AS VARCHAR), ''), CAST(grown_shard AS VARCHAR))), 1, 8) AS BIGINT) % {PARTS} AS part FROM p)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, size, text_crc32 NULLS FIRST, grown_shard) - 1 AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard
FROM q"""
