import zlib
from collections import Counter, defaultdict

from tallyforge.llm import sharding
from tests.llm.helpers import clashing, write_documents


def test_edge_rows(spark, tmp_path):
    texts = [None, "", "é" * 3, "same", "same", "x" * 100_000, "same"]
    ids = [1, 2, 3, 4, 4, 5, None]
    rows = sharding.op1_hash_tree_shards(spark, write_documents(tmp_path, texts, ids, **clashing(7))).collect()
    assert len(rows) == 7
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].size == 8 and by_id[1].text_crc32 is None
    assert by_id[2].size == 8 and by_id[2].text_crc32 == 0
    assert by_id[3].size == 14 and by_id[3].text_crc32 == zlib.crc32("é".encode() * 3)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_table(spark, tmp_path):
    assert sharding.op1_hash_tree_shards(spark, write_documents(tmp_path, [])).collect() == []


def test_growth_moves_rows_only_into_the_new_shard(spark):
    keys = spark.range(20_000)
    for n in (24, 25, 31):
        df = sharding.assign_shards(keys, keys.id, sharding.uniform_tree(n))
        df = sharding.assign_shards(df, keys.id, sharding.uniform_tree(n + 1), "grown")
        moved = [r for r in df.select("shard", "grown").collect() if r.shard != r.grown]
        assert moved and {r.grown for r in moved} == {n}
        assert abs(len(moved) / 20_000 - 1 / (n + 1)) < 0.01


def test_weights_decide_and_movement_stays_in_the_changed_subtree(spark):
    def tree(weight):
        leaf = lambda s, w=1.0: sharding.Node(f"s{s}", w, (), s)
        racks = [(leaf(0), leaf(1)), (leaf(2), leaf(3, weight))]
        nodes = tuple(sharding.Node(f"k{i}", sum(x.weight for x in r), r) for i, r in enumerate(racks))
        other = (sharding.Node("k9", 4.0, (leaf(4, 4.0),)),)
        return (sharding.Node("r0", sum(x.weight for x in nodes), nodes), sharding.Node("r1", 4.0, other))

    keys = spark.range(20_000)
    df = sharding.assign_shards(keys, keys.id, tree(1.0))
    df = sharding.assign_shards(df, keys.id, tree(3.0), "after").select("shard", "after").collect()
    counts = Counter(r.shard for r in df)
    assert abs(counts[4] / 20_000 - 0.5) < 0.02 and abs(counts[0] / 20_000 - 0.125) < 0.02
    # rows leave for the grown region, rack and shard, never out of them
    assert not [r for r in df if r.shard == 3 and r.after != 3]
    assert not [r for r in df if r.shard != r.after and r.after in (4,)]
