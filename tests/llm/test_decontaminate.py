import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tallyforge.llm import decontaminate as dc
from tests.llm.helpers import clashing, write_documents


def brute_score(query, target, s=dc.Settings()):
    table = [[0] * (len(target) + 1) for _ in range(len(query) + 1)]
    best = 0
    for i, a in enumerate(query, 1):
        for j, b in enumerate(target, 1):
            step = s.match if a == b else s.mismatch
            table[i][j] = max(0, table[i - 1][j - 1] + step, table[i - 1][j] + s.gap, table[i][j - 1] + s.gap)
            best = max(best, table[i][j])
    return best


def write_benchmark(folder, texts, ids=None):
    table = pa.table({"item_id": pa.array(ids or list(range(len(texts))), pa.int64()), "text": pa.array(texts, pa.string())})
    pq.write_table(table, f"{folder}/benchmark.parquet")


def corpus(seed=4):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in"]
    rare = [f"w{i}" for i in range(400)]

    def text(n):
        return [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]

    items = [text(rng.randrange(12, 50)) for _ in range(12)]
    docs = [text(rng.randrange(5, 200)) for _ in range(40)]
    for k, item in enumerate(items):
        for edits in (0, 0.1, 0.2):
            leak = [w if rng.random() > edits else rng.choice(["", "edit", w + " more"]) for w in item]
            docs.append([*text(30), *leak, *text(rng.randrange(60))])
        docs.append([*item[: len(item) // 4], *text(40)])
    docs.append(["the"] * 500)
    return [" ".join(x) for x in items], [" ".join(x) for x in docs]


def test_alignment_matches_the_textbook_table():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(1, 6, rng.integers(1, 15)), rng.integers(1, 6, rng.integers(1, 25))
        score, end = dc.smith_waterman(a, b, dc.Settings())
        assert score == brute_score(a.tolist(), b.tolist()) == brute_score(a.tolist(), b[:end].tolist())


def test_query_matches_alignment_of_everything_with_everything(spark, tmp_path):
    items, texts = corpus()
    write_benchmark(tmp_path, items)
    found = dc.op2_seed_align(spark, write_documents(tmp_path, texts)).collect()
    got = {(r.doc_id, r.item_id): r.score for r in found}
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            q = dc.words_of(item)
            share = brute_score(q, dc.words_of(t)) / (2 * len(q))
            if share >= 0.5 or share * len(q) >= 40:
                want[i, j] = round(share, 6)
    assert got == want and len(want) >= 30
    for r in found:
        words = dc.words_of(texts[r.doc_id])[r.first_word : r.end_word]
        q = dc.words_of(items[r.item_id])
        assert round(brute_score(q, words) / (2 * len(q)), 6) == r.score


def test_small_filter_gives_the_same(spark, tmp_path):
    items, texts = corpus(9)
    write_benchmark(tmp_path, items)
    path = write_documents(tmp_path, texts)
    docs, bench = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    whole = sorted(dc.leaks(docs, bench).collect())
    crowded = sorted(dc.leaks(docs, bench, settings=dc.Settings(filter_bits=1 << 15)).collect())
    assert whole and whole == crowded


def test_seeds_of_common_words_are_the_rarest_half(spark, tmp_path):
    """With every n-gram of the corpus too common, the rarest half of each item still finds its copies."""
    items, texts = corpus(12)
    write_benchmark(tmp_path, items)
    path = write_documents(tmp_path, texts)
    docs, bench = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    found = {(r.id, r.item) for r in dc.leaks(docs, bench, settings=dc.Settings(rare=0.0, few=0)).collect()}
    assert found >= {(i, j) for i, t in enumerate(texts) for j, item in enumerate(items) if item in t}


def test_edge_rows(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta"
    write_benchmark(tmp_path, [item, item.upper() + "!", None, "", "the the", item + " null id"], [5, 3, 6, 7, 8, 9])
    texts = [None, "", "...", item, item, "x " * 100_000 + item + " y" * 1000, "the the the", "clean text of its own"]
    path = write_documents(tmp_path, texts, [0, 1, 2, 3, 3, None, 6, 7], **clashing(8))
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.item_id) for r in dc.op2_seed_align(spark, path).collect())
    assert got == [(-1, 3), (-1, 9), (3, 3), (3, 3), (3, 9), (3, 9), (6, 8)]
    bench = spark.read.parquet(f"{path}/benchmark.parquet")
    assert sorted(map(tuple, dc.item_classes(bench).collect())) == [(3, 3), (5, 3), (8, 8), (9, 9)]


def test_short_items_and_null_ids(spark, tmp_path):
    write_benchmark(tmp_path, ["yes", "Yes!", "no way", "four words are few", "one two three four five six"], [4, 2, 3, 6, None])
    texts = ["oh yes of course", "no such way", "there is no way out", "Four words, are few.", "yesterday", "one two three four five six"]
    path = write_documents(tmp_path, texts)
    rows = dc.op2_seed_align(spark, path).collect()
    got = {(r.doc_id, r.item_id): (r.n_items, r.score, r.first_word, r.end_word) for r in rows}
    assert got == {(0, 2): (2, 1.0, 1, 2), (2, 3): (1, 1.0, 2, 4), (3, 6): (1, 1.0, 0, 4), (5, None): (1, 1.0, 0, 6)}
    docs, bench = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    assert [r.doc_id for r in dc.with_leak(docs, bench).where("leaked").collect()] == [5]


def test_empty_tables(spark, tmp_path):
    write_benchmark(tmp_path, ["a b c d e f g"])
    assert dc.op2_seed_align(spark, write_documents(tmp_path, [])).collect() == []
    write_benchmark(tmp_path, [])
    assert dc.op2_seed_align(spark, write_documents(tmp_path, ["a b c d e f g"])).collect() == []
