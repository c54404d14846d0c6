import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import repeats
from tests.llm.helpers import clashing, write_documents


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = int(np.sum(np.diff(np.r_[False, gone].astype(int)) == 1))
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}é" for _ in range(900)]

    def text(k):
        return " ".join(rng.choice(words) for _ in range(k))

    passages = [text(rng.randrange(20, 90)) for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and texts:
            base = list(rng.choice(texts))
            for _ in range(rng.randrange(4)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice("xyz")
            texts.append("".join(base))
        elif kind < 0.7:
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            texts.append(text(rng.randrange(40)) + rng.choice([p, p[cut:], p[:cut], p + p]) + text(rng.randrange(40)))
        else:
            texts.append(text(rng.randrange(120)))
    return texts


def run(spark, tmp_path, texts):
    rows = repeats.op7_prefix_doubling(spark, write_documents(tmp_path, texts)).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("seed", [3, 4])
def test_query_matches_brute_force(spark, tmp_path, seed):
    texts = corpus(seed, 150)
    want = brute(texts)
    assert run(spark, tmp_path, texts) == want
    assert 20 < sum(0 < w[1] < w[0] for w in want)


@pytest.mark.parametrize("step", [300, 1 << 20])
def test_equal_windows_pick_equal_anchors(monkeypatch, step):
    monkeypatch.setattr(repeats, "STEP", step)
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 5000, dtype=np.uint8)
    data[3000:4500] = data[500:2000]
    names, first, count, place = repeats.anchors(data, 200)
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == 4801
    of_window = np.repeat(names, count)
    assert (of_window[3000:4301] == of_window[500:1801]).all()
    grams = repeats.gram_names(data, repeats.ANCHOR)
    assert (grams[first + place] == names).all()


def test_one_step_of_doubling(spark):
    """Rows whose pair occurs again, wherever the partitions' borders lie and however many rows share a pair."""
    rng = random.Random(5)
    for partitions, kinds in ((1, 3), (4, 1), (13, 40), (7, 400), (5, 10**6)):
        pairs = [(rng.randrange(kinds), rng.randrange(3)) for _ in range(300)]
        rows = spark.createDataFrame([(a, b, 0, 0, i, "x") for i, (a, b) in enumerate(pairs)], "a long, b long, t1 long, t2 long, s long, more string")
        before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            found = repeats.repeated_pairs(rows).collect()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        count = Counter(pairs)
        assert sorted(r["s"] for r in found) == [i for i, p in enumerate(pairs) if count[p] > 1]


@pytest.mark.parametrize("length", [128, 200, 203])
def test_other_lengths(spark, tmp_path, length):
    texts = corpus(length, 80)
    rows = repeats.without_repeats(spark.read.parquet(write_documents(tmp_path, texts)), length=length).collect()
    got = [(len(r.data), len(r.data) - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in sorted(rows, key=lambda r: r.id)]
    assert got == brute(texts, length)


def test_periodic_and_long_texts(spark, tmp_path):
    rng = random.Random(8)
    long = "".join(rng.choice("abcd ") for _ in range(4000))
    texts = [long[:2500], long[700:], "ab" * 150, "ab" * 99, "x" * 199, "y" * 200, "z" * 201, long[1000:1199], long[1000:1200]]
    want = brute(texts)
    assert run(spark, tmp_path, texts) == want
    assert want[4][1] == want[5][1] == 0 and want[6][1] == 201


def test_edge_rows(spark, tmp_path):
    texts = [None, "", "short", "short", "é" * 150, "é" * 150, "w" * 300_000]
    ids = [1, 2, 3, 3, None, 5, 6]
    rows = repeats.op7_prefix_doubling(spark, write_documents(tmp_path, texts, ids, **clashing(7), data=[1] * 7, t1=[1] * 7)).collect()
    want = sorted((-1 if i is None else i, *w) for i, w in zip(ids, brute(texts[:6]) + [(300_000, 300_000, 1, hashlib.sha256(b"").hexdigest())]))
    assert sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in rows) == want
    empty = tmp_path / "empty"
    empty.mkdir()
    assert repeats.op7_prefix_doubling(spark, write_documents(empty, [])).collect() == []


@pytest.mark.parametrize("partitions", [1, 2, 13])
def test_runs_that_cross_partitions(spark, partitions):
    """Grams and segments that fill whole partitions are classed as if all rows lay side by side."""
    rng = random.Random(partitions)
    pairs = [(5, 50)] * 60 + [(6, rng.randrange(40)) for _ in range(60)] + [(rng.randrange(9), rng.randrange(4)) for _ in range(40)]
    pairs += [(100 + i, 1) for i in range(20)]
    rows = [(k, s, i, i, 0, 1, 0) for i, (k, s) in enumerate(pairs)]
    made = spark.createDataFrame(rows, repeats.ROWS)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = repeats.classed(made).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    count = Counter(pairs)
    kinds = Counter(k for k, _ in count)
    at = {kind: sorted(r["t1"] for r in found if r["kind"] == kind) for kind in (repeats.SETTLED, repeats.SINGLE, repeats.SAMPLE)}
    assert at[repeats.SETTLED] == [i for i, p in enumerate(pairs) if count[p] > 1]
    assert at[repeats.SINGLE] == [i for i, p in enumerate(pairs) if count[p] == 1 and kinds[p[0]] > 1]
    assert {pairs[i] for i in at[repeats.SAMPLE]} == {p for p in pairs if count[p] > 1 and kinds[p[0]] > 1}


@pytest.mark.parametrize("together", [300, 1 << 17])
def test_texts_together_have_the_rows_of_each(monkeypatch, together):
    """Steps over texts that lie end to end give what each text gives alone."""
    monkeypatch.setattr(repeats, "TOGETHER", together)
    rng = np.random.default_rng(5)
    texts = [b"", *[rng.integers(97, 100, n, np.uint8).tobytes() for n in (199, 200, 450, 3, 201, 0, 1000, 257)], b"a" * 500]
    column = pa.array([b"x" * 50, *texts], pa.binary()).slice(1)
    found, seen = [], 0
    for a, b, data, edges in repeats._parts(column):
        assert a == seen and data.tobytes() == b"".join(texts[a:b]) and (b - a == 1 or len(data) <= together)
        seen = b
        found += [(a + t, *x) for t, *x in zip(*[c.tolist() for c in repeats.anchors_of_several(data, edges, 200)])]
    want = [(i, *x) for i, t in enumerate(texts) for x in zip(*[c.tolist() for c in repeats.anchors(np.frombuffer(t, np.uint8), 200)])]
    assert seen == len(texts) and found == want and len({i for i, *_ in found}) == 6


def test_windows_merge_into_maximal_spans():
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    lists = [[{"lo": 9, "hi": 9}], None, [{"lo": 500, "hi": 510}, {"lo": 0, "hi": 300}, {"lo": 20, "hi": 30}, {"lo": 711, "hi": 711}], [], [{"lo": 0, "hi": 0}]]
    counts, start, end = repeats.merged(pa.array(lists, kind).slice(1), 200)
    assert (counts.tolist(), start.tolist(), end.tolist()) == ([0, 2, 0, 1], [0, 711, 0], [710, 911, 200])
