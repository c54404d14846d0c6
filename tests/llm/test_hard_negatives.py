import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyforge.llm import hard_negatives as hn
from tests.llm.helpers import CLASHING


def brute(rows, positives=5, negatives=3):
    """(vec_id, vector, label) -> the result, by every pair in Python's whole numbers."""
    known = set()
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        known.add((key, tuple(math.floor(256 * float(np.float32(x))) for x in vector), (label + 1) % 10 if key % 7 == 0 else label))
    out = []
    for key, vector, label in known:
        if key % 50:
            continue
        others = [(-sum(a * b for a, b in zip(vector, v)), k, other) for k, v, other in known if k != key and len(v) == len(vector)]
        for score, k, _ in sorted(x for x in others if x[2] == label)[:positives]:
            fit = sorted(x for x in others if x[2] != label and 50 * -score <= 100 * -x[0] <= 95 * -score)
            out += [(key, k, r + 1, n, -score, -s) for r, (s, n, _) in enumerate(fit[:negatives])]
    return sorted(out)


def write(folder, rows, **extra):
    keys, vectors, labels = zip(*rows) if rows else ((), (), ())
    columns = {"vec_id": pa.array(keys, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}
    pq.write_table(pa.table({**columns, **{k: pa.array([v] * len(rows)) for k, v in extra.items()}}), f"{folder}/embeddings.parquet")
    return str(folder)


def found(spark, folder):
    return sorted(tuple(r) for r in hn.op11_pca_negatives(spark, folder).collect())


@pytest.mark.parametrize("dim,spread", [(1, 1.0), (3, 1.0), (24, 0.2), (24, 3.0)])
def test_equals_brute_force(spark, tmp_path, dim, spread):
    rng = np.random.default_rng(dim)
    centres = rng.normal(0, 1, (10, dim))
    rows = []
    for i in range(700):
        label = int(rng.integers(10))
        rows.append((i, (centres[label] + rng.normal(0, spread, dim)).tolist(), label))
    assert found(spark, write(tmp_path, rows, **CLASHING)) == brute(rows)


def test_ties_copies_and_rows_that_take_no_part(spark, tmp_path):
    rng = random.Random(1)
    vector = lambda: [rng.choice((0.5, 0.25, -0.25)) for _ in range(4)]  # noqa: E731  many equal scores
    rows = [(i, vector(), rng.randrange(3)) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5], 1) for i in range(60)] + [(2000 + i, [0.45, 0.5, 0.5, 0.4], 2) for i in range(60)]
    rows += [(None, vector(), 1), (50, None, 1), (100, [0.1, None, 0.1, 0.1], 1), (150, [math.nan] * 4, 1), (200, [math.inf, 0, 0, 0], 2), (250, vector(), None)]
    rows += [(300, [0.0] * 4, 1), (350, [1.0, 2.0], 1), (351, [1.0, 2.0], 1), (352, [0.6, 1.0], 2), (400, [], 1), (401, [], 1), (402, [], 2)]
    rows += rows[:40] + [(450, [0.5, 0.5, 0.25, 0.25], 1), (450, [0.25, 0.5, 0.5, 0.25], 2)]
    assert found(spark, write(tmp_path, rows)) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert found(spark, write(tmp_path, [])) == []


def test_several_blocks_and_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hn, "ANCHORS", 3)
    monkeypatch.setattr(hn, "ROWS", 64)
    rng = np.random.default_rng(9)
    rows = [(i * 5, rng.normal(0, 1, 8).tolist(), int(rng.integers(4))) for i in range(500)]
    assert found(spark, write(tmp_path, rows)) == brute(rows)


def test_bounds_hold_and_rule_rows_out():
    rng = np.random.default_rng(4)
    low = rng.normal(0, 1, (2000, 4)) @ rng.normal(0, 200, (4, 32)) + rng.normal(0, 4, (2000, 32))
    whole = np.floor(low).astype(np.int64)
    rotation = np.linalg.eigh((whole.T @ whole).astype(float))[1][:, ::-1]
    side = hn._Side(whole, rotation, [8, 16])
    exact = whole[:50] @ whole.T
    partial = side.turned[:50, :8] @ side.turned[:, :8].T
    margin = np.outer(side.rest[8][:50], side.rest[8]) + 8 * 40 * 2.0**-52 * np.outer(side.norm[:50], side.norm)
    assert (np.abs(exact - partial) <= margin).all()
    best = np.partition(exact, -4, axis=1)[:, -4]
    assert ((partial + margin) >= best[:, None]).mean() < 0.05  # nearly all rows go after a quarter of the components


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, name):
    folder = f"/root/testdata/{name}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert found(spark, folder) == sorted(con.execute(hn.ORACLE_SQL).fetchall())
