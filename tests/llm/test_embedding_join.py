import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tallyforge.llm import embedding_join as ej
from tests.llm.helpers import CLASHING


def write(folder, rows, **extra):
    ids, vectors, labels = zip(*rows) if rows else ((), (), ())
    columns = {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}
    columns |= {k: pa.array(v, pa.int64()) for k, v in extra.items()}
    pq.write_table(pa.table(columns), f"{folder}/embeddings.parquet")
    return str(folder)


def brute(rows):
    """[(id, n_links, component)] by comparing every pair."""

    def ok(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        (_, u, a), (_, v, b) = rows[i], rows[j]
        if not ok(u, a) or not ok(v, b) or a != b or len(u) != len(v):
            return False
        u, v = (np.array(x, np.float32).astype(float).tolist() for x in (u, v))
        dot = math.fsum(x * y for x, y in zip(u, v))
        return dot / (math.sqrt(math.fsum(x * x for x in u)) * math.sqrt(math.fsum(y * y for y in v))) >= 0.98

    near = [[j for j in range(len(rows)) if j != i and linked(i, j)] for i in range(len(rows))]
    out = []
    for i, (key, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((key, len(near[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted(out, key=str)


def planted(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            base = np.array(rows[rng.integers(len(rows))][1])
            vector = base * rng.uniform(0.5, 2) + rng.normal(0, 0.13 * np.linalg.norm(base) / math.sqrt(dim), dim) * rng.integers(0, 2)
        else:
            vector = rng.normal(size=dim)
        rows.append((k * 3 % 1009, vector.astype(np.float32).tolist(), int(rng.integers(0, 2))))
    return rows


def test_small_blocks_match_brute_force(spark, monkeypatch):
    rows = planted(1, 260)
    monkeypatch.setattr(ej, "LEAF", 4)
    monkeypatch.setattr(ej.vector_links, "__defaults__", (16,))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted([tuple(r) for r in ej.vector_classes(df).collect()], key=str)
    want = brute(rows)
    assert got == want and len({c for _, _, c in want}) < 200


def test_query_on_edge_rows(spark, tmp_path):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, None, 0), (2, [0.0, 0.0, 0.0], 0), (3, [1.0, None, 2.0], 0), (4, [math.nan, 1.0, 1.0], 0), (5, [math.inf, 1.0, 1.0], 0),
        (6, v, None), (7, v, 0), (8, v, 0), (8, v, 0), (9, [2.0, 4.0, 6.0], 0), (10, v, 1), (11, [1.0, 2.0], 0), (12, [], 0),
        (None, v, 0), (13, [1e-30, 2e-30, 3e-30], 1), (14, [3.0, -2.0, 0.5], 0),
    ]
    extra = {k: [v] * len(rows) for k, v in {**CLASHING, "root": 1, "links": 2, "dim": 3}.items()}
    found = ej.op3_grid_join(spark, write(tmp_path, rows, **extra)).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in found], key=str) == brute(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)
    empty = tmp_path / "empty"
    empty.mkdir()
    assert ej.op3_grid_join(spark, write(empty, [])).collect() == []


def test_boundary_is_decided_exactly(spark):
    # cos = 0.98 to the last bit or so: the exact sum decides, not the order of a matrix product
    rows = [(i, [math.cos(a), math.sin(a)], 0) for i, a in enumerate((0.0, math.acos(0.98), -math.acos(0.98), math.acos(0.98) * 2))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted([tuple(r) for r in ej.vector_classes(df).collect()], key=str) == brute(rows)
