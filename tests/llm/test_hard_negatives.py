"""Hard negatives against all pairs in DuckDB, odd rows, and how much the bounds leave out."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as h
from tidemark.llm.queries import SQL

KIND = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def vectors(n, seed=3, dim=8, groups=4):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, dim))
    return [(i, [float(np.float32(x)) for x in centers[i % groups] + 0.4 * r.normal(size=dim)], int(i % groups)) for i in range(n)]


def duck(rows):
    con = duckdb.connect()
    con.register("given", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}))
    con.execute("CREATE TABLE embeddings AS SELECT * FROM given")
    return sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({SQL['op12_tree_bound_negatives']})").fetchall())


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in more.pop("extra", ())})
    return sorted(tuple(r) for r in h.mine(df, **more).select(COLUMNS).collect())


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(h, "TREE", 5)
    monkeypatch.setattr(h, "BLOCK", 64)


def test_equals_all_pairs(spark, small):
    rows = vectors(900)
    rows += [(900 + i, rows[50][1], 1) for i in range(60)] + [(1000 + 50 * i, rows[0][1], 2) for i in range(8)]  # copies, and anchors that are
    want = duck(rows)
    assert len(want) > 100 and mined(spark, rows, extra=("tree", "block", "part", "key", "n")) == want


def test_odd_rows(spark, small):
    rows = vectors(200)
    rows += [(None, [1.0] * 8, 1), (201, None, 1), (202, [1.0] * 8, None), (203, [1.0, None] + [0.0] * 6, 1), (204, [float("nan")] * 8, 1), (205, [float("inf")] * 8, 1), (250, [0.0] * 8, 1), (206, [-0.001] * 8, -3)]
    assert mined(spark, rows) == duck(rows)
    # vectors of other lengths count as filled with zeros, of rows that repeat an id one takes part
    short = [*rows, (300, [1.5, 0.25], 1), (301, [], 1), (302, [1.0] * 12, 1)]
    assert mined(spark, [*short, (300, [9.0], 3), (300, [1.5, 0.25], 1)]) == mined(spark, short)
    padded = [(i, (v + [0.0] * 12)[:12] if v is not None else None, n) for i, v, n in short]
    assert mined(spark, short) == duck(padded)


def test_empty_and_single(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_large_components_are_exact(spark, small):
    """Scores beyond what doubles hold exactly are summed as integers."""
    big = 4_000_000.0
    rows = [(0, [big, 3.0, 1.0], 0), *[(i, [big, float(i), -1.0], 1) for i in range(1, 7)], *[(10 + i, [0.75 * big, float(i), 5.0], 2) for i in range(5)]]
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows}
    got = mined(spark, rows)
    assert got and all(r[4] == sum(a * b for a, b in zip(q[r[0]], q[r[1]])) and r[5] == sum(a * b for a, b in zip(q[r[0]], q[r[3]])) for r in got)


def test_bounds_leave_candidates_out():
    """On vectors in tight groups most scores at children are never worked out; equal anchors need none at all."""
    r = np.random.default_rng(5)
    centers = r.normal(size=(6, 16)) * 256
    v = np.floor(np.repeat(centers, 40, axis=0) + r.normal(size=(240, 16)))
    order, parents, edges = h.spanning_tree(v[::4])
    assert sorted(order) == list(range(60)) and all(parents[k] < k for k in range(1, 60))
    a = v[::4][order]
    assert np.allclose(edges[1:], np.linalg.norm(a[1:] - a[parents[1:]], axis=1))
    cells = lambda x, labels: {"ids": np.arange(len(x)).astype("<i8").tobytes(), "labels": labels.astype("<i4").tobytes(), "vectors": h._pack(x), "n": len(x), "dim": 16}
    labels = np.repeat(np.arange(6), 40)
    w = h.Walk(cells(a, labels[::4][order]) | {"parents": parents.tobytes(), "edges": edges.tobytes()}, cells(v, labels))
    for k in range(60):
        w.enter(k)
        if k == 0:
            w.score(0, np.arange(240))
        s = v @ a[k]
        assert (w.low[k] <= s).all() and (s <= w.high[k]).all()
    w.scored = 0
    assert list(h._positives(w)) and w.scored < 60 * 240 / 3
