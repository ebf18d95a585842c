"""Nearest neighbours over cells against a scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrain.operators import cells, knn


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 20
    near = np.concatenate([rng.normal(size=(120, 8)) + c for c in centres])
    near[100:160] = near[100]  # equal vectors, more than are asked for
    return [(i, [float(x) for x in v]) for i, v in enumerate(near.astype(np.float32))]


@pytest.fixture(scope="module")
def vectors(spark, rows):
    odd = [(9001, None), (9002, [None] * 8), (9003, [float("nan")] * 8), (9004, [float("inf")] * 8)]
    return spark.createDataFrame(rows + odd, "hunk_id long, vector array<float>").repartition(3).cache()


def scan(rows, query, k):
    d = [(float(np.sqrt(((np.array(v) - query) ** 2).sum())), i) for i, v in rows]
    return [i for _, i in sorted((round(a, 6), i) for a, i in d)[:k]]


def test_cells_find_what_a_scan_finds(spark, rows, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 64)
    root = str(tmp_path / "c")
    state = cells.build(spark, root, vectors.where("hunk_id % 2 = 0"))
    state = cells.add(spark, root, state, vectors.where("hunk_id % 2 = 1"))
    assert len(state["parts"]) == 2 and cells.size(state) == len(rows)
    held = cells.view(spark, root, state)
    assert len(held.centres) > 8
    asked = {q: rows[q][1] for q in (0, 100, 130, 500, 1439)} | {7000: [0.0] * 8, 7001: [1000.0] * 8}
    got = {}
    for r in cells.nearest_batch(held, spark.createDataFrame([*asked.items(), (7002, None)], "qid long, query array<float>"), 10).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.hunk_id))
    for qid, query in asked.items():
        want = scan(rows, np.array(query), 10)
        assert [i for _, i in sorted(got[qid])] == want, qid
        assert [r.hunk_id for r in cells.nearest(held, query, 10).orderBy("distance", "hunk_id").collect()] == want
    assert set(got) == set(asked)
    # a query among tight clusters needs a few cells alone
    d = cells._exact(np.array(rows[500][1]), held.centres)
    t = sorted(float(np.sqrt(((np.array(v) - np.array(rows[500][1])) ** 2).sum())) for _, v in rows)[9]
    own, r = cells._nearest(np.array([v for _, v in rows]), held.centres)
    in_rings = (d[own] - held.radii[own] <= t) & (np.abs(d[own] - r) <= t)
    assert in_rings.sum() < len(rows) / 4
    few = cells.nearest(held, rows[0][1], 5000)
    assert few.count() == len(rows)  # fewer than k

    state = cells.delete(spark, root, state, spark.createDataFrame([(0,), (5,), (99999,)], "id long"))
    living = [r for r in rows if r[0] not in (0, 5)]
    state = cells.merge(spark, root, state)
    held = cells.view(spark, root, state)
    assert len(state["parts"]) == 1 and cells.size(state) == len(living)
    assert [r.hunk_id for r in cells.nearest(held, rows[0][1], 10).orderBy("distance", "hunk_id").collect()] == scan(living, np.array(rows[0][1]), 10)


def test_nothing_to_search(spark, vectors, tmp_path):
    state = cells.build(spark, str(tmp_path / "c"), vectors.where("hunk_id > 9000"))
    assert cells.view(spark, str(tmp_path / "c"), state) is None and cells.folders(state) == []


def test_a_batch_of_any_number_of_queries(spark, rows, vectors, monkeypatch):
    monkeypatch.setattr(knn, "MOST_QUERIES", 4)
    asked = vectors.where("hunk_id < 10").select(F.col("hunk_id").alias("qid"), F.col("vector").alias("query"))
    got = {}
    for r in knn.nearest_batch(vectors.where("hunk_id < 9000"), asked, 3).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.hunk_id))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: scan(rows, np.array(rows[q][1]), 3) for q in range(10)}
    assert knn.nearest_batch(vectors, asked.limit(0), 3).count() == 0


def test_queries_meet_a_cell_many_at_a_time(spark, rows, vectors, tmp_path, monkeypatch):
    """Cells of many units and queries of many batches lose nothing, and no distance is computed pair by pair in a plan."""
    monkeypatch.setattr(cells, "CELL_ROWS", 300)
    monkeypatch.setattr(cells, "UNIT_ROWS", 50)
    monkeypatch.setattr(cells, "AT_ONCE", 3)
    root = str(tmp_path / "c")
    held = cells.view(spark, root, cells.build(spark, root, vectors))
    asked = vectors.where("hunk_id < 9000 and hunk_id % 20 = 0").select(F.col("hunk_id").alias("qid"), F.col("vector").alias("query"))
    found = cells.nearest_batch(held, asked, 10)
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.qid, []).append((r["rank"], r.hunk_id))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: scan(rows, np.array(rows[q][1]), 10) for q in range(0, 1440, 20)}
