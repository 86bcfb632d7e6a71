"""Exact search against all scores."""

import numpy as np
import pytest

from postmill.llm import maxscore


def want(rows, k=10):
    usable = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in usable:
        if q % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in usable if i != q)
        out |= {(q, n + 1, i, max(-s, -(1 << 63))) for n, (s, i) in enumerate(scores[:k])}
    return out


def got(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = maxscore.top_k(df, df.where("vec_id % 100 = 0")).collect()
    assert len(found) == len({(r.query_id, r["rank"]) for r in found})
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in found}


@pytest.mark.parametrize("shard", [4096, 7])
def test_top_k(spark, shard, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "BLOCK", 2)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=12).round(2).tolist()) for i in range(0, 900, 3)]
    rows += [(i + 1, rows[5][1]) for i in range(0, 60, 3)]  # ties
    assert got(spark, rows) == want(rows)


@pytest.mark.parametrize("copies", [2, 11, 30])
@pytest.mark.parametrize("shard", [4096, 16])
def test_repeated_rows_of_the_query(spark, shard, copies, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).round(2).tolist()) for i in range(1, 60)]
    rows += [(100, [4.0] * 12)] * copies
    expected = want(rows[:59] + rows[59:60])
    assert len(expected) == 10 and got(spark, rows) == expected


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [-3.0, 0.001]), (None, [1.0, 1.0]), (200, [5e6, -7e6]), (300, [3e9, 4e9])]
    assert got(spark, rows) == want(rows)
    assert got(spark, []) == set()
    assert got(spark, [(0, [1.0])]) == set()


def test_pruning_keeps_all_that_reach_the_floor():
    rng = np.random.default_rng(8)
    matrix, queries = np.floor(1024 * rng.normal(size=(16, 500))), np.floor(1024 * rng.normal(size=(16, 6)))
    exact = queries.T @ matrix
    floor = np.sort(exact, axis=1)[:, -10]
    for row, least, (alive, score) in zip(exact, floor, maxscore.search(matrix, queries, floor, 10), strict=True):
        assert set(alive) == set(np.flatnonzero(row >= least)) and (score == row[alive]).all()


def test_queries_are_not_sent_through_the_driver(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = maxscore.top_k(df, df.where("vec_id % 100 = 0"))
    assert len(found.collect()) == 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


def test_bands_of_queries(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "BAND", 1)
    monkeypatch.setattr(maxscore, "SHARD", 30)
    monkeypatch.setattr(maxscore, "BLOCK", 2)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(400)]
    assert got(spark, rows) == want(rows)
