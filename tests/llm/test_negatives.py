"""Hard negatives against all scores; the trees against scanning all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import negatives

LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def whole(vector):
    if vector is None or any(x is None or not np.isfinite(x) for x in vector):
        return None
    return [math.floor(256 * x) for x in vector]


def want(rows, k=5):
    usable = []
    for i, v, label in rows:
        if i is not None and label is not None and whole(v) is not None:
            usable.append((i, whole(v), (label + 1) % 10 if i % 7 == 0 else label))
    out, seen = [], set()
    for a, av, al in usable:
        if a % 100 or (a, al, tuple(av)) in seen:
            continue
        seen.add((a, al, tuple(av)))
        scores = [(-max(min(sum(x * y for x, y in zip(av, v, strict=False)), (1 << 63) - 1), -(1 << 63)), i, label) for i, v, label in usable if i != a]
        for p, pid in sorted((s, i) for s, i, label in scores if label == al)[:k]:
            fits = sorted((s, i) for s, i, label in scores if label != al and 80 * -p <= 100 * -s <= 100 * -p)[:k]
            out += [(a, pid, n + 1, i, -p, -s) for n, (s, i) in enumerate(fits)]
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, score int, block string")
    found = negatives.mine(df, F.expr(LABEL), F.col("vec_id") % 100 == 0).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in found)


@pytest.mark.parametrize("shard, leaf, block", [(16_384, 128, 512), (40, 4, 2)])
def test_mined(spark, shard, leaf, block, monkeypatch):
    for name, value in (("SHARD", shard), ("LEAF", leaf), ("BLOCK", block), ("FANOUT", 3)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=6) + 0.4).round(2).tolist(), int(rng.integers(0, 4))) for i in range(0, 1200, 2)]
    rows += [(i + 1, rows[7][1], i % 3) for i in range(0, 60, 2)]  # ties
    rows += [rows[9]] * 6  # repeated candidates
    expected = want(rows)
    assert len(expected) > 100 and got(spark, rows) == expected


def test_edges(spark):
    rows = [
        (0, [1.0, 2.0], 0), (100, [0.0, 0.0], 1), (100, [0.0, 0.0], 1), (100, [1.0, 1.0], 2), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1),
        (4, [float("inf"), 1.0], 1), (5, [-3.0, 0.001], 1), (None, [1.0, 1.0], 1), (200, [5e6, -7e6], 1), (300, [3e9, 4e9], 2), (6, [3e9, 4e9], 2),
        (9, [2.9e9, 4e9], 3), (10, [1.0, 2.0], None), (11, [2.0], 1), (12, [], 1), (13, [1.0, 1.0], 1), (15, [1.0, 1.0], 2), (-100, [1.0, 2.0], 1),
    ]
    rows += [(400, [3.0, 1.0], 5)] * 40  # one id with a third of all rows
    assert got(spark, rows) == want(rows)
    assert got(spark, []) == [] and got(spark, [(0, [1.0], 1)]) == [] and got(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_negative_scores_have_no_window():
    assert negatives.window_of(-100) == (-80, -100) and negatives.window_of(0) == (0, 0)
    assert negatives.window_of(99) == (80, 99) and negatives.window_of(100) == (80, 100)


def test_tiles_hold_every_point_once():
    rng = np.random.default_rng(2)
    for n, dim, capacity in ((1, 3, 4), (4, 3, 4), (5, 1, 4), (1000, 2, 16), (777, 64, 16), (30, 0, 4)):
        parts = negatives.tiles(rng.normal(size=(n, dim)), capacity)
        assert sorted(np.concatenate(parts).tolist()) == list(range(n)) and max(map(len, parts)) <= capacity
        assert len(parts) <= 1.5 * -(-n // capacity) + 2


def test_search_prunes_and_keeps_all_hits(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 8)
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.normal(size=(4000, 2)))
    labels = rng.integers(0, 3, 4000)
    trees = negatives.forest(np.arange(4000), labels, rows)
    for node in range(len(trees.first)):
        if trees.leaf[node]:
            own = trees.rows[trees.first[node] : trees.last[node]]
            assert (own.min(axis=0) == trees.lower[node]).all() and (own.max(axis=0) == trees.upper[node]).all()
    anchors = np.floor(256 * rng.normal(size=(20, 2)))
    low, high = negatives.intervals(trees, anchors)
    for n, a in enumerate(anchors):
        scores = rows @ a
        top = float(np.sort(scores)[-40])
        for windows in ([(-math.inf, math.inf)], [(0.8 * top, top), (0.4 * top, 0.5 * top)]):
            found = [[] for _ in windows]
            scored = negatives.search(trees, a, low[n], high[n], list(trees.roots.values()), -1, windows, 5, found)
            for (least, most), hits in zip(windows, found, strict=True):
                at = [(-int(s), int(i)) for i, s in enumerate(scores) if least <= s <= most]
                assert hits == sorted(at)[:5]
            assert scored < 0.7 * len(rows)
