import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswarden.llm import nn_graph as nn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    good = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    size = max([len(v) for v in good.values()], key=[len(v) for v in good.values()].count) if good else 0
    good = {i: v for i, v in good.items() if len(v) == size}
    out = {}
    for i, v in good.items():
        if i % 100 == 0:
            far = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good.items() if j != i)
            out[i] = [(j, d) for d, j in far[:k]]
    return out


def run(spark, rows):
    got = {}
    for r in nn.report(spark.createDataFrame(rows, SCHEMA)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def same(got, want):
    assert got.keys() == {k for k, v in want.items() if v}
    for q, found in got.items():
        assert [j for j, _ in found] == [j for j, _ in want[q]], q
        assert np.allclose([d for _, d in found], [d for _, d in want[q]], atol=1e-12)


def test_small_table_is_exact_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=8)], k) for k in range(130)]
    rows += [(1000, None, 0), (1100, [0.0] * 8, 0), (1200, [float("nan")] * 8, 0), (1300, [1.0, None] * 4, 0),
             (1400, [float("inf")] + [1.0] * 7, 0), (1500, [1.0, 2.0], 0), (None, [1.0] * 8, 0), (1600, [], 0),
             (100, rows[100][1], 7), (1700, [-0.0] * 7 + [1.0], 0), (1701, [0.0] * 7 + [1.0], 0)]
    same(run(spark, rows), brute(rows))


def test_copies_come_in_order_of_ids(spark):
    rng = np.random.default_rng(2)
    hot = [float(x) for x in rng.normal(size=6)]
    rows = [(k, hot if k % 3 == 0 else [float(x) for x in rng.normal(size=6)], 0) for k in range(700)]
    got = run(spark, rows)
    assert [j for j, _ in got[0]] == [3, 6, 9, 12, 15, 18, 21, 24, 27, 30]
    assert [j for j, _ in got[300]] == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]
    want = brute(rows)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_fewer_candidates_than_asked_for(spark, n):
    rows = [(k * 100, [float(k), 1.0], 0) for k in range(n)]
    same(run(spark, rows), brute(rows))


def test_recall_with_descent_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=16)], 0) for k in range(2500)]
    got, want = run(spark, rows), brute(rows)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


def test_queries_from_outside_the_index(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(900, 8))
    index = nn.build(spark.createDataFrame([(k, [float(x) for x in p], 0) for k, p in enumerate(points)], SCHEMA))
    asked = rng.normal(size=(5, 8))
    queries = spark.createDataFrame([(k, [float(x) for x in p], None) for k, p in enumerate(asked)],
                                    "query long, target array<double>, start long")
    rows = nn._nearest(nn.search(index, queries), 10).collect()
    hits = 0
    for k, p in enumerate(asked):
        true = set(np.argsort(((points - p) ** 2).sum(axis=1))[:10].tolist())
        hits += len(true & {r.id for r in rows if r["query"] == k})
    assert hits >= 45


def test_degrees_are_bounded(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=4)], 0) for k in range(800)]
    graph = nn.build(spark.createDataFrame(rows, SCHEMA)).graph
    most = graph.agg(F.max(F.size("near"))).first()[0]
    assert most <= nn.DEGREE + 2 * nn.REVERSE


@pytest.mark.parametrize("far", [1e8, 3e38])
def test_recall_beside_a_far_row(spark, far):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(size=16)], 0) for k in range(2500)]
    rows.append((9001, [far] + [1.0] * 15, 0))
    got, want = run(spark, rows), brute(rows)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * 10 * len(want)
