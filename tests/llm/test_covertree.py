import numpy as np
import pytest
from pyspark.sql import functions as F

from costgrain.llm import covertree


def brute(ids, vectors, queries, k):
    out = []
    for q in queries:
        scores = [(-int(vectors[q] @ vectors[d]), d) for d in ids if d != q and len(vectors[d]) == len(vectors[q])]
        out += [(q, n + 1, d, -s) for n, (s, d) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("scale", [3, 3000, 10**9])
def test_search_is_exact_with_ties(scale):
    rng = np.random.default_rng(scale)
    data = rng.integers(-scale, scale + 1, (900, 4))
    data[100:300] = data[100]
    ids = rng.permutation(5000)[:900]
    a, b, s = covertree.search(data[:50], ids[:50], data, ids, 7)
    got = {}
    for q, d, x in zip(a, b, s, strict=True):
        got.setdefault(int(q), []).append((-int(x), int(d)))
    for n in range(50):
        want = sorted((-sum(int(x) * int(y) for x, y in zip(data[n], data[m], strict=True)), int(ids[m])) for m in range(900) if m != n)[:7]
        assert sorted(got[int(ids[n])]) == want


def test_cover_tree_covers():
    points = np.random.default_rng(2).normal(size=(2000, 3))
    tree = covertree.CoverTree(points)
    for centre, radius, (a, b) in zip(tree.centres, tree.radius, tree.span, strict=True):
        assert np.linalg.norm(tree.points[a:b] - centre, axis=1).max() <= radius + 1e-9
    assert sorted(tree.order) == list(range(2000)) and len(tree.centres) > 5


def test_operator_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(300)]
    rows += [(300 + i, rows[5][1], 0) for i in range(100)]  # one vector that many rows share
    bad = [(500, None, 0), (501, [float("nan")] * 8, 0), (502, [1.0, None, *[0.0] * 6], 0), (503, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (504, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int")
    got = covertree.top_k(covertree.quantised(df), F.col("vec_id") % 20 == 0, 20).collect()
    vectors = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v, _ in rows}
    assert sorted(map(tuple, got)) == sorted(brute(list(vectors), vectors, [i for i in vectors if i % 20 == 0], 20))


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert covertree.top_k(covertree.quantised(df), F.col("vec_id") % 20 == 0).count() == 0


def test_rows_that_repeat_are_candidates_as_often(spark):
    rows = [(k, [float(k % 7), 1.0]) for k in range(60)] + [(13, [6.0, 1.0])] * 3 + [(20, [6.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = covertree.top_k(covertree.quantised(df), F.col("vec_id") % 20 == 0, 5).collect()
    v = [(i, [int(64 * x) for x in e]) for i, e in rows]
    for q in (0, 20, 40):
        asked = [x for i, x in v if i == q]
        want = sorted((-(x[0] * y[0] + x[1] * y[1]), i) for x in asked for i, y in v if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def _clustered(n, clusters, size=16, seed=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, size)) * 8
    return [(i, (centre[i % clusters] + 0.05 * rng.normal(size=size)).tolist()) for i in range(n)]


def test_kth_scores_prune_pairs_of_balls(spark, monkeypatch):
    """On clustered vectors most pairs of balls can't reach the kth scores that the first balls give; the result is exact."""
    monkeypatch.setattr(covertree, "ROWS_A_BALL", 40)
    monkeypatch.setattr(covertree, "CELL_QUERIES", 2)  # balls are parties of their own
    rows = _clustered(1_600, 40)
    df = covertree.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    seen = []
    then = covertree.Plan.then
    monkeypatch.setattr(covertree.Plan, "then", lambda self, done, worst: seen.append((len(done), len(out := then(self, done, worst)), len(self.parties) * len(self.data))) or out)
    got = covertree.top_k(df, F.col("vec_id") % 20 == 0, 10).collect()
    vectors = {i: np.floor(64 * np.array(v)).astype(np.int64) for i, v in rows}
    assert sorted(map(tuple, got)) == sorted(brute(list(vectors), vectors, [i for i in vectors if i % 20 == 0], 10))
    done, after, all_ = seen[0]
    assert done + after < 0.5 * all_


def test_balls_cover_and_bounds_hold(spark):
    rows = covertree.quantised(spark.createDataFrame(_clustered(500, 7, 6), "vec_id long, embedding array<double>")).withColumn("_query", F.col("vec_id") % 5 == 0)
    dealt, plan = covertree.plan_of(rows)
    found = dealt.collect()
    assert len(plan.centres) > 1 and sum(n for n, _ in plan.data.values()) == 500 and sum(n for n, _ in plan.queries.values()) == 100
    for q in (r for r in found if r["_query"]):
        for d in found:
            assert np.dot(q.v, d.v) <= plan.bound(q.ball, d.ball)


def test_balls_with_few_queries_go_together(spark):
    plan = covertree.Plan(np.eye(5) * 9, {a: (700, 1.0) for a in range(5)}, {b: (9_000, 1.0) for b in range(5)})
    assert sorted(a for p in plan.parties for a in p) == list(range(5)) and [len(p) for p in plan.parties] == [3, 2]
    begun = plan.first(20)
    assert not set(begun) & set(plan.then(begun, {})) and len(begun) + len(plan.then(begun, {})) == 2 * 5
