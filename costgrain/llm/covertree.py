"""Operator 2: exact top-k inner products by dual-tree search over cover trees.

The top level of the trees spans all vectors: a net of centres, each far from the
others, with the ball of the vectors that are nearest to it; every ball has the radius that covers it. A ball's
rows are dealt by hash to cells of a size, so that a crowded ball is many tasks' work. In a cell both
sides are indexed further as cover trees: every node has a centre, a covering radius, and children whose
centres are far from each other, and pairs of nodes are visited from the likeliest down. The inner product of
any query within rq of q and vector within rp of p is at most q.p + rq |p| + rp |q| + rq rp; where that is
below the worst kth score of the query node, the pair is pruned.

The search goes over the balls twice: first each ball of queries meets the balls of data
that promise most, and so every query gets a kth score. Then only pairs of balls whose bound reaches the worst
of these are searched, with the kth scores that are known. The results for a query are merged by rank.

A vector that many rows share can give a query its k smallest ids at most, so
each keeps k + 1 rows (one may be the query itself); nothing else is left out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from costgrain.llm.common import cut, table

K = 20
SCALE = 64
EVERY = 20
#: Children of a node and vectors of a leaf, at most.
FANOUT, LEAF = 16, 256
#: Queries and vectors of a cell, about.
CELL_QUERIES, CELL_VECTORS = 2_048, 8_192
#: Balls of the top level, at most and at least; rows that make one more; rows that the net is chosen from; balls that are searched first.
BALLS, LEAST_BALLS, ROWS_A_BALL, NET, FIRST = 64, 8, 2_048, 4_096, 2
#: Parts over which the rows of one vector are dealt before the first K + 1 are chosen.
SALTS = 12


class CoverTree:
    """Nested balls over the rows of a matrix; ``order`` puts the rows of each node side by side."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.order = np.arange(len(points))
        self.centres: list[np.ndarray] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        if len(points):
            self._build(0, len(points), 0)
        self.points = self.points[self.order]
        self.norm = [float(np.linalg.norm(c)) for c in self.centres]

    def _build(self, a: int, b: int, first: int) -> int:
        """A node over order[a:b] with the row order[first] as its centre."""
        rows = self.order[a:b]
        centre = self.points[self.order[first]]
        far = np.linalg.norm(self.points[rows] - centre, axis=1)
        node = len(self.centres)
        self.centres.append(centre)
        self.radius.append(float(far.max()))
        self.span.append((a, b))
        self.children.append([])
        if b - a <= LEAF or far.max() == 0:
            return node
        # A net: each next centre is the row farthest from those before, until all are within half the radius.
        near, chosen = far.copy(), np.zeros(b - a, int)
        for k in range(1, FANOUT):
            at = int(near.argmax())
            if near[at] <= self.radius[node] / 2 and k > 1:
                break
            d = np.linalg.norm(self.points[rows] - self.points[rows[at]], axis=1)
            chosen[d < near] = k
            near = np.minimum(near, d)
        by = np.argsort(chosen, kind="stable")
        self.order[a:b] = rows[by]
        bounds = [0, *(np.flatnonzero(np.diff(chosen[by])) + 1).tolist(), b - a]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            centre_at = lo + int(near[by[lo:hi]].argmin())
            self.children[node].append(self._build(a + lo, a + hi, a + centre_at))
        return node


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int = K, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the k best of ``data`` for each query; ties to smaller ids, own id left out.

    ``known`` gives each query a score that k others are known to reach: what is below is left out."""
    q, d = CoverTree(queries), CoverTree(data)
    q_ids, d_ids = query_ids[q.order], data_ids[d.order]
    q_raw, d_raw = queries[q.order].astype(np.int64), data[d.order].astype(np.int64)
    most = float(np.abs(q_raw).max(initial=0)) * float(np.abs(d_raw).max(initial=0)) * max(1, q_raw.shape[1])
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    q_num, d_num = q_raw.astype(kind), d_raw.astype(kind)
    least = np.iinfo(np.int64).min
    worst = np.full(len(q_ids), least) if known is None else known[q.order].astype(np.int64)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q_ids)

    def bound(a: int, b: int) -> float:
        value = float(q.centres[a] @ d.centres[b]) + q.radius[a] * d.norm[b] + d.radius[b] * q.norm[a] + q.radius[a] * d.radius[b]
        return value + 1e-9 * abs(value) + 1e-6

    def visit(a: int, b: int) -> None:
        (q0, q1), (d0, d1) = q.span[a], d.span[b]
        scores = q_num[q0:q1] @ d_num[d0:d1].T
        for i in np.flatnonzero((scores >= worst[q0:q1, None].astype(np.float64)).any(axis=1)):
            at = q0 + int(i)
            some = np.flatnonzero(scores[i] >= worst[at])
            some = some[d_ids[d0 + some] != q_ids[at]]
            if len(some) > 4 * k:
                kth = np.partition(scores[i][some], len(some) - k)[len(some) - k]
                some = some[scores[i][some] >= kth]
            s = np.concatenate((best[at][0], scores[i][some].astype(np.int64)))
            n = np.concatenate((best[at][1], d_ids[d0 + some]))
            top = np.lexsort((n, -s))[:k]
            best[at] = s[top], n[top]
            if len(top) == k:
                worst[at] = max(worst[at], s[top[-1]])

    heap = [(-bound(0, 0), 0, 0)] if len(q_ids) and len(d_ids) else []
    while heap:
        value, a, b = heapq.heappop(heap)
        if -value < float(worst[slice(*q.span[a])].min()):
            continue
        if not q.children[a] and not d.children[b]:
            visit(a, b)
        elif not d.children[b] or (q.children[a] and q.radius[a] > d.radius[b]):
            for c in q.children[a]:
                heapq.heappush(heap, (-bound(c, b), c, b))
        else:
            for c in d.children[b]:
                heapq.heappush(heap, (-bound(a, c), a, c))
    sizes = [len(s) for s, _ in best]
    joined = lambda part: np.concatenate([x[part] for x in best]) if best else np.empty(0, np.int64)
    return np.repeat(q_ids, sizes), joined(1), joined(0)


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(64 x) of each component. Vectors that are null or hold
    a null or non-finite component take no part, nor do rows without an id."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    some = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
    return some.select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def _first_of_each(vectors: DataFrame, k: int) -> DataFrame:
    """The k + 1 smallest ids of each vector: a few parts of its rows first, then all."""
    dealt = vectors.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    by_part = W.partitionBy("v", "_salt").orderBy("vec_id")
    some = dealt.withColumn("_n", F.row_number().over(by_part)).where(F.col("_n") <= k + 1).drop("_n", "_salt")
    return some.withColumn("_n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1).drop("_n")


def net(points: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the points, each the farthest from those before; fewer where these are all there are."""
    chosen = points[:1]
    near = np.linalg.norm(points - points[0], axis=1) if len(points) else np.zeros(0)
    while len(chosen) < min(most, len(points)) and near.max() > 0:
        new = points[int(near.argmax())]
        chosen = np.concatenate((chosen, new[None]))
        near = np.minimum(near, np.linalg.norm(points - new, axis=1))
    return chosen


def _in_balls(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with the number of the nearest centre and how far it is; -1 for vectors of another length."""
    size = centres.shape[1] if len(centres) else -1

    @F.pandas_udf("ball int, far double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        ball, far = np.full(len(v), -1), np.zeros(len(v))
        fit = np.flatnonzero(v.map(len).to_numpy() == size)
        for at in (fit[k : k + 2_048] for k in range(0, len(fit), 2_048)):
            d = np.linalg.norm(np.stack(v.iloc[at].to_numpy()).astype(np.float64)[:, None] - centres[None], axis=2)
            ball[at], far[at] = d.argmin(1), d.min(1)
        return pd.DataFrame({"ball": ball, "far": far})

    return rows.withColumn("_b", nearest("v")).select("*", "_b.ball", "_b.far").drop("_b")


class Plan:
    """Balls of queries and data with their radii and sizes, and what a pair of balls can reach.

    Balls with few queries go together in parties of about CELL_QUERIES, as each party's cells get a copy of the data
    that it meets: a party meets what any of its balls has to.
    """

    def __init__(self, centres: np.ndarray, queries: dict[int, tuple[int, float]], data: dict[int, tuple[int, float]]):
        self.centres, self.queries, self.data = centres, queries, data
        self.norm = np.linalg.norm(centres, axis=1)
        self.parties: list[list[int]] = []
        held = CELL_QUERIES
        along = lambda a: (float(centres[a] @ centres[0]) if a >= 0 else np.inf, a)
        for a in sorted(queries, key=along):
            if held >= CELL_QUERIES:
                self.parties.append([])
                held = 0
            self.parties[-1].append(a)
            held += queries[a][0]

    def bound(self, a: int, b: int) -> float:
        """No inner product of a query of ball a and a vector of ball b is greater."""
        if a < 0 or b < 0:
            return np.inf if a == b else -np.inf  # vectors of other lengths: cells part these
        rq, rp = self.queries[a][1], self.data[b][1]
        value = float(self.centres[a] @ self.centres[b]) + rq * self.norm[b] + rp * self.norm[a] + rq * rp
        return value + 1e-9 * abs(value) + 1e-6

    def first(self, k: int) -> list[tuple[int, int]]:
        """(party, ball): for each ball of queries the balls of data that promise most, and more while they hold k + 1 rows or fewer."""
        out = set()
        for party, balls in enumerate(self.parties):
            for a in balls:
                ranked, held = sorted(self.data, key=lambda b: (-self.bound(a, b) if a < 0 or b < 0 else -float(self.centres[a] @ self.centres[b]), b)), 0
                for n, b in enumerate(ranked):
                    if n >= FIRST and held > k:
                        break
                    out.add((party, b))
                    held += self.data[b][0]
        return sorted(out)

    def then(self, done: list[tuple[int, int]], worst: dict[int, float]) -> list[tuple[int, int]]:
        """The other pairs that can still reach the worst kth score of a ball's queries."""
        seen = set(done)
        reach = lambda a, b: self.bound(a, b) > -np.inf and self.bound(a, b) >= worst.get(a, -np.inf)
        return [(p, b) for p, balls in enumerate(self.parties) for b in self.data if (p, b) not in seen and any(reach(a, b) for a in balls)]


def plan_of(rows: DataFrame) -> tuple[DataFrame, Plan]:
    """Rows (vec_id, v, _query) in balls, and the plan: one row a ball reaches the driver, and NET rows that the centres are chosen from."""
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    n = most[0]["count"] if most else 0
    some = rows.where(F.size("v") == (most[0]["d"] if most else 0)).orderBy(F.xxhash64("vec_id", "v")).limit(NET).select("v").collect()
    centres = net(np.array([r.v for r in some], np.float64), min(BALLS, max(LEAST_BALLS, n // ROWS_A_BALL))) if n else np.zeros((0, 0))
    dealt = cut(_in_balls(rows, centres))
    sides = {True: {}, False: {}}
    for is_query, ball, count, far in dealt.groupBy("_query", "ball").agg(F.count("*"), F.max("far")).collect():
        for side in (True, False) if is_query else (False,):
            old = sides[side].get(ball, (0, 0.0))
            sides[side][ball] = (old[0] + count, max(old[1], far))
    return dealt, Plan(centres, sides[True], sides[False])


def _searched(queries: DataFrame, data: DataFrame, plan: Plan, pairs: list[tuple[int, int]], k: int) -> DataFrame:
    """(query_id, vec_id, score, times) of the k best in each cell of the given pairs of parties and balls.

    A party is cut into groups of queries and a ball into stripes of data by hash; the pairs are at most BALLS squared
    and go to the tasks.
    """
    groups = [max(1, -(-sum(plan.queries[a][0] for a in balls) // CELL_QUERIES)) for balls in plan.parties]
    stripes = {b: max(1, -(-n // CELL_VECTORS)) for b, (n, _) in plan.data.items()}
    spark = queries.sparkSession
    meets = lambda: F.broadcast(spark.createDataFrame([(p, b, groups[p], stripes[b]) for p, b in pairs], "party int, dball int, groups int, stripes int"))
    of = F.broadcast(spark.createDataFrame([(a, p) for p, balls in enumerate(plan.parties) for a in balls], "ball int, _party int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col(n)).cast("int")
    new = lambda *names: [F.col(n).alias(n) for n in names]  # noqa: E731  # both sides come from one table
    left = queries.join(of, "ball").join(meets(), F.col("_party") == F.col("party")).withColumn("_group", own("groups")).select(*new("party", "dball", "_group"), each("stripes").alias("_stripe"), F.size("v").alias("_d"), *new("vec_id", "v", "times", "worst"))
    right = data.join(meets(), F.col("ball") == F.col("dball")).withColumn("_stripe", own("stripes")).select(*new("party", "dball"), each("groups").alias("_group"), *new("_stripe"), F.size("v").alias("_d"), *new("vec_id", "v", "times"))

    def cell(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({c: [] for c in ("query_id", "vec_id", "score", "times")}, dtype="int64")
        a, b, s = search(np.stack(q["v"].to_numpy()), q["vec_id"].to_numpy(), np.stack(d["v"].to_numpy()), d["vec_id"].to_numpy(), k, q["worst"].to_numpy(np.int64))
        often = q.groupby("vec_id")["times"].max().reindex(a).to_numpy() * d.groupby("vec_id")["times"].max().reindex(b).to_numpy()
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s, "times": often})

    keys = ["party", "dball", "_group", "_stripe", "_d"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score long, times long")


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best vectors for each row that ``is_query`` marks.

    ``vectors`` has vec_id and v (integers); vectors of different length do not
    meet. Each row is a query or candidate on its own, equal vectors too; a query
    is no candidate of itself or of a row with its id; a row that is repeated is a candidate as often, and
    as a query asks as often. Ties go to the smaller id. An empty table gives an empty one.
    """
    rows = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("times")).withColumn("_query", F.coalesce(is_query, F.lit(False)))
    dealt, plan = plan_of(cut(rows))
    data = _first_of_each(dealt.select("vec_id", "v", "times", "ball"), k)
    queries = dealt.where("_query").select("vec_id", "v", "times", "ball")
    least = np.iinfo(np.int64).min
    begun = plan.first(k)
    found = cut(_searched(queries.withColumn("worst", F.lit(int(least))), data, plan, begun, k))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = found.withColumn("_n", nth).where(F.col("_n") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("worst"))
    scored = cut(queries.join(kth, "vec_id", "left").withColumn("worst", F.coalesce("worst", F.lit(int(least)))))
    worst = dict(map(tuple, scored.groupBy("ball").agg(F.min("worst")).collect()))  # a row a ball
    rest = _searched(scored, data, plan, plan.then(begun, worst), k)
    both = found.unionByName(rest).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)))))
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark, sf_dir: str) -> DataFrame:
    """The digest of the operator: every twentieth vector against all others."""
    return top_k(quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
