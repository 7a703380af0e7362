import hashlib
import math
import random
from fractions import Fraction

import numpy as np

from treeline.llm import ball_kmeans
from treeline.llm.ball_kmeans import Balls

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance string, sums string, embedding2 string"


def brute(rows, clusters, rounds, seed, width):
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            own = [v for (_, v), j in zip(kept, of, strict=True) if j == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {k: sum(d for _, j, d in found if j == k) for k in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, k, d in found), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, "x", "y", "z", "w") for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in ball_kmeans.inertias(ball_kmeans.ball_kmeans(df, **how)).collect()), key=str)


def test_clusters_equal_brute_force(spark):
    rnd = random.Random(3)
    middles = [[rnd.gauss(0, 1) for _ in range(4)] for _ in range(9)]
    rows = [(i, [x + rnd.gauss(0, 0.2) for x in middles[i % 9]]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(80)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0, 2.0]), (2003, [math.nan, 1.0, 1.0, 1.0]), (2004, [None, 1.0, 1.0, 1.0]), (2005, [math.inf, 1.0, 1.0, 1.0])]
    how = {"clusters": 12, "rounds": 4, "seed": 2, "width": 4}
    assert run(spark, rows, **how) == brute(rows, **how)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 5) / 256, float(i // 5 % 5) / 256]) for i in range(75)]
    how = {"clusters": 20, "rounds": 3, "seed": 2, "width": 2}
    assert run(spark, rows, **how) == brute(rows, **how)


def test_extreme_components_are_exact(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [2.0**40 + 3, 1.5]), (3, [-(2.0**40), 0.1]), (4, [2.0**40, -7.0])]
    how = {"clusters": 2, "rounds": 2, "seed": 2, "width": 2}
    got, want = run(spark, rows, **how), brute(rows, **how)
    assert [r[:2] + r[5:] for r in got] == [r[:2] + r[5:] for r in want]
    assert all(r[2] == (w[2] if w[2] < 1 << 63 else None) for r, w in zip(got, want, strict=True))
    huge = run(spark, [(1, [1e300, 1.0]), (2, [-1e300, 1.0]), (3, [1e300, 2.0])], clusters=1, rounds=1, seed=2, width=2)
    assert len(huge) == 3 and all(r[2] is r[3] is r[4] is None for r in huge)


def test_few_and_no_vectors(spark):
    how = {"clusters": 5, "rounds": 2, "seed": 2, "width": 2}
    few = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [0.25, 1.0])]
    assert run(spark, few, **how) == brute(few, **how)
    assert run(spark, [], **how) == []
    assert run(spark, [(1, [1.0])], **how) == []


def test_balls_compare_fewer_and_find_the_same():
    rnd = np.random.default_rng(5)
    middles = rnd.integers(-4000, 4000, (30, 3))
    points = (middles[rnd.integers(0, 30, 3000)] + rnd.integers(-150, 150, (3000, 3))).astype(float)
    balls = Balls(middles.tolist(), [True] * 30)
    best, distance = balls.nearest(points)
    before = best.copy()
    before[:300] = (before[:300] + 1) % 30  # members that have to move
    assert all((x == y).all() for x, y in zip(balls.improved(points, before), (best, distance), strict=True))
    near = [sum(balls.apart[k][balls.order[k]] <= 4 * distance[best == k].max()) for k in range(30) if (best == k).any()]
    assert np.mean(near) < 10


def test_still_balls_keep_their_members():
    balls = Balls([[0, 0], [10, 0], [500, 0]], [False, False, True])
    best, distance = balls.improved(np.array([[9.0, 0.0], [1.0, 0.0]]), np.array([0, 0]))
    assert best.tolist() == [0, 0] and distance.tolist() == [81, 1]  # as promised by the last round, not compared again
