import math
import random

import numpy as np
import pytest

from tests.compare import assert_same, connection
from tests.conftest import DATA
from treeline.llm import kdtree, nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int, id string, width int, vector string, own string"


def awkward(seed=1, n=160, dims=6):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        base = [rnd.gauss(0, 1) for _ in range(dims)]
        rows.append((i, base, i % 3))
        if i % 8 == 0:
            rows.append((1000 + i, [x + rnd.gauss(0, 0.02) for x in base], i % 3))
            rows.append((2000 + i, base, i % 3))
            rows.append((3000 + i, base, (i + 1) % 3))
    for i in range(60):  # one crowd of near copies
        rows.append((5000 + i, [1.0 + rnd.gauss(0, 0.03) for _ in range(dims)], 1))
    rows += [(6000, None, 1), (6001, [], 1), (6002, [0.0] * dims, 1), (6003, [math.nan] * dims, 1), (6004, [math.inf] + [1.0] * (dims - 1), 1), (6005, [None] + [1.0] * (dims - 1), 1)]
    rows += [(6006, rows[0][1], None), (6007, [1.0, 2.0], 1), (6008, [1.0, 2.0], 1), (None, rows[0][1], 0), (50, rows[0][1], 2)]
    return [(*r, "x", 3, "y", "z") for r in rows]


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def test_links_equal_brute_force(spark):
    rows = [r for r in awkward() if r[0] != 50]
    got = {(r.vec_id): (r.n_links, r.component_id, r.kept) for r in nn_descent.embedding_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    f32 = {r[0]: np.array(r[1], np.float32).astype(float) for r in rows if r[0] is not None and r[2] is not None and good(r[1]) and any(r[1])}
    label = {r[0]: r[2] for r in rows}
    linked = {i: [j for j in f32 if j != i and label[i] == label[j] and len(f32[i]) == len(f32[j]) and f32[i] @ f32[j] / np.linalg.norm(f32[i]) / np.linalg.norm(f32[j]) >= 0.98] for i in f32}
    for vec_id in {r[0] for r in rows}:
        seen, todo = {vec_id}, [vec_id]
        while todo:
            for j in linked.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        if vec_id is None:
            assert got[None] == (0, None, False)
        else:
            assert got[vec_id] == (len(linked.get(vec_id, [])), min(seen), min(seen) == vec_id)


def test_crowd_larger_than_lists_and_blocks(spark):
    rnd = np.random.default_rng(2)
    crowd = rnd.standard_normal(16) + rnd.standard_normal((1200, 16)) * 0.02
    rows = [(i, x.tolist(), 0) for i, x in enumerate(crowd)] + [(5000 + i, rnd.standard_normal(16).tolist(), 0) for i in range(200)]
    found = nn_descent.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in found}
    assert [got[r[0]] for r in rows] == want.tolist()


def crowds(groups=2, each=100, dims=64, cosine=0.985):
    """Groups of near copies, cosine about 0.99, with few links from a group to the next."""
    rnd = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base, side = np.linalg.qr(rnd.standard_normal((dims, 2)))[0].T
    turn = math.acos(cosine)
    return unit(np.concatenate([math.cos(g * turn) * base + math.sin(g * turn) * side + unit(rnd.standard_normal((each, dims))) * 0.1 for g in range(groups)]))


def test_links_between_saturated_lists(spark):
    x = crowds()
    linked = x @ x.T >= 0.98
    assert linked[:100, :100].all() and 0 < linked[:100, 100:].sum() < 1000
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    found = {r.vec_id: r for r in nn_descent.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [found[i].n_links for i in range(200)] == (linked.sum(axis=1) - 1).tolist()
    assert {r.component_id for r in found.values()} == {0}
    # the comparison of saturated components alone: lists that hold only their own group
    nodes = spark.createDataFrame([(i, 0, 64, v.tolist()) for i, v in enumerate(x)], "id long, label int, width int, vector array<double>")
    graph = spark.createDataFrame([(i, i // 100 * 100 + (i + k) % 100, 0.99) for i in range(200) for k in range(1, 9)], "a long, b long, cosine double")
    component = spark.createDataFrame([(i, i // 100 * 100) for i in range(200)], "id long, component long")
    edges = nn_descent._between(graph, component, nodes, 0.98, 8).collect()
    assert edges and all(linked[e.a, e.b] and e.a < 100 <= e.b for e in edges)


def test_lost_pairs_are_found_beside_a_crowd(spark, monkeypatch):
    """Pairs that the orders miss, next to a group whose links outnumber them."""
    rnd = np.random.default_rng(4)
    crowd = rnd.standard_normal(16) + rnd.standard_normal((400, 16)) * 0.02
    alone = rnd.standard_normal((100, 16))
    x = np.concatenate([crowd, alone, alone + rnd.standard_normal((100, 16)) * 0.01])
    # orders that see only the crowd
    started = nn_descent._started
    monkeypatch.setattr(nn_descent, "_started", lambda nodes, *rest: started(nodes.where("id < 400"), *rest))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    found = {r.vec_id: r for r in nn_descent.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert [found[i].n_links for i in range(600)] == ((x @ x.T >= 0.98).sum(axis=1) - 1).tolist()
    assert [found[i].component_id for i in range(500, 600)] == list(range(400, 500))


def linked_rows(spark, x):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    return {r.vec_id: r for r in nn_descent.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}


def test_links_on_one_row_in_a_thousand(spark):
    """Too few linked vectors for a sample to see: the probes judge."""
    rnd = np.random.default_rng(6)
    x = rnd.standard_normal((9_000, 48))
    x = np.concatenate([x, x[:5] + 0.01 * rnd.standard_normal((5, 48))])
    found = linked_rows(spark, x)
    assert {i: r.n_links for i, r in found.items() if r.n_links} == dict.fromkeys([*range(5), *range(9_000, 9_005)], 1)
    assert [found[9_000 + i].component_id for i in range(5)] == list(range(5))
    assert all(0.98 <= r.recall <= 1 for r in found.values())


def test_probes_tell_a_descent_that_finds_nothing(spark, monkeypatch):
    """Without starting edges no probe is found, so all vectors are compared."""
    rnd = np.random.default_rng(8)
    x = rnd.standard_normal((300, 16))
    x = np.concatenate([x, x[:3] + 0.001])
    monkeypatch.setattr(nn_descent, "MOST_AUDITED", 1)
    started = nn_descent._started
    monkeypatch.setattr(nn_descent, "_started", lambda nodes, *rest: started(nodes.limit(0), *rest))
    found = linked_rows(spark, x)
    assert {i for i, r in found.items() if r.n_links} == {0, 1, 2, 300, 301, 302}
    assert [found[300 + i].component_id for i in range(3)] == [0, 1, 2] and found[0].recall == 1


def test_a_crowd_of_cliques(spark):
    """Cliques as large as a list, each linked with the next: no list has room for the link onwards."""
    base, rnd = np.eye(40)[:1], np.random.default_rng(7)
    turn, x = math.acos(0.9805), []
    for g in range(6):
        centre = math.cos(g * turn) * base[0] + math.sin(g * turn) * np.eye(40)[1]
        x += [centre + 0.0005 * rnd.standard_normal(40) for _ in range(nn_descent.GROWN + 1)]
    x = np.array(x)
    found = linked_rows(spark, x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [found[i].n_links for i in range(len(x))] == ((unit @ unit.T >= 0.98).sum(axis=1) - 1).tolist()
    assert {r.component_id for r in found.values()} == {0}


def test_components_with_hot_centres(spark):
    from treeline.llm.graph import connected_components

    edges = [(1, i) for i in range(2, 400)] + [(500, i) for i in range(501, 800)] + [(399, 799), (900, 901), (902, 901), (7, 7), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {(i, 1) for i in [*range(1, 400), *range(500, 800)]} | {(900, 900), (901, 900), (902, 900)}
    for hot in (20, 1_000_000):
        assert {tuple(r) for r in connected_components(frame, hot=hot).collect()} == want


def test_links_and_search_equal_sql(spark):
    con = connection(DATA)
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet")
    assert_same(nn_descent.embedding_near_duplicates(vectors).drop("recall"), con, nn_descent.ORACLE_SQL)
    assert_same(kdtree.top_k(vectors), con, kdtree.ORACLE_SQL)


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nn_descent.embedding_near_duplicates(none).count() == 0
    assert kdtree.top_k(none).count() == 0
    one = spark.createDataFrame([(50, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert kdtree.top_k(one).count() == 0


@pytest.mark.parametrize("shard_rows", [16, 4096])
def test_search_equals_brute_force(spark, shard_rows):
    rows = awkward(3)
    got = sorted(tuple(r) for r in kdtree.top_k(spark.createDataFrame(rows, SCHEMA), shard_rows=shard_rows).collect())
    points = [(r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]]) for r in rows if r[0] is not None and good(r[1])]
    want = []
    for query_id in sorted({i for i, _ in points if i % 50 == 0}):
        own = [v for i, v in points if i == query_id]
        if len(own) == 1:
            scores = [(-sum(a * b for a, b in zip(own[0], v, strict=True)), i) for i, v in points if i != query_id and len(v) == len(own[0])]
            want += [(query_id, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5])]
    assert [r for r in got if r[0] != 50] == [r for r in want if r[0] != 50]
    assert len([r for r in got if r[0] == 50]) == 5  # a repeated query id is one query


def test_boxes_keep_queries_from_leaves(spark):
    """Clustered vectors: most leaves cannot hold a better row and are never sent the query; lots and lists change nothing."""
    rnd = np.random.default_rng(11)
    centres = rnd.standard_normal((20, 12)) * 3
    x = centres[rnd.integers(0, 20, 3000)] + 0.1 * rnd.standard_normal((3000, 12))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sent, leaves = [], kdtree._leaves

    def counted(asked, boxes, first):
        out = leaves(asked, boxes, first)
        sent.append((out.count(), asked.count() * boxes.count()))
        return out

    kdtree._leaves = counted
    try:
        got = sorted(tuple(r) for r in kdtree.top_k(frame, shard_rows=64).collect())
    finally:
        kdtree._leaves = leaves
    y = np.floor(x * 256)
    want = []
    for q in range(0, 3000, 50):
        scores = y @ y[q]
        order = [i for i in np.lexsort((np.arange(3000), -scores)) if i != q][:5]
        want += [(q, n + 1, int(i), int(scores[i])) for n, i in enumerate(order)]
    assert got == want
    assert sum(n for n, _ in sent) < 0.5 * sent[0][1]
    again = sorted(tuple(r) for r in kdtree.top_k(frame, shard_rows=64, shard_queries=3, sample=200).collect())
    assert again == want
    kdtree._BROADCAST_BOXES, before = 0, kdtree._BROADCAST_BOXES
    try:
        assert sorted(tuple(r) for r in kdtree.top_k(frame, shard_rows=500).collect()) == want
    finally:
        kdtree._BROADCAST_BOXES = before


def test_scores_beyond_a_long(spark):
    rows = [(0, [1e306, 1.0]), (1, [1e306, 2.0]), (2, [-1e306, 0.0]), (3, [1.0, 1.0]), (50, [0.5, -3.0])]
    found = kdtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = {(r.query_id, r.vec_id): r.score for r in found}
    assert got[0, 1] == (1 << 63) - 1 and got[0, 2] == -(1 << 63) and got[50, 3] == 128 * 256 - 768 * 256


def test_tree_boxes_bound_their_points():
    rnd = np.random.default_rng(1)
    points = np.floor(rnd.standard_normal((300, 5)) * 256)
    tree, query = kdtree.KdTree(np.arange(300), points, leaf=8), np.floor(rnd.standard_normal(5) * 256)
    bound = tree.bounds(query[None, :])[0]
    for number, below in enumerate(tree.below):
        if not isinstance(below, tuple):
            assert bound[number] >= (points[below] @ query).max()
    ties = kdtree.KdTree(np.arange(10), np.ones((10, 2)), leaf=2)
    assert [-i for _, i in ties.search(3, np.ones(2), ties.bounds(np.ones((1, 2)))[0], 4, -9)] == [0, 1, 2, 4]


def test_labels_of_any_type_and_extreme_lengths(spark):
    base = np.random.default_rng(4).standard_normal(8).tolist()
    rows = [(i, [x * s for x in base]) for i, s in enumerate((1.0, 1e200, 1e-200, 1e-310, 3.0))]
    for kind, one, other in (("long", 3_000_000_000, 3_000_000_001), ("string", "a", "b"), ("double", 0.5, 1.5)):
        df = spark.createDataFrame([(*r, one) for r in rows] + [(9, base, other), (10, base, None)], f"vec_id long, embedding array<double>, label {kind}")
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn_descent.embedding_near_duplicates(df).collect()}
        assert got == {0: (4, 0, True), **{i: (4, 0, False) for i in range(1, 5)}, 9: (0, 9, True), 10: (0, 10, True)}


def test_every_link_between_components_is_found_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "_BLOCK", 16)
    rnd = np.random.default_rng(7)
    x = np.repeat(rnd.standard_normal((40, 6)), 5, axis=0) + rnd.standard_normal((200, 6)) * 0.02
    label = rnd.integers(0, 2, 200)
    nodes = spark.createDataFrame([(i, int(label[i]), 6, x[i].tolist()) for i in range(200)], "id long, label long, width int, vector array<double>")
    component = spark.createDataFrame([(i, i // 2 * 2) for i in range(100)], "id long, component long")
    of = {i: i // 2 * 2 if i < 100 else i for i in range(200)}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    want = {(min(i, j), max(i, j)) for i in range(200) for j in range(200) if near[i, j] and label[i] == label[j] and of[i] != of[j]}
    assert {(min(r), max(r)) for r in nn_descent._every_link(nodes, component, 0.98).collect()} == want
