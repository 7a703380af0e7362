"""Interval labels and replayed moves against plain walks and step-by-step replays."""

import json
import random

import pytest

from treeline.plans import editing as E
from treeline.plans import hierarchy as H
from treeline.plans import intervals as I
from treeline.plans import layout as L
from treeline.plans import moves as V

NODES = "doc_id long, id string, parent_id string, ord long"


def forest(seed, docs=4, n=60, odd=True):
    rnd, rows = random.Random(seed), []
    for doc in range(docs):
        for i in range(n):
            deep = rnd.random() < 0.7
            parent = None if i < 2 else f"x{i - 1 if deep else rnd.randrange(i)}"
            if odd and i % 19 == 18:
                parent = rnd.choice(["gone", "", f"x{min(n - 1, i + 3)}"])
            rows.append((doc, f"x{i}", parent, rnd.randrange(5)))
    return rows


def walked(rows):
    """(doc, id) -> the path from the topmost node down, and whether that names a missing parent; None on and below cycles."""
    parents = {(d, i): p or None for d, i, p, _ in rows}
    out = {}
    for doc, node in parents:
        path, at = [node], parents[doc, node]
        while at and (doc, at) in parents and at not in path:
            path.append(at)
            at = parents[doc, at]
        out[doc, node] = None if at in path else (path[::-1], bool(at))
    return out


@pytest.mark.parametrize("seed", [1])
def test_labels_equal_walks(spark, seed):
    rows = forest(seed)
    found = {(r.doc_id, r.id): r for r in I.numbered(spark.createDataFrame(rows, NODES)).collect()}
    paths = walked(rows)
    assert set(found) == set(paths)
    order = {(d, i): (o, i) for d, i, _, o in rows}
    for doc in {r[0] for r in rows}:
        whole = [k for k in paths if k[0] == doc and paths[k]]
        by_place = sorted(whole, key=lambda k: [order[doc, x] for x in paths[k][0]])
        assert [found[k].first for k in by_place] == list(range(len(whole)))
    for k, r in found.items():
        if paths[k] is None:
            assert r.top is r.branch is r.level is r.first is r.last is None
            continue
        path, dangling = paths[k]
        assert (r.top, r.level, r.dangling) == (path[0], len(path) - 1 + dangling, dangling)
        assert r.branch == (path[0] if dangling or len(path) == 1 else path[1])
        below = {j for j in paths if j[0] == k[0] and paths[j] and k[1] in paths[j][0]}
        assert {j for j in found if j[0] == k[0] and found[j].first is not None and r.first <= found[j].first <= r.last} == below


def test_subtrees_and_cycles_equal_the_paths(spark):
    rows = forest(5)
    nodes = spark.createDataFrame(rows, NODES)
    paths = walked(rows)
    rnd = random.Random(2)
    tops = [(d, f"x{rnd.randrange(60)}") for d in range(3) for _ in range(5)] + [(0, "absent")]
    got = {tuple(r) for r in I.without_subtrees(nodes, spark.createDataFrame(tops, "doc_id long, id string")).select("doc_id", "id").collect()}
    gone = {k for k, p in paths.items() if k in tops or p and any((k[0], x) in tops for x in p[0])}
    assert got >= set(paths) - gone - {k for k in paths if paths[k] is None} and not got & {k for k in gone if paths[k]}
    moves = [(d, f"x{rnd.randrange(60)}", f"x{rnd.randrange(60)}") for d in range(4) for _ in range(40)]
    frame = spark.createDataFrame(list(set(moves)), "doc_id long, id string, new_parent string")
    for r in I.makes_cycle(frame, I.numbered(nodes)).collect():
        way = paths[r.doc_id, r.new_parent]
        assert r.cycle == (r.id == r.new_parent or bool(way) and r.id in way[0])


def test_a_long_chain_takes_rounds_not_paths(spark):
    n = 2_000
    chain = spark.range(n).selectExpr("1L AS doc_id", "concat('x', id) AS id", "CASE WHEN id > 0 THEN concat('x', id - 1) END AS parent_id", "0L AS ord")
    found = I.numbered(chain)
    assert found.where(f"level <> first OR last <> {n - 1} OR level <> CAST(substr(id, 2) AS long) OR top <> 'x0'").count() == 0
    tops = spark.createDataFrame([(1, "x700")], "doc_id long, id string")
    assert I.without_subtrees(chain, tops).count() == 700


def test_no_rows(spark):
    none = spark.createDataFrame([], NODES)
    assert I.numbered(none).collect() == [] and V.judged(none, spark.createDataFrame([], "doc_id long, seq long, id string, new_parent string")).collect() == []


def replay(rows, moves):
    parents = {(d, i): p for d, i, p, *_ in rows}
    verdicts = {}
    for doc, seq, node, goal in sorted(moves):
        fine, at = (doc, node) in parents and (doc, goal) in parents, goal
        while fine and at and (doc, at) in parents:
            fine = at != node
            at = parents[doc, at]
        if fine:
            parents[doc, node] = goal
        verdicts[doc, seq] = fine
    return verdicts, parents


@pytest.mark.parametrize(("seed", "small"), [(1, 0), (3, 1000)])
def test_moves_equal_a_step_by_step_replay(spark, seed, small):
    rnd = random.Random(seed)
    rows = forest(seed, docs=5, n=12 if small else 7, odd=False)
    names = [f"x{i}" for i in range(12 if small else 7)] + ["absent"]
    moves = [(d, 10 * s, rnd.choice(names), rnd.choice(names)) for d in range(4) for s in range(rnd.choice([0, 8, 25, 45]) if small else 7)]
    nodes = spark.createDataFrame(rows, NODES)
    found = V.judged(nodes, spark.createDataFrame(moves, "doc_id long, seq long, id string, new_parent string"), small=small)
    verdicts, parents = replay(rows, moves)
    assert {(r.doc_id, r.seq): r.accepted for r in found.collect()} == verdicts
    assert {(r.doc_id, r.id): r.parent_id for r in V.replayed(nodes, found).collect()} == parents
    assert any(verdicts.values()) and not all(verdicts.values())


def test_moves_of_whole_documents_are_replayed_in_blocks(spark, monkeypatch):
    """Documents in a block, cut by borders, larger than a block, with cycles, empty parents and odd moves: as one by one; the small ones never take the joins."""
    rnd = random.Random(9)
    rows = [r[:4] for r in forest(9, docs=40, n=19)] + [(50, i, p, o) for _, i, p, o in forest(8, docs=1, n=150, odd=False)] + [(60, "a", "b", 0), (60, "b", "a", 0), (60, "c", "b", 0), (60, "d", "", 0)]
    names = [f"x{i}" for i in range(19)] + ["absent", None]
    moves = [(d, s * 3, rnd.choice(names), rnd.choice(names)) for d in [*range(0, 40, 2), 50] for s in range(rnd.choice([1, 9, 30]))] + [(60, 1, "d", "c"), (60, 2, "a", "d"), (60, 3, "d", "b"), (77, 1, "x1", "x2")]
    nodes, log = spark.createDataFrame(rows, NODES), spark.createDataFrame(moves, "doc_id long, seq long, id string, new_parent string")
    key = lambda x: sorted(map(tuple, x.collect()), key=str)
    want, slow = key(V._judged(nodes, log, 1000)), V._judged
    want_after = key(V.replayed(nodes, slow(nodes, log, 1000)).select("doc_id", "id", "parent_id"))
    joined = []
    monkeypatch.setattr(V, "_judged", lambda n, *a: joined.append({r.doc_id for r in n.select("doc_id").distinct().collect()}) or slow(n, *a))
    assert key(V.judged(nodes, log)) == want and joined == []
    assert key(V.after(nodes, log)) == want_after and joined == []
    monkeypatch.setattr(V.blocks, "BLOCK", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert key(V.judged(nodes, log)) == want and joined == [{50}]
        assert key(V.after(nodes, log)) == want_after and joined == [{50}, {50}]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_layout_follows_the_moves(spark):
    rows = [(*r, True, None) for r in forest(7, docs=2, n=20, odd=False)]
    schema = f"{NODES}, auto_align boolean, side string"
    moves = [(0, 1, "x5", "x1"), (0, 2, "x1", "x9"), (1, 1, "x3", "x0"), (1, 2, "x0", "x3")]
    nodes = spark.createDataFrame(rows, schema)
    after = V.replayed(nodes, V.judged(nodes, spark.createDataFrame(moves, "doc_id long, seq long, id string, new_parent string")))
    _, parents = replay([r[:4] for r in rows], moves)
    plain = spark.createDataFrame([(d, i, parents[d, i], *rest) for d, i, _, *rest in rows], schema)
    place = lambda x: sorted(map(tuple, L.positions(L.tree(x)).collect()))
    assert place(after) == place(plain) != place(nodes)


def test_levels_and_colours_equal_those_of_paths(spark):
    nodes = spark.createDataFrame(forest(9), NODES)
    paths = H.rooted(nodes)
    climbed = I.climbed(nodes)
    assert sorted(map(tuple, climbed.select("doc_id", "id", "level").collect()), key=str) == sorted(map(tuple, H.levels(paths).collect()), key=str)
    assert sorted(map(tuple, climbed.select("doc_id", "id", "branch").collect()), key=str) == sorted(map(tuple, H.branch_colors(paths).select("doc_id", "id", "branch_id").collect()), key=str)


def test_generated_trees_of_any_depth(spark):
    def chain(n):
        return {"text": "a", "children": [chain(n - 1)] if n else []}

    tree = {"text": "World", "children": [chain(6), {"text": "Pros", "children": [{"text": "x"}]}, {"text": "Pros", "children": [{"text": "x"}, {"text": "x"}]}, {"text": "Pros#1"}, {"text": "a/a"}, {"id": "own", "text": ""}, {"children": [{"text": "y"}]}]}
    rows = spark.createDataFrame([(1, json.dumps(tree)), (2, '{"text":"W"}'), (3, "no json"), (4, None)], "doc_id long, json string")
    want = []

    def walk(children, parent, side, level):
        for k, child in enumerate(children):
            want.append((child.get("text"), level, side, 600.0 + (-250 if side == "left" else 250) * level, 100.0 * level + 80 * k))
            walk(child.get("children", []), child, side, level + 1)

    walk(tree["children"][:4], None, "left", 1)
    walk(tree["children"][4:], None, "right", 1)
    nodes, edges = E.flattened(rows)
    found = nodes.collect()
    assert sorted(((r.label, r.level, r.side, r.x, r.y) for r in found), key=str) == sorted(want, key=str)
    ids = {r.id for r in found}
    assert len(ids) == len(found) and {"ai-Pros", "ai-Pros#1", "ai-Pros~21", "ai-a~1a", "ai-a/a", "own"} <= ids
    assert all(r.parent_id == "root-node" or r.parent_id in ids for r in found)
    assert {(r.source, r.target) for r in edges.collect()} == {(r.parent_id, r.id) for r in found}
    assert {r.doc_id: r.valid for r in E.generated_valid(rows).collect()} == {1: False, 2: True, 3: False, 4: False}
