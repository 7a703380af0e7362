"""Hierarchies and layout against direct models of their rules."""

import random

import pytest

from treeline.plans import editing as E
from treeline.plans import hierarchy as H
from treeline.plans import layout as L

NODES = "doc_id long, id string, parent_id string, label string, ord long, auto_align boolean, side string"


def forest(seed, n, roots=2, presets=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        parent = None if i < roots else f"x{rnd.randrange(i)}"
        side = rnd.choice([None, None, "left", "right"]) if presets else None
        rows.append((f"x{i}", parent, f"L{i}", i, rnd.random() > 0.1 if i >= roots else True, side))
    return rows


def model_layout(rows):
    """The recursive rule: heights bottom-up, places top-down."""
    rows = [r for r in rows if r[4] is not False]
    kids = {r[0]: [c for c in rows if c[1] == r[0]] for r in rows}
    places, sides = {}, {}

    def height(node):
        below = [height(c[0]) for c in kids[node]]
        return max(50, sum(below) + 80 * (len(below) - 1)) if below else 50

    def column(children, x, y, side):
        x += -250 if side == "left" else 250
        heights = [height(c[0]) for c in children]
        at = y - (sum(heights) + 80 * (len(heights) - 1)) / 2
        for child, h in zip(children, heights, strict=True):
            places[child[0]], sides[child[0]] = (x, at + h / 2), side
            if kids[child[0]]:
                column(kids[child[0]], x, at + h / 2, side)
            at += h + 80

    for i, root in enumerate(r for r in rows if not r[1]):
        places[root[0]] = (600, 400 + 600 * i)
        halves = {"left": [], "right": []}
        for child in kids[root[0]]:
            side = child[5] if child[5] in halves else "left" if len(halves["left"]) <= len(halves["right"]) else "right"
            halves[side].append(child)
        for side, children in halves.items():
            if children:
                column(children, 600, 400 + 600 * i, side)
    return places, sides


def frame(spark, *documents):
    """Rows of several documents, numbered from 1."""
    return spark.createDataFrame([(i, *r) for i, rows in enumerate(documents, 1) for r in rows], NODES)


def pairs(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "doc_id long, id string, parent_id string")


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 7), (3, 40), (4, 90)])
def test_layout_equals_the_recursive_rule(spark, seed, n):
    rows = forest(seed, n, roots=1 if n == 1 else 2)
    places, sides = model_layout(rows)
    got = {r.id: (r.x, r.y, r.side) for r in L.positions(L.tree(frame(spark, rows))).collect()}
    assert got == {k: (float(x), float(y), sides.get(k)) for k, (x, y) in places.items()}


def test_documents_with_the_same_ids_do_not_mix(spark):
    """Every function over several documents gives what it gives over each of them alone."""
    documents = [forest(seed, 25) for seed in (11, 12, 13)]
    nodes = frame(spark, *documents)
    paths = H.rooted(nodes)

    def apart(build):
        return {(i, *tuple(r)[1:]) for i, rows in enumerate(documents, 1) for r in build(frame(spark, rows)).collect()}

    for build in (
        lambda x: L.positions(L.tree(x)),
        lambda x: L.heights(L.tree(x)),
        lambda x: L.suggested_sides(x, L.sides(L.tree(x))),
        lambda x: H.levels(H.rooted(x)),
        lambda x: H.branch_colors(H.rooted(x)),
        lambda x: H.closure(H.rooted(x)),
        lambda x: H.ancestor_labels(x, H.rooted(x)),
    ):
        whole = build(nodes)
        assert whole.columns[0] == "doc_id" and {tuple(r) for r in whole.collect()} == apart(build)
    places, _ = model_layout(documents[1])
    got = {r.id: (r.x, r.y) for r in L.positions(L.tree(nodes)).where("doc_id = 2").collect()}
    assert got == {k: (float(x), float(y)) for k, (x, y) in places.items()}
    tops = spark.createDataFrame([(2, "x0")], "doc_id long, id string")
    left = H.without_subtrees(nodes, paths, tops).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in left}[1] == 25 and {r[0]: r[1] for r in left}[3] == 25 and {r[0]: r[1] for r in left}.get(2, 0) < 25
    plan = L.positions(L.tree(nodes))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def model_reparented(nodes, edges, dragged, parent):
    """The editor's steps, one by one, on one document."""
    nodes, edges = {k: dict(v) for k, v in nodes.items()}, [dict(e) for e in edges]
    at = parent
    while at:
        if at == dragged:
            return nodes, edges
        at = nodes[at]["parent_id"] if at in nodes else None
    old = next((e for e in edges if e["is_parent_child"] and e["target"] == dragged), None)
    if old:
        edges.remove(old)
    if nodes[parent]["parent_id"]:
        side = nodes[parent]["side"] or "right"
    else:
        kids = [n["side"] for n in nodes.values() if n["parent_id"] == parent and n["auto_align"] is not False]
        side = "left" if kids.count("left") <= kids.count("right") else "right"
    handles = {"source_handle": f"source-{side}", "target_handle": "target-right" if side == "left" else "target-left"}
    todo = [dragged]
    while todo:
        top = todo.pop()
        nodes[top]["side"] = side
        for e in edges:
            if e["is_parent_child"] and e["target"] == top:
                e.update(handles)
        todo += [k for k, n in nodes.items() if n["parent_id"] == top]
    nodes[dragged].update(parent_id=parent, color=nodes[parent]["color"], auto_align=True)
    edges.append({"id": f"e-{parent}-{dragged}", "source": parent, "target": dragged, **handles, "color": nodes[parent]["color"], "is_parent_child": True})
    return nodes, edges


def test_reparent_equals_the_editors_steps(spark):
    rnd, rows, links, moves, want = random.Random(5), [], [], [], {}
    for doc in range(1, 13):
        nodes, edges = {}, []
        for i in range(12):
            parent = f"x{rnd.randrange(i)}" if i else None
            nodes[f"x{i}"] = {"parent_id": parent, "side": rnd.choice(["left", "right", None]), "color": f"#{i}", "auto_align": rnd.random() > 0.2}
            if parent:
                edges.append({"id": f"e-{parent}-x{i}", "source": parent, "target": f"x{i}", "source_handle": None, "target_handle": None, "color": "#e", "is_parent_child": True})
        edges.append({"id": "c", "source": "x1", "target": "x5", "source_handle": "source-top", "target_handle": "target-top", "color": "#c", "is_parent_child": False})
        move = (f"x{rnd.randrange(1, 12)}", f"x{rnd.randrange(12)}")
        moves.append((doc, *move))
        rows += [(doc, k, n["parent_id"], n["side"], n["color"], n["auto_align"]) for k, n in nodes.items()]
        links += [(doc, *e.values()) for e in edges]
        want[doc] = model_reparented(nodes, edges, *move)
    frame_ = spark.createDataFrame(rows, "doc_id long, id string, parent_id string, side string, color string, auto_align boolean")
    edges = spark.createDataFrame(links, "doc_id long, id string, source string, target string, source_handle string, target_handle string, color string, is_parent_child boolean")
    moved, left = E.reparented(frame_, edges, H.rooted(frame_), spark.createDataFrame(moves, "doc_id long, id string, new_parent string"))
    assert {tuple(r) for r in moved.collect()} == {(d, k, n["parent_id"], n["side"], n["color"], n["auto_align"]) for d, (nodes, _) in want.items() for k, n in nodes.items()}
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(str((d, *(e[c] for c in left.columns[1:]))) for d, (_, es) in want.items() for e in es)


def test_children_of_free_nodes_are_lower(spark):
    nodes = spark.createDataFrame([(1, "r", None, True, False), (1, "f", None, False, True), (1, "a", "f", True, False), (1, "b", "r", True, False)], "doc_id long, id string, parent_id string, auto_align boolean, is_free boolean")
    places = spark.createDataFrame([(1, "r", None, 600.0, 400.0), (1, "f", "left", 0.0, 0.0)], "doc_id long, id string, side string, x double, y double")
    sides = spark.createDataFrame([(1, "r", "right"), (1, "f", "left")], "doc_id long, id string, side string")
    assert {(r.id, r.x, r.y) for r in L.child_places(nodes, places, sides).collect()} == {("r", 850.0, 440.0), ("f", -250.0, 80.0)}


def test_chain_star_and_unaligned_child(spark):
    rows = [("r", None, "", 0, True, None), ("a", "r", "", 1, True, None), ("b", "a", "", 2, True, None), ("c", "r", "", 3, False, None), ("d", "c", "", 4, True, None), ("e", "gone", "", 5, True, None)]
    found = {r.id: (r.x, r.y) for r in L.positions(L.tree(frame(spark, rows))).collect()}
    assert found == {"r": (600.0, 400.0), "a": (350.0, 400.0), "b": (100.0, 400.0)}  # below an unaligned or missing node: no place


def test_levels_paths_and_missing_parents(spark):
    rows = [("r", None, "R", 0, True, None), ("a", "r", "A", 1, True, None), ("b", "a", "B", 2, True, None), ("lost", "gone", "X", 3, True, None), ("sub", "lost", "Y", 4, True, None), ("e", "", "E", 5, True, None)]
    nodes = frame(spark, rows)
    paths = H.rooted(nodes)
    assert {r.id: r.level for r in H.levels(paths).collect()} == {"r": 0, "a": 1, "b": 2, "lost": 1, "sub": 2, "e": 0}
    assert {r.id: r.labels for r in H.ancestor_labels(nodes, paths).collect()} == {"r": "", "a": "R", "b": "R > A", "lost": "", "sub": "X", "e": ""}
    assert {r.id: r.branch_id for r in H.branch_colors(paths).collect()} == {"r": "r", "a": "a", "b": "a", "lost": "lost", "sub": "lost", "e": "e"}


def test_cycles_have_no_path_and_are_refused(spark):
    looped = pairs(spark, [("a", "b"), ("b", "a"), ("c", "b"), ("r", None)])
    assert {r.id: r.path for r in H.rooted(looped).collect()} == {"a": None, "b": None, "c": None, "r": ["r"]}
    nodes = pairs(spark, [("r", None), ("a", "r"), ("b", "a")])
    moves = spark.createDataFrame([(1, "a", "b"), (1, "b", "r")], "doc_id long, id string, new_parent string")
    assert {(r.id, r.cycle) for r in H.makes_cycle(moves, H.rooted(nodes)).collect()} == {("a", True), ("b", False)}
    assert [tuple(r) for r in H.possible(moves, nodes, H.rooted(nodes)).collect()] == [(1, "b", "r")]


def test_deep_chain_needs_few_rounds(spark):
    nodes = spark.range(300).selectExpr("1L doc_id", "concat('n', id) id", "if(id = 0, null, concat('n', id - 1)) parent_id")
    assert {r.id: r.level for r in H.levels(H.rooted(nodes)).collect()} == {f"n{i}": i for i in range(300)}


def test_cascade_leaves_edges_dangling(spark):
    nodes = pairs(spark, [("r", None), ("a", "r"), ("b", "a"), ("c", "r")])
    edges = spark.createDataFrame([(1, "e1", "r", "a", True), (1, "e2", "a", "b", True), (1, "e3", "r", "c", True), (1, "x", "a", "zz", False)], "doc_id long, id string, source string, target string, is_parent_child boolean")
    left = H.without_subtrees(nodes, H.rooted(nodes), spark.createDataFrame([(1, "a"), (2, "r")], "doc_id long, id string"))
    assert {r.id for r in left.collect()} == {"r", "c"}
    assert {r.id for r in H.dangling_edges(edges, left).collect()} == {"e1", "e2"}
    assert H.rooted(nodes.limit(0)).count() == 0
