"""Documents walked in blocks against jumps alone."""

from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.test_intervals_and_moves import NODES, forest
from treeline.plans import blocks as B
from treeline.plans import hierarchy as H
from treeline.plans import intervals as I
from treeline.plans import layout as L
from treeline.plans.catalog import queries

QUERIES = queries()

FOUND = ["doc_id", "id", "top", "branch", "level", "dangling", "first", "last", "leaf", "leaves"]


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_documents_in_blocks_equal_jumps(spark):
    """Most documents are walked where they lie; those larger than a block, cut by a border or with odd ids are left, and both agree with the jumps."""
    rows = forest(3, docs=30, n=23) + [(100 + d, i, p, o) for d, i, p, o in forest(4, docs=2, n=120)]
    nodes = spark.createDataFrame(rows, NODES)
    by_jumps = sorted_rows(I._numbered(nodes), *FOUND)
    assert sorted_rows(I.numbered(nodes), *FOUND) == by_jumps
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        known, rest = B.resolved(nodes, block=64)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    left = {r.doc_id for r in rest.select("doc_id").distinct().collect()}
    assert {100, 101} <= left and len(left) < 12
    assert sorted_rows(known, *FOUND) == [r for r in by_jumps if r[0] not in left]
    assert known.count() + rest.count() == len(rows)
    odd = spark.createDataFrame([*rows, (5, "x1", None, 9), (6, None, None, 9), (None, "x", None, 1)], NODES)
    known, rest = B.resolved(odd)
    assert {5, 6, None} <= {r.doc_id for r in rest.select("doc_id").distinct().collect()}
    paths = sorted_rows(H._doubled(nodes, 40), "doc_id", "id", "path", "dangling")
    assert sorted_rows(H.rooted(nodes), "doc_id", "id", "path", "dangling") == paths


def test_new_children_need_one_walk_and_equal_the_separate_steps(spark, monkeypatch):
    """Side and place of a new child from the rows of one tree, as from sides, places and counts of all nodes; in blocks and by jumps."""
    rows = [(*r, i % 13 != 5, ("left", None, "right", None, None)[i % 5] if r[0] > 1 else None, i % 4 == 0) for i, r in enumerate(forest(11, docs=4, n=40))]
    nodes = spark.createDataFrame(rows, f"{NODES}, auto_align boolean, side string, is_free boolean")
    places = L.positions(L.tree(nodes))
    want = sorted_rows(L.child_places(nodes, places, L.suggested_sides(nodes, places)), "doc_id", "id", "side", "x", "y")
    tree = L.tree(nodes)
    assert sorted_rows(L.spots_below(tree, tree), "doc_id", "id", "side", "x", "y") == want and len(want) > 50
    resolved, walks = B.resolved, []
    monkeypatch.setattr(B, "resolved", lambda *a, **k: walks.append(1) or resolved(*a, **k))
    QUERIES["added_edges"](spark, DATA)
    assert len(walks) == 1
    monkeypatch.setattr(B, "resolved", lambda *a, **k: resolved(*a, **k, block=8))
    tree = L.tree(nodes)
    assert sorted_rows(L.spots_below(tree, tree), "doc_id", "id", "side", "x", "y") == want


def test_new_nodes_are_made_from_the_tree_alone(spark):
    """After the walk no step of added_nodes reads or joins all nodes again."""
    plan = QUERIES["added_nodes"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "children" in plan and "o_orderkey" not in plan


def test_places_of_tops_and_written_rows(spark, monkeypatch, request):
    """Roots and branches have their new children's places from windows alone, with and without set sides; of documents walked whole no other rows are written, and all of the rest is kept."""
    rows = [(*r, i % 13 != 5, ("left", None, "right", None, None)[i % 5] if r[0] % 3 == 1 else None, i % 4 == 0) for i, r in enumerate(forest(11, docs=40, n=30))]
    nodes = spark.createDataFrame(rows, f"{NODES}, auto_align boolean, side string, is_free boolean")
    shown, asked = ("doc_id", "id", "side", "x", "y"), lambda level, parent: (level < 2) | (parent == "x3")
    # small blocks, and borders that cut documents
    for name, value in {"spark.sql.execution.arrow.maxRecordsPerBatch": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}.items():
        before = spark.conf.get(name)
        spark.conf.set(name, value)
        request.addfinalizer(lambda name=name, before=before: spark.conf.set(name, before))
    whole = L.tree(nodes)
    want = [sorted_rows(L.spots_below(t, t).where("level < 2"), *shown) for t in (whole, whole.withColumn("side", F.lit(None).cast("string")))]
    for block in (B.BLOCK, 16):
        monkeypatch.setattr(B, "BLOCK", block)
        few = L.tree(nodes, asked)
        assert sorted_rows(few, *whole.columns) == sorted_rows(whole.where("level < 2 OR parent_id = 'x3'"), *whole.columns)
        assert [sorted_rows(L.spots_of_tops(t), *shown) for t in (few, few.withColumn("side", F.lit(None).cast("string")))] == want
    known, rest = B.resolved(nodes.where("auto_align"), wanted=lambda level, parent: level < 0)
    left = {r.doc_id for r in rest.select("doc_id").distinct().collect()}
    assert left and rest.count() == sum(r[0] in left and r[4] for r in rows) and known.count() + rest.count() < len(rows) / 2


def test_nodes_without_children_do_not_jump(spark, monkeypatch):
    """A large shallow document goes by rounds of its few inner nodes, not of all its nodes."""
    rows = [(1, "a", None, 0), *((1, f"b{i}", "a", i) for i in range(5)), *((1, f"c{i}", f"b{i % 5}", i) for i in range(300)), (1, "d", "gone", 1), (1, "e", "d", 1), (2, "f", "g", 0), (2, "g", "f", 0), (2, "h", "g", 0)]
    nodes, sizes, climbed = spark.createDataFrame(rows, NODES), [], I._climbed
    want = sorted_rows(I.numbered(nodes), *FOUND, "children")
    monkeypatch.setattr(I, "_climbed", lambda links, known: sizes.append(links.count()) or climbed(links, known))
    assert sorted_rows(I._numbered(nodes), *FOUND, "children") == want
    assert sizes == [9]
