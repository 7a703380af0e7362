"""Lists under concurrent edits against a list that is edited element by element; sums over groups of all sizes."""

import random

import pytest
from pyspark.sql import functions as F

from treeline.operators import lists as L
from treeline.operators.ordered import sums_before

OPS = "doc_id long, kind string, id string, after string, clock long, client string, value string"


def random_ops(seed, docs=3, n=70):
    """Three clients that see what they have seen: each edits its own copy, and now and then takes over all others."""
    rnd, ops = random.Random(seed), []
    for doc in range(docs):
        made, clocks, seen = [], {c: 0 for c in "abc"}, {c: [] for c in "abc"}
        for i in range(n):
            me = rnd.choice("abc")
            if rnd.random() < 0.2:
                seen[me], clocks[me] = list(made), max(clocks.values())
            clocks[me] += 1
            known = [o for o in seen[me] if o[1] == "insert"]
            if known and rnd.random() < 0.25:
                op = (doc, "delete", rnd.choice(known)[2], None, clocks[me], me, None)
            else:
                after = rnd.choice(known[-3:])[2] if known and rnd.random() < 0.9 else None
                op = (doc, "insert", f"{me}{i}", after, clocks[me], me, f"v{i}")
            made.append(op)
            seen[me].append(op)
        ops += made
    return ops


def integrated(ops):
    """(doc, position, id, value): each insertion skips the newer ones that stand behind its neighbour, deletions leave tombstones."""
    lists, gone, rest = {}, set(), sorted({o for o in ops if o[1] == "insert"}, key=lambda o: (o[4], o[2]))
    rank = {(o[0], o[2]): (-o[4], o[5], o[2]) for o in rest}
    for doc, kind, name, *_ in ops:
        if kind == "delete":
            gone.add((doc, name))
    for doc, _, name, after, *_, value in rest:
        line = lists.setdefault(doc, [])
        at = 0 if after is None else next(i for i, (x, _) in enumerate(line) if x == after) + 1
        # those that are newer come first, with all that follows them
        while at < len(line) and rank[doc, line[at][0]] < rank[doc, name]:
            at += 1
        line.insert(at, (name, value))
    out = []
    for doc, line in lists.items():
        out += [(doc, i, *e) for i, e in enumerate(e for e in line if (doc, e[0]) not in gone)]
    return sorted(out)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_arrival_gives_the_list_of_one_integration(spark, seed):
    ops = random_ops(seed)
    want = integrated(ops)
    random.Random(seed).shuffle(ops)
    got = L.listed(spark.createDataFrame(ops + ops[::3], OPS).repartition(5).withColumn("first", F.lit(1)))
    assert rows(got, "doc_id", "position", "id", "value") == want


def test_elements_wait_for_what_they_follow(spark):
    ops = [(1, "insert", "a", None, 1, "x", "A"), (1, "insert", "c", "b", 3, "x", "C"), (1, "insert", "d", "c", 4, "x", "D"), (1, "delete", "d", None, 5, "y", None)]
    late = spark.createDataFrame(ops, OPS)
    assert rows(L.listed(late), "position", "id") == [(0, "a")]
    assert rows(L.waiting(late), "id", "after") == [("c", "b"), ("d", "c")]
    whole = late.union(spark.createDataFrame([(1, "insert", "b", "a", 2, "y", "B")], OPS))
    assert rows(L.placed(whole), "position", "id", "deleted") == [(0, "a", False), (1, "b", False), (2, "c", False), (3, "d", True)]
    assert L.waiting(whole).count() == 0


def test_awkward_operations(spark):
    assert L.listed(spark.createDataFrame([], OPS)).count() == 0
    ops = [(None, "insert", "a", None, 1, "x", "A"), (1, "insert", None, None, 1, "x", "A"), (1, "other", "b", None, 1, "x", "B"), (1, None, "b", None, 1, "x", "B"), (1, "delete", "nobody", None, 1, "x", None),
           (1, "insert", "n", None, None, None, None), (1, "insert", "m", "", 2**63 - 1, "x", "v" * 100_000), (1, "insert", "m", None, 2**63 - 1, "y", "second"), (1, "insert", "k", None, -(2**63), "x", "K"), (1, "insert", "u", "w", 1, "x", "U"), (1, "insert", "w", "u", 1, "x", "W")]
    assert rows(L.listed(spark.createDataFrame(ops, OPS)), "position", "id", F.length("value")) == [(0, "m", 100_000), (1, "n", None), (2, "k", 1)]


def test_places_become_operations(spark):
    ops = spark.createDataFrame([(1, "insert", x, before, n, "a", x) for n, (x, before) in enumerate([("p", None), ("q", "p"), ("r", "q"), ("s", "r")])], OPS)
    seen = L.listed(ops)
    added = L.inserted_at(seen, spark.createDataFrame([(1, 0, "first", 10, "b", "F"), (1, 2, "mid", 10, "b", "M"), (1, 99, "end", 10, "b", "E"), (2, 3, "new", 1, "b", "N")], "doc_id long, index long, id string, clock long, client string, value string"))
    cut = L.deleted_ranges(seen, spark.createDataFrame([(1, 1, 2, 11, "c"), (1, 3, 50, 11, "c"), (1, -2, 1, 11, "c"), (7, 0, 5, 11, "c")], "doc_id long, start long, count long, clock long, client string"))
    assert rows(cut, "doc_id", "id") == [(1, "q"), (1, "r"), (1, "s")]
    # the insertion behind q stands although q goes at the same time
    assert rows(L.listed(ops.union(added).union(cut)), "doc_id", "position", "id") == [(1, 0, "first"), (1, 1, "p"), (1, 2, "mid"), (1, 3, "end"), (2, 0, "new")]


def test_sums_of_a_group_with_most_rows(spark):
    data = [(None if n % 50 == 0 else "hot" if n % 3 else f"g{n % 7}", n, None if n % 11 == 0 else n) for n in range(3000)]
    df = spark.createDataFrame(data, "g string, n long, v long").repartition(7)
    got = {r.n: r.s for r in sums_before(df, ["g"], ["n"], s=F.col("v")).collect()}
    run, want = {}, {}
    for g, n, v in data:
        want[n] = run.get(g, 0)
        run[g] = want[n] + (v or 0)
    assert got == want
