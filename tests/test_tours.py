"""Tours shortened in blocks, and sums over ranges, against jumps alone and plain sums."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_intervals_and_moves import NODES, forest
from tests.test_lists import OPS, integrated, random_ops
from treeline.operators import lists as L
from treeline.operators.ordered import sums_before
from treeline.plans import intervals as I
from treeline.plans import tours


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 1 << 17)])
def test_tours_equal_jumps(spark, seed, block):
    rows = forest(seed, docs=3, n=80)
    nodes = spark.createDataFrame(rows, NODES).repartition(5)
    got = {(r.doc_id, r.id): r.back for r in tours.places(nodes, block).collect()}
    want = I._numbered(nodes).where("first IS NOT NULL AND NOT dangling").collect()
    assert set(got) == {(r.doc_id, r.id) for r in want}
    by_tour = sorted(got, key=lambda k: (k[0], -got[k]))
    assert by_tour == [(r.doc_id, r.id) for r in sorted(want, key=lambda r: (r.doc_id, r.first))]


def test_only_the_borders_of_blocks_take_part_in_rounds(spark, monkeypatch):
    """A list that grows with time: the jumps had as many rows as elements, in every round."""
    written = []

    class Counted(tours.Rounds):
        def __call__(self, df):
            out = super().__call__(df)
            written.append((out.columns, out.count()))
            return out

    monkeypatch.setattr(tours, "Rounds", Counted)
    rnd = random.Random(4)
    rows = [(1, f"e{i}", f"e{i - rnd.randrange(1, 4)}" if i > 3 else None, i) for i in range(4000)]
    assert tours.places(spark.createDataFrame(rows, NODES), block=500).count() == 4000
    assert max(n for columns, n in written if "to_enters" in columns) < 200
    assert len([c for c, n in written if n >= 4000]) == 2


@pytest.mark.parametrize("block", [5, 1 << 17])
def test_lists_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(tours, "BLOCK", block)
    ops = random_ops(6)
    got = L.listed(spark.createDataFrame(ops, OPS).repartition(5))
    assert sorted_rows(got, "doc_id", "position", "id", "value") == sorted(integrated(ops), key=str)


def test_sums_of_groups_that_ranges_cut(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, "a", "b", "b", "b", f"s{i}"]), i, rnd.choice([None, 1, 5, -2])) for i in range(3000)]
    got = {r.n: r.s for r in sums_before(spark.createDataFrame(rows, "g string, n long, v long").repartition(7), ["g"], ["n"], s=F.col("v")).collect()}
    sums, want = {}, {}
    for g, n, v in rows:
        want[n] = sums.get(g, 0)
        sums[g] = want[n] + (v or 0)
    assert got == want
