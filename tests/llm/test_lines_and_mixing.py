import collections
import random
import re

import pytest

from tests.compare import assert_same, connection
from tests.conftest import DATA
from tests.llm.cases import edge_docs, no_docs
from treeline.llm import line_dedup, mixing


def test_lines_equal_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert_same(line_dedup.without_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped"), connection(DATA), line_dedup.ORACLE_SQL)


def test_lines_equal_the_rule(spark):
    rnd = random.Random(1)
    rows = [(i, "\n".join(rnd.choice(["menu", "footer", "", f"own {i}", "rare", f"own {i}"]) for _ in range(rnd.randrange(6))) if i % 9 else None, rnd.choice(["a", "b", "c", None])) for i in range(120)]
    pages, on = collections.Counter(r[2] for r in rows), collections.Counter()
    for _, text, host in rows:
        on.update((host, line) for line in set((text or "").split("\n")) if text is not None)
    bad = {(h, line) for (h, line), n in on.items() if h and line.strip() and n >= 3 and n > 0.05 * pages[h]}
    want = {i: None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad) for i, t, h in rows}
    got = line_dedup.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.text for r in got} == want and bad
    assert all(r.n_dropped == (0 if r.text is None else r.n_lines - (len(r.text.split("\n")) if r.n_lines > r.n_dropped else 0)) for r in got)


def test_lines_edges_and_plan(spark):
    docs = edge_docs(spark)
    made = line_dedup.without_boilerplate(docs)
    assert made.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted((r.doc_id or -1, r.text or "") for r in made.collect()) == sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    assert line_dedup.without_boilerplate(no_docs(spark)).count() == 0
    clash = docs.selectExpr("*", "size AS n_lines", "size AS site", "size AS slots", "size AS `row`", "size AS kept", "size AS `a.b`")
    again = line_dedup.without_boilerplate(clash)
    assert again.count() == 12 and set(again.columns) == {*made.columns, "site", "slots", "row", "kept", "a.b"}
    assert all(r.site == "x" == r.kept and isinstance(r.n_lines, int) for r in again.collect())
    assert not re.search("Python|Arrow|Pandas", made._jdf.queryExecution().toString())


def test_lines_without_broadcasts(spark):
    """The same rows where no site's lines may be broadcast by their number, and where every site is hot."""
    rnd = random.Random(12)
    rows = [(i, "\n".join(f"line {rnd.randrange(60)}" for _ in range(8)), rnd.choice("ab") if i % 50 else None, 7) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    want = sorted(map(tuple, line_dedup.without_boilerplate(docs).collect()))
    assert sum(r[5] for r in want) > 1000
    assert all(r[3] == (len(r[1]) if r[5] else 7) for r in want)
    for hot in (1, 1000):
        assert sorted(map(tuple, line_dedup.without_boilerplate(docs, broadcast_lines=0, hot=hot).collect())) == want


def test_a_thousand_boilerplate_lines_on_a_page(spark):
    lines = [f"line {i}" for i in range(1000)]
    docs = spark.range(40).selectExpr("id AS doc_id", "'a' AS source").crossJoin(spark.createDataFrame([("\n".join(lines) + "\nmine",)], "text string"))
    listed = line_dedup.boilerplate_lines(docs).first()
    assert listed.n == 1001 and max(len(x or []) for x in listed.slots) < 20
    assert {(r.text, r.n_dropped) for r in line_dedup.without_boilerplate(docs).collect()} == {("", 1001)}


def model_targets(sizes, weights=(3, 1, 2), share=1.5, times=2.0):
    """Shares by weight, what is over a cap reshared until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_ones, out = share * sum(sizes.values()), set(order), {}
    while open_ones:
        total = sum(weight[s] for s in open_ones)
        over = {s for s in open_ones if left * weight[s] / total > times * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_ones}
            break
        for s in over:
            out[s] = times * sizes[s]
        left -= sum(times * sizes[s] for s in over)
        open_ones -= over
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, seed):
    rnd = random.Random(seed)
    names = ["a", "B", "é", "z", None, "", "tiny"]
    rows = []
    for i in range(150):
        source = rnd.choice(names[:6])
        rows.append((i, " ".join("w" * rnd.randrange(1, 4) for _ in range(200 if source == "B" else rnd.randrange(40))), source))
    rows += [(900, "only five words in here", "tiny"), (901, None, "a"), (None, "no id here", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs, shard_words=300).collect()
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
    targets, taken = model_targets(sizes), collections.Counter()
    for r in got:
        assert r.size * 2 >= r.taken >= 0 and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 1 + 0.002 * target
    again = mixing.mixed(docs.repartition(7), shard_words=300).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_blocks_of_many_words(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 900)), f"s{rnd.choice([0, 0, 0, 1, 2, 3])}") for i in range(300)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_words=20_000).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    block = min(r.source_size for r in got) // 64
    assert block > 100
    for source, want in target.items():
        assert abs(taken[source] - want) <= block * 6


def model_seats(votes, seats, caps):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max((i for i in range(len(votes)) if won[i] < caps[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * won[i] + 1), -i), default=None)
        if best is None:
            break
        won[best] += 1
    return won


def test_seats_equal_the_highest_quotients(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for group in range(30):
        n, seats = rnd.randrange(1, 12), rnd.randrange(0, 60)
        votes = [float(rnd.choice([0, 1, 1, 5, 100, rnd.randrange(1, 1000)])) for _ in range(n)]
        caps = [10_000 if group % 3 else rnd.choice([0, 1, 3, seats // n, seats]) for _ in range(n)]
        rows += [(group, seats, v, c, i) for i, (v, c) in enumerate(zip(votes, caps, strict=True))]
        want |= {(group, i): w for i, w in enumerate(model_seats(votes, seats, caps))}
    rows += [(99, 10, 1.0, 10, 0), (99, 10, 1000.0, 5, 1)]
    want |= {(99, 0): 5, (99, 1): 5}
    units = spark.createDataFrame(rows, "g long, seats long, votes double, cap long, nth long")
    got = {(r.g, r.nth): r.won for r in mixing.apportion(units, "g", "seats", "votes", "cap", "nth", "won").collect()}
    assert got == want


def test_mixed_texts_hold_the_taken_words(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.mixed(docs).collect()}
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    found, texts = collections.Counter(), {r.doc_id: r.text for r in docs.collect()}
    for r in made.collect():
        found[r.doc_id] += words(r.text)
        assert texts[r.doc_id].startswith(r.text)
    assert dict(found) == {k: v for k, v in taken.items() if v}


def test_repeated_rows_and_shuffled_plans(spark, monkeypatch):
    """A document that is a third of all rows, rows without ids, ids with several texts: the same however they are dealt out."""
    rows = [(1, "one two three", "a")] * 40 + [(None, f"t{i % 7} u v", "a") for i in range(40)] + [(i % 9, f"{i} x " * (i % 4), None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mixed(docs, shard_words=50).collect()))
    made = sorted(map(str, mixing.mixed_documents(docs, shard_words=50).collect()))
    assert len(want) == 120
    monkeypatch.setattr(mixing, "_TOGETHER", 7)
    again = mixing.mixed(docs.repartition(5), shard_words=50)
    assert sorted(map(str, again.collect())) == want
    mixed = mixing.mixed_documents(docs.repartition(3), shard_words=50, broadcast_rows=0)
    assert sorted(map(str, mixed.collect())) == made
    assert sum(words(r.text) for r in mixed.collect()) == sum(r.taken for r in again.collect())
    # by hand: a shard's documents in order of their marks, each row a document
    by_hand = mixing.mixed(docs.withColumn("source", docs.source), shard_words=50).where("doc_id = 1 AND source = 'a'").collect()
    assert len(by_hand) == 40 and len({r.nth for r in by_hand}) == 40 and all(0 <= r.taken <= 6 for r in by_hand)


def test_mix_edges_and_plan(spark):
    docs = edge_docs(spark)
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 12 and all(r.taken == 0 for r in rows if r.size == 0)
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    assert sum(words(r.text) for r in made.collect()) == sum(r.taken for r in rows)
    assert mixing.mixed(no_docs(spark)).count() == 0 and mixing.mixed_documents(no_docs(spark)).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.mixed(blank).collect()] == [(0, 0.0), (0, 0.0)]
    assert not re.search("Python|Arrow|Pandas", made._jdf.queryExecution().toString())
