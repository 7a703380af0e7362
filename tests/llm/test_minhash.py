import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.cases import edge_docs, no_docs
from treeline.llm import minhash, textnp
from treeline.llm.graph import connected_components


def words(rnd, n):
    return [rnd.choice("abcdefghij") + str(rnd.randrange(5000)) for _ in range(n)]


def model_shingles(text):
    import re

    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not found:
        return collections.Counter()
    return collections.Counter(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4)))


def model_similarity(x, y):
    every = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in set(x) & set(y))


def model_classes(rows):
    sets = {i: model_shingles(t or "") for i, t in rows.items()}
    least = {i: i for i in rows}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            same = (rows[a] or "") == (rows[b] or "")
            if same or sets[a] and sets[b] and set(sets[a]) & set(sets[b]) and model_similarity(sets[a], sets[b]) >= 0.8:
                x, y = top(a), top(b)
                least[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_kernels_equal_the_plain_rules():
    texts = ["Ab cd-Éf 12", None, "", "x", "one two three four five six", "one two three four five one two three four five", "é!é é"]
    sets = minhash._sets(pa.array(texts), 5)
    for text, (_, counts) in zip(texts, sets, strict=True):
        assert sorted(counts.tolist()) == sorted(model_shingles(text or "").values())
    rnd = random.Random(4)
    for _ in range(30):
        base = words(rnd, rnd.randrange(1, 30)) * rnd.choice([1, 2, 3])
        other = [w if rnd.random() > 0.1 else "zz" for w in base]
        x, y = minhash._sets(pa.array([" ".join(base), " ".join(other)]), 5)
        want = model_similarity(model_shingles(" ".join(base)), model_shingles(" ".join(other)))
        assert minhash.probability_jaccard(x, y) == pytest.approx(want)


def test_signatures_estimate_the_similarity():
    rnd = random.Random(7)
    base = words(rnd, 400) + ["again"] * 60
    other = base[:330] + words(rnd, 70) + ["again"] * 60
    x, y = minhash._sets(pa.array([" ".join(base), " ".join(other)]), 5)
    owner = np.concatenate([np.zeros(len(x[0]), int), np.ones(len(y[0]), int)])
    signed = minhash.prob_minhash(owner, np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]), 2, 4096)
    assert (signed[0] == signed[1]).mean() == pytest.approx(minhash.probability_jaccard(x, y), abs=0.03)


def test_powers_invert():
    assert (textnp.powers(textnp._BASE, 50) * textnp.powers(textnp._BASE_INVERSE, 50) == 1).all()


def test_equals_brute_force_on_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == model_classes(rows)


@pytest.mark.parametrize("further", [0, 16])
def test_large_group_of_near_copies_in_blocks(spark, monkeypatch, further):
    monkeypatch.setattr(minhash, "_FURTHER", further)
    rnd = random.Random(3)
    base = words(rnd, 200)
    rows = {}
    for i in range(700):  # copies with their own edits: similar to the base, less so to each other
        copy = list(base)
        for _ in range(rnd.randrange(0, 6)):
            copy[rnd.randrange(200)] = f"edit{i}x{rnd.randrange(99)}"
        rows[i] = " ".join(copy)
    for i in range(700, 760):
        rows[i] = " ".join(words(rnd, 60))
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    sets = minhash._sets(pa.array(list(rows.values())), 5)
    least = list(range(760))

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in range(700):
        for b in range(a + 1, 700):
            if minhash.probability_jaccard(sets[a], sets[b]) >= 0.8:
                x, y = top(a), top(b)
                least[max(x, y)] = min(x, y)
    assert got == {i: top(i) for i in range(760)}


def test_block_links_join_what_pairs_would():
    rnd = random.Random(5)
    texts = [" ".join(words(rnd, 30) * rnd.choice([1, 2])) for _ in range(6)]
    texts += [t + " tail" for t in texts[:3]]
    ids, parts = np.arange(9), np.array([0, 1, 2, 3, 4, 5, 6, 7, 8])
    found = {(a, b) for a, b, _ in minhash._joining(ids, parts, pa.array(texts), 5, 0.8)}
    sets = minhash._sets(pa.array(texts), 5)
    assert found == {(a, b) for a in range(9) for b in range(a + 1, 9) if minhash.probability_jaccard(sets[a], sets[b]) >= 0.8}
    assert not minhash._joining(ids, np.zeros(9, int), pa.array(texts), 5, 0.8)


def test_a_stranger_in_a_large_bucket_is_few_pairs(spark):
    """20,000 linked rows and two strangers: about 20,000 pairs each, not the square."""
    n = 20_000
    members = spark.range(n + 2).select("id", F.lit(7).cast("long").alias("bucket")).unionAll(spark.createDataFrame([(1, 8), (n, 8)], "id long, bucket long"))
    component = spark.range(n).select("id", F.lit(0).cast("long").alias("component"))
    placed = minhash._mixed_buckets(members, component, n + 2, 1 << 21)
    assert placed.where("blocks > 0").count() == 0
    found = minhash._few_pairs(placed)
    assert found.count() == 2 * n + 1
    outside, every = placed.where("component <> main").count(), placed.count()
    assert outside * every <= 4 * found.count() * 2  # rows that the join tries


def test_buckets_without_shuffles_of_hot_keys_or_broadcasts(spark):
    """The same classes where every key is hot and nothing may be broadcast by its size."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    assert sorted(map(tuple, minhash.near_duplicates(docs, hot=1, broadcast_ids=0).collect())) == want
    once = minhash.keep_one_of_each(docs.unionByName(docs), broadcast_ids=0)
    assert once.exceptAll(minhash.keep_one_of_each(docs)).count() == 0 and once.count() == sum(r[2] for r in want)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 450)] + [(500, 500), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {}

    def top(i):
        while least.setdefault(i, i) != i:
            i = least[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            least[max(x, y)] = min(x, y)
    assert got == {i: top(i) for i in list(least)}


def test_edges_and_empty(spark):
    rows = minhash.near_duplicates(edge_docs(spark)).collect()
    found = collections.Counter((r.doc_id, r.class_id, r.kept) for r in rows)
    assert len(rows) == 12
    assert found[(1, 1, True)] == 1 and found[(2, 1, False)] == 1  # null and empty are the same text
    assert found[(4, 4, True)] == 1 and found[(5, 4, False)] == 2
    assert found[(None, None, False)] == 2
    assert found[(3, 3, True)] == 1 and found[(8, 8, True)] == 1 and found[(6, 6, True)] == 1
    assert minhash.near_duplicates(no_docs(spark)).collect() == []
    kept = minhash.keep_one_of_each(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 3, 4, 6, 7, 8, 9]
    assert minhash.keep_one_of_each(no_docs(spark)).count() == 0


def test_repeated_ids_give_one_result_whatever_the_order(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    b = "quite another text with other words and no shingle of the first one"
    rows = [(1, b), (1, a), (3, a + " thirteen"), (4, b), (2, None), (2, b + " x"), (None, a), (None, a)]
    want = None
    for given in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
        got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
        want = want or got
        assert got == want and len(got) == len(rows)
    classes = {r[0]: r[1] for r in want}
    assert classes == {1: 1, 3: 1, 4: 2, 2: 2, None: None}
