import random
import re
from collections import Counter

from tests.compare import assert_same, connection
from tests.conftest import DATA
from tests.llm.cases import edge_docs, no_docs
from treeline.llm import divergence
from treeline.llm.registry import queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, least, top, scale):
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(UPPER)))) for text, lang, source in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        on = Counter(t for d in own for t in d[2])
        kept = sorted((t for t in on if on[t] >= least), key=lambda t: t.encode())
        counts = {s: sum((d[2] for d in own if d[1] == s), Counter()) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + scale * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        p = {s: share(c) for s, c in counts.items()}
        q = share(whole)
        for s in counts:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def made(seed=4, n=400):
    rnd = random.Random(seed)
    words = ["the", "Über", "naïve", "x", "漢字", "É", "é", "_a_b", "DON'T", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))]
    rows = []
    for i in range(n):
        source = rnd.choice(["hot"] * 5 + ["a", "b", "c", None, ""])
        few = words[: rnd.choice([9, 60, 209])]
        rows.append((rnd.choice(["\n", " ", ", ", "1"]).join(rnd.choices(few, k=rnd.randrange(0, 60))), rnd.choice(["en", "en", "de", None]), source))
    rows += [(None, "en", "silent"), ("", "fr", "only"), ("9 8 7", "it", "p"), ("unseen words here", "it", "q"), ("the " * 5000, "en", "hot")]
    return rows + [rows[0]] * 30


def run(spark, rows, **how):
    df = spark.createDataFrame([(t, lang, s, "x", 1) for t, lang, s in rows], "text string, lang string, source string, term string, n long")
    return sorted(tuple(r) for r in divergence.source_divergence(df.repartition(5), **how).collect())


def test_rows_equal_brute_force(spark):
    rows = made()
    assert run(spark, rows, top=25) == brute(rows, 3, 25, divergence.SCALE)


def test_many_shards_and_small_blocks_change_nothing(spark):
    rows = made(9, 150)
    assert run(spark, rows, shard=300, least_block=1) == brute(rows, 3, 200, divergence.SCALE)


def test_shares_beyond_a_long(spark):
    df = spark.sql("SELECT 20000000000L AS n, 30000000000L AS total UNION ALL SELECT 5L, 7L UNION ALL SELECT 9223372036L, 9223372037L")
    got = [r[0] for r in df.select(divergence._share("n", "total", 10**9)).collect()]
    assert got == [1 + 10**9 * (n + 1) // total for n, total in ((20000000000, 30000000000), (5, 7), (9223372036, 9223372037))]


def test_awkward_rows(spark):
    docs = edge_docs(spark)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert sorted(tuple(r) for r in divergence.source_divergence(docs).collect()) == brute(rows, 3, 200, divergence.SCALE)
    assert divergence.source_divergence(no_docs(spark)).collect() == []


def test_query_equals_sql(spark):
    assert_same(queries()["op12_source_divergence"](spark, DATA), connection(DATA), divergence.ORACLE_SQL)
