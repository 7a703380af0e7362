import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.cases import edge_docs, no_docs
from treeline.llm import license_rules, licenses, quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert not [r for r in rows if r.quality == 1 and r.predicted == 0]


def test_held_out_labels_are_never_learned(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    import zlib

    held = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({(r.doc_id, round(r.score, 9)) for r in quality.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert one == two
    flagged = {r.doc_id for r in quality.quality_scores(docs, labels).where("held_out").collect()}
    assert flagged >= set(held)


def test_votes_are_exact_weighted_shares():
    rnd = np.random.default_rng(1)
    vectors, labels = rnd.random((60, quality.BUCKETS + quality.WORDS + 2)).astype(np.float32), rnd.integers(0, 2, 60)
    voters = quality.Voters(vectors, labels, dimensions=8)
    asked = rnd.random((5, quality.BUCKETS + quality.WORDS + 2)).astype(np.float32)
    got = voters.scores(asked, voters=7)
    latent, known = voters.latent(asked), voters.nearby
    for i in range(5):
        cosine = known @ latent[i]
        best = np.argsort(-cosine)[:7]
        weight = np.maximum(cosine[best], 0).astype(float) ** quality.SHARPNESS
        assert abs(got[i] - (weight * labels[best]).sum() / weight.sum()) < 1e-4


def test_ties_go_to_the_first():
    vectors = np.zeros((6, quality.BUCKETS + quality.WORDS + 2), np.float32)
    vectors[:, 0] = 1
    voters = quality.Voters(vectors, np.array([1, 0, 1, 1, 0, 0]), dimensions=2)
    assert voters.scores(vectors[:1], voters=3)[0] == pytest.approx(2 / 3)
    assert voters.scores(vectors[:1], voters=4)[0] == pytest.approx(3 / 4)


def test_quality_that_shows_only_in_the_words(spark):
    """Texts of one shape, good or bad by their vocabulary."""
    rnd = np.random.default_rng(3)
    words = {1: ["proof", "theorem", "lemma", "measure", "integral", "converge", "bounded"], 0: ["click", "winner", "cheap", "offer", "prize", "casino", "bonus"]}
    rows = [(i, " ".join(rnd.choice(words[i % 2], 30)), i % 2) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    found = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.98


def test_query_equals_brute_force(spark):
    """Scores by plain loops over all labelled documents, from the same term vectors."""
    import zlib

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = sorted((r.doc_id, r.quality) for r in labels.collect() if r.doc_id in texts and r.quality is not None and texts[r.doc_id] and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    vector = lambda text: next(quality.terms(pa.array([text])))
    voters = quality.Voters(np.vstack([vector(texts[i]) for i, _ in known]), np.array([q for _, q in known]))
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    for doc_id, text in texts.items():
        own = voters.latent(vector(text))[0].astype(float)
        near = sorted(((-float(own @ v.astype(float)), i) for i, v in enumerate(voters.nearby)))[: quality.VOTERS]
        weights = [(max(-c, 0) ** quality.SHARPNESS, known[i][1]) for c, i in near]
        total = sum(w for w, _ in weights)
        assert got[doc_id] == pytest.approx(sum(w * q for w, q in weights) / total if total > 1e-9 else voters.prior, abs=2e-3)


def test_quality_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (9, 0, 0), (7, 1, 0), (99, 1, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert not [r for r in rows if r.doc_id is None and r.held_out]
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(no_docs(spark), labels).count() == 0
    assert quality.without_rejected(docs, labels).columns == docs.columns
    assert next(quality.terms(pa.array(["", None]))).sum() == 0


def model_scan(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, base = [], set()
    for phrase, label in license_rules.BASE.values():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                places.append(i)
                base.add(label)
    line, found = f" {' '.join(words)} ", []
    for rule in license_rules.RULES:
        if rule.keyword in line:
            for m in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", line):
                found.append((line[: m.start()].count(" ") - 1, -(line[: m.end()].count(" ") - 1), rule.rank, rule.label))
    # every two detections held against each other
    found, labels, best = set(found), set(), 9
    for d in found:
        lost = False
        for e in found - {d}:
            holds = e[0] <= d[0] and -e[1] >= -d[1]
            held = d[0] <= e[0] and -d[1] >= -e[1]
            same = holds and held
            lost |= held and e[2] < d[2] or holds and (e[2] < d[2] or e[2] == d[2] and (not same or e[3] < d[3]))
        if not lost:
            labels.add(d[3])
            best = min(best, d[2])
    score = max(licenses.CONFIDENCE.get(best, 0.0), 0.9 if places else 0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def test_license_scan_equals_brute_force(spark):
    texts = [
        "MIT License mit license. CC-BY-NC-SA 4.0 and CC BY 4.0; cc-by",
        "GPL-3.0-or-later; SPDX-License-Identifier: Apache-2.0 gnu general public license version 2",
        "Éa mit licenseé mit license\x00mit\nlicense " * 40,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Licensed under the GNU Lesser General Public License v2.1 (LGPL 2.1) or the Mozilla Public License, version 2.0",
        "KIT İ cc by ſa",
        None,
        "",
    ]
    extra = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = extra.union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    want = {r.doc_id: model_scan(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.license_scan(docs).collect()}
    assert got == want


def test_license_rules_are_well_formed():
    assert len(license_rules.RULES) >= 300
    # real expressions, not just words
    assert sum(bool(re.search(r"[?*+\[|(]", r.pattern)) for r in license_rules.RULES) >= 200
    assert len({(r.label, r.pattern) for r in license_rules.RULES}) == len(license_rules.RULES)
    for rule in license_rules.RULES:
        assert any(a in f" {rule.keyword} " for a in license_rules.ANCHORS), rule
        assert re.compile(rule.pattern) and rule.rank in licenses.CONFIDENCE
        assert not re.search(rf"(?:{rule.pattern})", ""), rule


def test_license_scan_is_native(spark):
    plan = licenses.license_scan(edge_docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert licenses.license_scan(edge_docs(spark)).count() == 12
    assert licenses.license_scan(no_docs(spark)).count() == 0


def test_the_sample_is_bounded_whatever_repeats(spark):
    rows = [(i, f"text number {i} with some words") for i in range(60)] + [(3, f"another text {i}") for i in range(3000)] + [(4, "")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(i, 1) for i in range(1000, 3000)], "doc_id long, quality int")
    for shuffled in (docs, docs.orderBy(F.desc("text"))):
        model = quality.fitted(shuffled, labels, sample=20, held_out=False)
        assert len(model.labels) == 20  # labels without a document take no place
        found = model.nearby if shuffled is docs else found
        assert (model.nearby == found).all()
