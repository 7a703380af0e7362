import base64
import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tests.conftest import DATA
from tests.llm.cases import edge_docs
from treeline.llm import line_dedup, minhash, mixing, pipeline, quality, registry, shared


def test_stages_hand_on_documents(spark, tmp_path):
    docs, sizes = spark.read.parquet(f"{DATA}/documents.parquet"), []
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        assert name == "bpe" or docs.columns == columns
    assert sizes[0] >= sizes[1] >= sizes[2] and sizes[3] == sizes[4]
    run = pipeline.run(spark, DATA)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_awkward_rows(spark, tmp_path):
    docs = edge_docs(spark)
    columns, ids = docs.columns, []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append({r.doc_id for r in docs.collect()})
        assert name == "bpe" or docs.columns == columns
    # junk of symbols may go for its quality, copies for their likeness, texts without words when they are mixed
    assert {4, 6, 9, None} <= ids[0] and ids[1] == ids[0] and ids[2] == ids[0] - {2, 5}
    assert ids[3] <= ids[2] - {1, 3} and ids[4] == ids[3] and ids[3]


def test_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_stage_tables_are_removed(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    kept = lambda: {x: sorted(os.listdir(f"{folder}/{x}")) for x in os.listdir(folder) if x.startswith("corpus-")}
    before = kept()
    pipeline.run(spark, DATA)
    assert [x for name, x in kept().items() if name not in before] == [["mixing"]]


def test_run_equals_a_chain_of_brute_force_versions(spark):
    """Every stage by its independent version: votes in loops, SQL over all lines, pairs and seats, the tokenizer library."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    known = sorted(i for i, q in labels.items() if q is not None and rows.get(i, {}).get("text") and zlib.crc32(str(i).encode()) % 3 != 1)
    vector = lambda text: next(quality.terms(pa.array([text])))
    voters = quality.Voters(np.vstack([vector(rows[i]["text"]) for i in known]), np.array([labels[i] for i in known]))
    for doc_id in list(rows):
        own = voters.latent(vector(rows[doc_id]["text"]))[0]
        near = np.argsort(-(voters.nearby @ own), kind="stable")[: quality.VOTERS]
        weight = np.maximum(voters.nearby[near] @ own, 0).astype(float) ** quality.SHARPNESS
        if (weight * voters.labels[near]).sum() < 0.5 * weight.sum():
            del rows[doc_id]

    def sql(query):
        con = duckdb.connect()
        documents = pa.Table.from_pylist(sorted(rows.values(), key=lambda r: r["doc_id"]), schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())]))
        con.register("documents", documents)
        return con.sql(query).to_arrow_table().to_pylist()

    for r in sql(line_dedup.ORACLE_SQL):
        rows[r["doc_id"]]["text"] = r["text"]
    kept = {r["doc_id"] for r in sql(minhash.ORACLE_SQL) if r["kept"]}
    rows = {i: r for i, r in rows.items() if i in kept}
    want = collections.Counter()
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in sql(mixing.ORACLE_SQL):
        text = rows[r["doc_id"]]["text"] or ""
        cuts = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        whole, rest = divmod(r["taken"], max(r["size"], 1))
        for made in [text] * whole + [text[: cuts[rest - 1]]] * bool(rest):
            ids = np.array(library.encode_ordinary(made), "<u4")
            want[r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(made.encode()).hexdigest()] += 1
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, DATA).collect())
    assert got == want and len(want) > 100


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


def test_registered_queries():
    names = list(registry.queries())
    assert [n for n in names if re.match(r"op\d+_", n)] == sorted((n for n in names if n != "pipeline"), key=lambda n: int(n[2:].split("_")[0]))
    import corpus_pipeline

    assert corpus_pipeline.STAGES is pipeline.STAGES and corpus_pipeline.run is pipeline.run
    assert len(names) == 14 and set(registry.oracle_sql()) <= set(names)
