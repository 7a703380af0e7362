import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import DATA
from tests.llm.cases import edge_docs, no_docs
from treeline.llm import curve_packing
from treeline.llm.curve_packing import Encoder, Places, _Packer, hilbert
from treeline.llm.registry import queries


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 5), (3, 4), (4, 3), (1, 6)])
def test_the_curve_visits_every_cell_in_single_steps(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = hilbert(cells, bits)
    assert sorted(keys) == list(range(1 << bits * dimensions))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_ids_are_the_library_s(library):
    encode = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a", "Ünïcödé 漢字 😀 <|endoftext|> it's\r\n\r\n  x", "<|endoftext|><|endoftext|>", "<|endof", "  \t\n ", "x" * 5000, "ab " * 3000, "​ 　 z", "١٢٣ ⅷ ²", "he'll HE'LL don't"]
    texts += ["".join(map(chr, range(a, a + 400))) for a in (0, 0x0530, 0x1780, 0x2000, 0xA7C0, 0x1F300)]
    assert encode.fast
    for text in texts:
        assert encode.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = Encoder(path)
    assert encode.slow and encode.ids("Some words").tolist() == Tokenizer.from_file(path).encode("Some words", add_special_tokens=False).ids


def check(rows, docs, library, length):
    """Every document's ids in gapless pieces, sequences gapless and full or a power of two long."""
    want = defaultdict(list)
    for doc, text in docs:
        want[doc].append([*library.encode(text or "", add_special_tokens=False).ids, 0])
    sequences, starts = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        starts[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for pieces in sequences.values():
        total = 0
        for offset, n in sorted(pieces):
            assert offset == total and n > 0
            total += n
        assert total == length or total < length and total & total - 1 == 0
    assert set(starts) == set(want)
    for doc, documents in want.items():
        left = sorted(starts[doc])
        tokens = sum(map(len, documents))
        assert sum(n for _, n, _, _ in left) == tokens
        if len(documents) == 1:
            at = 0
            for start, n, crc, whole in left:
                ids = documents[0][start : start + n]
                assert (start, whole) == (at, tokens) and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
                at += n
            assert at == tokens


def test_query_packs_every_token(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    check(queries()["op13_curve_packing"](spark, DATA).collect(), docs, library, 1024)


def test_awkward_rows_over_many_ranges(spark, library):
    docs = edge_docs(spark)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for length, tokens in ((1024, 1 << 23), (16, 200), (1, 1000)):
        check(curve_packing.checksums(curve_packing.packed(docs, length=length, range_tokens=tokens)).collect(), texts, library, length)
    assert curve_packing.packed(no_docs(spark)).collect() == []


def test_copies_share_a_place_and_are_dealt_out(spark):
    rows = [(i, "the same words again and again") for i in range(2000)] + [(None, "no id")] * 2000
    found = curve_packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), range_tokens=2000).collect()
    assert len({r.sequence_id >> 40 for r in found if r.doc_id is not None}) > 2
    assert len({r.sequence_id >> 40 for r in found if r.doc_id is None}) > 2


def test_what_is_left_becomes_powers_of_two():
    packer = _Packer(64, 5)
    for doc, n in enumerate((50, 30, 1, 90)):
        packer.add(doc, np.arange(n))
    packer.finish()
    sizes = defaultdict(int)
    for row in packer.done:
        sizes[row[4]] += row[2]
    assert [sizes[k] for k in sorted(sizes)] == [64, 64, 32, 8, 2, 1]


def test_neighbours_on_the_curve_are_alike():
    rnd = np.random.default_rng(1)
    topics = [rnd.integers(0, 50000, 60) for _ in range(40)]
    documents, topic = [], []
    for i in range(800):
        topic.append(i % 40)
        documents.append(rnd.choice(topics[i % 40], 150))
    keys = Places(50257, 256, 4, 15, 1).of(documents)
    order = np.array(topic)[np.argsort(keys, kind="stable")]
    assert (order[1:] == order[:-1]).mean() > 0.15  # one in 40 by chance
