import time
import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.conftest import DATA
from tests.llm.cases import ROWS, edge_docs, no_docs
from treeline.llm import bpe, prefix_tokens

PIECES = ["a", "b", "the", " ", "  ", "\n", "'s", "'re", "'", "é", "ß", "漢", "字", "1", "23", "٣", "!", "?!", "<|endoftext|>", "\t", "　", "😀", "՘", "\U00010940", "x" * 30, "= ", "----", "\r\n", "_", "aaaaaaa", "\x1c", "\x85"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tik():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(n, seed=5):
    rnd = random.Random(seed)
    mixed = ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(25))) for _ in range(n)]
    wild = lambda: chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x20, 0x3000), rnd.randrange(0x10000, 0x20000)]))
    return mixed + ["".join(wild() for _ in range(20)) for _ in range(n // 3)]


def test_counts_and_cuts_equal_the_library(library):
    tokens = prefix_tokens.prefix_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    size = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    for text in fuzz(1500):
        assert tokens.count(text) == size(text)
        for budget in (0, 1, 3, 6):
            found = tokens.prefixes(text)
            count, cut = found.count, found.cut(budget)
            prefix = text.encode()[:cut].decode()
            assert size(prefix) <= budget and (count > budget or prefix == text)


def test_further_budgets_encode_nothing(library, monkeypatch):
    tokens = prefix_tokens.prefix_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    text = "An internationalisation<|endoftext|>of " + "acgt" * 40 + " Zuständigkeiten, 1234567890! " * 3
    found = tokens.prefixes(text)
    monkeypatch.setattr(tokens, "table", lambda piece: pytest.fail("a table was made again"))
    size = lambda n: len(library.encode(text.encode()[:n].decode(), add_special_tokens=False).ids)
    cuts = [found.cut(budget) for budget in range(found.count + 2)]
    assert cuts == sorted(cuts) and cuts[0] == 0 and cuts[found.count] == found.size(len(found.pieces)) == len(text.encode())
    assert all(size(cut) <= budget for budget, cut in enumerate(cuts))


def test_every_prefix_of_a_piece_is_exact(library):
    tokens = prefix_tokens.prefix_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    for piece in ["international", "thththereandon", "aaaaaaaaaaa", "Zuständigkeit", "12345678901"]:
        table, raw = tokens.table(piece.encode()), piece.encode()
        for end in range(len(piece) + 1):
            stop = len(piece[:end].encode())
            assert table[stop] == len(library.encode(piece[:end], add_special_tokens=False).ids)
        assert len(table) == len(raw) + 1


def test_token_counts_on_the_table(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in prefix_tokens.token_counts(docs).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
        assert len(library.encode(texts[r.doc_id].encode()[: r.cut_bytes].decode(), add_special_tokens=False).ids) <= 512


def test_token_counts_edges(spark, library):
    rows = prefix_tokens.token_counts(edge_docs(spark)).collect()
    want = sorted(((x[0] or -1), len((x[1] or "").encode()), len(library.encode(x[1] or "", add_special_tokens=False).ids)) for x in ROWS)
    assert sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens) for r in rows) == want
    assert prefix_tokens.token_counts(no_docs(spark)).count() == 0
    several = prefix_tokens.token_counts(edge_docs(spark), budgets=(3, 512)).collect()
    assert all(r.cuts[1] == r.cut_bytes and r.cuts[0] <= r.cut_bytes for r in several)


def test_recursion_equals_the_library(tik):
    texts = fuzz(1500, 9) + ["a" * 2000, "ab" * 300 + "a" * 77, "=" * 900, "x" * 255, "x" * 256]
    encoder = bpe.recursive_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text, (ids, decoded) in zip(texts, encoder.encode(texts), strict=True):
        assert ids == np.array(tik.encode_ordinary(text), "<u4").tobytes()
        assert decoded == text.encode()


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.mark.parametrize("alphabet", ["acgt", LETTERS, ["the", "international", "xq", "zz", "aaaa", "ation"], "漢字日本語文書", "=-"])
@pytest.mark.parametrize("size", [255, 257, 1_000, 20_000])
def test_long_pieces_equal_the_library(tik, alphabet, size):
    rnd = random.Random(size)
    text = "".join(rnd.choice(alphabet) for _ in range(size))
    encoder = bpe.recursive_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ((ids, decoded),) = encoder.encode([text])
    assert ids == np.array(tik.encode_ordinary(text), "<u4").tobytes() and decoded == text.encode()


def test_pieces_of_a_million_letters(tik):
    rnd = random.Random(3)
    encoder = bpe.recursive_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = ["a" * 1_000_000, "b" + "a" * 1_000_000, "x " + "ab" * 100_000 + "a" * 77_777 + "bc" * 9_999, "".join(rnd.choice(LETTERS) for _ in range(200_000))]
    for text, (ids, decoded) in zip(texts, encoder.encode(texts), strict=True):
        assert ids == np.array(tik.encode_ordinary(text), "<u4").tobytes() and decoded == text.encode()


def test_work_grows_with_the_length_of_a_piece():
    encoder, asked, rnd = bpe.recursive_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), [], random.Random(4)
    plain = encoder.encode_pieces

    def counted(pieces):
        asked.append(sum(map(len, pieces)))
        return plain(pieces)

    encoder.encode_pieces = counted
    try:
        for size in (20_000, 80_000):
            encoder.encode_long([bytes(rnd.choice(b"acgt") for _ in range(size))])
            asked.append(-1)
    finally:
        del encoder.encode_pieces
    first, second = (sum(x) for x in (asked[: asked.index(-1)], asked[asked.index(-1) + 1 : -1]))
    assert second < 5 * first and second < 10 * 80_000


def test_decoding_any_ids(tik):
    encoder = bpe.recursive_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rnd = random.Random(1)
    ids = [[rnd.randrange(50_256) for _ in range(rnd.randrange(30))] for _ in range(50)]
    assert encoder.decode(ids) == [tik.decode_bytes(x) for x in ids]
    assert encoder.decode([[], []]) == [b"", b""]


def test_digests_on_the_table_and_edges(spark, tik):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(edge_docs(spark).where("doc_id IS NOT NULL").selectExpr("doc_id + 100000", "text"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.digests(docs).collect():
        ids = np.array(tik.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert r.n_tokens == len(ids) // 4 and r.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.digests(edge_docs(spark)).count() == 12
    assert bpe.digests(no_docs(spark)).count() == 0
    row = bpe.encoded(edge_docs(spark).where("doc_id = 9")).first()
    assert row.ids == tik.encode_ordinary("hi") and bytes(row.decoded) == b"hi"


def test_workers_keep_one_operators_cache():
    from treeline.llm.shared import worker_cache

    worker_cache("one")["x"] = 1
    assert worker_cache("one") == {"x": 1}
    assert worker_cache("two") == {} and worker_cache("one") == {}


def test_a_cut_in_a_piece_of_a_million_letters_is_one_walk(library):
    tokens = prefix_tokens.prefix_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    piece = "é" * 999_999 + "x"
    size = len(piece.encode())
    found = prefix_tokens.Prefixes([piece], [list(range(size + 1))], tokens.special)
    began = time.process_time()
    assert found.cut(1001) == 1000 and found.cut(size - 1) == size - 1
    assert time.process_time() - began < 2
