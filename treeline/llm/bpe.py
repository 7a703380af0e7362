"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

Every distinct piece of text is a set of token-position rows. One step of the recursion joins each token
and its successor to the merge table and contracts the piece's leftmost pair of least rank;
pieces without such a pair are done.

Long pieces are cut into chunks that are encoded like pieces. Tokens in a row are the encoding of their bytes exactly
when every two neighbours are the encoding of theirs: up to the first contraction across a border, what happens
inside two neighbours is what happens to them alone. So only the borders between chunks are looked at, and
where one does not hold, the bytes around it are encoded again, until all hold. Work and
memory grow with a piece's length, not with its square.

Decoding is an ordered aggregation of the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .pretokens import pretokens
from .shared import id_and_text, worker_cache

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Rows of a recursion, distinct pieces a worker remembers, bytes of text looked at together.
_QUERY_BYTES, _REMEMBERED, _LONGEST, _PIECE_BYTES = 60_000, 500_000, 64, 3 << 19
#: Pieces from this length on are cut into chunks; a longer stretch around a border takes the query that
#: contracts several pairs in a step.
_LONG, _CHUNK = 256, 64
#: Tokens before and bytes after a border that are encoded again at first; most bytes while borders move on.
_BACK, _AHEAD, _FAR = 4, 64, 4096

_DONE = "SELECT list(tok ORDER BY pos) AS ids FROM state WHERE tok >= 0 GROUP BY word ORDER BY word"
_DECODE = "SELECT string_agg(shown, '' ORDER BY pos) AS shown FROM given JOIN vocabulary ON tok = id GROUP BY word ORDER BY word"
_ENCODE = f"""
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
  SELECT word, pos, tok FROM pieces
  UNION
  (WITH live AS (
     SELECT word, pos, tok, lead(tok) OVER along AS right_tok, lead(pos) OVER along AS right_pos, lead(word) OVER along AS right_word
     FROM recurring.state WHERE tok >= 0 AND word IN (SELECT word FROM state) WINDOW along AS (ORDER BY (word::BIGINT << 32) | pos)),
   least AS (SELECT word, min((made::BIGINT << 32) | (pos << 16) | right_pos) AS best
     FROM live JOIN merges ON pair = (tok::BIGINT << 32) | right_tok WHERE right_word = word GROUP BY word)
   SELECT word, ((best >> 16) & 65535)::INTEGER, (best >> 32)::INTEGER FROM least
   UNION ALL SELECT word, (best & 65535)::INTEGER, -1 FROM least))
{_DONE}
"""
_ENCODE_LONG = f"""
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
  SELECT word, pos, tok FROM pieces
  UNION
  (WITH live AS (
     SELECT word, pos, tok, lead(tok) OVER next_one AS right_tok, lead(pos) OVER next_one AS right_pos
     FROM recurring.state WHERE tok >= 0 AND word IN (SELECT word FROM state)
     WINDOW next_one AS (PARTITION BY word ORDER BY pos)),
   pair AS (SELECT word, pos, right_pos, made, alone FROM live JOIN merges ON pair = (tok::BIGINT << 32) | right_tok),
   least AS (SELECT * FROM pair QUALIFY made = min(made) OVER (PARTITION BY word)),
   linked AS (SELECT *, coalesce(lag(right_pos) OVER (PARTITION BY word ORDER BY pos) <> pos, true) AS fresh FROM least),
   run AS (SELECT *, row_number() OVER by_pos AS nth, sum(fresh::INTEGER) OVER by_pos AS run FROM linked
     WINDOW by_pos AS (PARTITION BY word ORDER BY pos)),
   chosen AS (SELECT * FROM run
     QUALIFY CASE WHEN alone THEN nth = 1 ELSE row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1 END)
   SELECT word, pos, made FROM chosen UNION ALL SELECT word, right_pos, -1 FROM chosen))
{_DONE}
"""


class RecursiveBpe:
    """Encoder and decoder over one file of token ranks (base64 bytes and rank, a line each)."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            rank = {base64.b64decode(token): int(number) for token, number in (line.split() for line in file if line.strip())}
        made = [(rank[t[:i]], rank[t[i:]], number) for t, number in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
        left, right, joined = (np.array(x, np.int64) for x in zip(*made, strict=True))
        soonest = np.full(max(rank.values()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(soonest, left, joined)
        np.minimum.at(soonest, right, joined)
        # alone: the new token may take part in a merge of lower rank than its own
        merges = pa.table({"pair": left << 32 | right, "made": pa.array(joined, pa.int32()), "alone": soonest[joined] < joined})
        vocabulary = pa.table({"id": pa.array(list(rank.values()), pa.int32()), "shown": [t.hex() for t in rank]})
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        self.packed = "<u2" if len(soonest) <= 1 << 16 else "<u4"
        #: ids of pieces, packed; and whether two tokens stay apart next to each other
        self.known: dict[str, bytes] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("given", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        numbers = sorted(rank.values())
        #: the bytes of every token, by its id
        self.token: list[bytes] = [b""] * len(soonest)
        for number, raw in zip(numbers, self.decode([[x] for x in numbers]), strict=True):
            self.token[number] = raw
        self.width = np.array([len(x) for x in self.token])

    def _asked(self, query: str, name: str, table: pa.Table) -> pa.Table:
        self.con.register(name, table)
        out = self.con.sql(query).to_arrow_table().combine_chunks()
        self.con.unregister(name)
        return out

    def _rows(self, values: np.ndarray, counts: np.ndarray) -> pa.Table:
        word = np.repeat(np.arange(len(counts)), counts)
        pos = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
        return pa.table({"word": pa.array(word, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array(values, pa.int32())})

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of non-empty pieces, each contracted as a whole."""
        out, start, size = [], 0, 0
        for i, piece in enumerate([*pieces, b""]):
            if i == len(pieces) or size and size + len(piece) > _QUERY_BYTES:
                part = pieces[start:i]
                if part:
                    raw = np.frombuffer(b"".join(part), np.uint8)
                    query = _ENCODE if max(map(len, part)) < _LONG else _ENCODE_LONG
                    rows = self._rows(self.single[raw], np.array([len(x) for x in part]))
                    lists = self._asked(query, "pieces", rows).column("ids").combine_chunks()
                    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                    out += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                start, size = i, 0
            size += len(piece)
        return out

    def _stay_apart(self, pairs: set[tuple[int, int]]) -> None:
        """Learns of pairs of tokens whether their bytes are encoded as just these two."""
        new = sorted(pairs - self.apart.keys(), key=lambda p: len(self.token[p[0]]) + len(self.token[p[1]]))
        if len(self.apart) > _REMEMBERED:
            self.apart.clear()
            new = list(pairs)
        for pair, ids in zip(new, self.encode_pieces([self.token[a] + self.token[b] for a, b in new]), strict=True):
            self.apart[pair] = len(ids) == 2 and (int(ids[0]), int(ids[1])) == pair

    def encode_long(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of long pieces: chunks first, then the borders that do not hold."""
        found: dict[bytes, np.ndarray] = {}

        def learn(parts: set[bytes]) -> None:
            new = sorted(parts - found.keys(), key=len)
            found.update(zip(new, self.encode_pieces(new), strict=True))

        learn({x[i : i + _CHUNK] for x in pieces for i in range(0, len(x), _CHUNK)})
        sequences = [_Sequence([found[x[i : i + _CHUNK]] for i in range(0, len(x), _CHUNK)]) for x in pieces]
        work = sequences
        while work:
            self._stay_apart({pair for s in work for pair in s.pairs()})
            for s in work:
                s.judge(self.apart)
            work = [s for s in work if len(s.borders)]
            for s in work:
                s.plan(self.token, self.width)
            learn({part for s in work for _, _, part in s.windows})
            for s in work:
                s.replace(found)
        return [s.ids for s in sequences]

    def decode(self, sequences: list[list[int]]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        counts = np.array([len(x) for x in sequences], np.int64)
        values = np.array([t for x in sequences for t in x], np.int64)
        shown = self._asked(_DECODE, "given", self._rows(values, counts)).column("shown").to_pylist() if len(values) else []
        found = map(bytes.fromhex, shown)
        return [next(found) if n else b"" for n in counts]

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each text; ids as little-endian 32-bit integers.

        The bytes are looked up from the text's own ids, in what ``decode`` gives for every token.
        """
        split = [pretokens(text) for text in texts]
        if len(self.known) > _REMEMBERED:  # frequent pieces came early
            for old in list(self.known)[_REMEMBERED // 2 :]:
                del self.known[old]
        # by length, so that the pieces of one query are done after about as many steps
        new = sorted({piece for pieces in split for piece in pieces if piece not in self.known}, key=len)
        raw = [x.encode() for x in new]
        short = [x for x in raw if len(x) < _LONG]
        ids_of = dict(zip(short, self.encode_pieces(short), strict=True))
        rest = [x for x in raw if len(x) >= _LONG]
        ids_of.update(zip(rest, self.encode_long(rest), strict=True))
        for piece, x in zip(new, raw, strict=True):
            self.known[piece] = ids_of[x].astype(self.packed).tobytes()
        token = self.token.__getitem__
        for pieces in split:
            ids = np.frombuffer(b"".join([self.known[piece] for piece in pieces]), self.packed)
            yield ids.astype("<u4").tobytes(), b"".join(map(token, ids.tolist()))
        for piece in new:
            if len(piece) > _LONGEST:
                del self.known[piece]


class _Sequence:
    """Tokens of one long piece, and its borders that are not known to hold."""

    def __init__(self, parts: list[np.ndarray]):
        self.ids = np.concatenate(parts)
        #: border i lies between tokens i - 1 and i
        self.borders = np.cumsum([len(x) for x in parts])[:-1]
        self.back, self.ahead, self.first, self.turn = _BACK, _AHEAD, -1, 0
        self.windows: list[tuple[int, int, bytes]] = []

    def pairs(self) -> set[tuple[int, int]]:
        return set(zip(self.ids[self.borders - 1].tolist(), self.ids[self.borders].tolist(), strict=True))

    def judge(self, apart: dict[tuple[int, int], bool]) -> None:
        """Keeps the borders that do not hold."""
        pairs = zip(self.ids[self.borders - 1].tolist(), self.ids[self.borders].tolist(), strict=True)
        self.borders = self.borders[np.fromiter((not apart[pair] for pair in pairs), bool, len(self.borders))]

    def plan(self, token: list[bytes], width: np.ndarray) -> None:
        """The windows (first token, last token + 1, bytes) around borders, left to right, apart from each other.

        Each round either brings the first border further or gives windows more room, in the end all of the piece.
        """
        sizes = np.concatenate([[0], np.cumsum(width[self.ids])])
        first, self.turn = int(sizes[self.borders[0]]), self.turn + 1
        if first <= self.first:
            self.back, self.ahead = 2 * self.back, 2 * self.ahead
        elif self.turn % 16 == 0:  # a border that runs along a repetition
            self.ahead = max(self.ahead, min(2 * self.ahead, _FAR))
        self.first, self.windows, free = max(first, self.first), [], 0
        stops = np.searchsorted(sizes, sizes[self.borders] + self.ahead)
        for border, stop in zip(self.borders.tolist(), stops.tolist(), strict=True):
            start, stop = max(0, border - self.back), min(max(stop, border + self.back), len(self.ids))
            if start >= free:
                self.windows.append((start, stop, b"".join([token[i] for i in self.ids[start:stop].tolist()])))
                free = stop + 1

    def replace(self, found: dict[bytes, np.ndarray]) -> None:
        """Puts the windows' own encodings in place; their edges are borders again."""
        parts, borders, done, size = [], [], 0, 0
        for start, stop, part in [*self.windows, (len(self.ids), len(self.ids), b"")]:
            low, high = np.searchsorted(self.borders, [done + 1, start])
            borders += (self.borders[low:high] + (size - done)).tolist()
            parts.append(self.ids[done:start])
            size += start - done
            if part:
                parts.append(found[part])
                borders += [size, size + len(found[part])]
                size += len(found[part])
            done = stop
        self.ids = np.concatenate(parts)
        self.borders = np.array(sorted({x for x in borders if 0 < x < len(self.ids)}), np.int64)


def recursive_bpe(path: str) -> RecursiveBpe:
    """The vocabulary at a path, loaded into an in-memory DuckDB once a process."""
    loaded = worker_cache("bpe")
    if path not in loaded:
        loaded[path] = RecursiveBpe(path)
    return loaded[path]


def _grouped(texts: pa.Array) -> Iterator[list[str]]:
    part, size = [], 0
    for value in texts:
        text = value.as_py() or ""
        if part and size + len(text) > _PIECE_BYTES:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): token ids of each whole text, and the bytes they decode to.

    One row per row of ``docs`` (doc_id, text); a null text is empty and gives no ids. A
    null doc_id stays null, repeated rows are encoded alike, other columns are ignored and
    no rows give no rows. The pass has no shuffle; a lost task is simply run again. Texts are
    whole, whatever their length, and so are single pieces without a blank: those take memory and, but
    for such as repeat themselves at length, time in proportion to their length.
    """
    return _pass(docs, path, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encoded``, without its long columns."""
    return _pass(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _pass(docs: DataFrame, path: str | None, schema: str) -> DataFrame:
    path, whole = path or public_tokenizers.path(VOCABULARY), "decoded binary" in schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = recursive_bpe(path)
        for batch in batches:
            done = 0
            for texts in _grouped(batch.column("text")):
                ids_of = batch.column("doc_id").slice(done, len(texts))
                done += len(texts)
                rows = list(bpe.encode(texts))
                if whole:
                    ids = pa.array([np.frombuffer(ids, "<u4").astype(np.int32) for ids, _ in rows], pa.list_(pa.int32()))
                    columns, names = [ids, pa.array([x for _, x in rows], pa.binary())], ["ids", "decoded"]
                else:
                    columns = [pa.array([len(ids) // 4 for ids, _ in rows], pa.int64()), *(pa.array([hashlib.sha256(x[k]).hexdigest() for x in rows], pa.string()) for k in (0, 1))]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([ids_of, *columns], names=["doc_id", *names])

    narrow = id_and_text(docs)
    return narrow.mapInArrow(run, schema)
