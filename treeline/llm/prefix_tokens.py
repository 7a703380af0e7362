"""Exact token counts at every prefix, by dynamic programming over byte-level BPE.

For each byte prefix of a piece of text (a pretoken) the table stores the number of tokens of its encoding
and the last of them. A sequence of tokens is the encoding of its bytes exactly when every two
neighbours are the encoding of theirs, so the last token of a prefix is the one suffix
token that agrees with the last token of the shorter prefix before it: one pass over
the bytes. The tables of a text's pieces and their running sums are kept together: they answer how many tokens
any prefix has and where any budget ends, for as many budgets as asked, without encoding anything again.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .pretokens import pretokens
from .shared import id_and_text, worker_cache

VOCABULARY, LIMIT = "byte_bpe_50k.json", 512
#: Pieces whose counts a worker remembers at once, and the longest that it remembers.
_REMEMBERED, _LONGEST = 800_000, 64


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 is itself, others follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixTokens:
    """Token counts of texts and of all their prefixes, for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = _byte_of()
        raw = lambda piece: bytes(byte_of[c] for c in piece)
        self.token = {raw(piece): number for piece, number in spec["model"]["vocab"].items()}
        pairs = (x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"])
        #: rank of the merge of two tokens, and of each token the rank and the parts of its own merge
        self.rank: dict[int, int] = {}
        self.made, self.left, self.right = ([-1] * (max(self.token.values()) + 1) for _ in range(3))
        for rank, (x, y) in enumerate(pairs):
            x, y = raw(x), raw(y)
            left, right, joined = self.token[x], self.token[y], self.token[x + y]
            self.rank[left << 20 | right] = rank
            self.made[joined], self.left[joined], self.right[joined] = rank, left, right
        self.longest = max(map(len, self.token))
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.agreed: dict[int, bool] = {}
        self.counts = _Counts(self)

    def _agree(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their bytes are merged together.

        Undoes the merges next to the border, latest first; the tokens agree unless, at some
        moment, the two parts at the border would have been merged before one of them was
        merged with what is behind it. Of equal ranks the left pair is merged first.
        """
        rank, made, before = self.rank, self.made, 1 << 30
        while True:
            if rank.get(left << 20 | right, 1 << 30) < before:
                return False
            if made[left] > made[right]:
                before, left = made[left], self.right[left]
            elif made[right] >= 0:
                before, right = made[right] + 1, self.left[right]
            else:
                return True

    def table(self, piece: bytes) -> list[int]:
        """The number of tokens of every prefix of one piece, from 0 bytes to all."""
        token, agreed, agree, longest = self.token.get, self.agreed, self._agree, self.longest
        count, last = [0], [-1]
        if len(agreed) > 1_000_000:
            agreed.clear()
        for stop in range(1, len(piece) + 1):
            for start in range(stop - longest if stop > longest else 0, stop):
                number = token(piece[start:stop])
                if number is None:
                    continue
                if start:
                    pair = last[start] << 20 | number
                    good = agreed.get(pair)
                    if good is None:
                        good = agreed[pair] = agree(last[start], number)
                    if not good:
                        continue
                count.append(count[start] + 1)
                last.append(number)
                break
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return count

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """(part, is a special token) in order; special strings inside a text are one token each."""
        if self.special is None:
            yield text, False
            return
        at = 0
        for found in self.special.finditer(text):
            yield text[at : found.start()], False
            yield found.group(), True
            at = found.end()
        yield text[at:], False

    def prefixes(self, text: str) -> Prefixes:
        """The token counts of all prefixes of a text, made once."""
        parts: list[str] = []
        tables: list[bytes | list[int]] = []
        for part, whole in self.segments(text):
            if whole:
                parts.append(part)
                tables.append([0, *[1] * len(part.encode())])
            else:
                pieces = pretokens(part)
                parts += pieces
                tables += map(self.counts.__getitem__, pieces)
        return Prefixes(parts, tables, self.special)

    def count(self, text: str) -> int:
        return self.prefixes(text).count


class Prefixes:
    """Exact token counts at every prefix of one text: its pieces, their tables, and the running sums."""

    def __init__(self, pieces: list[str], tables: list, special: regex.Pattern | None):
        self.pieces, self.tables, self.special = pieces, tables, special
        #: tokens before each piece, and of the whole text
        self.sums = list(accumulate([table[-1] for table in tables], initial=0))
        self.count = self.sums[-1]

    def size(self, pieces: int) -> int:
        """Bytes of the first so many pieces."""
        return sum(map(len, self.tables[:pieces])) - pieces

    def cut(self, budget: int) -> int:
        """Bytes of the longest stable prefix with at most ``budget`` tokens.

        A prefix is stable where it ends between two pieces, or after a letter or digit of a
        piece of such: its pieces are then the text's own, cut there.
        """
        if self.count <= budget:
            return self.size(len(self.pieces))
        fit = bisect_right(self.sums, budget) - 1
        return self.size(fit) + self._inside(self.pieces[fit], self.tables[fit], budget - self.sums[fit])

    def _inside(self, piece: str, table, left: int) -> int:
        """Bytes of the longest stable proper prefix of a piece with at most ``left`` tokens."""
        if not left or not piece[-1].isalnum() or piece[0] == "'" or self.special and self.special.fullmatch(piece):
            return 0
        shortest = int(piece[0] == " ")
        stop = fit = 0
        for i, c in enumerate(piece[:-1]):
            stop += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            if table[stop] <= left and i >= shortest:
                fit = stop
        return fit


class _Counts(dict):
    """Piece to the token counts of its prefixes, made on first use; a byte each in pieces that are kept."""

    def __init__(self, tokens: PrefixTokens):
        super().__init__()
        self.tokens = tokens

    def __missing__(self, piece: str) -> bytes | list[int]:
        raw = piece.encode()
        table = self.tokens.table(raw)
        if len(raw) > _LONGEST:
            return table
        if len(self) >= _REMEMBERED:  # frequent pieces came early
            for old in list(self)[_REMEMBERED // 2 :]:
                del self[old]
        self[piece] = bytes(table)
        return self[piece]


def prefix_tokens(path: str) -> PrefixTokens:
    """The vocabulary at a path, read once a process."""
    loaded = worker_cache("prefix_tokens")
    if path not in loaded:
        loaded[path] = PrefixTokens(path)
    return loaded[path]


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None, budgets: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, cut_bytes), one row per row of ``docs``; with ``budgets`` also cuts.

    ``n_tokens`` counts the whole text's tokens; ``cut_bytes`` is the length of the longest stable
    prefix of at most ``limit`` tokens, and ``cuts`` (array) that of each of the ``budgets``, all read off the same
    tables. A null or empty text has 0 of all; a null doc_id stays null; repeated rows are counted alike, other columns do
    not matter, no rows give no rows. A text of any length is whole: one pass over its bytes, and memory in proportion to them.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long" + ", cuts array<long>" * bool(budgets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = prefix_tokens(path)
        for batch in batches:
            n = batch.num_rows
            size, count, cut = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 1 + len(budgets)), np.int64)
            for i, value in enumerate(batch.column("text")):
                if text := value.as_py():
                    found = tokens.prefixes(text)
                    size[i], count[i] = found.size(len(found.pieces)), found.count
                    cut[i] = [found.cut(x) for x in (limit, *budgets)]
            columns = [batch.column("doc_id"), pa.array(size), pa.array(count), pa.array(count > limit), pa.array(np.ascontiguousarray(cut[:, 0]))]
            if budgets:
                columns.append(pa.array(cut[:, 1:].tolist(), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes", "cuts"][: len(columns)])

    narrow = id_and_text(docs)
    return narrow.mapInArrow(run, schema)
