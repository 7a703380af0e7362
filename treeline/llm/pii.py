"""Format-preserving Feistel pseudonyms for personal data and secrets.

Validated values (payment cards by Luhn, IBANs by mod 97, social security numbers, phone numbers, IPv4
addresses, calendar dates, e-mail addresses, credentials) are permuted under a key within
their own format: digits stay digits, letters letters, separators and case stay, check
digits hold again. Equal values get equal pseudonyms in every document, and the holder of the
key can undo them. Only a value that shares characters with a match that fails its check may get another
pseudonym there: one with which that match fails still.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import id_and_text

_ROUNDS = 10
#: Components that are permuted at once; longer values go block by block, twice.
_BLOCK = 64
#: The longest value whose pseudonym a task remembers.
_LONGEST = 128
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days
_FREE = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"

# The written forms that are looked for, in order of preference.
FORMS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_+-]+(?:\.[A-Za-z0-9_+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)[\"']?[ ]?[=:][ ]?[\"']?(?P<value>[A-Za-z0-9_+/-]{8,})",
    "access_key": rf"{_FREE[0]}(?:AKIA|ASIA)[0-9A-Z]{{16}}{_FREE[1]}",
    "iban": rf"{_FREE[0]}[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{2,7}}(?: ?[0-9A-Z]{{1,3}})?{_FREE[1]}",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])",
    "date": rf"{_FREE[0]}(?:[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}|[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{4}}){_FREE[1]}",
    "ssn": rf"{_FREE[0]}(?<!-)[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?!-){_FREE[1]}",
    "phone": r"(?<![\w+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\w)|(?<![\w+])\+(?!1[ .(-])[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?!\w|\.[0-9])|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?!\w)|(?<![\w.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![\w-])",
    "card": rf"{_FREE[0]}[0-9](?:[ -]?[0-9]){{12,18}}{_FREE[1]}",
}
_ANY = re.compile("|".join(f"(?P<{kind}>{form})" for kind, form in FORMS.items()))
_LIKELY = re.compile(r"[0-9@]|[=:] ?[\"']?[A-Za-z0-9_+/-]{8}")


class Feistel:
    """A keyed permutation of number tuples, each component within its own radix."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mix(self, tweak: str, turn: int, value: int) -> int:
        text = f"{tweak}/{turn}/".encode() + value.to_bytes(value.bit_length() // 8 + 1, "big")
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=48).digest(), "big")

    def permute(self, values: list[int], radices: list[int], tweak: str, back: bool = False) -> list[int]:
        """A permutation of tuples of any length, in time in proportion to it; ``back`` undoes it.

        Long tuples are cut into blocks, each permuted under what came before it: once from the front and once from
        the end, so that every component depends on all others.
        """
        if len(values) <= _BLOCK:
            return self._halves(values, radices, tweak, back)
        blocks = [slice(at, at + _BLOCK) for at in range(0, len(values), _BLOCK)]
        passes = [("front", blocks), ("end", blocks[::-1])]
        out = list(values)
        for name, order in reversed(passes) if back else passes:
            before = b""
            for at in order:
                given = out[at]
                out[at] = self._halves(given, radices[at], f"{tweak}/{len(values)}/{name}/{before.hex()}", back)
                before = hashlib.blake2b(before + repr(out[at] if back else given).encode(), key=self.key, digest_size=16).digest()
        return out

    def _halves(self, values: list[int], radices: list[int], tweak: str, back: bool) -> list[int]:
        """Alternates sums modulo the sizes of the two halves."""
        half = (len(values) + 1) // 2
        sizes, parts = [1, 1], [0, 0]
        for i, (value, radix) in enumerate(zip(values, radices, strict=True)):
            side = int(i >= half)
            sizes[side], parts[side] = sizes[side] * radix, parts[side] * radix + value
        tweak = f"{tweak}/{','.join(map(str, radices))}"
        for turn in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
            side = turn % 2
            step = self._mix(tweak, turn, parts[1 - side])
            parts[side] = (parts[side] - step if back else parts[side] + step) % sizes[side]
        out = [0] * len(values)
        for i in reversed(range(len(values))):
            side = int(i >= half)
            parts[side], out[i] = divmod(parts[side], radices[i])
        return out

    def walk(self, values: list[int], radices: list[int], tweak: str, valid: Callable[[list[int]], bool], back: bool = False) -> list[int]:
        """The permutation within the valid tuples: repeated until the result is valid."""
        values = self.permute(values, radices, tweak, back)
        while not valid(values):
            values = self.permute(values, radices, tweak, back)
        return values


def luhn(digits: list[int]) -> bool:
    total = sum(digits[-1::-2]) + sum(x for d in digits[-2::-2] for x in divmod(2 * d, 10))
    return total % 10 == 0


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


class Hit(NamedTuple):
    """A value's place, where the failed matches that reach it begin, and where its longest match ends."""

    kind: str
    start: int
    stop: int
    tried: int
    longest: int


class Pseudonyms:
    """Replaces the values of one key; ``back`` restores them."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back
        self.known: dict[tuple[str, str], str | None] = {}

    def _digits(self, text: str, digits: list[int]) -> str:
        left = iter(digits)
        return "".join(str(next(left)) if c.isdigit() else c for c in text)

    def _classes(self, text: str, tweak: str) -> str:
        """Letters within letters, case kept; digits within digits; hexadecimal words stay so."""
        hexadecimal = len(text) >= 8 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text)
        at = [i for i, c in enumerate(text) if c.isalnum()]
        if not at:
            return text
        bases = [16 if hexadecimal else 10 if text[i].isdigit() else 26 for i in at]
        values = [int(text[i], 16) if b == 16 else int(text[i]) if b == 10 else int(text[i], 36) - 10 for i, b in zip(at, bases, strict=True)]
        out = list(text)
        for i, b, value in zip(at, bases, self.feistel.permute(values, bases, tweak, self.back), strict=True):
            made = f"{value:x}" if b == 16 else str(value) if b == 10 else chr(97 + value)
            out[i] = made.upper() if text[i].isupper() or b == 16 and text.upper() == text else made
        return "".join(out)

    def email(self, text: str) -> str:
        local, _, domain = text.partition("@")
        *labels, top = domain.split(".")
        return f"{self._classes(local, 'local')}@{'.'.join([*(self._classes(x, 'label') for x in labels), top])}"

    def secret(self, text: str) -> str:
        return self._classes(text, "secret")

    def access_key(self, text: str) -> str:
        return text[:4] + self._classes(text[4:], "access_key")

    def iban(self, text: str) -> str | None:
        flat = text.replace(" ", "")
        # check digits are made as 98 minus a remainder: 02 to 98, of which only one fits
        if not 15 <= len(flat) <= 34 or not 2 <= int(flat[2:4]) <= 98 or _mod97(flat[4:] + flat[:4]) != 1:
            return None
        body = self._classes(flat[4:] + " ", f"iban/{flat[:2]}")[:-1]
        made = iter(f"{flat[:2]}{98 - _mod97(f'{body}{flat[:2]}00'):02d}{body}")
        return "".join(c if c == " " else next(made) for c in text)

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(x) > 255 or x != str(int(x)) for x in parts):
            return None
        return ".".join(map(str, self.feistel.permute([int(x) for x in parts], [256] * 4, "ip", self.back)))

    def date(self, text: str) -> str | None:
        fields = re.split(r"[-/.]", text)
        marks = re.findall(r"[-/.]", text)
        if marks[0] != marks[1]:
            return None
        numbers = [int(x) for x in fields]
        if len(fields[0]) == 4:
            order = (0, 1, 2)
        elif numbers[0] <= 12:
            order = (2, 0, 1)
        else:
            order = (2, 1, 0)
        try:
            day = datetime.date(*(numbers[i] for i in order)).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None

        def written(day: int) -> list[int]:
            made, out = datetime.date.fromordinal(_FIRST_DAY + day), [0, 0, 0]
            for place, value in zip(order, (made.year, made.month, made.day), strict=True):
                out[place] = value
            return out

        bare = min(map(len, fields)) == 1  # months and days are written without zeros, at least here

        def shown(day: int) -> list[str]:
            return [f"{x:02d}" if len(field) == 2 else str(x) for x, field in zip(written(day), fields, strict=True)]

        def fits(v: list[int]) -> bool:
            """Dates within the same form: widths, zeros in front, and a first number over 12 if the days come first."""
            day = v[0] * 512 + v[1]
            if day >= _DAYS or order == (2, 1, 0) and written(day)[0] <= 12:
                return False
            made = shown(day)
            return all(len(x) == len(y) and (not bare or (x[0] == "0") == (y[0] == "0")) for x, y in zip(made, fields, strict=True))

        form = f"date/{order}/{','.join(f'{len(x)}{x[0] == "0"}' if bare else str(len(x)) for x in fields)}"
        high, low = self.feistel.walk(list(divmod(day, 512)), [-(-_DAYS // 512), 512], form, fits, self.back)
        return "".join(x + m for x, m in zip(shown(high * 512 + low), [*marks, ""], strict=True))

    def ssn(self, text: str) -> str | None:
        valid = lambda v: 0 < v[0] < 900 and v[0] != 666 and v[1] > 0 and v[2] > 0
        values = [int(x) for x in text.split("-")]
        if not valid(values):
            return None
        area, group, serial = self.feistel.walk(values, [1000, 100, 10000], "ssn", valid, self.back)
        return f"{area:03d}-{group:02d}-{serial:04d}"

    def phone(self, text: str) -> str | None:
        country = re.match(r"\+\d{1,3}(?=\D)|\+\d{2}", text)
        head = country.group() if country else ""
        digits = [int(c) for c in text[len(head) :] if c.isdigit()]
        if not 7 <= len(digits) <= 13:
            return None
        return head + self._digits(text[len(head) :], self.feistel.permute(digits, [10] * len(digits), "phone", self.back))

    def card(self, text: str) -> str | None:
        digits = [int(c) for c in text if c.isdigit()]
        if not luhn(digits) or len(set(digits)) == 1:
            return None
        whole = lambda body: next([*body, d] for d in range(10) if luhn([*body, d]))
        body = self.feistel.walk(digits[:-1], [10] * (len(digits) - 1), "card", lambda body: len(set(whole(body))) > 1, self.back)
        return self._digits(text, whole(body))

    def replaced(self, text: str) -> tuple[str, Counter]:
        """The text with its values replaced, and how many of each kind."""
        found: Counter = Counter()
        if not _LIKELY.search(text):
            return text, found

        out, done = [], 0
        while hit := self._first(text, done):
            kind, start, stop, tried, longest = hit
            value = text[start:stop]
            made = self._made(kind, value)
            if tried < start or stop < longest:
                # a place that fails now must not pass with the pseudonym in it, or ``back`` would take that one
                low, high = max(0, tried - 1), stop + 60
                place = lambda x: (self._first(text[low:start] + x + text[stop:high], tried - low) or ())[:3]
                same = (kind, start - low, stop - low)
                if place(value) == same:
                    while made is not None and place(made) != same:
                        made = self._made(kind, made)
            out += [text[done:start], value if made is None else made]
            found[kind] += 1
            done = stop
        return "".join([*out, text[done:]]), found

    def _made(self, kind: str, value: str) -> str | None:
        if len(value) > _LONGEST:
            return getattr(self, kind)(value)
        known = self.known.get((kind, value), "")
        if known == "":
            if len(self.known) > 100_000:
                self.known.clear()
            known = self.known[kind, value] = getattr(self, kind)(value)
        return known

    def _first(self, text: str, at: int) -> Hit | None:
        """The first valid value from a place on; a match that fails is searched for shorter and later ones."""
        tried = failed = at
        while match := _ANY.search(text, at):
            if match.start() >= failed:
                tried = match.start()
            kind = next(k for k in FORMS if match.group(k) is not None)
            span = match.span("value") if kind == "secret" else match.span()
            for start, stop in _windows(kind, *span, text):
                if self._made(kind, text[start:stop]) is not None:
                    return Hit(kind, start, stop, min(tried, start) if tried < match.start() else start, span[1])
            failed, at = max(failed, match.end()), match.start() + 1
        return None


def _windows(kind: str, start: int, stop: int, text: str) -> Iterator[tuple[int, int]]:
    """The places to try from the start of a match: all of it, then, for cards and IBANs, up to its group borders, longest first."""
    yield start, stop
    if kind in ("card", "iban"):
        form = re.compile(FORMS[kind])
        for end in range(stop - 1, start, -1):
            if text[end] in " -" and form.fullmatch(text, start, end):
                yield start, end


def pseudonymised(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """(doc_id, text, n_found, kinds): each text with its personal data replaced under ``key``.

    ``kinds`` counts the replaced values as "kind:count", sorted, comma-joined. Numbers that fail
    their check (Luhn, mod 97, ranges, calendar) are left alone, as is everything else. A null text
    stays null with 0 found, an empty one empty; a null doc_id stays null; repeated rows are treated alike, no rows give no rows, other
    columns are ignored. Where forms overlap, the match that begins first wins, and of two that begin together the one that comes first in ``FORMS``.
    One pass without a shuffle, whole texts and values of any length; with ``back`` and
    the same key the originals return.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key.encode(), back)
        for batch in batches:
            texts, numbers, kinds = [], np.zeros(batch.num_rows, np.int64), []
            for i, value in enumerate(batch.column("text")):
                text = value.as_py()
                made, found = names.replaced(text) if text else (text, Counter())
                texts.append(made)
                numbers[i] = found.total()
                kinds.append(",".join(f"{k}:{n}" for k, n in sorted(found.items())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(numbers), pa.array(kinds, pa.string())], names=["doc_id", "text", "n_found", "kinds"])

    narrow = id_and_text(docs)
    return narrow.mapInArrow(run, "doc_id long, text string, n_found long, kinds string")
