"""Pre-tokens of a byte-pair tokenizer, found by array operations and looked up in two tiers.

Tier one is a read-only hash table of frequent pre-tokens that is broadcast; tier two is a cache that each Python worker fills.
Both are accelerators: a result never depends on what they hold.  Texts with code points from 0x300 on, or with the text of a
special token, are handed to the tokenizers library whole.  A pre-token is known by a 64-bit hash of its code points.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from roadsift.llm.text import UNITS, unit_hashes, utf8

PLAIN = 0x300
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
CACHED = 1 << 20
SECOND = np.uint64(32)

# fixed values: white space below 0x300
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0]
# fixed values: endings that are split from a word after an apostrophe
ENDINGS_ONE = "stmd"
ENDINGS_TWO = ["re", "ve", "ll"]


def _kinds() -> np.ndarray:
    out = np.full(PLAIN, OTHER, np.uint8)
    for c in range(PLAIN):
        major = unicodedata.category(chr(c))[0]
        out[c] = LETTER if major == "L" else NUMBER if major == "N" else OTHER
    out[SPACES] = SPACE
    return out


KINDS = _kinds()
# lower case of U+0130 has two code points, so it isn't plain
LOWERED = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(PLAIN)], np.uint32)
LOWERED_UNITS = np.where(LOWERED < PLAIN, UNITS[np.minimum(LOWERED, PLAIN - 1)], UNITS[:PLAIN] + np.uint64(1))


class Pieces:
    """Pre-tokens of a slice of documents: code point borders, document bounds and hashes.  ``odd`` marks the documents left to the library."""

    def __init__(self, column: pa.Array, words: bool, special: list[str]):
        data, offsets = utf8(column)
        self.n_docs = len(offsets) - 1
        raw = data.tobytes()
        ahead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=ahead[1:])
        self.offsets = ahead[offsets]
        self.codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        self.words = words
        codes, n = self.codes, len(self.codes)
        self.odd = np.zeros(self.n_docs, bool)
        strange = np.flatnonzero((codes >= PLAIN) | (codes == 0x130))
        if len(strange):
            self.odd[np.unique(np.searchsorted(self.offsets, strange, "right") - 1)] = True
        if any(s.encode() in raw for s in special):
            for d in range(self.n_docs):
                text = raw[offsets[d]:offsets[d + 1]]
                self.odd[d] |= any(s.encode() in text for s in special)
        small = np.minimum(codes, PLAIN - 1)
        kind = KINDS[small]
        head = np.zeros(n + 1, bool)
        head[self.offsets] = True
        head = head[:n]
        run = head.copy()
        if n:
            run[1:] |= kind[1:] != kind[:-1]
        start = self._starts(kind, run, head, codes)
        self.starts = np.flatnonzero(start)
        values = (LOWERED_UNITS if words else UNITS)[small]
        if words:
            values[kind == SPACE] = 0
        self.hashes = unit_hashes(values, self.starts)
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.kind = kind
        self._texts = None

    def _starts(self, kind, run, head, codes):
        n = len(kind)
        blank = kind == SPACE
        if self.words:
            start = (run | (kind == NUMBER)) & ~blank
            joined = np.zeros(n, bool)
        else:
            start = run.copy()
            joined = np.zeros(n, bool)  # a run of other characters right after a blank that belongs to it
            joined[1:] = run[1:] & ~head[1:] & ~blank[1:] & (codes[:-1] == 32)
            start &= ~joined
            if n:
                start[:-1] |= blank[:-1] & ~blank[1:] & ~head[1:]
        mark = np.flatnonzero((codes == 39) & run & ~joined)
        mark = mark[mark + 1 < n]
        mark = mark[run[mark + 1] & ~head[mark + 1] & (kind[mark + 1] == LETTER)]
        if len(mark):
            case = (lambda x: LOWERED[np.minimum(x, PLAIN - 1)]) if self.words else (lambda x: x)
            first = case(codes[mark + 1])
            there = mark + 2 < n
            after = np.minimum(mark + 2, n - 1)
            letter = there & ~run[after] & (kind[after] == LETTER)
            second = np.where(letter, case(codes[after]), 0)
            one = np.isin(first, [ord(c) for c in ENDINGS_ONE])
            two = np.zeros(len(mark), bool)
            for a, b in ENDINGS_TWO:
                two |= (first == ord(a)) & (second == ord(b))
            for chosen, size in ((one, 2), (two & ~one, 3)):
                at = mark[chosen]
                start[at + 1] = False
                rest = at + size
                rest = rest[rest < n]
                start[rest[~run[rest] & (kind[rest] == LETTER)]] = True
        return start

    def text(self, i: int) -> str:
        if self._texts is None:  # the slice as one string, only if a piece of it is new
            codes = LOWERED[np.minimum(self.codes, PLAIN - 1)] if self.words else self.codes
            ends = np.append(self.starts[1:], len(codes))
            if self.words and len(ends):  # blanks stand between pieces
                ends = self.starts + np.add.reduceat((self.kind != SPACE).astype(np.int64), self.starts)
            self._texts = codes.astype(np.uint32).tobytes().decode("utf-32-le"), self.starts.tolist(), ends.tolist()
        whole, starts, ends = self._texts
        return whole[starts[i]:ends[i]]

    def document(self, d: int) -> str:
        return self.codes[self.offsets[d]:self.offsets[d + 1]].tobytes().decode("utf-32-le")


class Cache:
    """Entry numbers of pre-token hashes; entries are made by ``make`` for hashes not seen and forgotten when there are too many."""

    def __init__(self, make: Callable[[list[str]], None], clear: Callable[[], None], bits: int = 20):
        self.make, self.clear = make, clear
        self.mask = np.uint64((1 << bits) - 1)
        self._reset()

    def _reset(self):
        n = int(self.mask) + 1
        self.tags, self.slots = np.zeros((2, n), np.uint64), np.zeros((2, n), np.int32)
        self.known: dict[int, int] = {}
        self.clear()

    def find(self, hashes: np.ndarray, text: Callable[[int], str]) -> np.ndarray:
        if len(self.known) > CACHED:
            self._reset()
        at = hashes & self.mask
        found = self.slots[0][at]
        missed = np.flatnonzero(self.tags[0][at] != hashes)
        if len(missed):
            rest = hashes[missed]
            at = (rest >> SECOND) & self.mask
            found[missed] = self.slots[1][at]
            away = self.tags[1][at] != rest
            missed, rest = missed[away], rest[away]
        if len(missed):
            new, first, back = np.unique(rest, return_index=True, return_inverse=True)
            known, fresh, numbers = self.known, [], []
            at = missed[first].tolist()
            for k, h in enumerate(new.tolist()):
                number = known.get(h)
                if number is None:
                    number = known[h] = len(known)
                    fresh.append(text(at[k]))
                numbers.append(number)
            if fresh:
                self.make(fresh)
            numbers = np.array(numbers, np.int32)
            found[missed] = numbers[back]
            first_at = new & self.mask
            old, old_numbers = self.tags[0][first_at], self.slots[0][first_at]
            moved = (old >> SECOND) & self.mask  # what stood there moves to its second place
            self.tags[1][moved], self.slots[1][moved] = old, old_numbers
            self.tags[0][first_at], self.slots[0][first_at] = new, numbers
        return found


def special_strings(source: str) -> list[str]:
    return [t["content"] for t in json.loads(source)["added_tokens"]]


def load(source: str):
    """The library's tokenizer from the JSON text, without truncation and padding; kept once per worker."""
    key = hash(source)
    if key not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(source)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _LOADED.clear()
        _LOADED[key] = tokenizer
    return _LOADED[key]


_LOADED: dict[int, object] = {}


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else counted up from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in keep else chr(next(rest)) for b in range(256)}


LETTERS = byte_letters()


def as_letters(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(LETTERS)
