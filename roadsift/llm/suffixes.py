"""Suffix and common-prefix arrays by external induced sorting.

The suffixes that start a descent of the text (S*) are named by their substrings and sorted by recursion over the names; all others are
induced from them, first upwards and then downwards.  An induction pass pops suffix tuples (key, position) from a priority queue and pushes
the tuple of the preceding suffix.  The queue is kept as buckets of key ranges; what is not in the bucket at the front is only ever
appended to, so beyond ``memory`` bytes it lies in files of a scratch folder, as do the sorted tuples.  A block of tuples is popped at
once, as far as none of them pushes a tuple that belongs before the block's end.

Common prefixes are carried along: that of two induced neighbours is one more than the least between their sources, that of two S* suffixes
is the length of the named substrings they share, from the recursion, and the start of the next ones.  They are capped at ``cap``.

In memory stay, for each symbol of a shard, its text (2 to 4 bytes), the S* positions and names (about 8) and the common prefixes of
the pass (6); the tuples (16 bytes for each suffix, in several passes) are what goes to disk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs

SEQ = np.uint64(32)
LOW = np.uint64((1 << 32) - 1)
LAST = np.uint64(2**64 - 1)
BLOCK = 64
BUCKETS = 512
SMALL = 1 << 21  # symbols of a recursion's text that are sorted in memory, by doubling; some 100 bytes each


class Scratch:
    """Files below a folder, which may be a URI; removed as soon as they are read, and the rest by ``close``."""

    def __init__(self, folder: str, memory: int):
        self.memory = memory
        self.uri, self.system, self.path = folder, None, ""
        self.spilled = 0

    def write(self, *columns: np.ndarray) -> tuple:
        if self.system is None:
            uri = self.uri if "://" in self.uri else "file://" + self.uri.removeprefix("file:")
            self.system, base = fs.FileSystem.from_uri(uri)
            self.path = f"{base}/suffixes-{uuid.uuid4().hex}"
            self.system.create_dir(self.path)
        name = f"{self.path}/{uuid.uuid4().hex}"
        with self.system.open_output_stream(name) as out:
            for c in columns:
                out.write(pa.py_buffer(np.ascontiguousarray(c)))
        self.spilled += 1
        return name, [(c.dtype, len(c)) for c in columns]

    def read(self, handle: tuple) -> list[np.ndarray]:
        name, kinds = handle
        with self.system.open_input_stream(name) as source:
            out = [np.frombuffer(source.read(kind.itemsize * n), kind) for kind, n in kinds]
        self.system.delete_file(name)
        return out

    def close(self):
        if self.system is not None:
            self.system.delete_dir(self.path)
            self.system = None


class Tape:
    """A sequence of tuples that is written once and read once, from either end."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.blocks, self.held, self.n = scratch, [], 0, 0

    def append(self, *columns: np.ndarray):
        if not len(columns[0]):
            return
        self.n += len(columns[0])
        self.held += sum(c.nbytes for c in columns)
        self.blocks.append(columns)
        if self.held > self.scratch.memory // 4:
            loose = [k for k, b in enumerate(self.blocks) if not isinstance(b[0], str)]
            whole = [np.concatenate(c) for c in zip(*[self.blocks[k] for k in loose])]
            self.blocks = [b for b in self.blocks if isinstance(b[0], str)] + [self.scratch.write(*whole)]
            self.held = 0

    def read(self, backwards: bool = False) -> Iterator[list[np.ndarray]]:
        blocks, self.blocks = self.blocks, []
        for block in reversed(blocks) if backwards else blocks:
            columns = self.scratch.read(block) if isinstance(block[0], str) else block
            yield [c[::-1] for c in columns] if backwards else list(columns)


class Queue:
    """Suffix tuples by key (symbol, then order); pushes are never below what was popped last."""

    def __init__(self, scratch: Scratch, counts: np.ndarray):
        """``counts`` is the number of tuples expected for each symbol; symbols share a bucket until it would be large."""
        self.scratch = scratch
        share = max(1, int(counts.sum()) // BUCKETS)
        border = np.cumsum(counts) // share
        alone = counts > share
        new = np.append(True, (border[1:] != border[:-1]) | alone[1:] | alone[:-1])
        self.bucket_of = (np.cumsum(new) - 1).astype(np.int32)
        n = int(self.bucket_of[-1]) + 1
        self.single = np.bincount(self.bucket_of, minlength=n) == 1
        self.waiting: list[list[tuple]] = [[] for _ in range(n)]
        self.front = -1
        self.keys, self.positions = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held = 0

    def push(self, keys: np.ndarray, positions: np.ndarray):
        """Keys in the order of their lower half."""
        if not len(keys):
            return
        symbols = (keys >> SEQ).astype(np.int64)
        buckets = self.bucket_of[symbols]
        order = np.argsort(buckets, kind="stable")
        keys, positions, buckets = keys[order], positions[order], buckets[order]
        borders = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])).tolist()
        for a, b in zip(borders, [*borders[1:], len(keys)]):
            bucket = int(buckets[a])
            if bucket == self.front and not self.single[bucket]:
                self.keys, self.positions = np.concatenate([self.keys, keys[a:b]]), np.concatenate([self.positions, positions[a:b]])
                order = np.argsort(self.keys, kind="stable")
                self.keys, self.positions = self.keys[order], self.positions[order]
            else:
                self.waiting[bucket].append((keys[a:b], positions[a:b]))
                self.held += 16 * (b - a)
        if self.held > self.scratch.memory:
            self._spill()

    def _spill(self):
        for k in range(max(self.front, 0), len(self.waiting)):
            loose = [b for b in self.waiting[k] if not isinstance(b[0], str)]
            if loose:
                kept = [b for b in self.waiting[k] if isinstance(b[0], str)]
                self.waiting[k] = [*kept, self.scratch.write(*(np.concatenate(c) for c in zip(*loose)))]
        self.held = 0

    def peek(self) -> bool:
        """Bring the next tuples, sorted, to the front; False where none is left."""
        while not len(self.keys):
            if self.front >= 0 and self.waiting[self.front]:
                taken = self.waiting[self.front]
                # a bucket of one symbol is filled in order and can be read block by block
                now, self.waiting[self.front] = (taken[:1], taken[1:]) if self.single[self.front] and isinstance(taken[0][0], str) else (taken, [])
                blocks = [self.scratch.read(b) if isinstance(b[0], str) else b for b in now]
                self.held -= sum(16 * len(b[0]) for b in now if not isinstance(b[0], str))
                self.keys, self.positions = (np.concatenate(c) for c in zip(*blocks))
                if not self.single[self.front]:
                    order = np.argsort(self.keys, kind="stable")
                    self.keys, self.positions = self.keys[order], self.positions[order]
            elif self.front + 1 < len(self.waiting):
                self.front += 1
            else:
                return False
        return True

    def take(self, n: int):
        self.keys, self.positions = self.keys[n:], self.positions[n:]


class Least:
    """Minima over ranges of a growing sequence of common prefixes."""

    def __init__(self, n: int):
        size = -(-max(n, 1) // BLOCK) * BLOCK
        self.value, self.until, self.since = (np.zeros(size, np.uint16) for _ in range(3))
        self.n, self.blocks = 0, 0
        self.table = [np.zeros(size // BLOCK, np.uint16)]

    def append(self, values: np.ndarray):
        a, b = self.n, self.n + len(values)
        self.value[a:b] = values
        first, last = a // BLOCK, -(-b // BLOCK)
        whole = self.value[first * BLOCK:last * BLOCK].reshape(-1, BLOCK)
        self.until[first * BLOCK:last * BLOCK] = np.minimum.accumulate(whole, axis=1).ravel()
        done = b // BLOCK
        if done > first:
            whole = whole[:done - first]
            self.since[first * BLOCK:done * BLOCK] = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
            self.table[0][first:done] = whole.min(axis=1)
            k = 1
            while 1 << k <= done:
                if k == len(self.table):
                    self.table.append(np.zeros(len(self.table[0]), np.uint16))
                lo = max(0, self.blocks - (1 << k) + 1)
                hi = done - (1 << k) + 1
                self.table[k][lo:hi] = np.minimum(self.table[k - 1][lo:hi], self.table[k - 1][lo + (1 << (k - 1)):hi + (1 << (k - 1))])
                k += 1
            self.blocks = done
        self.n = b

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least from ``lo`` to ``hi``, both included."""
        left, right = lo // BLOCK, hi // BLOCK
        out = self.value[lo]
        far = left != right
        out[far] = np.minimum(self.since[lo[far]], self.until[hi[far]])
        between = np.flatnonzero(right - left > 1)
        if len(between):
            a, b = left[between] + 1, right[between]
            k = np.frexp((b - a).astype(np.float64))[1] - 1
            for level in np.unique(k).tolist():
                at = k == level
                t = self.table[level]
                mine = between[at]
                out[mine] = np.minimum(out[mine], np.minimum(t[a[at]], t[b[at] - (1 << level)]))
        near = np.flatnonzero(~far & (hi > lo))
        step = 1
        while len(near):
            out[near] = np.minimum(out[near], self.value[lo[near] + step])
            step += 1
            near = near[lo[near] + step <= hi[near]]
        return out


def extended(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` share, up to ``cap``; the text ends in a symbol of its own."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        live = live[(out[live] < cap)]
        live = live[text[a[live] + out[live]] == text[b[live] + out[live]]]
        out[live] += 1
    return out


def induced(text: np.ndarray, start: Iterator[tuple[np.ndarray, np.ndarray]], n_start: int, down: bool, cap: int, scratch: Scratch) -> Tape:
    """One pass.  ``start`` yields (positions, common prefixes) of the given suffixes in the order of the pass; all suffixes, or upwards
    only the new ones, come out in that order with their common prefix to the one before.

    Upwards a given suffix's prefix is the one it shares with the suffix given before it, downwards with the one given after it."""
    top = int(text.max())
    counts = np.zeros(2 * top + 2, np.int64)
    rank_of = (lambda c: top - c) if down else (lambda c: c)
    both = np.bincount(text, minlength=top + 1)
    counts[0::2] = counts[1::2] = both[::-1] if down else both
    queue, given, out = Queue(scratch, counts), np.zeros(n_start + 1, np.uint16), Tape(scratch)
    at = 0
    for positions, shared in start:
        given[at:at + len(shared)] = shared
        symbols = rank_of(text[positions].astype(np.int64)) * 2 + 1
        queue.push(symbols.astype(np.uint64) << SEQ | np.arange(at, at + len(positions), dtype=np.uint64), positions)
        at += len(positions)
    history = Least(len(text) + 1)
    last_key, last_position = LAST, -1
    while queue.peek():
        keys, positions = queue.keys, queue.positions
        before = positions - 1
        symbol, former = text[positions], text[np.maximum(before, 0)]
        is_given = (keys >> SEQ) & np.uint64(1) == 1
        # a suffix induces the one before it if that is of the pass's type
        pushes = (before >= 0) & (((former < symbol) | ((former == symbol) & ~is_given)) if down else (former >= symbol))
        new = (rank_of(former.astype(np.int64)) * 2).astype(np.uint64) << SEQ | (np.arange(len(keys)) + history.n).astype(np.uint64)
        new[~pushes] = LAST
        n = len(keys)
        if n > 1:
            late = np.flatnonzero(np.minimum.accumulate(new)[:-1] < keys[1:])
            if len(late):
                n = int(late[0]) + 1
        keys, positions, pushes, new, is_given = keys[:n], positions[:n], pushes[:n], new[:n], is_given[:n]
        queue.take(n)
        # common prefix with the suffix before, which is the last of the block before for the first one
        earlier_keys, earlier = np.append(last_key, keys[:-1]), np.append(last_position, positions[:-1])
        shared = np.zeros(n, np.uint16)
        same = (earlier_keys >> SEQ == keys >> SEQ) & (earlier >= 0)
        own = np.flatnonzero(same & is_given)
        shared[own] = given[((earlier_keys if down else keys)[own] & LOW).astype(np.int64)]
        made = np.flatnonzero(same & ~is_given)
        if len(made):
            lo, hi = (earlier_keys[made] & LOW).astype(np.int64) + 1, (keys[made] & LOW).astype(np.int64)
            shared[made] = np.minimum(history.over(lo, hi).astype(np.int64) + 1, cap)
        seam = np.flatnonzero(~same & (earlier >= 0) & (earlier_keys >> np.uint64(33) == keys >> np.uint64(33)))
        if len(seam):
            shared[seam] = extended(text, earlier[seam], positions[seam], cap)
        history.append(shared)
        if down:
            out.append(positions, shared)
        else:
            out.append(positions[~is_given], shared[~is_given])
        last_key, last_position = keys[-1], positions[-1]
        queue.push(new[pushes], positions[pushes] - 1)
    return out


def names_of(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """S* positions by their substrings (each up to and with the next start), the name of each start, and whether all names differ."""
    n = len(starts)
    ends = np.append(starts[1:] + 1, len(text))
    bits = max(1, int(text.max()) + 1).bit_length()
    per = max(1, 63 // bits)
    beyond = (1 << bits) - 1  # a substring that ends is the greater one: its last symbol rises there, the longer one's falls

    def key(which: np.ndarray, depth: int) -> np.ndarray:
        out = np.zeros(len(which), np.uint64)
        for k in range(per):
            p = starts[which] + depth + k
            c = np.where(p < ends[which], text[np.minimum(p, len(text) - 1)].astype(np.int64), beyond)
            out = out << np.uint64(bits) | c.astype(np.uint64)
        return out

    first = key(np.arange(n), 0)
    order = np.argsort(first, kind="stable")
    new = np.append(True, first[order][1:] != first[order][:-1])
    depth = per
    while True:
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        longer = np.zeros(len(size), bool)
        longer[group[starts[order] + depth < ends[order]]] = True
        open = np.flatnonzero((size[group] > 1) & longer[group])  # whole groups, with the members that have ended
        if not len(open):
            break
        k = key(order[open], depth)
        again = np.lexsort((k, group[open]))
        order[open], k, g = order[open][again], k[again], group[open][again]
        differs = np.append(True, (k[1:] != k[:-1]) | (g[1:] != g[:-1]))
        new[open] |= differs
        depth += per
    names = np.empty(n, np.int64)
    names[order] = np.cumsum(new) - 1
    return order, names, bool(new.all())


def sorted_in_memory(text: np.ndarray, cap: int, scratch: Scratch) -> Tape:
    """As ``suffix_array``: ranks by 1, 2, 4, ... symbols until all differ or ``cap`` is reached; the ranks also tell what neighbours share."""
    n, h = len(text), 1
    ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    while True:
        after = np.zeros(n, np.int64)
        after[:n - h] = ranks[-1][h:] + 1
        key = ranks[-1] << 32 | after
        order = np.argsort(key, kind="stable")
        differs = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(differs))
        ranks.append(rank)
        h *= 2
        if h >= cap or bool(differs.all()):
            break
    order = order[:0:-1]
    a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(n - 2, np.int64)
    for k in reversed(range(len(ranks))):
        same = ranks[k][a] == ranks[k][b]
        for moved in (a, b, shared):
            moved[same] += 1 << k
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
    out = Tape(scratch)
    out.append(order, np.append(0, np.minimum(shared, cap)).astype(np.uint16))
    return out


def suffix_array(text: np.ndarray, cap: int, scratch: Scratch) -> Tape:
    """Positions of the suffixes in descending order of their first ``cap`` symbols at least, each with the prefix shared with the one before it, up to ``cap``.

    ``text`` ends in its only, least symbol; that suffix itself is left out."""
    n = len(text)
    if n >= 1 << 31:
        raise ValueError("a shard has to have fewer than 2 ** 31 symbols")
    if n < 2:
        return Tape(scratch)
    # type of each suffix: that of the next place where symbols differ
    differs = np.append(text[1:] != text[:-1], True)
    rises = np.append(text[:-1] < text[1:], True)
    place = np.flatnonzero(differs)
    is_s = rises[place[np.searchsorted(place, np.arange(n))]]
    starts = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    del differs, rises, place, is_s
    order, names, distinct = names_of(text, starts)
    if distinct:
        sorted_starts, shared = order, np.zeros(len(order), np.int64)
    else:
        below = (sorted_in_memory if len(names) <= SMALL else suffix_array)(names.astype(np.int32), cap, scratch)
        blocks = [[c.copy() for c in b] for b in below.read(backwards=True)]
        found, told = (np.concatenate(c) for c in zip(*blocks))
        sorted_starts = np.append(len(names) - 1, found)  # the end comes first
        # read backwards, a suffix's own value tells what it shares with the one that now follows it
        shared = np.append(0, np.append(0, told[:-1]).astype(np.int64))
    del order, names
    # symbols in the shared substrings, then those that the next ones share
    a, b = sorted_starts[:-1], sorted_starts[1:]
    whole = np.minimum(shared[1:], len(starts) - 1 - np.maximum(a, b))
    known = np.minimum(starts[b + whole] - starts[b], cap)
    less = np.flatnonzero(known < cap)
    known[less] += extended(text, starts[a[less]] + known[less], starts[b[less]] + known[less], cap)
    shared = np.append(0, np.minimum(known, cap)).astype(np.uint16)
    up = induced(text, iter([(starts[sorted_starts], shared)]), len(starts), False, cap, scratch)
    return induced(text, ((p, s) for p, s in up.read(backwards=True)), up.n, True, cap, scratch)
