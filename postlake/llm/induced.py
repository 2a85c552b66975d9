"""Suffix order and common prefixes of one shard by induced sorting with queues on disk.

Suffixes that start a descent after an ascent ("seeds") are ordered first: the
stretches between them are sorted and named, and the string of names is ordered
by recursion.  Two passes induce all other suffixes: a pass takes suffixes in
order from a queue keyed by first symbol and puts the suffix one position
earlier back.  An entry of the queue is a tuple (symbol, position, common prefix
with the entry before it).  Entries beyond the memory allowed wait in a temporary file
of the task, by ranges of symbols, and are read when their range comes up; the
arrays of large shards are mapped files.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Queue entries held in memory; arrays of more bytes than eight times this are mapped files.
MEMORY = 4 << 20
#: Entries of a range of symbols, which are sorted at once.
_RANGE = 1 << 12


def array(n: int, dtype, memory: int = MEMORY) -> np.ndarray:
    """n zeros, in a file without a name if they are many."""
    size = n * np.dtype(dtype).itemsize
    if size <= 8 * memory:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as f:
        f.truncate(size)
        return np.memmap(f, dtype, "r+", shape=(n,))


class Spool:
    """First-in-first-out queues of int64 columns, one for each range; beyond ``memory`` entries all of them go to disk."""

    def __init__(self, ranges: int, width: int, memory: int):
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(ranges)]
        self.places: list[list[tuple[int, int]]] = [[] for _ in range(ranges)]
        self.width, self.memory, self.held, self.file, self.spilled = width, memory, 0, None, 0

    def put(self, of: np.ndarray, entries: np.ndarray) -> None:
        """Entries (columns x n) with their ranges, which ascend."""
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(of)], strict=True):
            self.waiting[of[lo]].append(entries[:, lo:hi])
        self.held += len(of)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for i, parts in enumerate(self.waiting):
            if parts:
                whole = np.concatenate(parts, axis=1)
                self.places[i].append((self.file.tell(), whole.shape[1]))
                whole.tofile(self.file)
                self.waiting[i] = []
        self.file.flush()
        self.spilled += self.held
        self.held = 0

    def take(self, i: int) -> np.ndarray:
        parts = []
        for at, n in self.places[i]:
            self.file.seek(at)
            parts.append(np.fromfile(self.file, np.int64, n * self.width).reshape(self.width, n))
        self.held -= sum(p.shape[1] for p in self.waiting[i])
        parts += self.waiting[i]
        self.waiting[i], self.places[i] = [], []
        return np.concatenate(parts, axis=1) if parts else np.zeros((self.width, 0), np.int64)


class RangeMinimum:
    """Minima of stretches of a sequence of small numbers that grows at its end."""

    def __init__(self, n: int, memory: int):
        self.levels = [array(n, np.uint8, memory) for _ in range(max(1, n.bit_length()))]

    def extend(self, lo: int, values: np.ndarray) -> None:
        hi = lo + len(values)
        self.levels[0][lo:hi] = values
        for k in range(1, len(self.levels)):
            half, start = 1 << (k - 1), max(lo, (1 << k) - 1)
            if start >= hi:
                break
            self.levels[k][start:hi] = np.minimum(self.levels[k - 1][start:hi], self.levels[k - 1][start - half : hi - half])

    def __call__(self, after: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Minimum of the numbers behind index ``after`` up to ``to``."""
        k = np.frexp((to - after).astype(np.float64))[1] - 1
        out = np.empty(len(to), np.int64)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            out[at] = np.minimum(self.levels[level][to[at]], self.levels[level][after[at] + (1 << level)])
        return out


def agreement(text: np.ndarray, i: np.ndarray, j: np.ndarray, most) -> np.ndarray:
    """Lengths of the common prefixes of suffixes i and j, up to ``most``."""
    out = np.zeros(len(i), np.int64)
    most = np.broadcast_to(np.asarray(most, np.int64), len(i))
    live, d, n = np.flatnonzero(most > 0), 0, len(text)
    k = 8 // text.dtype.itemsize
    if k > 1 and n >= k:  # several symbols at once
        words = np.ndarray(n - k + 1, np.uint64, text, strides=(text.dtype.itemsize,))
        going = live
        while len(going):
            going = going[(most[going] >= out[going] + k) & (np.maximum(i[going], j[going]) + out[going] <= n - k)]
            going = going[words[i[going] + out[going]] == words[j[going] + out[going]]]
            out[going] += k
        live = live[most[live] > out[live]]
        a, b = i[live] + out[live], j[live] + out[live]
        for _ in range(k):
            live, a, b = (x[(most[live] > out[live]) & (a < n) & (b < n)] for x in (live, a, b))
            equal = text[a] == text[b]
            live, a, b = live[equal], a[equal] + 1, b[equal] + 1
            out[live] += 1
        return out
    while len(live):
        a, b = i[live] + d, j[live] + d
        live = live[(a < n) & (b < n) & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])]
        d += 1
        out[live] = d
        live = live[most[live] > d]
    return out


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one is."""
    up = np.append(text[:-1] < text[1:], True)
    decided = np.append(text[:-1] != text[1:], True)
    following = np.where(decided, np.arange(len(text)), len(text))
    return up[np.minimum.accumulate(following[::-1])[::-1]]


class Pass:
    """One induction over a text: upwards from seeds to falling suffixes, or downwards from those to rising ones."""

    def __init__(self, text: np.ndarray, rises: np.ndarray, symbols: int, down: bool, memory: int, most: int = 0):
        self.text, self.down, self.symbols, self.memory, self.most = text, down, symbols, memory, most
        self.wanted = rises if down else ~rises
        loads = np.bincount(self._key(np.flatnonzero(self.wanted)), minlength=symbols)
        self.range_of = np.zeros(symbols, np.int64)
        ends = np.cumsum(loads)
        self.range_of = np.cumsum(np.append(0, (ends[1:] // _RANGE != ends[:-1] // _RANGE) | (loads[1:] > _RANGE))) if symbols > 1024 else np.arange(symbols)
        self.made = int(ends[-1])

    def _key(self, at: np.ndarray) -> np.ndarray:
        symbol = self.text[at].astype(np.int64)
        return self.symbols - 1 - symbol if self.down else symbol

    def run(self, seeds: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in order, which of them were induced, and common prefixes with the one before.

        seeds are in the pass's order, common their common prefixes with the seed
        before.  Of one first symbol the induced suffixes come before the seeds.
        """
        n, lcps = self.made + len(seeds), common is not None
        self.order, self.induced, self.done = array(n, np.int64, self.memory), array(n, bool, self.memory), 0
        self.minima = RangeMinimum(n, self.memory) if lcps else None
        self.last = np.full(self.symbols if lcps else 0, -1, np.int64)
        self.end, self.width = (-1, -1, False), 1024  # key, position and kind of the last suffix; entries looked at at once
        self.spool = Spool(int(self.range_of[-1]) + 1, 3, self.memory)
        keys = self._key(seeds)
        cuts = np.searchsorted(self.range_of[keys], np.arange(int(self.range_of[-1]) + 2)) if len(seeds) else np.zeros(int(self.range_of[-1]) + 2, np.int64)
        common = common if lcps else np.zeros(len(seeds), np.int64)
        for r in range(int(self.range_of[-1]) + 1):
            rank = self.spool.take(r)
            rank = rank[:, np.argsort(rank[0], kind="stable")]
            mine = slice(int(cuts[r]), int(cuts[r + 1]))
            self._range(r, rank, np.stack([keys[mine], seeds[mine], common[mine]]))
        n = self.done  # nothing precedes the end of the text, which rises
        return self.order[:n], self.induced[:n], self.minima.levels[0][:n] if lcps else np.zeros(0, np.uint8)

    def _range(self, r: int, rank: np.ndarray, seeds: np.ndarray) -> None:
        """All suffixes whose first symbol is in a range: batches that nothing induced in them could come into."""
        width, many = self.width, self.symbols > 1024  # else one symbol a range, whose seeds come last
        while rank.shape[1] or seeds.shape[1]:
            if many:
                both, is_seed = self._merged(rank[:, :width], seeds[:, :width], rank.shape[1] > width, seeds.shape[1] > width)
            else:
                both = rank[:, : 1 << 18] if rank.shape[1] else seeds[:, : 1 << 18]
                is_seed = np.full(both.shape[1], not rank.shape[1])
            n, before = both.shape[1], both[1] - 1
            makes = (before >= 0) & self.wanted[before]
            key = self._key(before[makes])
            if many:
                place = 2 * both[0] + is_seed
                made = np.full(n, np.iinfo(np.int64).max)
                made[makes] = 2 * key
                late = np.minimum.accumulate(made)[:-1] < place[1:]
                if late.any():
                    n = int(np.argmax(late)) + 1
                    both, is_seed, makes = both[:, :n], is_seed[:n], makes[:n]
                    key = key[: int(makes.sum())]
            self._emit(both, is_seed)
            old = int(n - is_seed.sum())
            rank, seeds = rank[:, old:], seeds[:, n - old :]
            at = np.flatnonzero(makes)
            fresh = self._induce(before[at], key, at + self.done - n)
            here = int(np.searchsorted(self.range_of[fresh[0]], r, side="right"))
            if here:
                new = fresh[:, :here]
                rank = np.concatenate([rank, new], axis=1) if not rank.shape[1] or new[0, 0] >= rank[0, -1] else np.insert(rank, np.searchsorted(rank[0], new[0], side="right"), new, axis=1)
            if here < fresh.shape[1]:
                self.spool.put(self.range_of[fresh[0, here:]], fresh[:, here:])
            width = self.width = min(max(3 * n, 512), 1 << 18)

    def _merged(self, a: np.ndarray, b: np.ndarray, more_a: bool, more_b: bool) -> tuple[np.ndarray, np.ndarray]:
        """Induced suffixes and seeds in order, up to the end of either if there is more of it; and which are seeds."""
        both = np.concatenate([a, b], axis=1)
        place = np.concatenate([2 * a[0], 2 * b[0] + 1])
        by = np.argsort(place, kind="stable")
        both, place = both[:, by], place[by]
        for part, more, seed in ((a, more_a, 0), (b, more_b, 1)):
            if more:
                to = int(np.searchsorted(place, 2 * part[0, -1] + seed, side="right"))
                both, place = both[:, :to], place[:to]
        return both, (place & 1).astype(bool)

    def _emit(self, batch: np.ndarray, is_seed: np.ndarray) -> None:
        lo, hi = self.done, self.done + batch.shape[1]
        self.order[lo:hi], self.induced[lo:hi] = batch[1], ~is_seed
        if self.minima is not None:
            key = np.append(self.end[0], batch[0])
            at = np.append(self.end[1], batch[1])
            was_seed = np.append(self.end[2], is_seed)
            common = np.where(key[1:] == key[:-1], batch[2], 0)
            seam = np.flatnonzero(is_seed & ~was_seed[:-1] & (key[1:] == key[:-1]))
            if len(seam):
                common[seam] = agreement(self.text, at[seam], at[seam + 1], self.most)
            self.minima.extend(lo, common)
            self.end = (int(batch[0, -1]), int(batch[1, -1]), bool(is_seed[-1]))
        self.done = hi

    def _induce(self, at: np.ndarray, key: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Tuples of new suffixes, by symbol; source: the places in the order of those that they precede."""
        by = np.argsort(key.astype(np.uint16) if self.symbols <= 1024 else key, kind="stable")  # two bytes are sorted by radix
        key, at, source = key[by], at[by], source[by]
        common = np.zeros(len(at), np.int64)
        if self.minima is not None and len(at):
            first = np.append(True, key[1:] != key[:-1])
            earlier = np.where(first, self.last[key], np.append(-1, source[:-1]))
            held = np.flatnonzero(earlier >= 0)
            common[held] = np.minimum(1 + self.minima(earlier[held], source[held]), self.most)
            last = np.append(np.flatnonzero(first)[1:] - 1, len(key) - 1)
            self.last[key[last]] = source[last]
        return np.stack([key, at, common])


def ranked(text: np.ndarray, starts: np.ndarray, length: np.ndarray, symbols: int, after: int) -> np.ndarray:
    """Ranks, equal ones for equal stretches, of the stretches from starts; behind its end a stretch goes on with the symbol ``after``."""
    bits = max(symbols, after).bit_length()
    at_once = 63 // bits
    rank, live, d = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
    while len(live):
        word = np.zeros(len(live), np.int64)
        for s in range(d, d + at_once):
            symbol = text[np.minimum(starts[live] + s, len(text) - 1)].astype(np.int64)
            word = word << bits | np.where(s < length[live], symbol, after)
        by = np.lexsort((word, rank[live])) if d else np.argsort(word, kind="stable")
        live, word = live[by], word[by]
        group = np.append(True, rank[live[1:]] != rank[live[:-1]])
        part = group | np.append(True, word[1:] != word[:-1])
        index = np.arange(len(live))
        rank[live] += index[part][np.cumsum(part) - 1] - index[group][np.cumsum(group) - 1]
        d += at_once
        alone = part & np.append(part[1:], True)
        # one that ends right here goes on as well: a longer one may begin with it
        live = live[~alone & (length[live] >= d)]
    return rank


def name_stretches(text: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """Names, in order, of the stretches from each seed to the next one; equal stretches have equal names.

    Of two stretches where one begins with the other the longer is smaller: at its
    end the shorter one rises, and the longer one still falls there.
    """
    rank = ranked(text, seeds, np.append(np.diff(seeds) + 1, 1), symbols, symbols)
    return np.unique(rank, return_inverse=True)[1].astype(np.int64)


#: A string of names of which so many first ones decide the order is sorted by them.
_DIRECT = 13


def suffix_order(text: np.ndarray, symbols: int, memory: int = MEMORY, most: int = 0, enough: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in ascending order and, if most > 0, their common prefixes with the one before, up to ``most``.

    text ends with its only 0; its values are below ``symbols``.  With ``enough`` (or
    ``most``) suffixes that have as many first symbols in common come in any order.  A
    name stands for two symbols or more, so each level needs half as many; the
    recursion ends where these are few.
    """
    n = len(text)
    rises = rising(text)
    seeds = np.flatnonzero(rises & np.append(False, ~rises[:-1])) if n > 1 else np.zeros(1, np.int64)

    def sweep(ordered: np.ndarray, common: np.ndarray | None):
        order, induced, prefix = Pass(text, rises, symbols, False, memory, most).run(ordered, common)
        falling = np.flatnonzero(induced)
        between = None
        if common is not None:  # common prefixes of neighbours once the seeds between them are gone
            between = np.zeros(len(falling), np.int64)
            if len(falling):
                between[0] = prefix[falling[0]]
                lowest = RangeMinimum(len(prefix), memory)
                lowest.extend(0, prefix)
                between[1:] = lowest(falling[:-1], falling[1:])
            between = np.append(between[1:], 0)[::-1]
        return Pass(text, rises, symbols, True, memory, most).run(order[falling][::-1], between)

    names = name_stretches(text, seeds, symbols)
    different, enough = int(names.max()) + 1, -(-(enough or most) // 2)
    if different == len(seeds):
        first = names
    elif 0 < enough <= _DIRECT:
        at = np.arange(len(names))
        first = ranked(names, at, np.minimum(enough, len(names) - at), different, 0)
    else:
        first = None
    sorted_seeds = seeds[suffix_order(names, different, memory, enough=enough)[0] if first is None else np.argsort(first, kind="stable")]
    common = None
    if most:
        common = np.append(0, agreement(text, sorted_seeds[:-1], sorted_seeds[1:], most))
    order, _, prefix = sweep(sorted_seeds, common)
    order = np.append(n - 1, order[::-1][order[::-1] != n - 1])
    if not most:
        return order, np.zeros(0, np.uint8)
    # downwards each number stands with the larger suffix of the two; the 0 at the end has nothing in common
    return order, np.concatenate([[0, 0], prefix[::-1][:-1]])[: len(order)].astype(np.uint8)
