"""Suffix and common-prefix arrays by external induced sorting.

Only S* suffixes (an S suffix after an L one) are sorted by recursion on the
names of their substrings; all others follow by two scans. A scan works through
a priority queue of suffix tuples keyed by (first symbol, rank of the inducing
suffix). Tuples enter in rank order, so a queue bucket is a sequence that can be
appended to disk and read back once. Each tuple carries the least common prefix
since the last tuple of its bucket; one more symbol gives its own value.

Values are capped at ``cap``. The queue's spill files are unlinked scratch of
the one task that made them, as a sort's spills are: nothing else reads them.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: An ordinary shard of suffix_dedup has more tuples than this: its queues go to disk.
MEMORY_ITEMS = 1 << 16
BASE_LENGTH = 1 << 23


class TupleQueue:
    """Buckets of (position, least common prefix) sequences; the oldest go to disk beyond a number of tuples."""

    def __init__(self, memory_items: int):
        self.memory_items, self.items = memory_items, 0
        self.buckets: dict[int, list] = {}
        self.file = None

    def push(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.buckets.setdefault(symbol, []).append((positions, prefixes))
        self.items += len(positions)
        if self.items > self.memory_items:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.buckets.values():
            for k, part in enumerate(parts):
                if len(part) == 2:
                    at = self.file.tell()
                    for array in part:
                        self.file.write(array.tobytes())
                    parts[k] = (at, len(part[0]), part[0].dtype, part[1].dtype)
        self.items = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        positions, prefixes = [], []
        for part in self.buckets.pop(symbol, []):
            if len(part) == 2:
                self.items -= len(part[0])
            else:
                at, n, kind, prefix_kind = part
                self.file.seek(at)
                raw = self.file.read(n * (kind.itemsize + prefix_kind.itemsize))
                part = np.frombuffer(raw, kind, n), np.frombuffer(raw, prefix_kind, n, n * kind.itemsize)
            positions.append(part[0])
            prefixes.append(part[1])
        if not positions:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(positions), np.concatenate(prefixes)


class _Scan:
    """Hands the tuples of a scan to the queue with the least common prefix since each bucket's last tuple."""

    def __init__(self, symbols: int, cap: int, memory_items: int):
        self.queue = TupleQueue(memory_items)
        self.least = np.zeros(symbols, np.int32)
        self.cap = cap

    def feed(self, prefixes: np.ndarray, targets: np.ndarray, positions: np.ndarray, ok: np.ndarray) -> None:
        """``prefixes`` of a batch in scan order; where ``ok``, its tuple (position) goes to bucket ``target``."""
        if not len(prefixes):
            return
        at = np.flatnonzero(ok)
        small = targets[at].astype(np.uint16) if len(self.least) <= 1 << 16 else targets[at]
        at = at[np.argsort(small, kind="stable")]
        symbol = targets[at]
        suffix_least = np.minimum.accumulate(prefixes[::-1])[::-1]
        if not len(at):
            np.minimum(self.least, suffix_least[0], out=self.least)
            return
        first = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        heads = np.flatnonzero(first)
        value = np.empty(len(at), np.int32)
        prefix_least = np.minimum.accumulate(prefixes)
        value[heads] = np.minimum(self.least[symbol[heads]], prefix_least[at[heads]])
        rest = np.flatnonzero(~first)
        if len(rest):
            value[rest] = range_least(prefixes, at[rest - 1] + 1, at[rest])
        # What later tuples of each bucket have to count from here on.
        np.minimum(self.least, suffix_least[0], out=self.least)
        tails = at[np.append(heads[1:], len(at)) - 1]
        after = np.append(suffix_least, self.cap)[tails + 1]
        self.least[symbol[heads]] = after
        own = np.minimum(value + 1, self.cap).astype(np.int32)
        for a, b in zip(heads, np.append(heads[1:], len(at)), strict=True):
            self.queue.push(int(symbol[a]), positions[at[a:b]], own[a:b])


def range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last], both included, by a sparse table built as far as needed."""
    out = np.empty(len(first), values.dtype)
    length = last - first + 1
    level, step = values, 1
    left = np.arange(len(first))
    while len(left):
        done = length[left] < 2 * step
        own = left[done]
        out[own] = np.minimum(level[first[own]], level[last[own] - step + 1])
        left = left[~done]
        if len(left):
            level = np.minimum(level[:-step], level[step:])
            step *= 2
    return out


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last suffix counts as L but for a lone end."""
    n = len(text)
    rising = np.zeros(n, bool)
    change = np.flatnonzero(text[:-1] != text[1:])
    if len(change):
        to = np.searchsorted(change, np.arange(n))
        known = to < len(change)
        at = change[to[known]]
        rising[np.flatnonzero(known)] = text[at] < text[at + 1]
    return rising


def equal_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix lengths of suffix pairs, up to cap."""
    out = np.zeros(len(a), np.int32)
    active = np.arange(len(a))
    n, step = len(text), 16
    offsets = np.arange(step)
    for done in range(0, cap, step):
        if not len(active):
            break
        x, y = a[active, None] + done + offsets, b[active, None] + done + offsets
        same = (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)]) & (x < n) & (y < n)
        length = np.where(same.all(axis=1), step, same.argmin(axis=1))
        out[active] += length.astype(np.int32)
        active = active[length == step]
    return np.minimum(out, cap)


def doubling_sort(text: np.ndarray) -> np.ndarray:
    """Suffix array in memory by prefix doubling; a suffix that ends first is smaller."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(n - step, 0)] = rank[step:]
        key = rank * (n + 2) + second
        order = np.argsort(key)
        ordered = key[order]
        new = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n:
            return order
        step *= 2


def name_substrings(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Ranks of the S* substrings; equal substrings get equal ranks."""
    # The last one ends with an end symbol that is smaller than all.
    length = np.append(stars[1:], len(text)) - stars + 1
    rank = np.zeros(len(stars), np.int64)
    width = 3
    pad = np.int64(text.max()) + 2
    text = np.append(text.astype(np.int64) + 1, 0)
    active = np.arange(len(stars))
    done = 0
    while len(active):
        key = np.zeros(len(active), np.int64)
        for k in range(width):
            at = stars[active] + done + k
            # Past its end a substring is larger than one that goes on (there the other's type is L).
            symbol = np.where(done + k < length[active], text[np.minimum(at, len(text) - 1)], pad)
            key = key * (pad + 1) + symbol
        order = np.lexsort((key, rank[active]))
        a, r = active[order], rank[active][order]
        k = key[order]
        new_group = np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])
        group_start = np.concatenate([[True], r[1:] != r[:-1]])
        # Ranks keep gaps: a group's rank is the count of substrings in smaller groups.
        within = np.arange(len(a)) - np.maximum.accumulate(np.where(group_start, np.arange(len(a)), 0))
        rank[a] = r + _starts(within, new_group)
        done += width
        heads = np.flatnonzero(new_group)
        sizes = np.diff(np.append(heads, len(a)))
        # A group stays if one of its substrings goes on; those that have ended are then its largest.
        goes_on = np.maximum.reduceat(length[a], heads) > done
        active = a[np.repeat((sizes > 1) & goes_on, sizes)]
    return rank


def _starts(within: np.ndarray, new_group: np.ndarray) -> np.ndarray:
    """For each row the value of ``within`` at the beginning of its group."""
    heads = np.flatnonzero(new_group)
    return np.repeat(within[heads], np.diff(np.append(heads, len(within))))


def induced_sort(text: np.ndarray, cap: int, memory_items: int = MEMORY_ITEMS, base_length: int = BASE_LENGTH, prefixes: bool = True):
    """(suffix array, common prefix with the suffix before, capped) of a non-negative integer array."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    symbols, dense = np.unique(text, return_inverse=True)
    dense = dense.astype(np.int64 if len(symbols) > 65535 else np.uint16 if len(symbols) > 255 else np.uint8)
    rising = suffix_types(dense)
    star = np.zeros(n, bool)
    star[1:] = rising[1:] & ~rising[:-1]
    stars = np.flatnonzero(star)
    if len(stars):
        names = name_substrings(dense, stars)
        if len(np.unique(names)) == len(names):
            star_order = np.argsort(names)
        elif len(names) <= base_length:
            star_order = doubling_sort(names)
        else:
            star_order = induced_sort(names, cap, memory_items, base_length, prefixes=False)[0]
        stars = stars[star_order]
    star_prefix = np.zeros(len(stars), np.int32)
    if len(stars) > 1 and prefixes:
        star_prefix[1:] = equal_prefix(dense, stars[:-1], stars[1:], cap)
    return _induce(dense, len(symbols), rising, stars, star_prefix, cap, memory_items)


def _run_lengths(text: np.ndarray) -> np.ndarray:
    """Equal symbols from each position on."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[:-1] != text[1:]), n - 1)
    length = np.diff(ends, prepend=-1)
    return np.repeat(ends, length) - np.arange(n) + 1


def _induce(text, symbols, rising, stars, star_prefix, cap, memory_items):
    n = len(text)
    run = _run_lengths(text)
    star_cuts = np.searchsorted(text[stars], np.arange(symbols + 1)) if len(stars) else np.zeros(symbols + 1, np.int64)

    def meet(a: int, b: int) -> int:
        """Common prefix of the last L and the first S suffix of a bucket."""
        return min(int(run[a]), int(run[b]), cap)

    lower: list = []
    scan = _Scan(symbols, cap, memory_items)
    for c in range(symbols):
        batch, prefix = scan.queue.pop(c)
        if c == text[n - 1]:
            # The last suffix is shorter than every other one with its symbol.
            batch, prefix = np.append(np.int64(n - 1), batch), np.append(np.int32(0), prefix)
            if len(prefix) > 1:
                prefix[1] = min(1, cap)
        if len(prefix):
            prefix = prefix.copy()
            prefix[0] = 0
        held, held_prefix = [], []
        while len(batch):
            held.append(batch)
            held_prefix.append(prefix)
            before = batch - 1
            real = before >= 0
            target = text[np.maximum(before, 0)].astype(np.int64)
            scan.feed(prefix, target, before, real & (target >= c))
            batch, prefix = scan.queue.pop(c)
        own = np.concatenate(held) if held else np.zeros(0, np.int64)
        own_prefix = np.concatenate(held_prefix) if held else np.zeros(0, np.int32)
        lower.append((own, own_prefix))
        s = stars[star_cuts[c] : star_cuts[c + 1]]
        if len(s):
            p = star_prefix[star_cuts[c] : star_cuts[c + 1]].copy()
            p[0] = meet(own[-1], s[0]) if len(own) else 0
            scan.feed(p, text[s - 1].astype(np.int64), s - 1, np.ones(len(s), bool))
    order, values = [None] * symbols, [None] * symbols
    scan = _Scan(symbols, cap, memory_items)
    for c in range(symbols - 1, -1, -1):
        batch, prefix = scan.queue.pop(c)
        own, own_prefix = lower[c]
        if len(prefix):
            prefix = prefix.copy()
            prefix[0] = 0
        held, held_prefix = [], []
        while len(batch):
            held.append(batch)
            held_prefix.append(prefix)
            before = batch - 1
            target = text[np.maximum(before, 0)].astype(np.int64)
            scan.feed(prefix, target, before, (before >= 0) & (target <= c))
            batch, prefix = scan.queue.pop(c)
        upper = np.concatenate(held) if held else np.zeros(0, np.int64)
        upper_prefix = np.concatenate(held_prefix) if held else np.zeros(0, np.int32)
        if len(own):
            # Downwards, an L suffix's value is that of the pair (it, the one above it).
            down = np.append(own_prefix[1:][::-1], 0).astype(np.int32)
            down = np.concatenate([[meet(own[-1], upper[-1]) if len(upper) else 0], down[:-1]]).astype(np.int32)
            backwards = own[::-1]
            before = backwards - 1
            target = text[np.maximum(before, 0)].astype(np.int64)
            scan.feed(down, target, before, (before >= 0) & (target < c))
        # Values belong to the pair with the suffix before in ascending order.
        ascending = upper[::-1]
        up = np.zeros(len(upper), np.int32)
        if len(upper):
            up[1:] = upper_prefix[1:][::-1]
            up[0] = meet(own[-1], ascending[0]) if len(own) else 0
        order[c] = np.concatenate([own, ascending])
        values[c] = np.concatenate([own_prefix, up]).astype(np.int32)
    return np.concatenate(order), np.concatenate(values)
