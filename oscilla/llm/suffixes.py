"""External suffix sorting by recursive induction, with common prefixes carried along, for shards larger than memory.

Suffixes are of type S (smaller than the next one) or L. The leftmost S suffixes of each run, the stars,
are sorted by the pieces from one star to the next, dealt by letters and sorted run by run, named, and the names
sorted in recursion where they are not unique, until there are no more of them than half the entries that a queue keeps
in memory: those are sorted there, by doubling. Two scans then induce all others, each driven by a monotone priority queue of tuples (key,
position, common prefix): taken in order, a suffix puts the one before it into the queue under that one's
first character. Entries of equal key leave in the order they came.

Common prefixes ride in the tuples: two suffixes that follow one another into one bucket share one character
more than the two that induced them, and those share the least common prefix of all that the scan took between
them. ``_History`` answers that for any stretch of the scan. Seeds get theirs from the recursion, names counted
in bytes, and only where a scan passes from one kind of suffix to the other within a bucket are characters
compared. Prefixes count up to a cap: suffixes that share that many are in any order, and no piece is compared
further.

Text, types, stars, names, orders, prefixes and the scans' histories are files mapped into memory, which the
system writes out as it needs, but for the first ``MEMORY`` bytes of them; the queues keep ``limit`` entries in memory and the rest in files. Everything is
done ``BATCH`` entries at a time: a scan takes the longest run of entries before which nothing that they induce
can come.
"""

from __future__ import annotations

import os
import tempfile
import weakref
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np

#: Entries of a queue in memory before its largest buckets go to disk.
QUEUE_ENTRIES = 1 << 21
#: Bytes of a shard's arrays that are in memory.
MEMORY = 96 << 20
#: What a block of entries takes besides them, in entries.
BLOCK = 40
#: Entries that are handled at a time.
BATCH = 1 << 15
#: Entries of a bucket of several letters, which is sorted in memory.
BUCKET = 1 << 13
_NEVER, _END = -2, -1
_MOST = np.int32((1 << 31) - 1)
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def scratch_file():
    """An unnamed file in one of the executor's own folders, or in the default folder outside of Spark's tasks."""
    folders = [f for f in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(f)]
    return tempfile.TemporaryFile(dir=folders[os.getpid() % len(folders)] if folders else None)


class Disk:
    """Arrays in unnamed files, which go with their last user; the first ``memory`` bytes at a time are no files."""

    def __init__(self, memory: int = 0) -> None:
        self.memory = memory

    def _given_back(self, size: int) -> None:
        self.memory += size

    def array(self, kind: type, size: int) -> np.ndarray:
        if not size:
            return np.zeros(0, kind)
        if (taken := size * np.dtype(kind).itemsize) <= self.memory:
            out = np.zeros(size, kind)
            self.memory -= taken
            weakref.finalize(out, self._given_back, taken)
            return out
        with scratch_file() as file:
            file.truncate(size * np.dtype(kind).itemsize)
            return np.memmap(file, kind, "r+", shape=(size,)).view(np.ndarray)


def _ranges(size: int, step: int | None = None) -> Iterator[tuple[int, int]]:
    step = step or BATCH
    for low in range(0, size, step):
        yield low, min(size, low + step)


class DiskQueue:
    """A monotone priority queue of (key, position, common prefix), first in first out for each key.

    Letters are dealt to buckets; a key is twice a letter, or one more for the entries of ``side``, a sorted stream
    that is merged in. A bucket of one letter is read block by block, one of several letters is sorted when its
    turn comes. ``first`` has the first letter of each bucket.
    """

    def __init__(self, first: np.ndarray, letters: int, side: Callable[[int, int], Entries], n_side: int, limit: int) -> None:
        self.bounds = 2 * np.append(first, letters).astype(np.int64)
        self.firsts = self.bounds.tolist()
        self.blocks: list[list] = [[] for _ in first]
        self.counts = np.zeros(len(first), np.int64)
        self.single = np.diff(self.bounds) == 2
        self.limit, self.held, self.peak = limit, 0, 0
        self.file = None
        self.side, self.n_side, self.at_side = side, n_side, 0
        self.bucket, self.fresh = 0, True
        self.ready: Entries = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int16))

    def put(self, keys: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Entries sorted by key, none of them before what was taken last."""
        if len(keys) == 1:
            self._put(bisect_right(self.firsts, int(keys[0])) - 1, (keys, positions, prefixes))
            return
        into = np.searchsorted(self.bounds, keys, "right") - 1
        cuts = np.flatnonzero(into[1:] != into[:-1]) + 1
        starts = [0, *cuts.tolist()]
        for start, end in zip(starts, [*starts[1:], len(keys)]):
            # copies, so that what has gone to disk is not kept alive by its neighbours
            self._put(int(into[start]), (keys[start:end].copy(), positions[start:end].copy(), prefixes[start:end].copy()))

    def _put(self, bucket: int, block: Entries) -> None:
        if bucket == self.bucket and not self.fresh and not self.single[bucket]:
            self.ready = self._sorted([self.ready, block]) if len(self.ready[0]) else block
            return
        self.blocks[bucket].append(block)
        self.counts[bucket] += len(block[0]) + BLOCK
        self.held += len(block[0]) + BLOCK
        self.peak = max(self.peak, self.held)
        if self.held > self.limit:
            self._spill()

    @staticmethod
    def _sorted(blocks: list[Entries]) -> Entries:
        keys, positions, prefixes = (np.concatenate([b[k] for b in blocks]) for k in range(3))
        order = np.argsort(keys, kind="stable")
        return keys[order], positions[order], prefixes[order]

    def _spill(self) -> None:
        """Write the entries of the fullest buckets to disk until half the limit is free."""
        self.file = self.file or scratch_file()
        while self.held > self.limit // 2:
            bucket = int(self.counts.argmax())
            kept = []
            run: list[Entries] = []
            for block in [*self.blocks[bucket], None]:
                if block is not None and len(block) == 3:
                    run.append(block)
                    continue
                if run:
                    self.file.seek(0, 2)
                    kept.append((self.file.tell(), sum(len(b[0]) for b in run)))
                    for k in range(3):
                        for b in run:
                            self.file.write(b[k].tobytes())
                    run = []
                if block is not None:
                    kept.append(block)
            self.blocks[bucket] = kept
            self.held -= int(self.counts[bucket])
            self.counts[bucket] = 0

    def _read(self, block: tuple) -> Entries:
        if len(block) == 3:
            self.held -= len(block[0]) + BLOCK
            self.counts[self.bucket] -= len(block[0]) + BLOCK
            return block
        self.file.seek(block[0])
        return tuple(np.frombuffer(self.file.read(size * block[1]), kind) for size, kind in ((4, np.int32), (4, np.int32), (2, np.int16)))

    def _from_side(self, most: int) -> Entries | None:
        """The next entries of the side stream in this bucket."""
        if self.at_side >= self.n_side:
            return None
        part = self.side(self.at_side, min(self.n_side, self.at_side + most))
        own = int(np.searchsorted(part[0], self.bounds[self.bucket + 1]))
        self.at_side += own
        return tuple(x[:own] for x in part) if own else None

    def next(self, most: int) -> Entries | None:
        """The first entries, at most so many; they stay until ``drop``."""
        while not len(self.ready[0]):
            waiting, single = self.blocks[self.bucket], self.single[self.bucket]
            if waiting and single:
                parts, size = [], 0
                while waiting and size < most:
                    parts.append(self._read(waiting.pop(0)))
                    size += len(parts[-1][0])
                self.ready = parts[0] if len(parts) == 1 else tuple(np.concatenate([p[k] for p in parts]) for k in range(3))
            elif self.fresh and not single:
                all_ = [self._read(b) for b in waiting]
                waiting.clear()
                while (part := self._from_side(most)) is not None:
                    all_.append(part)
                if all_:
                    self.ready = self._sorted(all_)
            elif single and (part := self._from_side(most)) is not None:
                self.ready = part
            else:
                self.bucket, self.fresh = self.bucket + 1, True
                if self.bucket == len(self.blocks):
                    return None
                continue
            self.fresh = False
        return tuple(x[:most] for x in self.ready)

    def drop(self, count: int) -> None:
        self.ready = tuple(x[count:] for x in self.ready)


class _History:
    """The common prefixes that a scan has met, and the least of any stretch of them that ends in the newest batch."""

    def __init__(self, size: int, disk: Disk) -> None:
        self.after = disk.array(np.int16, size)  # the least of what follows an entry in its batch
        self.begins = np.zeros(1024, np.int64)
        self.table = np.zeros((1, 1024), np.int16)  # row k: the least of the 2^k batches that end with one
        self.batches = self.size = 0

    def least(self, values: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For entries ``at`` of a new batch of ``values``: the least value since the last use of their letter.

        ``at`` is sorted by letter, ``first`` marks the first use of a letter in this batch and ``last`` has the place in
        the scan of its last use before it. Letters never used give -1.
        """
        out = np.empty(len(at), np.int16)
        again = (~first).nonzero()[0]
        if len(again):
            out[again] = self._within(values, at[again - 1] + 1, at[again])
        new = first.nonzero()[0]
        since = last[new]
        found = np.minimum.accumulate(values)[at[new]]
        known = (since >= 0).nonzero()[0]
        if len(known):
            when = since[known]
            batch = np.searchsorted(self.begins[: self.batches], when, "right") - 1
            best = np.minimum(found[known], self.after[when])
            between = (batch + 1 < self.batches).nonzero()[0]
            if len(between):
                low, high = batch[between] + 1, self.batches - 1
                k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
                best[between] = np.minimum(best[between], np.minimum(self.table[k, high], self.table[k, low + (1 << k) - 1]))
            found[known] = best
        found[since == _END] = 0  # nothing is shared with what comes before the first entry
        found[since == _NEVER] = -1
        out[new] = found
        return out

    @staticmethod
    def _within(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int16)
        level = values
        for step in range(int(k.max()) + 1):
            at = np.flatnonzero(k == step)
            out[at] = np.minimum(level[low[at]], level[high[at] - (1 << step) + 1])
            level = np.minimum(level[: -(1 << step)], level[1 << step :]) if len(level) > 1 << step else level[:0]
        return out

    def add(self, values: np.ndarray) -> None:
        begin, b = self.size, self.batches
        behind = np.minimum.accumulate(values[::-1])[::-1]
        self.after[begin : begin + len(values) - 1] = behind[1:]
        self.after[begin + len(values) - 1] = np.iinfo(np.int16).max
        if b == len(self.begins):
            self.begins = np.append(self.begins, np.zeros(b, np.int64))
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], 1)
        if b + 1 >= 1 << len(self.table):
            self.table = np.concatenate([self.table, np.zeros((1, self.table.shape[1]), np.int16)])
        self.begins[b], self.table[0, b] = begin, behind[0]
        k = 1
        while (1 << k) <= b + 1:
            self.table[k, b] = min(self.table[k - 1, b], self.table[k - 1, b - (1 << (k - 1))])
            k += 1
        self.batches, self.size = b + 1, begin + len(values)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, known: np.ndarray | None = None) -> np.ndarray:
    """Characters that the suffixes at ``a`` and ``b`` share, up to ``cap``; they share ``known`` at least."""
    out = np.zeros(len(a), np.int64) if known is None else np.minimum(known, cap).astype(np.int64)
    live = np.flatnonzero(out < cap)
    while len(live):
        i, j = a[live] + out[live], b[live] + out[live]
        inside = np.maximum(i, j) < len(text)
        live = live[inside]
        live = live[text[i[inside]] == text[j[inside]]]
        out[live] += 1
        live = live[out[live] < cap]
    return out.astype(np.int16)


def _types(text: np.ndarray, disk: Disk) -> np.ndarray:
    """True where a suffix is of type S; the last one is L, as nothing follows it."""
    n = len(text)
    out = disk.array(bool, n)
    following = False
    for high in range(n, 0, -BATCH):
        low = max(0, high - BATCH)
        here = np.asarray(text[low : min(n, high + 1)]).astype(np.int64)
        rises = np.sign(np.diff(here)) if high < n else np.append(np.sign(np.diff(here)), -1)
        at = np.where(rises != 0, np.arange(len(rises)), len(rises))
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        out[low:high] = np.append(rises > 0, following)[nearest]
        following = bool(out[low])
    return out


def _stars(kind: np.ndarray, disk: Disk) -> np.ndarray:
    """Positions of S suffixes that follow an L suffix."""
    def found(low: int, high: int) -> np.ndarray:
        return low + 1 + np.flatnonzero(kind[low + 1 : high + 1] & ~kind[low : min(high, len(kind) - 1)])

    out = disk.array(np.int32, sum(len(found(low, high)) for low, high in _ranges(len(kind))))
    at = 0
    for low, high in _ranges(len(kind)):
        part = found(low, high)
        out[at : at + len(part)] = part
        at += len(part)
    return out


def _first_letters(text: np.ndarray, letters: int, limit: int, disk: Disk) -> np.ndarray:
    """First letters of buckets of about ``BUCKET`` entries each; a more frequent letter has its own."""
    if letters <= 512:
        return np.arange(letters)
    counts = disk.array(np.int32, letters)
    for low, high in _ranges(len(text)):
        found, times = np.unique(text[low:high], return_counts=True)
        counts[found] += times.astype(np.int32)
    # no more buckets than can hold several blocks each within the limit
    size = max(1, min(max(BUCKET, 8 * BLOCK * len(text) // limit), limit // 4))
    first, total = [np.zeros(1, np.int64)], 0
    for low, high in _ranges(letters):
        own = np.asarray(counts[low:high], np.int64)
        upto = total + np.cumsum(own)
        begins = np.flatnonzero(upto // size != (upto - own) // size) + low + 1  # the next one starts a bucket
        hot = np.flatnonzero(own >= size) + low
        first += [begins, hot]
        total = int(upto[-1])
    bounds = np.unique(np.concatenate(first))
    return bounds[bounds < letters]


def _scan(text: np.ndarray, kind: np.ndarray, wanted: bool, letters: int, side: Callable[[int, int], Entries], n_side: int, cap: int, first: np.ndarray, limit: int, disk: Disk) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Induce the suffixes of type ``wanted``: batches (from side, position, common prefix with the one before), in order.

    L suffixes come in ascending order of letters, from the stars in ``side``; S suffixes in descending order, from
    the L suffixes there.
    """
    n, top = len(text), letters - 1
    queue = DiskQueue(np.sort(top + 1 - np.append(first[1:], letters)) if wanted else first, letters, side, n_side, limit)
    last = disk.array(np.int32, letters)
    last[:] = _NEVER
    history = _History(n, disk)
    if not wanted:  # the last suffix has none after it to induce it
        queue.put(np.array([2 * int(text[-1])], np.int32), np.array([n - 1], np.int32), np.zeros(1, np.int16))
        last[int(text[-1])] = _END
    before_key, before = -2, 0
    taken = 0
    while (entries := queue.next(BATCH)) is not None:
        keys, at, prefixes = entries
        previous = np.maximum(at - 1, 0)
        letter = text[previous].astype(np.int32)
        pushed = 2 * (top - letter) if wanted else 2 * letter
        induces = (at > 0) & (kind[previous] == wanted)
        early = np.minimum.accumulate(np.where(induces, pushed, _MOST))
        # keys rise and early falls: the first key beyond what was induced before it ends the run
        late = keys[1:] > early[:-1]
        count = len(keys)
        if late.size and late[-1]:
            count = int(late.argmax()) + 1
        queue.drop(count)
        keys, at = keys[:count], at[:count]
        step = np.empty(count, np.int32)
        step[0] = keys[0] - before_key
        np.subtract(keys[1:], keys[:-1], out=step[1:])
        values = np.where(step == 0, prefixes[:count], np.int16(0))
        # from an even key to the odd one of the same letter
        meet = ((step == 1) & (keys & 1 == 1)).nonzero()[0]
        if len(meet):
            behind = np.where(meet > 0, at[meet - 1], before)
            values[meet] = common_prefixes(text, at[meet].astype(np.int64), behind.astype(np.int64), cap)
        yield (keys & 1).astype(bool), at, values
        use = induces[:count].nonzero()[0]
        if len(use):
            use = use[pushed[use].argsort(kind="stable")]
            key, own = pushed[use], letter[use]
            new = np.ones(len(use) + 1, bool)
            np.not_equal(key[1:], key[:-1], out=new[1:-1])
            shared = np.minimum(history.least(values, use, new[:-1], last[own]) + np.int16(1), np.int16(cap))
            end = new[1:]
            last[own[end]] = taken + use[end]
            queue.put(key, at[use] - np.int32(1), shared)
        history.add(values)
        before_key, before = int(keys[-1]), int(at[-1])
        taken += count


def _induced(text: np.ndarray, kind: np.ndarray, letters: int, seeds: np.ndarray, seed_prefixes: np.ndarray, cap: int, limit: int, disk: Disk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from sorted stars: batches (position, common prefix with the one before), in descending order."""
    n, top = len(text), letters - 1
    first = _first_letters(text, letters, limit, disk)

    def stars(low: int, high: int) -> Entries:
        at = np.asarray(seeds[low:high])
        return 2 * text[at].astype(np.int32) + 1, at, np.asarray(seed_prefixes[low:high])

    larger, larger_prefixes = disk.array(np.int32, n), disk.array(np.int16, n + 1)
    count = 0
    for from_side, at, prefixes in _scan(text, kind, False, letters, stars, len(seeds), cap, first, limit, disk):
        own = np.flatnonzero(~from_side)
        larger[count : count + len(own)], larger_prefixes[count : count + len(own)] = at[own], prefixes[own]
        count += len(own)

    def reversed_larger(low: int, high: int) -> Entries:
        at = np.asarray(larger[count - high : count - low][::-1])
        # its common prefix with the next larger one
        return 2 * (top - text[at].astype(np.int32)) + 1, at, np.asarray(larger_prefixes[count - high + 1 : count - low + 1][::-1])

    for _, at, prefixes in _scan(text, kind, True, letters, reversed_larger, count, cap, first, limit, disk):
        yield at, prefixes


def _sorted_pieces(text: np.ndarray, stars: np.ndarray, letters: int, cap: int, disk: Disk) -> tuple[np.ndarray, np.ndarray, int]:
    """Stars by the pieces from each to the next, names of the pieces in that order, and the number of names.

    Stars are dealt by their first letters to runs, the largest runs by their third, and a run is sorted in memory by as many letters at a time as fit in
    63 bits, until pieces differ or end or ``cap`` letters are equal. Beyond its end a piece is larger than any letter, as
    the suffix that goes on there is of type L; the end of the text is smaller.
    """
    m, n, base = len(stars), len(text), letters + 2
    names, name = disk.array(np.int32, m), -1
    pairs = letters <= 512

    def first(at: np.ndarray) -> np.ndarray:
        letter = text[at].astype(np.int64)
        return letter * letters + text[at + 1] if pairs else letter  # a star is never the last position

    def third(at: np.ndarray) -> np.ndarray:  # every piece but the last, which ends with the text, has three letters
        return np.where(at + 2 < n, text[np.minimum(at + 2, n - 1)].astype(np.int64) + 1, 0)

    order = _dealt(stars, first, letters * letters if pairs else letters, disk)

    def runs() -> Iterator[tuple[int, int]]:
        for low, high in _runs(order, first, 0, m):
            if pairs and high - low > BATCH:
                order[low:high] = _dealt(order[low:high], third, letters + 1, disk)
                yield from _runs(order, third, low, high)
            else:
                yield low, high

    width = max(1, int(63 / np.log2(base)))

    def keys(at: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
        key = np.zeros(len(at), np.int64)
        for k in range(depth, depth + width):
            place = at + k
            letter = text[np.minimum(place, n - 1)].astype(np.int64) + 1
            letter[place >= n] = 0
            key *= base
            key += np.where(k < size, letter, base - 1)
        return key

    for low, high in runs():
        at = order[low:high].astype(np.int64)
        rank = np.searchsorted(stars, order[low:high])
        size = np.minimum(np.where(rank + 1 < m, stars[np.minimum(rank + 1, m - 1)] - at + 1, n - at + 1), cap + 1)
        by = np.arange(len(at))
        group = np.zeros(len(at), np.int64)
        live, depth = np.arange(len(at)), 0
        while len(live):
            # ``live`` are places in the order whose groups are not told apart yet
            key = keys(at[by[live]], size[by[live]], depth)
            own = group[live]
            sub = np.lexsort((key, own))
            by[live] = by[live[sub]]
            key, own = key[sub], own[sub]
            new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
            begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            group[live] = live[begin]
            depth += width
            tied = ~new | np.append(~new[1:], False)
            # one that ends just here is larger than those that go on, which the next letters tell
            live = live[tied & (size[by[live]] >= depth)]
        order[low:high] = at[by]
        fresh = np.append(True, group[1:] != group[:-1])
        names[low:high] = name + np.cumsum(fresh)
        name += int(fresh.sum())
    return order, names, name + 1


def doubled_suffixes(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``sorted_suffixes`` returns, in memory: ranks by twice as many characters in each round.

    Common prefixes are put together from the ranks of all rounds, the longest first.
    """
    n, width = len(text), 1
    ranks = [np.unique(text, return_inverse=True)[1].astype(np.int32) + np.int32(1)]
    while width < cap and int(ranks[-1].max()) < n:
        key = ranks[-1].astype(np.int64) * (n + 1)
        key[: max(0, n - width)] += ranks[-1][width:]  # beyond the end is smaller than any character
        by = np.argsort(key)
        key = key[by]
        own = np.empty(n, np.int32)
        own[by] = np.cumsum(np.append(True, key[1:] != key[:-1]))
        ranks.append(own)
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    shared = np.zeros(n, np.int64)
    a, b = order[1:], order[:-1]
    for k in range(len(ranks) - 1, -1, -1):
        i, j = a + shared[1:], b + shared[1:]
        inside = np.maximum(i, j) < n
        shared[1:] += (inside & (ranks[k][np.minimum(i, n - 1)] == ranks[k][np.minimum(j, n - 1)])).astype(np.int64) << k
    return order.astype(np.int32), np.minimum(shared, cap).astype(np.int16)


def sorted_suffixes(text: np.ndarray, letters: int, cap: int, limit: int | None = None, disk: Disk | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, prefixes) of a text of numbers below ``letters``: positions by their suffixes, and what each shares with the one before.

    Suffixes are ordered by their first ``cap`` characters, and prefixes counted up to so many.
    """
    limit, disk = limit or QUEUE_ENTRIES, disk or Disk()
    n = len(text)
    order, prefixes = disk.array(np.int32, n), disk.array(np.int16, n + 1)
    kind = _types(text, disk)
    seeds = stars = _stars(kind, disk)
    m = len(stars)
    seed_prefixes = disk.array(np.int16, m)
    if m > 1:
        pieces, named, count = _sorted_pieces(text, stars, letters, cap, disk)
        if count < m:
            names = disk.array(np.int32, m)
            for low, high in _ranges(m):
                names[np.searchsorted(stars, pieces[low:high])] = named[low:high]
            # a piece has two characters of its own at least
            ranks, shared = doubled_suffixes(names, cap // 2 + 1) if m <= limit // 2 else sorted_suffixes(names, count, cap // 2 + 1, limit, disk)
        seeds = pieces if count == m else disk.array(np.int32, m)
        for low, high in _ranges(m):
            if count < m:
                seeds[low:high] = stars[ranks[low:high]]
            a = seeds[max(low, 1) : high].astype(np.int64)
            b = seeds[max(low, 1) - 1 : high - 1].astype(np.int64)
            known = None
            if count < m:  # names shared, in characters
                upto = ranks[max(low, 1) : high].astype(np.int64) + shared[max(low, 1) : high]
                known = np.where(upto < m, stars[np.minimum(upto, m - 1)], n) - a
            seed_prefixes[max(low, 1) : high] = common_prefixes(text, a, b, cap, known)
    at = n
    for positions, values in _induced(text, kind, letters, seeds, seed_prefixes, cap, limit, disk):
        order[at - len(positions) : at] = positions[::-1]
        prefixes[at - len(positions) + 1 : at + 1] = values[::-1]
        at -= len(positions)
    prefixes[0] = 0
    return order, prefixes[:n]


Keys = Callable[[np.ndarray], np.ndarray]


def _dealt(items: np.ndarray, key_of: Keys, keys: int, disk: Disk) -> np.ndarray:
    """Positions sorted by a key below ``keys``, a batch at a time by counting."""
    out = disk.array(np.int32, len(items))
    begin = disk.array(np.int32, keys + 1)
    for low, high in _ranges(len(items)):
        found, times = np.unique(key_of(items[low:high]), return_counts=True)
        begin[found + 1] += times.astype(np.int32)
    total = 0
    for low, high in _ranges(keys + 1):
        upto = total + np.cumsum(begin[low:high])
        begin[low:high] = upto
        total = int(upto[-1])
    for low, high in _ranges(len(items)):
        own = np.asarray(items[low:high])
        key = key_of(own)
        order = np.argsort(key, kind="stable")
        own, key = own[order], key[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times = np.diff(np.append(new, len(own)))
        out[begin[key] + np.arange(len(own)) - np.repeat(new, times)] = own
        begin[key[new]] += times.astype(np.int32)
    return out


def _runs(items: np.ndarray, key_of: Keys, low: int, end: int) -> Iterator[tuple[int, int]]:
    """Ranges of dealt positions that keep equal keys together, of ``BATCH`` at most unless one key has more."""
    while low < end:
        high = min(end, low + BATCH)
        if high < end:  # up to where another key begins, before or, if there is none, behind
            keys = key_of(items[low : high + 1])
            left = int(np.searchsorted(keys, keys[-1]))
            if left:
                high = low + left
            else:
                while high < end and (more := int((key_of(items[high : min(end, high + BATCH)]) == keys[-1]).sum())):
                    high += more
        yield low, high
        low = high


def suffix_order(text: np.ndarray, limit: int | None = None, cap: int | None = None) -> np.ndarray:
    """The positions of a non-empty text of small non-negative integers, sorted by their suffixes."""
    return sorted_suffixes(text.astype(np.int32), int(text.max()) + 1, cap or len(text), limit)[0]


class Shard:
    """Strings, spooled to disk, in which windows of ``length`` bytes are looked for that occur twice or more."""

    def __init__(self, length: int, limit: int | None = None, memory: int = MEMORY) -> None:
        self.length, self.limit, self.disk = length, limit, Disk(memory)
        self.file = scratch_file()
        self.sizes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, raw: np.ndarray, offsets: np.ndarray, times: np.ndarray) -> None:
        """Further strings, one after the other in ``raw``; string k counts ``times[k]`` times."""
        sizes = np.diff(offsets)
        body = np.zeros(len(raw) + len(sizes), np.uint16)
        inside = np.ones(len(body), bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        body[inside] = raw
        body[inside] += 1
        self.file.write(body.tobytes())
        self.sizes.append(sizes)
        self.times.append(times)

    def repeats(self) -> Iterator[tuple[int, np.ndarray]]:
        """(string, whether each of its windows is repeated) of every string.

        The suffixes of all strings are sorted together; windows that share ``length`` bytes with their neighbour in
        that order are equal.
        """
        sizes, times = np.concatenate(self.sizes), np.concatenate(self.times)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        n = int(begin[-1])
        self.file.flush()
        text = np.memmap(self.file, np.uint16, "r", shape=(n,)).view(np.ndarray)
        order, prefixes = sorted_suffixes(text, 257, self.length, self.limit, self.disk)
        hit = self.disk.array(bool, n)
        for low, high in _ranges(n):
            at = order[low:high].astype(np.int64)
            shared = np.append(prefixes[low : min(n, high + 1)], [0] if high == n else []) >= self.length
            owner = np.searchsorted(begin, at, "right") - 1
            whole = at + self.length < begin[owner + 1]
            hit[at[whole & (shared[:-1] | shared[1:] | (times[owner] > 1))]] = True
        for k, size in enumerate(sizes.tolist()):
            yield k, np.asarray(hit[begin[k] : begin[k] + max(0, size - self.length + 1)])
