"""External induced sorting of suffixes, with common-prefix lengths.

The suffixes of a symbol string are sorted by induction: those that start at a left-most smaller
position (S*) are sorted first; scanning the order upwards gives the order of all larger-typed (L)
suffixes, scanning it downwards that of all smaller-typed (S) ones. What is still to be scanned
stands in a queue with one lane for each first symbol: inside a lane, tuples come in the order in
which they were induced, so the queue is a priority queue by (symbol, order). A tuple holds the
position and the common prefix with the tuple before it in the lane, which is one more than the
least common prefix over what was scanned between their sources.

Nothing is held whole beyond `memory` bytes. Lanes are buffers that go to an anonymous file once the
queue holds its share; text, types, S* positions, names and orders are mapped files once they are
larger than theirs; all passes over them go piece by piece, and the order leaves piece by piece, as
lanes close, from the largest suffix to the smallest. Such files are private to a task and vanish
with it.

The S* suffixes are sorted through the string of their substrings' names. While that string is
larger than memory, names come from an induction of their own, in which S* positions of one symbol
count as equal, so that substrings are equal if their common prefix has no end; the names are
written in two digits each and that string is sorted by this same procedure, recursively. Once the
names fit in memory, they are sorted there, by doubling ranks: the base case of the recursion.

All tuples of a piece of a lane are scanned at once, in numpy, so the steps number the pieces and
the symbols' longest repeats, not the suffixes.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

FAR = np.iinfo(np.int32).max
#: A common prefix without end, as that of equal star substrings; real ones are shorter.
ENDLESS = 1 << 30
MEMORY = 32 << 20
#: Bytes that sorting in memory takes for each name.
NAME_BYTES = 40
PAIR = np.dtype([("at", "<i4"), ("lcp", "<i4")])


def pairs(at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), PAIR)
    out["at"], out["lcp"] = at, lcp
    return out


class Disk:
    """Arrays of a task: in memory while small, else in anonymous mapped files."""

    def __init__(self, memory: int):
        self.memory = memory
        self.piece = max(memory // 256, 1024)
        self.mapped = self.spilled = 0

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if size <= self.memory // 4:
            return np.empty(n, dtype)
        with tempfile.TemporaryFile() as file:
            file.truncate(size)
            self.mapped += size
            return np.asarray(np.memmap(file, dtype, "r+", shape=(n,)))

    def cuts(self, n: int) -> list[tuple[int, int]]:
        return [(a, min(a + self.piece, n)) for a in range(0, n, self.piece)]


class LaneQueue:
    """Tuples (position, common prefix) in lanes by symbol; lanes spill to an anonymous file."""

    def __init__(self, lanes: int, disk: Disk):
        self.fresh: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, list[tuple[int, int]]] = {}
        self.held, self.disk = 0, disk
        self.file = None

    def push(self, lane: int, tuples: np.ndarray) -> None:
        """Tuples seen as one number each."""
        self.fresh.setdefault(lane, []).append(tuples)
        self.held += tuples.nbytes
        if self.held > self.disk.memory // 4:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        end = self.file.seek(0, 2)
        for lane, parts in self.fresh.items():
            whole = np.concatenate(parts)
            self.files.setdefault(lane, []).append((end, len(whole)))
            end += self.file.write(whole.data)
        self.fresh = {}
        self.disk.spilled += self.held
        self.held = 0

    def _read(self, at: int, n: int) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * PAIR.itemsize), PAIR)

    def _fresh(self, lane: int) -> np.ndarray:
        whole = np.concatenate(self.fresh.pop(lane))
        self.held -= whole.nbytes
        return whole.view(PAIR)

    def drain(self, lane: int) -> Iterator[np.ndarray]:
        """Pieces of a lane in order, with what is pushed meanwhile; the lane is empty then."""
        piece = self.disk.piece
        while True:
            if self.files.get(lane):
                at, n = self.files[lane].pop(0)
                take = min(n, piece)
                if n > take:
                    self.files[lane].insert(0, (at + take * PAIR.itemsize, n - take))
                yield self._read(at, take)
            elif lane in self.fresh:
                whole = self._fresh(lane)
                for a in range(0, len(whole), piece):
                    yield whole[a : a + piece]
            else:
                return

    def back(self, lane: int) -> Iterator[np.ndarray]:
        """Pieces of a lane from its end, each turned round; the lane is empty then."""
        piece = self.disk.piece
        if lane in self.fresh:
            whole = self._fresh(lane)[::-1]
            for a in range(0, len(whole), piece):
                yield whole[a : a + piece]
        for at, n in reversed(self.files.pop(lane, [])):
            for end in range(n, 0, -piece):
                begin = max(end - piece, 0)
                yield self._read(at + begin * PAIR.itemsize, end - begin)[::-1]


class RangeMin:
    """Least values over ranges (a, b] of one array."""

    def __init__(self, values: np.ndarray):
        n = self.n = len(values)
        levels = np.empty((n.bit_length(), n), values.dtype)
        levels[0] = values
        for k in range(1, len(levels)):
            half = 1 << (k - 1)
            np.minimum(levels[k - 1, :-half], levels[k - 1, half:], out=levels[k, :-half])
        self.flat = levels.ravel()

    def over(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """FAR where a range is empty."""
        some = b > a
        span = np.where(some, b - a, 1)
        level = np.frexp(span.astype(np.float64))[1].astype(np.int64) - 1
        row = level * self.n
        low = np.minimum(a + 1, self.n - 1)
        return np.where(some, np.minimum(self.flat[row + low], self.flat[row + b - (1 << level) + 1]), FAR)


class Scan:
    """One induction pass: hands tuples on to the lanes of the symbols before them."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, alphabet: int, disk: Disk):
        self.text, self.wanted = text, wanted
        self.queue = LaneQueue(alphabet, disk)
        self.least = np.full(alphabet, FAR, np.int32)

    def spread(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """Scan tuples in order; lcp is with the tuple scanned before."""
        if not len(at):
            return
        ok = np.flatnonzero(at > 0)
        ok = ok[self.wanted[at[ok] - 1]]
        lanes = np.asarray(self.text[at[ok] - 1])
        order = np.argsort(lanes, kind="stable")
        source, lanes = ok[order], lanes[order].astype(np.int64)
        self_least = int(lcp.min())
        if not len(source):
            np.minimum(self.least, self_least, out=self.least)
            return
        starts = np.flatnonzero(np.concatenate(([True], lanes[1:] != lanes[:-1])))
        ends = np.append(starts[1:], len(lanes))
        before = np.empty(len(source), np.int64)
        before[1:] = source[:-1]
        before[starts] = -1
        table = RangeMin(lcp)
        low = table.over(before, source)
        touched = lanes[starts]
        low[starts] = np.minimum(low[starts], self.least[touched])
        np.minimum(self.least, self_least, out=self.least)
        last = source[ends - 1]
        self.least[touched] = table.over(last, np.full(len(last), len(lcp) - 1))
        made = pairs(at[source] - 1, np.where(low == FAR, 0, np.minimum(low, ENDLESS) + 1)).view(np.int64)
        for lane, a, b in zip(touched.tolist(), starts, ends):
            self.queue.push(lane, made[a:b])


def types(text: np.ndarray, disk: Disk) -> np.ndarray:
    """Whether each suffix is S: smaller than the one that follows it."""
    n, carry = len(text), True
    out = disk.array(n, bool)
    for a, b in reversed(disk.cuts(n)):
        step = np.sign(np.diff(text[a : b + 1].astype(np.int64)))
        step = step if b < n else np.append(step, 0)
        size = b - a
        at = np.minimum.accumulate(np.where(step != 0, np.arange(size), size)[::-1])[::-1]
        out[a:b] = np.where(at < size, step[np.minimum(at, size - 1)] > 0, carry)
        carry = bool(out[a])
    return out


def run_length(text: np.ndarray, at: int) -> int:
    """How often the symbol there repeats from there."""
    symbol, n, width = text[at], 1, 64
    while True:
        part = text[at + n : at + n + width]
        other = np.flatnonzero(part != symbol)
        if len(other):
            return n + int(other[0])
        n += len(part)
        if len(part) < width:
            return n
        width *= 2


def star_positions(small: np.ndarray, disk: Disk) -> np.ndarray:
    """The S suffixes behind an L one, in text order."""
    n = len(small)
    count = sum(int((small[max(a, 1) : b] & ~small[max(a, 1) - 1 : b - 1]).sum()) for a, b in disk.cuts(n))
    if not count:
        return np.array([n - 1], np.int32)
    out, done = disk.array(count, np.int32), 0
    for a, b in disk.cuts(n):
        a = max(a, 1)
        found = np.flatnonzero(small[a:b] & ~small[a - 1 : b - 1]) + a
        out[done : done + len(found)] = found
        done += len(found)
    return out


def _names(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Names, from 0, of the substrings from each S* position to the next, in their order.

    A substring that is the start of another is the larger one, so the ends are padded high.
    """
    stops = np.append(stars[1:], len(text) - 1)
    sizes = stops - stars + 1
    high = int(text.max()) + 1
    bits = max(high.bit_length(), 1)
    width = max(62 // bits, 1)
    names = np.zeros(len(stars), np.int64)
    live = np.arange(len(stars))
    for offset in range(0, int(sizes.max()), width):
        key = np.zeros(len(live), np.int64)
        for i in range(offset, offset + width):
            inside = i < sizes[live]
            symbol = text[np.minimum(stars[live] + i, len(text) - 1)].astype(np.int64)
            key = (key << bits) | np.where(inside, symbol, high)
        order = np.lexsort((key, names[live]))
        a, k = names[live][order], key[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (k[1:] != k[:-1])))
        first = np.flatnonzero(new)
        members = np.diff(np.append(first, len(order)))
        base = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        parent = np.repeat(base, np.diff(np.append(base, len(order))))
        # Ranks stay apart by the number of members, so that refining one group moves no other.
        names[live[order]] = a + np.repeat(first, members) - parent
        live = live[order][np.repeat(members, members) > 1]
        live = live[sizes[live] > offset + width]
        if not len(live):
            break
    used = np.zeros(len(names) + 1, np.int64)
    used[names + 1] = 1
    return np.cumsum(used)[names]


def _regroup(rank: np.ndarray, live: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Ranks of live members refined by what follows them; returns those whose rank is shared yet.

    A rank is the number of members in smaller groups, so refining a group moves no other.
    """
    key = rank[live] * (int(follow.max()) + 1) + follow
    order = np.argsort(key)
    key = key[order]
    members = live[order]
    old = rank[members]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(key)))
    base = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
    parent = np.repeat(base, np.diff(np.append(base, len(key))))
    rank[members] = old + np.repeat(first, sizes) - parent
    return members[np.repeat(sizes, sizes) > 1]


def _doubling(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of a string of names, and the common prefixes in names, by doubling ranks."""
    m = len(names)
    rank, step = np.zeros(m, np.int64), 1
    live = _regroup(rank, np.arange(m), names)
    ranks = [rank.astype(np.int32)]
    while len(live):
        after = live + step
        follow = np.where(after < m, rank[np.minimum(after, m - 1)] + 1, 0)
        live = _regroup(rank, live, follow)
        ranks.append(rank.astype(np.int32))
        step *= 2
    order = np.empty(m, np.int64)
    order[rank] = np.arange(m)
    a, b = order[1:].copy(), order[:-1].copy()
    lcp = np.zeros(max(m - 1, 0), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        # Ranks of two suffixes are equal if as many names agree; a suffix that ends earlier differs.
        ok = np.flatnonzero((a < m) & (b < m))
        ok = ok[ranks[level][a[ok]] == ranks[level][b[ok]]]
        a[ok] += 1 << level
        b[ok] += 1 << level
        lcp[ok] += 1 << level
    return order, np.concatenate(([0], lcp))[:m]


def _in_memory(text: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the star suffixes, and common prefixes in names, while the names fit in memory."""
    return _doubling(_names(text, np.asarray(stars)))


def _between(stream: Iterator[np.ndarray], chosen) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Only chosen positions of a stream, with the common prefix with the chosen one before."""
    least = FAR
    for part in stream:
        at, lcp = part["at"], part["lcp"]
        keep = np.flatnonzero(chosen(at))
        if not len(keep):
            least = min(least, int(lcp.min()))
            continue
        low = np.minimum.reduceat(lcp[: keep[-1] + 1], np.concatenate(([0], keep[:-1] + 1)))
        low[0] = min(least, int(lcp[: keep[0] + 1].min()))
        rest = lcp[keep[-1] + 1 :]
        least = int(rest.min()) if len(rest) else FAR
        yield at[keep], low


def _by_induction(text: np.ndarray, small: np.ndarray, stars: np.ndarray, disk: Disk) -> tuple[np.ndarray, np.ndarray]:
    """The same, from names by induction and the names' string sorted by this procedure again."""
    m, n = len(stars), len(text)
    # Positions of one symbol count as equal here: all with an endless common prefix.
    lanes = np.concatenate(([0], np.cumsum(sum(
        np.bincount(text[stars[a:b]], minlength=int(text.max()) + 1) for a, b in disk.cuts(m)
    ))))
    dealt, fill = disk.array(m, np.int32), lanes.copy()
    for a, b in disk.cuts(m):
        symbols = np.asarray(text[stars[a:b]])
        order = np.argsort(symbols, kind="stable")
        counts = np.bincount(symbols, minlength=len(lanes) - 1)
        within = np.arange(b - a) - np.repeat(np.cumsum(counts) - counts, counts)
        dealt[fill[symbols[order]] + within] = stars[a:b][order]
        fill[:-1] += counts
    # From the largest substring down: a new name wherever the common prefix ends.
    is_star = disk.array(n, bool)
    for a, b in disk.cuts(n):
        is_star[a:b] = False
    for a, b in disk.cuts(m):
        is_star[stars[a:b]] = True
    name_at, name = disk.array(n, np.int32), 0
    for at, lcp in _between(_induce(text, small, dealt, None, disk), lambda at: is_star[at]):
        new = name + np.cumsum(lcp < ENDLESS)
        name_at[at], name = new, int(new[-1])
    base = int(np.ceil(np.sqrt(name + 2)))
    digits = disk.array(2 * m + 1, np.int32)
    for a, b in disk.cuts(m):
        # Counted downwards, so that a smaller substring has a smaller name.
        own = name - name_at[stars[a:b]]
        digits[2 * a : 2 * b : 2], digits[2 * a + 1 : 2 * b : 2] = own // base + 1, own % base + 1
    digits[2 * m] = 0
    del name_at, is_star, dealt
    order, shared, to = disk.array(m, np.int32), disk.array(m, np.int32), m
    stream = (part[part["at"] < 2 * m] if (part["at"] == 2 * m).any() else part for part in induced_order(digits, disk=disk))
    for at, lcp in _between((p for p in stream if len(p)), lambda at: at % 2 == 0):
        order[to - len(at) : to] = at[::-1] // 2
        # In the stream a common prefix is with the larger one before; here, with the smaller one before.
        values = np.minimum(lcp, ENDLESS)[::-1] // 2
        shared[to - len(at) + 1 : to + 1] = values if to < m else values[:-1]
        to -= len(at)
    shared[0] = 0
    return order, shared


def sort_stars(text: np.ndarray, small: np.ndarray, stars: np.ndarray, disk: Disk) -> tuple[np.ndarray, np.ndarray]:
    """S* positions in suffix order, each with the common prefix with the one before."""
    m, end = len(stars), len(text)
    if m * NAME_BYTES <= disk.memory or m < 4:
        order, shared = _in_memory(text, stars)
    else:
        order, shared = _by_induction(text, small, stars, disk)
    out_at, out_lcp = disk.array(m, np.int32), disk.array(m, np.int32)
    before = 0
    for a, b in disk.cuts(m):
        at = np.asarray(stars[order[a:b]])
        lcp = stars[np.minimum(order[a:b] + shared[a:b], m - 1)] - at
        ahead = np.concatenate(([before], at[:-1]))
        # The first name that differs still shares symbols.
        live = np.arange(0 if a else 1, b - a)
        while len(live):
            x, y = at[live] + lcp[live], ahead[live] + lcp[live]
            ok = (x < end) & (y < end)
            ok[ok] = text[x[ok]] == text[y[ok]]
            live = live[ok]
            lcp[live] += 1
        out_at[a:b], out_lcp[a:b], before = at, lcp, at[-1]
    out_lcp[0] = 0
    return out_at, out_lcp


def _induce(text: np.ndarray, small: np.ndarray, stars: np.ndarray, lcp: np.ndarray | None, disk: Disk) -> Iterator[np.ndarray]:
    """All suffixes from the largest down, from stars in order; without lcp, stars of a symbol are equal."""
    n, m = len(text), len(stars)
    alphabet = 1 + max(int(text[a:b].max()) for a, b in disk.cuts(n))
    bounds = np.concatenate(([0], np.cumsum(sum(np.bincount(text[stars[a:b]], minlength=alphabet) for a, b in disk.cuts(m)))))

    class Typed:
        """Positions of one type, looked up in place."""

        def __init__(self, of: bool):
            self.of = of

        def __getitem__(self, at: np.ndarray) -> np.ndarray:
            return small[at] if self.of else ~small[at]

    up, larger = Scan(text, Typed(False), alphabet, disk), LaneQueue(alphabet, disk)
    highest: dict[int, int] = {}
    for c in range(alphabet):
        last = None
        for batch in up.queue.drain(c):
            values = batch["lcp"].copy()
            if last is None:
                values[0] = 0
            up.spread(batch["at"], values)
            larger.push(c, pairs(batch["at"], values).view(np.int64))
            last = highest[c] = int(batch["at"][-1])
        for a in range(int(bounds[c]), int(bounds[c + 1]), disk.piece):
            part = np.asarray(stars[a : min(a + disk.piece, int(bounds[c + 1]))])
            values = np.full(len(part), ENDLESS, np.int32) if lcp is None else lcp[a : a + len(part)].copy()
            if a == bounds[c]:
                values[0] = 0 if last is None else min(run_length(text, last), run_length(text, int(part[0])))
            up.spread(part, values)
    down = Scan(text, Typed(True), alphabet, disk)
    for c in range(alphabet - 1, -1, -1):
        lowest = None
        for batch in down.queue.drain(c):
            values = batch["lcp"].copy()
            if lowest is None:
                values[0] = 0
            down.spread(batch["at"], values)
            lowest = int(batch["at"][-1])
            # Scanned downwards, a tuple's common prefix is with the next larger suffix.
            yield pairs(batch["at"], values)
        carry = 0
        if c in highest and lowest is not None:
            carry = min(run_length(text, highest[c]), run_length(text, lowest))
        for batch in larger.back(c):
            values = np.concatenate(([carry], batch["lcp"][:-1])).astype(np.int32)
            carry = int(batch["lcp"][-1])
            down.spread(batch["at"], values)
            yield pairs(batch["at"], values)
        if c == 0 and lowest is None:
            yield pairs(np.array([n - 1]), np.zeros(1, np.int32))


def induced_order(text: np.ndarray, memory: int = MEMORY, disk: Disk | None = None) -> Iterator[np.ndarray]:
    """The suffixes from the largest down, in pieces of (at, lcp); lcp is with the suffix before.

    The last symbol must be 0 and occur nowhere else.
    """
    if len(text) >= ENDLESS:
        raise ValueError("a shard has under 2**30 symbols")
    disk = disk or Disk(memory)
    small = types(text, disk)
    stars = star_positions(small, disk)
    at, lcp = sort_stars(text, small, stars, disk)
    del stars
    yield from _induce(text, small, at, lcp, disk)
