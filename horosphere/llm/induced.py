"""External induced sorting of suffixes, with their common prefixes.

A text of bytes, or of names in the recursion, lies in a file. A suffix is left-type if it is greater than the next one, else
right-type; a seed is a right-type suffix after a left-type one. Seeds' substrings, up to the next seed, are sorted and named;
where names repeat, the order of the seeds is that of the suffixes of the text of names, by recursion. From the seeds, in
their order, two sweeps induce all others: the first, over rising symbols, left-type suffixes, each pushed by the suffix that
begins one symbol later; the second, over falling symbols, right-type ones.

What waits is a tuple: first symbol, place, some symbols before it, and the common prefix with the tuple pushed before it under
the same symbol. That is one more than the least common prefix between the suffixes that pushed the two, so common prefixes are
carried from the recursion through both sweeps, and the text is read again only where a tuple has used up its symbols. Tuples
wait in a priority queue by symbol and arrival: lists, one for each range of symbols, of which MEMORY bytes stay in memory and
the rest goes to a scratch file. A range is taken from the queue at once, or, if it is of one symbol, some tuples at a time; what
a range's tuples push into the range itself is put in order by the order of those that pushed it.

Scratch files lie in Spark's own local folder of the executor, as its shuffles' do. They belong to one attempt at one task, have
no names, and end with it: another attempt makes its own.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Bytes of waiting tuples kept in memory; tuples taken at once; symbols read at once; greatest common prefix told from longer ones.
MEMORY, TAKEN, BLOCK, LONGEST = 4 << 20, 1 << 16, 1 << 20, 65535
TUPLE = np.dtype([("key", "<u4"), ("pos", "<u4"), ("before", "<u8"), ("left", "u1"), ("lcp", "<u2")])


def scratch_dir() -> str | None:
    given = os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS")
    return next((d for d in (given or "").split(",") if d and os.path.isdir(d)), None)


def scratch_file():
    return tempfile.TemporaryFile(dir=scratch_dir())


def stable_order(x: np.ndarray, limit: int) -> np.ndarray:
    """The stable order of numbers below limit: digits of 16 bits, for which NumPy counts instead of comparing."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16) if limit > 1 << 16 else x.astype(np.uint16), kind="stable")
    return order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")] if limit > 1 << 16 else order


class Queues:
    """First-in first-out lists of records; beyond a bound on memory they wait in a scratch file."""

    def __init__(self, lists: int, kind: np.dtype, memory: int = MEMORY):
        self.kind, self.memory, self.used, self.file, self.spills = np.dtype(kind), memory, 0, None, 0
        self.parts: list[deque] = [deque() for _ in range(lists)]
        self.loose: dict[int, list[np.ndarray]] = {}

    def push(self, k: int, records: np.ndarray) -> None:
        if len(records):
            self.loose.setdefault(k, []).append(records)
            self.used += records.nbytes
            if self.used > self.memory:
                self.spill()

    def deal(self, which: np.ndarray, records: np.ndarray) -> None:
        """Push records to the lists that which names, keeping their order within a list."""
        if len(which):
            order = stable_order(which, len(self.parts))
            self.deal_sorted(which[order], records[order])

    def deal_sorted(self, which: np.ndarray, records: np.ndarray) -> None:
        if len(which):
            cut = (np.flatnonzero(which[1:] != which[:-1]) + 1).tolist()
            for lo, hi in zip([0, *cut], [*cut, len(which)], strict=True):
                self.push(int(which[lo]), records[lo:hi])

    def spill(self) -> None:
        if self.file is None:
            self.file = scratch_file()
        self.spills += 1
        self.file.seek(0, 2)
        for k, arrays in self.loose.items():  # what is on disk came before
            self.parts[k].append((self.file.tell(), sum(map(len, arrays))))
            for a in arrays:
                self.file.write(a.tobytes())
        self.loose, self.used = {}, 0

    def some(self, k: int, most: int = TAKEN) -> np.ndarray:
        """The next records of a list, about most of them; none: it is empty."""
        out, n = [], 0
        while self.parts[k] and n < most:
            at, size = self.parts[k].popleft()
            read = min(size, most - n)
            if read < size:
                self.parts[k].appendleft((at + read * self.kind.itemsize, size - read))
            self.file.seek(at)
            out.append(np.frombuffer(self.file.read(read * self.kind.itemsize), self.kind))
            n += read
        if not self.parts[k] and n < most and k in self.loose:
            arrays = self.loose.pop(k)
            self.used -= sum(a.nbytes for a in arrays)
            out += arrays
        return np.concatenate(out) if out else np.zeros(0, self.kind)

    def all(self, k: int) -> np.ndarray:
        got = list(self.each(k))
        return np.concatenate(got) if got else np.zeros(0, self.kind)

    def each(self, k: int) -> Iterator[np.ndarray]:
        while len(got := self.some(k)):
            yield got

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def in_order(parts: Iterator[np.ndarray], field: str, total: int, memory: int) -> Iterator[np.ndarray]:
    """Records whose field numbers them from 0 to total - 1, in that order, by way of lists of neighbours."""
    kind, queues, width = None, None, TAKEN
    for p in parts:
        if queues is None:
            kind = p.dtype
            queues = Queues(-(-total // width), kind, memory)
        queues.deal(p[field] // width, p)
    for k in range(len(queues.parts) if queues else 0):
        got = queues.all(k)
        out = np.empty(len(got), kind)
        out[got[field].astype(np.int64) - k * width] = got
        yield out
    if queues:
        queues.close()


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo : hi + 1], for many ranges."""
    out = np.empty(len(lo), values.dtype)
    size = hi - lo + 1
    level, span, table = 0, 1, values
    depth = np.frexp(size.astype(np.float64))[1] - 1  # the power of two not above the size
    top = int(depth.max(initial=0))
    while True:
        mine = np.flatnonzero(depth == level)
        if len(mine):
            a, b = lo[mine], hi[mine] - span + 1
            out[mine] = np.minimum(table[a], table[b])
        if level == top:
            return out
        table = np.minimum(table[:-span], table[span:])
        level, span = level + 1, 2 * span


class Text:
    """Symbols of 8 or 32 bits in an array or a file of them, less than symbols."""

    def __init__(self, data: np.ndarray, symbols: int):
        self.data, self.symbols, self.bits = data, symbols, 8 * data.dtype.itemsize
        self.slots = 64 // self.bits

    def __len__(self) -> int:
        return len(self.data)

    def before(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols before each place, the nearest in the highest bits, and how many there are."""
        pos = pos.astype(np.int64)
        out = np.zeros(len(pos), np.uint64)
        for k in range(self.slots):
            at = pos - 1 - k
            out |= np.where(at >= 0, self.data[np.maximum(at, 0)], 0).astype(np.uint64) << np.uint64(64 - self.bits * (k + 1))
        return out, np.minimum(pos, self.slots).astype(np.uint8)

    def word(self, pos: np.ndarray, size: np.ndarray, k: int, last: np.ndarray) -> np.ndarray:
        """The k-th word of the strings of size symbols from each place, greatest symbol first; beyond a string's end its
        symbols are the greatest, and the least of a string that ends with the text (last)."""
        out = np.zeros(len(pos), np.uint64)
        for j in range(k * self.slots, (k + 1) * self.slots):
            inside = j < size
            x = np.where(inside, self.data[np.minimum(pos + j, len(self.data) - 1)], np.where(last, 0, (1 << self.bits) - 1)).astype(np.uint64)
            out = (out << np.uint64(self.bits)) | x
        return out

    def common(self, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
        """The common prefixes, up to cap, of the suffixes from two different places each."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        out, alive, n = np.zeros(len(a), np.int64), np.arange(len(a)), len(self.data)
        for step in range(cap):
            x, y = a[alive] + step, b[alive] + step
            same = (x < n) & (y < n)
            same &= self.data[np.minimum(x, n - 1)] == self.data[np.minimum(y, n - 1)]
            alive = alive[same]
            if not len(alive):
                break
            out[alive] += 1
        return out

    def run(self, pos: np.ndarray, cap: int) -> np.ndarray:
        """How often each place's symbol repeats from there."""
        return np.minimum(1 + self.common(pos, pos.astype(np.int64) + 1, cap), cap)

    def seeds(self) -> tuple[list[np.ndarray], int]:
        """Places of seeds in rising blocks: as offsets in them, files of their own would be larger."""
        out, n, later = [], len(self.data), False
        hi = n - 1
        while hi > 0:  # types of [lo, hi], the last one's known
            lo = max(0, hi - BLOCK)
            x = np.asarray(self.data[lo : hi + 1])
            ends = np.append(np.flatnonzero(x[1:] != x[:-1]), len(x) - 1)  # of runs of equal symbols
            right = np.repeat(np.append(x[ends[:-1]] < x[ends[:-1] + 1], later), np.diff(ends, prepend=-1))
            out.append((lo + 1 + np.flatnonzero(right[1:] & ~right[:-1])).astype(np.uint32))
            hi, later = lo, bool(right[0])
        return out[::-1], sum(map(len, out))


def stored_array(parts: Iterator[np.ndarray], kind: str) -> np.ndarray:
    """Arrays, one after another, as an array in a scratch file."""
    f, n = scratch_file(), 0
    for p in parts:
        f.write(np.ascontiguousarray(p, kind).tobytes())
        n += len(p)
    f.flush()
    return np.memmap(f, kind, "r", shape=(n,)) if n else np.zeros(0, kind)


def ranges(cells: np.ndarray) -> np.ndarray:
    """The range of each cell: neighbouring cells of about TAKEN records together, larger ones for themselves."""
    reach = (np.cumsum(cells) - 1) // TAKEN
    return np.cumsum(np.append(0, reach[1:] != reach[:-1]))


class Level:
    """One text of the recursion."""

    def __init__(self, text: Text, memory: int, cap: int, spills: list[int]):
        self.text, self.memory, self.cap, self.spills = text, memory, cap, spills
        self.shift = 0 if text.bits == 8 else max(0, (text.symbols - 1).bit_length() - 16)
        cells = np.zeros(((text.symbols - 1) >> self.shift) + 1, np.int64)
        for lo in range(0, len(text), BLOCK):
            cells += np.bincount(np.asarray(text.data[lo : lo + BLOCK]).astype(np.int64) >> self.shift, minlength=len(cells))
        self.range_of = np.arange(len(cells)) if text.bits == 8 else ranges(cells)
        self.count = int(self.range_of[-1]) + 1
        self.single = (np.bincount(self.range_of) == 1) & (self.shift == 0)

    def where(self, keys: np.ndarray) -> np.ndarray:
        return self.range_of[keys.astype(np.int64) >> self.shift]

    # seeds in order

    def named(self, parts: list[np.ndarray], m: int) -> Iterator[np.ndarray]:
        """Records (index, name, lcp) of the seeds, in the order of their substrings; lcp: 1 where the name repeats."""
        text, n = self.text, len(self.text)
        kind = np.dtype([("index", "<u4"), ("pos", "<u4"), ("size", "<u4")])
        first = text.data

        def cell(pos: np.ndarray) -> np.ndarray:
            x = first[pos].astype(np.int64)
            return x >> self.shift if text.bits > 8 else x << 8 | first[np.minimum(pos + 1, n - 1)]

        cells = np.zeros(len(self.range_of) if text.bits > 8 else 1 << 16, np.int64)
        for p in parts:
            if len(p):
                cells += np.bincount(cell(p.astype(np.int64)), minlength=len(cells))
        group = ranges(cells)
        queues, index = Queues(int(group[-1]) + 1, kind, self.memory), 0
        for i, p in enumerate(parts):
            if not len(p):
                continue
            r = np.empty(len(p), kind)
            r["index"], r["pos"] = np.arange(index, index + len(p)), p
            after = next((q[0] for q in parts[i + 1 :] if len(q)), n)
            r["size"] = np.append(p[1:], after).astype(np.int64) - p + 1
            index += len(p)
            queues.deal(group[cell(p.astype(np.int64))], r)
        name = 0
        for k in range(len(queues.parts)):
            r = queues.all(k)
            if not len(r):
                continue
            pos, size, last = r["pos"].astype(np.int64), r["size"].astype(np.int64), r["index"] == m - 1
            size = np.where(last, 1 << 40, size)
            word = text.word(pos, np.where(last, n - pos, size), 0, last)
            order = np.argsort(word, kind="stable")
            new = np.append(True, word[order][1:] != word[order][:-1])
            step = 1
            while True:
                number = np.cumsum(new) - 1
                due = np.bincount(number, size[order] > step * text.slots) > 0
                due &= np.bincount(number) > 1
                at = np.flatnonzero(due[number])
                if not len(at):
                    break
                o = order[at]
                word = text.word(pos[o], np.where(last[o], n - pos[o], size[o]), step, last[o])
                by = np.lexsort((word, number[at]))
                order[at] = o[by]
                word, g = word[by], number[at]
                new[at] |= np.append(True, (word[1:] != word[:-1]) | (g[1:] != g[:-1]))
                step += 1
            number = np.cumsum(new) - 1
            by = np.lexsort((-size[order], number))  # of strings that differ by their ends only the longer is less
            order = order[by]
            new |= np.append(True, size[order][1:] != size[order][:-1])
            out = np.empty(len(r), np.dtype([("index", "<u4"), ("name", "<u4"), ("rank", "<u4")]))
            out["index"], out["name"] = r["index"][order], name + np.cumsum(new) - 1
            name = int(out["name"][-1]) + 1
            yield out
        self.spills[0] += queues.spills
        queues.close()

    def seeds_in_order(self) -> Iterator[np.ndarray]:
        """Tuples of the seeds, in order."""
        text = self.text
        parts, m = text.seeds()
        if not m:
            return
        rank, different = 0, 0

        def ranked() -> Iterator[np.ndarray]:
            nonlocal rank, different
            for r in self.named(parts, m):
                r["rank"] = np.arange(rank, rank + len(r))
                rank, different = rank + len(r), int(r["name"][-1]) + 1
                yield r

        both = stored_array((x for r in in_order(ranked(), "index", m, self.memory) for x in (np.stack([r["name"], r["rank"]], 1).ravel(),)), "<u4").reshape(-1, 2)
        place = stored_array(iter(parts), "<u4")
        kind = np.dtype([("rank", "<u4"), ("index", "<u4"), ("lcp", "<u4")])

        def ordered() -> Iterator[np.ndarray]:  # (rank, index, lcp in names) by rank
            if different == m:
                rec = np.dtype([("rank", "<u4"), ("index", "<u4")])

                def pairs():
                    for lo in range(0, m, BLOCK):
                        r = np.empty(min(BLOCK, m - lo), rec)
                        r["rank"], r["index"] = both[lo : lo + len(r), 1], np.arange(lo, lo + len(r))
                        yield r

                for r in in_order(pairs(), "rank", m, self.memory):
                    out = np.zeros(len(r), kind)
                    out["rank"], out["index"] = r["rank"], r["index"]
                    yield out
                return
            done = 0
            text_of_names = stored_array((both[lo : lo + BLOCK, 0] for lo in range(0, m, BLOCK)), "<u4")
            for pos, lcp in Level(Text(text_of_names, different), self.memory, self.cap, self.spills).sorted():
                out = np.empty(len(pos), kind)
                out["rank"], out["index"], out["lcp"] = np.arange(done, done + len(pos)), pos, lcp
                done += len(pos)
                yield out

        def with_prefixes() -> Iterator[np.ndarray]:  # lcp in symbols
            last = None
            for r in ordered():
                i = r["index"].astype(np.int64)
                j = np.append(i[:1] if last is None else last, i[:-1])
                h, cap = r["lcp"].astype(np.int64), self.cap
                a, b = place[i].astype(np.int64), place[j].astype(np.int64)
                known = place[np.minimum(i + h, m - 1)].astype(np.int64) - a
                more = text.common(a + known, b + known, cap)
                out = r.copy()
                out["lcp"] = np.minimum(known + more, cap)
                if last is None and len(out):
                    out["lcp"][0] = 0
                last = i[-1:]
                yield out

        def with_symbols() -> Iterator[np.ndarray]:  # in the text's order, so that it is read from end to end
            seen = np.dtype([("rank", "<u4"), *TUPLE.descr])
            for r in in_order(with_prefixes(), "index", m, self.memory):
                out = np.empty(len(r), seen)
                pos = place[r["index"].astype(np.int64)].astype(np.int64)
                out["rank"], out["pos"], out["key"], out["lcp"] = r["rank"], pos, text.data[pos], r["lcp"]
                out["before"], out["left"] = text.before(pos)
                yield out

        for r in in_order(with_symbols(), "rank", m, self.memory):
            out = np.empty(len(r), TUPLE)
            for name in TUPLE.names:
                out[name] = r[name]
            yield out

    # the sweeps

    def previous(self, t: np.ndarray, first: np.ndarray, falls: bool) -> tuple[np.ndarray, np.ndarray]:
        """(places in t of tuples that push, what they push): the suffix one symbol earlier, if its symbol lies further in the
        sweep's direction, or is the same and the tuple is of the kind that the sweep induces."""
        text = self.text
        empty = np.flatnonzero((t["left"] == 0) & (t["pos"] > 0))
        before, left = t["before"].copy(), t["left"].copy()
        if len(empty):
            before[empty], left[empty] = text.before(t["pos"][empty])
        symbol = (before >> np.uint64(64 - text.bits)).astype(np.uint32)
        further = symbol < t["key"] if falls else symbol > t["key"]
        who = np.flatnonzero((t["pos"] > 0) & (further | ((symbol == t["key"]) & first)))
        out = np.empty(len(who), TUPLE)
        out["key"], out["pos"], out["left"], out["lcp"] = symbol[who], t["pos"][who] - 1, left[who] - 1, 0
        out["before"] = before[who] << np.uint64(text.bits)
        return who, out

    def sweep(self, second, falls: bool, begin: np.ndarray | None) -> Queues:
        """All tuples of the kind induced, in lists by range, in the sweep's order; second(range) gives the range's tuples of the
        other kind, in that order, which come after the induced ones of their symbol."""
        cap, text = self.cap, self.text
        waiting, done = (Queues(self.count, TUPLE, self.memory) for _ in range(2))
        run, seen = np.zeros(text.symbols, np.uint16), np.zeros(text.symbols, bool)
        if begin is not None:
            waiting.deal(self.where(begin["key"]), begin)
            seen[begin["key"]] = True
            run[begin["key"]] = cap

        def sources(t: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """previous(), in the order of symbols."""
            who, pushed = self.previous(t, first, falls)
            by = stable_order(pushed["key"], text.symbols)
            return who[by], pushed[by]

        def prefixes(who: np.ndarray, pushed: np.ndarray, between: np.ndarray) -> np.ndarray:
            """The lcp of what is pushed: between is that of each source with the one before it; who: the sources that pushed."""
            k = pushed["key"]
            lcp = np.empty(len(k), np.int64)
            same = np.append(False, k[1:] == k[:-1])[: len(k)]
            head, tail = np.flatnonzero(~same), np.flatnonzero(same)
            reach = np.minimum.accumulate(between)
            lcp[head] = np.where(seen[k[head]], 1 + np.minimum(run[k[head]], reach[who[head]]).astype(np.int64), 0)
            if len(tail):
                lcp[tail] = 1 + least_between(between, who[tail - 1] + 1, who[tail]).astype(np.int64)
            return np.minimum(lcp, cap)

        def leave(who: np.ndarray, pushed: np.ndarray, between: np.ndarray) -> None:
            """Brings run and seen up to the batch's end."""
            np.minimum(run, between.min(), out=run)
            if len(who):
                k = pushed["key"]
                back = np.append(np.minimum.accumulate(between[::-1])[::-1], cap).astype(np.uint16)  # least from each place on
                last = np.append(k[1:] != k[:-1], True)
                run[k[last]] = back[who[last] + 1]
                seen[k[last]] = True

        def seam(a: int, b: int) -> int:
            return int(min(text.run(np.array([a, b]), cap)))

        def straight(k: int) -> None:
            """A range of one symbol: what it pushes into itself follows what is there."""
            final = None
            while len(t := waiting.some(k)):
                done.push(k, t)
                final = t["pos"][-1]
                emit(t, np.ones(len(t), bool), t["lcp"].astype(np.uint16))
            for t in second(k):
                between = t["lcp"].astype(np.uint16)
                if final is not None:
                    between[0] = seam(final, t["pos"][0])
                    final = None
                emit(t, np.zeros(len(t), bool), between)

        def emit(t: np.ndarray, first: np.ndarray, between: np.ndarray) -> None:
            who, pushed = sources(t, first)
            pushed["lcp"] = prefixes(who, pushed, between)
            leave(who, pushed, between)
            waiting.deal_sorted(self.where(pushed["key"]), pushed)

        def mixed(k: int) -> None:
            """A range of several symbols, at once."""
            t = waiting.all(k)
            other = [*second(k)]
            t = np.concatenate([t, *other])
            first = np.arange(len(t)) < len(t) - sum(map(len, other))
            n, depth, new, mine, parts, parents = len(t), 0, t, first, [t], []
            base = 0
            while True:  # what is pushed within the range
                who, pushed = self.previous(new, mine, falls)
                inside = self.where(pushed["key"]) == k
                if not inside.any():
                    break
                parents.append(base + who[inside])
                depth, base, new = depth + 1, base + len(new), pushed[inside]
                mine = np.ones(len(new), bool)
                parts.append(new)
            if depth:
                t = np.concatenate(parts)
                first = np.concatenate([first, np.ones(len(t) - n, bool)])
            parent = np.concatenate([np.full(n, -1), *parents])
            symbol = -t["key"].astype(np.int64) if falls else t["key"].astype(np.int64)
            induced, origin = parent >= 0, np.append(np.arange(n), np.zeros(len(t) - n, np.int64))
            deep = np.arange(n, len(t))
            for _ in range(depth):  # by then the order of those pushed follows that of those that pushed them, all the way up
                above = parent[deep]
                by = np.lexsort((origin[above], induced[above], ~first[above], symbol[above]))
                origin[deep[by]] = np.arange(len(deep))
            order = np.lexsort((origin, induced, ~first, symbol))
            t, first, induced = t[order], first[order], induced[order]
            if not len(t):
                return
            between = t["lcp"].astype(np.uint16)
            change = np.append(True, t["key"][1:] != t["key"][:-1])
            border = np.flatnonzero(~change & ~first & np.append(False, first[:-1]))  # the first of the other kind after induced ones
            if len(border):
                between[border] = np.minimum(text.run(t["pos"][border], cap), text.run(t["pos"][border - 1], cap))
            who, pushed = sources(t, first)
            within = self.where(pushed["key"]) == k
            if depth:  # those pushed within the range are sources in it, too
                at, mine, own = np.flatnonzero(induced), pushed[within], who[within]
                place = np.empty(len(mine), np.int64)
                place[np.argsort(mine["pos"])] = at[np.argsort(t["pos"][at])]
                between[at] = cap
                while True:
                    lcp = prefixes(own, mine, between)
                    if (between[place] == lcp).all():
                        break
                    between[place] = lcp
                t["lcp"][at] = between[at]
            pushed["lcp"] = prefixes(who, pushed, between)
            leave(who, pushed, between)
            done.push(k, t[first])
            waiting.deal_sorted(self.where(pushed["key"][~within]), pushed[~within])

        for k in range(self.count - 1, -1, -1) if falls else range(self.count):
            (straight if self.single[k] else mixed)(k)
        self.spills[0] += waiting.spills + done.spills
        waiting.close()
        return done

    def sorted(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, common prefixes with the suffix before) of all suffixes, in order."""
        n = len(self.text)
        if n == 1:
            yield np.zeros(1, np.int64), np.zeros(1, np.int64)
            return
        seeds = Queues(self.count, TUPLE, self.memory)
        for t in self.seeds_in_order():
            t["lcp"][np.append(len(seeds.loose) == 0 and not any(seeds.parts), t["key"][1:] != t["key"][:-1])] = 0
            seeds.deal(self.where(t["key"]), t)
        self.spills[0] += seeds.spills
        begin = np.zeros(1, TUPLE)
        begin["key"], begin["pos"] = self.text.data[n - 1], n - 1
        begin["before"], begin["left"] = self.text.before(np.array([n - 1]))
        left = self.sweep(seeds.each, False, begin)
        seeds.close()
        kept = Queues(self.count, TUPLE, self.memory)

        def backwards(k: int) -> Iterator[np.ndarray]:
            """A range's left-type tuples from the greatest on, each with its common prefix with the one before it here."""
            t = left.all(k)
            kept.push(k, t)
            if len(t):
                out = t[::-1].copy()
                out["lcp"] = np.append(0, np.where(t["key"][1:] == t["key"][:-1], t["lcp"][1:], 0)[::-1])
                yield out

        right = self.sweep(backwards, True, None)
        left.close()
        for k in range(self.count):
            a, b = kept.all(k), right.all(k)[::-1]
            if len(b):
                b = b.copy()
                b["lcp"] = np.append(0, np.where(b["key"][1:] == b["key"][:-1], b["lcp"][:-1], 0))
            t = np.concatenate([a, b])
            if not len(t):
                continue
            is_right = np.append(np.zeros(len(a), bool), np.ones(len(b), bool))
            if not self.single[k]:
                by = np.lexsort((np.arange(len(t)), is_right, t["key"]))
                t, is_right = t[by], is_right[by]
            change = np.append(True, t["key"][1:] != t["key"][:-1])
            lcp = np.where(change, 0, t["lcp"]).astype(np.int64)
            border = np.flatnonzero(~change & is_right & np.append(False, ~is_right[:-1]))
            if len(border):
                lcp[border] = np.minimum(self.text.run(t["pos"][border], self.cap), self.text.run(t["pos"][border - 1], self.cap))
            yield t["pos"].astype(np.int64), lcp
        self.spills[0] += kept.spills
        kept.close()
        right.close()


def sorted_suffixes(data: np.ndarray, memory: int = MEMORY, cap: int = LONGEST, spills: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefixes up to cap with the suffix before) of all suffixes of bytes - an array or a file's -, in order.
    spills[0] is raised by the number of times that lists went to disk."""
    if len(data):
        yield from Level(Text(data, 256), memory, min(cap, LONGEST), [0] if spills is None else spills).sorted()


def suffix_order(text: np.ndarray, memory: int = MEMORY, depth: int = LONGEST) -> np.ndarray:
    """The places of a text's suffixes in order; depth bounds the common prefixes that are carried, not the order."""
    got = [p for p, _ in sorted_suffixes(np.asarray(text, np.uint8), memory, depth)]
    return np.concatenate(got) if got else np.zeros(0, np.int64)
