"""Sums over all pairs of vertices on the circle, without a step per pair, where hidden degrees fall into few classes.

Within a pair of classes what a pair of vertices adds depends on its angular distance only. Sums of such a function are taken
by levels of cells that halve: cells that neither touch nor lie opposite each other meet through their Chebyshev nodes (the
function is smooth there), the others are divided, and pairs of the last level's touching and opposite cells are evaluated one
by one. Counts by distance come from places in sorted angles, pairs at the brink being evaluated as such. Draws take runs of
vertices in bands of distance, from which candidates are drawn at the band's greatest probability and thinned to their own.

A class's angles lie sorted in files of the shared folder; a task reads the classes it works on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.sources.shared import new_path, read_arrow, stored

#: Nodes of a cell, vertices of a last cell, pairs evaluated at once, and tasks that work is dealt to at least.
NODES, LEAF, AT_ONCE, TASKS = 18, 8, 1 << 21, 64
#: Vertices of a class pair's smaller class in one task, and classes up to which all this is done.
RUN, CLASSES = 1 << 16, 256

TURN = 2 * math.pi


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.pi - np.abs(np.pi - np.abs(a - b))


def spans(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of all places of ranges [lo, lo + size)."""
    which = np.repeat(np.arange(len(lo)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


def chunks(size: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes sum to about most."""
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield slice(lo, hi)
        lo = hi


@lru_cache
def _nodes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chebyshev nodes of [-1, 1], what makes polynomials' values there their Chebyshev sums, and nodes of both halves by those of the whole."""
    x = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
    c = np.cos(np.arange(NODES)[:, None] * np.arccos(x)[None, :]) * 2 / NODES
    c[0] /= 2
    return x, c, np.stack([_basis(x / 2 - 0.5, c), _basis(x / 2 + 0.5, c)])


def _basis(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nodes' Lagrange polynomials at x."""
    t = np.empty((len(x), NODES))
    t[:, 0], t[:, 1] = 1, x
    for k in range(2, NODES):
        t[:, k] = 2 * x * t[:, k - 1] - t[:, k - 2]
    return t @ c


def _cells(theta: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(the cell of each angle, its place within from -1 to 1)."""
    at = theta * ((1 << level) / TURN)
    cell = np.clip(np.floor(at), 0, (1 << level) - 1).astype(np.int64)
    return cell, 2 * (at - cell) - 1


def class_sums(targets: np.ndarray, sources: np.ndarray, f: Callable[[np.ndarray], np.ndarray], same: bool = False) -> np.ndarray:
    """The sum of f(angular distance) over sources at each target, angles in [0, 2 pi), both sorted; same: targets are the
    sources, and none counts itself."""
    n, m = len(targets), len(sources)
    out = np.zeros(n)
    level = max(2, int(math.log2(max(n, m, 1) / LEAF)) if max(n, m) > LEAF else 2)
    if level < 4 or min(n, m) < 4:
        step = max(1, AT_ONCE // max(1, m))
        for lo in range(0, n, step):
            x = f(distance(targets[lo : lo + step, None], sources[None, :]))
            if same:
                x[np.arange(len(x)), np.arange(lo, lo + len(x))] = 0
            out[lo : lo + step] = x.sum(1)
        return out
    nodes, c, halves = _nodes()
    moments = [np.zeros((0, 0))] * (level + 1)
    cells = 1 << level
    cell, x = _cells(sources, level)
    moments[level] = np.zeros((cells, NODES))
    for lo in range(0, m, 1 << 17):
        part = slice(lo, lo + (1 << 17))
        first = np.flatnonzero(np.diff(cell[part], prepend=-1))
        moments[level][cell[part][first]] += np.add.reduceat(_basis(x[part], c), first)
    for k in range(level - 1, 2, -1):
        moments[k] = moments[k + 1][0::2] @ halves[0] + moments[k + 1][1::2] @ halves[1]
    local = np.zeros((8, NODES))
    for k in range(3, level + 1):
        size, half, width = 1 << k, 1 << (k - 1), TURN / (1 << k)
        if k > 3:
            parent, local = local, np.empty((size, NODES))
            local[0::2], local[1::2] = parent @ halves[0].T, parent @ halves[1].T
        for side in (0, 1):
            near = (-2, 2, 3) if side == 0 else (-3, -2, 2)
            offsets = (-2, 2) if k == 3 else (*near, *(half + o for o in near))
            own = np.arange(side, size, 2)
            for o in offsets:
                t = o * width + width / 2 * (nodes[None, :] - nodes[:, None])
                t = np.abs(t) % TURN
                local[own] += moments[k][(own + o) % size] @ f(np.minimum(t, TURN - t)).T
    mine, x = _cells(targets, level)
    for lo in range(0, n, 1 << 17):
        part = slice(lo, lo + (1 << 17))
        out[part] = np.einsum("ij,ij->i", _basis(x[part], c), local[mine[part]])
    starts = np.searchsorted(cell, np.arange(cells + 1))
    for o in (-1, cells // 2 - 1):  # three cells in a row from there on
        for j in range(3):
            at = (mine + o + j) % cells
            low, number = starts[at], starts[at + 1] - starts[at]
            for part in chunks(number, AT_ONCE):
                which, place = spans(low[part], number[part])
                which += part.start
                x = f(distance(targets[which], sources[place]))
                if same:
                    x[which == place] = 0
                out[part] += np.bincount(which - part.start, x, part.stop - part.start)[: len(out[part])]
    return out


class Layout:
    """Vertices of the circle by class: (kappa, number) of each class in memory, angles and ids in files."""

    def __init__(self, vertices: DataFrame, most: int = CLASSES):
        inside = F.count_if((F.col("theta") >= 0) & (F.col("theta") <= TURN)) == F.count("*")
        kinds = vertices.groupBy("kappa").agg(F.count("*").alias("n"), inside.alias("inside")).orderBy("kappa").limit(most + 1).collect()
        self.few = 0 < len(kinds) <= most and all(r.inside and r.kappa is not None and r.kappa > 0 for r in kinds)
        self.kinds = [(float(r.kappa), int(r.n)) for r in kinds] if self.few else []
        if self.few:
            self.path = new_path(vertices.sparkSession, "classes")
            vertices.select("kappa", "theta", "vid").repartitionByRange("kappa", "theta").sortWithinPartitions("kappa", "theta", "vid").write.parquet(self.path)

    @property
    def count(self) -> int:
        return sum(n for _, n in self.kinds)


def of_class(path: str, kappa: float) -> tuple[np.ndarray, np.ndarray]:
    """(angles, ids) of a class, sorted by both."""
    got = read_arrow(path, ["theta", "vid"], ("kappa", kappa))
    theta, vid = got["theta"].to_numpy(), got["vid"].to_numpy()
    order = np.lexsort((vid, theta))
    return theta[order], vid[order]


def _dealt(spark, jobs: list[tuple], schema: str) -> DataFrame:
    """A task for each job."""
    return spark.sparkContext.parallelize(jobs, max(1, len(jobs))).toDF(schema)


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _mapped(spark, jobs: list[tuple], kind: str, work: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """What work makes, as tuples of arrays, of every job."""
    arrow = _arrow(schema, spark)

    def run(batches):
        for b in batches:
            for job in b.to_pylist():
                for made in work(**job):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, arrow, strict=True)], schema=arrow)

    return _dealt(spark, jobs, kind).mapInArrow(run, schema)


def sums(layout: Layout, spark, big_r: float, mu: float, f: Callable[[np.ndarray], np.ndarray], path: str | None = None, kinds: list[tuple[float, int]] | None = None) -> DataFrame:
    """(vid, x): the sum of f(rescaled distance) over all other vertices. With path and kinds, at the angles of that layout's
    rows of the same form, own vertex included."""
    same, home = path is None, layout.path
    path, kinds = path or home, kinds or layout.kinds
    cost = [(k, s, max(n, m)) for k, n in kinds for s, m in layout.kinds]
    most, jobs, now, load = max(1 << 18, sum(c[2] for c in cost) // TASKS), [], [], 0
    for i, (k, s, c) in enumerate(cost):
        now.append(s)
        load += c
        if load >= most or i + 1 == len(cost) or cost[i + 1][0] != k:
            jobs.append((load, k, now))
            now, load = [], 0
    jobs = [(k, s) for _, k, s in sorted(jobs, key=lambda j: -j[0])]

    def work(k: float, sources: list[float]) -> Iterator[tuple]:
        theta, vid = of_class(path, k)
        total = np.zeros(len(theta))
        for s in sources:
            scale = big_r / (mu * k * s)
            total += class_sums(theta, theta if same and s == k else of_class(home, s)[0], lambda d: f(scale * d), same and s == k)  # noqa: B023
        for lo in range(0, len(vid), 1 << 16):
            yield vid[lo : lo + (1 << 16)], total[lo : lo + (1 << 16)]

    return _mapped(spark, jobs, "k double, sources array<double>", work, "vid long, x double")


def class_pairs(layout: Layout) -> list[tuple[float, float, int, int]]:
    """(class, class, from, to) of each pair of classes, once, by runs of the smaller class; the longest first."""
    kinds, out = layout.kinds, []
    for i, (a, n) in enumerate(kinds):
        for b, m in kinds[i:]:
            x, y, size = (a, b, n) if n <= m else (b, a, m)
            out += [(x, y, lo, min(size, lo + RUN)) for lo in range(0, size, RUN)]
    return sorted(out, key=lambda j: j[2] - j[3])


def _jobs(layout: Layout) -> list[tuple]:
    """Class pairs dealt to tasks: long ones by themselves, short ones together."""
    out, load = [[]], 0
    for p in class_pairs(layout):
        if out[-1] and load + p[3] - p[2] + 2000 > RUN:
            out.append([])
            load = 0
        out[-1].append(p)
        load += p[3] - p[2] + 2000
    return [(p,) for p in out]


_JOB = "pairs array<struct<a:double,b:double,lo:long,hi:long>>"


class Around:
    """Sorted angles, three times round."""

    def __init__(self, theta: np.ndarray):
        self.n, self.theta = len(theta), theta
        self.all = np.concatenate([theta - TURN, theta, theta + TURN])
        self.sum = np.concatenate([[0], np.cumsum(self.all.astype(np.longdouble))])


def extremes(theta: np.ndarray, other: np.ndarray) -> tuple[float, float]:
    """The least distance above 0, and the greatest one; 0 and 0 where there is no such pair."""
    a = Around(other)
    low = np.searchsorted(a.all, theta, side="left") - 1
    high = np.searchsorted(a.all, theta, side="right")
    d = np.concatenate([distance(theta, other[x % a.n]) for x in (low, high)])
    far = np.searchsorted(a.all, theta + np.pi)
    top = np.concatenate([distance(theta, other[x % a.n]) for x in (far - 1, far)])
    return float(d[d > 0].min(initial=math.inf)), float(top.max(initial=0.0))


def bounds(layout: Layout, spark, big_r: float, mu: float) -> tuple[float, float] | None:
    """The least rescaled distance above 0, and the greatest."""
    path = layout.path

    def work(pairs: list[dict]) -> Iterator[tuple]:
        low, high = math.inf, 0.0
        for p in pairs:
            theta, other = of_class(path, p["a"])[0][p["lo"] : p["hi"]], of_class(path, p["b"])[0]
            near, far = extremes(theta, other)
            low, high = min(low, big_r * near / (mu * p["a"] * p["b"])), max(high, big_r * far / (mu * p["a"] * p["b"]))
        yield [low], [high]

    got = _mapped(spark, _jobs(layout), _JOB, work, "low double, high double").agg(F.min("low"), F.max("high")).first()
    return None if got[0] is None or not 0 < got[0] < math.inf else (got[0], got[1])


def binned(theta: np.ndarray, lo: int, hi: int, other: Around, same: bool, edges: np.ndarray, scale: float, bin_of: Callable[[np.ndarray], np.ndarray], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, sum of rescaled distances) by bin of the pairs of theta[lo : hi] with others (same: with those of greater place
    in theta itself). bin_of gives the bin of a rescaled distance, rising with it; edges[k] divides bins k and k + 1, but for
    rounding: pairs within it are asked of bin_of."""
    t = theta[lo:hi]
    number, total = np.zeros(bins), np.zeros(bins)
    weight = 0.5 if same else 1.0  # each pair is met from both ends
    brink = 1e-13
    core = min(16 / other.n, 1.0) if other.n > 16 else math.pi  # up to here pairs are evaluated one by one

    def each(which: np.ndarray, place: np.ndarray, sign: float = 1.0) -> None:
        if same:
            keep = place % other.n != which + lo
            which, place = which[keep], place[keep]
        x = scale * distance(t[which], other.theta[place % other.n])
        k = bin_of(x)
        ok = (k >= 0) & (k < bins)
        number[:] += sign * weight * np.bincount(k[ok], minlength=bins)
        total[:] += sign * weight * np.bincount(k[ok], x[ok], minlength=bins)

    if core >= math.pi:
        for part in chunks(np.full(len(t), other.n), AT_ONCE):
            which, place = spans(np.full(part.stop - part.start, other.n), np.full(part.stop - part.start, other.n))
            which += part.start
            ok = which < len(t)
            each(which[ok], place[ok])
        return number, total
    left, right = np.searchsorted(other.all, t - core, side="left"), np.searchsorted(other.all, t + core, side="right")
    for part in chunks(right - left, AT_ONCE):
        which, place = spans(left[part], (right - left)[part])
        each(which + part.start, place)
    # beyond: shells between the edges' distances, up to the antipode, where the two sides share out what is left
    whole = int(np.searchsorted(edges, scale * core, side="left"))
    ends = [float(e) / scale for e in edges[whole:] if float(e) / scale < math.pi]
    opposite = np.searchsorted(other.all, t + np.pi, side="right")
    for d in [*ends, None]:
        if d is None:
            new_right = opposite
            new_left = opposite - other.n  # the same vertices, a turn before: each is on one side
        else:
            new_right = np.minimum(np.searchsorted(other.all, t + d, side="right"), opposite)
            new_left = np.maximum(np.searchsorted(other.all, t - d, side="left"), opposite - other.n)
            new_right, new_left = np.maximum(new_right, right), np.minimum(new_left, left)
        k = whole + ends.index(d) if d is not None else whole + len(ends)
        n = (new_right - right) + (left - new_left)
        if k < bins:
            s = (other.sum[new_right] - other.sum[right] - (new_right - right) * t.astype(np.longdouble)) + ((left - new_left) * t.astype(np.longdouble) - other.sum[left] + other.sum[new_left])
            number[k] += weight * n.sum()
            total[k] += weight * scale * float(s.sum())
        if d is not None:  # pairs at the brink, given to bin k or k + 1 by the search, go where bin_of says
            for side in (1.0, -1.0):
                a = np.searchsorted(other.all, t + side * d - brink, side="left")
                b = np.searchsorted(other.all, t + side * d + brink, side="right")
                for i in np.flatnonzero(b > a).tolist():
                    for j in range(int(a[i]), int(b[i])):
                        inside = left[i] <= j < right[i]  # counted before this shell, as a core pair
                        if inside or not opposite[i] - other.n <= j < opposite[i]:
                            continue
                        took = k if new_left[i] <= j < new_right[i] else k + 1
                        x = float(scale * distance(t[i : i + 1], other.theta[j % other.n : j % other.n + 1])[0])
                        due = int(bin_of(np.array([x]))[0])
                        for to, sign in ((took, -1.0), (due, 1.0)):
                            if took != due and 0 <= to < bins:
                                number[to] += sign * weight
                                total[to] += sign * weight * x
        left, right = new_left, new_right
    return number, total


def histogram(layout: Layout, spark, big_r: float, mu: float, edges: np.ndarray, bin_of: Callable[[np.ndarray], np.ndarray], bins: int) -> DataFrame:
    """(bin, n, x): number and sum of rescaled distances of all unordered pairs, by bin; pairs of no bin are left out."""
    path = layout.path

    def work(pairs: list[dict]) -> Iterator[tuple]:
        number, total, held = np.zeros(bins), np.zeros(bins), (None, None)
        for p in pairs:
            theta = of_class(path, p["a"])[0]
            if held[0] != p["b"]:
                held = (p["b"], Around(of_class(path, p["b"])[0]))
            n, x = binned(theta, p["lo"], p["hi"], held[1], p["a"] == p["b"], edges, big_r / (mu * p["a"] * p["b"]), bin_of, bins)
            number += n
            total += x
        yield np.arange(bins, dtype=np.int32), number, total

    got = _mapped(spark, _jobs(layout), _JOB, work, "bin int, n double, x double")
    return got.groupBy("bin").agg(F.round(F.sum("n")).cast("long").alias("n"), F.sum("x").alias("x")).where("n > 0")


def picked(size: int, p: float, rng: np.random.Generator) -> np.ndarray:
    """Sorted places below size, each with probability p by itself."""
    if p >= 1:
        return np.arange(size)
    n = int(rng.binomial(size, p))
    if n > size // 2:
        return np.sort(rng.permutation(size)[:n])
    got = np.unique(rng.integers(0, size, n))
    while len(got) < n:  # repeats are drawn anew
        more = np.setdiff1d(rng.integers(0, size, n - len(got)), got)
        got = np.union1d(got, more)
    return got


def drawn(theta: np.ndarray, other: Around, scale: float, beta: float, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in theta, place in other) of linked pairs, every pair by its own probability."""
    opposite = np.searchsorted(other.all, theta + np.pi, side="right")
    left = right = np.searchsorted(other.all, theta, side="left")
    d = min(math.pi, max(1 / scale, 4 / other.n))
    p = 1.0
    while True:
        last = d >= math.pi
        new_right = opposite if last else np.maximum(right, np.minimum(opposite, np.searchsorted(other.all, theta + d, side="right")))
        new_left = opposite - other.n if last else np.minimum(left, np.maximum(opposite - other.n, np.searchsorted(other.all, theta - d, side="left")))
        for low, high in ((right, new_right), (new_left, left)):
            size = high - low
            for part in chunks(size, max(1, int(AT_ONCE / p))):
                ends = np.cumsum(size[part])
                at = picked(int(ends[-1]), p, rng)
                which = np.searchsorted(ends, at, side="right")
                place = (low[part][which] + at - (ends - size[part])[which]) % other.n
                x = scale * distance(theta[part][which], other.theta[place])
                hit = rng.random(len(at)) * p < 1 / (1 + x**beta)
                yield which[hit] + part.start, place[hit]
        if last:
            return
        left, right = new_left, new_right
        p = min(1.0, (1 + 1e-6) / (1 + (scale * d * (1 - 1e-9)) ** beta))
        d *= 2


def simulate(layout: Layout, spark, beta: float, big_r: float, mu: float, graphs: int, seed: int) -> DataFrame:
    """(g, src, dst): graphs drawn from the model, every pair by its own probability; reproducible from the seed, the classes
    and the angles."""
    path, number = layout.path, {k: i for i, (k, _) in enumerate(layout.kinds)}

    def work(pairs: list[dict]) -> Iterator[tuple]:
        for p in pairs:
            (theta, vid), (there, ids) = of_class(path, p["a"]), of_class(path, p["b"])
            around, theta = Around(there), theta[p["lo"] : p["hi"]]
            vid = vid[p["lo"] : p["hi"]]
            for g in range(graphs):
                rng = np.random.default_rng([seed, g, number[p["a"]], number[p["b"]], p["lo"]])
                for i, j in drawn(theta, around, big_r / (mu * p["a"] * p["b"]), beta, rng):
                    a, b = vid[i], ids[j]
                    if p["a"] == p["b"]:  # each pair is met from both ends
                        keep = i + p["lo"] < j
                        a, b = a[keep], b[keep]
                    yield np.full(len(a), g), np.minimum(a, b), np.maximum(a, b)

    return stored(_mapped(spark, _jobs(layout), _JOB, work, "g int, src long, dst long"), "drawn")
