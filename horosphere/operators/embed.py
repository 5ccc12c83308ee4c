"""From an edge table to positions: spectral first guess, likelihood refinement, refit, results."""

from __future__ import annotations

import logging
import math
import time
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horosphere.functions import geometry as G
from horosphere.functions import special
from horosphere.operators import circle, graph, infer, ordered, pairs
from horosphere.operators.infer import Params
from horosphere.sources.shared import new_path, read_arrow, stored

log = logging.getLogger(__name__)

#: Vertices up to which the eigenproblem is solved densely on the driver; beyond, by subspace iteration on tables.
DENSE = 4000
#: Edges up to which it is solved by one task that holds the graph, vectors and bytes of its basis, residual and rounds there.
TASK_EDGES, VECTORS, BASIS, CLOSE, EXPANSIONS = 10_000_000, 240, 400_000_000, 1e-7, 4000
#: Vertices up to which a pass of refinement evaluates every candidate, and, on the circle, up to which it goes one by one on the
#: driver, where a vertex takes a millisecond or three (on a sphere bounds rule out less); the result is the same.
SEQUENTIAL, ALONE = 1500, 50_000
#: Residual up to which an eigenvector of the tables' iteration counts as found, and vectors iterated at most.
RESIDUAL, WIDEST = 1e-4, 40


class NotConvergedError(ArithmeticError):
    """The eigenmap's iteration did not reach its residual bound."""


@dataclass
class EmbedConfig:
    dim: int = 1
    beta: float | None = None
    fast: bool = False  # no refinement
    post_kappa: bool = True
    post_beta: bool = False
    only_kappas: bool = False
    seed: int = 1
    candidates: int = 100
    batches: int = 20  # into which a pass of refinement is cut at least; the result does not depend on it


@dataclass
class Embedding:
    coordinates: DataFrame  # vid, kappa, theta or pos, hyp_rad
    params: Params
    timings: dict[str, float] = field(default_factory=dict)


def weights(edges: DataFrame, props: DataFrame, p: Params) -> DataFrame:
    """(src, dst, w) of edges between vertices of more than one neighbour: heat kernel of the expected chord."""
    d = props.where("degree > 1").select("vid", "degree")
    e = edges.join(d.toDF("src", "ks"), "src").join(d.toDF("dst", "kd"), "dst")
    kinds = [(r.ks, r.kd) for r in e.select("ks", "kd").distinct().collect()]  # pairs of degree classes
    far = special.linked_distance(np.array([p.kappa[a] for a, _ in kinds]), np.array([p.kappa[b] for _, b in kinds]), p.n, p.mu, p.beta, p.dim) if kinds else []
    look = edges.sparkSession.createDataFrame([(int(a), int(b), float(x)) for (a, b), x in zip(kinds, far, strict=True)], "ks long, kd long, d double")
    return heat_kernel(e.join(F.broadcast(look) if len(kinds) < 100_000 else look, ["ks", "kd"]))


def heat_kernel(links: DataFrame) -> DataFrame:
    """links (src, dst, d) to (src, dst, w): exp of minus the squared chord of distance d over its mean."""
    c = stored(links.select("src", "dst", F.pow(G.chord(F.col("d")), 2).alias("c2")), "chords")
    t = c.agg(F.avg("c2")).first()[0] or 1.0
    return c.select("src", "dst", F.exp(-F.col("c2") / F.lit(t)).alias("w"))


def both_ways(w: DataFrame) -> DataFrame:
    return w.select("src", "dst", "w").unionByName(w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def strengths(both: DataFrame) -> DataFrame:
    return both.groupBy("src").agg(F.sum("w").alias("s"))


def laplacian(w: DataFrame) -> DataFrame:
    """The entries (i, j, l) of I - S^-1 W that are not 0."""
    both = both_ways(w)
    s = strengths(both)
    off = both.join(s, "src").select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w") / F.col("s")).alias("l"))
    return off.unionByName(s.select(F.col("src").alias("i"), F.col("src").alias("j"), F.lit(1.0).alias("l")))


def subspace(q: DataFrame, strength: DataFrame, width: int, need: int, seed: int, rounds: int) -> DataFrame | None:
    """(src, top, x) with the need greatest non-trivial eigenvectors of q first in x, each of a residual of RESIDUAL at most;
    None where rounds do not do."""
    top = strength.select("src", F.sqrt("s").alias("top"))
    block = stored(top.select("src", "top", F.array(*(F.randn(seed + i) for i in range(width))).alias("x")), "block")
    for k in range(rounds):  # (I + Q) / 2 keeps the wanted end of the spectrum greatest; the known top vector is taken out
        y = q.join(block.select(F.col("src").alias("dst"), "x"), "dst").groupBy("src").agg(F.array(*(F.sum(F.col("w") * F.col("x")[i]) for i in range(width))).alias("y"))
        y = stored(block.join(y, "src").select("src", "top", F.col("x").alias("old"), F.zip_with("x", "y", lambda a, b: (a + b) / 2).alias("x")), "block")
        sums = y.agg(*(F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"g{i}_{j}") for i in range(width) for j in range(i, width)), *(F.sum(F.col("old")[i] * F.col("x")[j]).alias(f"c{i}_{j}") for i in range(width) for j in range(width)), *(F.sum(F.col("x")[i] * F.col("top")).alias(f"t{i}") for i in range(width)), F.sum(F.col("top") * F.col("top")).alias("tt")).first()
        t = np.array([sums[f"t{i}"] for i in range(width)]) / sums["tt"]
        g = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(width)] for i in range(width)]) - sums["tt"] * np.outer(t, t)
        c = np.array([[sums[f"c{i}_{j}"] for j in range(width)] for i in range(width)])
        value, u = np.linalg.eigh(g)
        value, u = np.maximum(value, 1e-300)[::-1], u[:, ::-1]
        back = u / np.sqrt(value)
        block = stored(y.select("src", "top", F.array(*(sum((F.lit(float(back[j, i])) * (F.col("x")[j] - F.lit(float(t[j])) * F.col("top")) for j in range(width)), F.lit(0.0)) for i in range(width))).alias("x")), "block")
        # of Q's vectors X u before this round, which were orthonormal from the second on: |Q X u - m X u|, twice that of (I + Q) / 2
        mid = np.einsum("ji,jk,ki->i", u, (c + c.T) / 2, u)
        if k and 2 * np.sqrt(np.maximum(value - mid**2, 0))[:need].max() <= RESIDUAL:
            return block
    return None


def steep(times, x: np.ndarray, cut: float, degree: int) -> np.ndarray:
    """Rows of x times a Chebyshev polynomial of the matrix, at most 1 on [-1, cut] and rising beyond."""
    half, mid = (1 + cut) / 2, (cut - 1) / 2
    before, now = x, (times(x) - mid * x) / half
    for _ in range(degree - 1):
        before, now = now, (times(now) - mid * now) * (2 / half) - before
    return now


def krylov(times, top: np.ndarray, need: int, seed: int, most: int, rounds: int) -> np.ndarray | None:
    """The need greatest eigenvectors, descending, of the symmetric matrix of spectrum [-1, 1] that times() multiplies by, but for
    its known unit vector top: block Lanczos, orthogonal in full, of at most so many vectors. Where these do not do, it begins
    anew from the best, on a polynomial of the matrix that lifts what lies beyond its next estimates, which are too low if
    anything: orthogonalising is what costs. None where rounds do not reach CLOSE."""
    rng, width = np.random.default_rng(seed), need + 1
    basis, image, size = np.empty((most, len(top))), np.empty((most, len(top))), 0  # a row a vector

    def fresh(x: np.ndarray) -> np.ndarray:
        """Rows of x made orthonormal to all before; random ones instead of what lies in their span."""
        for again in range(3):
            before = np.linalg.norm(x, axis=1)
            x = x - np.outer(x @ top, top)
            x = x - (x @ basis[:size].T) @ basis[:size]
            lost = np.linalg.norm(x, axis=1) <= 1e-10 * np.maximum(before, 1e-300)
            x[lost] = rng.standard_normal((int(lost.sum()), len(top)))
            x = np.linalg.qr(x.T)[0].T
        return x

    new, cut, degree, since = fresh(rng.standard_normal((width, len(top)))), 0.0, 0, 0
    for _ in range(rounds):
        basis[size : size + width] = new
        image[size : size + width] = steep(times, new, cut, degree) if degree else times(new)
        size, since = size + width, since + 1
        full = size + width > most
        if full or since % (4 if degree else 10) == 0:
            u = np.linalg.eigh(basis[:size] @ image[:size].T)[1][:, ::-1].T
            best = u[: min(size, need + 9)] @ basis[:size]
            moved = times(best)
            value, v = np.linalg.eigh(best @ moved.T)
            value, x, y = value[::-1], v[:, ::-1].T @ best, v[:, ::-1].T @ moved
            if np.linalg.norm(y[:need] - value[:need, None] * x[:need], axis=1).max() <= CLOSE:
                return x[:need].T
        if full:
            cut = max(cut, float(min(value[-1], value[need - 1] - 1e-9)))
            rise = math.acosh(max(1.0, 1 + 2 * (value[need - 1] - cut) / (1 + cut)))
            degree, size, since = int(min(200, max(8, math.ceil(6 / max(rise, 1e-3))))), 0, 0
            new = fresh(x[:width])
        else:
            new = fresh(image[size - width : size])
    return None


def eigenmap_in_a_task(w: DataFrame, need: int, seed: int) -> DataFrame:
    """(vid, x) of w's vertices, by krylov() in one task; no rows where it does not converge."""
    path = new_path(w.sparkSession, "weights")
    w.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")).write.parquet(path)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            e = read_arrow(path, ["src", "dst", "w"]).sort_by([("src", "ascending"), ("dst", "ascending")])
            src, dst, weight = (e[c].to_numpy() for c in ("src", "dst", "w"))
            ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
            a, c = ends, np.concatenate([ends[len(src) :], ends[: len(src)]])
            order = np.argsort(a, kind="stable")
            near, start = c[order], np.searchsorted(a[order], np.arange(len(ids)))
            both = np.concatenate([weight, weight])[order]
            s = np.add.reduceat(both, start)
            both = both / np.sqrt(s[a[order]] * s[near])
            top = np.sqrt(s / s.sum())
            most = int(max(4 * need + 4, min(VECTORS, BASIS / 16 / len(ids))))
            x = krylov(lambda v: np.stack([np.add.reduceat(both * r[near], start) for r in v]), top, need, seed, most, EXPANSIONS)
            if x is not None:
                x = x / np.sqrt(s)[:, None]
                for lo in range(0, len(ids), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + (1 << 16)], pa.int64()), pa.array(x[lo : lo + (1 << 16)].tolist(), pa.list_(pa.float64()))], ["vid", "x"])

    return stored(w.sparkSession.range(1).repartition(1).mapInArrow(run, "vid long, x array<double>"), "eigenmap")


def eigenmap(w: DataFrame, dim: int, seed: int = 1, rounds: int = 200) -> dict[int, np.ndarray]:
    """vid to its entries in the dim + 1 smallest non-trivial eigenvectors of I - S^-1 W, descending eigenvalue.
    Beyond DENSE vertices by a task that holds the graph; beyond TASK_EDGES edges, and where that does not converge, by subspace
    iteration on tables, wider where rounds do not reach RESIDUAL, else NotConvergedError."""
    both = both_ways(w)
    need = max(2, dim + 1)
    n = both.select("src").distinct().count()
    if n <= DENSE:
        rows = w.collect()  # at most DENSE vertices
        ids = sorted({r.src for r in rows} | {r.dst for r in rows})
        at = {v: i for i, v in enumerate(ids)}
        m = np.zeros((len(ids), len(ids)))
        for r in rows:
            m[at[r.src], at[r.dst]] = m[at[r.dst], at[r.src]] = r.w
        s = m.sum(1)
        value, vector = np.linalg.eigh(np.eye(len(ids)) - m / np.sqrt(s[:, None] * s[None, :]))
        out = (vector / np.sqrt(s)[:, None])[:, 1 : need + 1][:, ::-1]
        return dict(zip(ids, out, strict=True))
    if n > VECTORS and w.count() <= TASK_EDGES:
        got = {r.vid: np.array(r.x)[::-1] for r in eigenmap_in_a_task(w, need, seed).toLocalIterator()}
        if got:
            return got
    strength = stored(strengths(both), "strength")
    q = stored(both.join(strength, "src").join(strength.toDF("dst", "t"), "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("s") * F.col("t"))).alias("w")), "normed")
    width, block = need + 3, None
    while block is None:
        block = subspace(q, strength, width, need, seed, rounds)
        if block is None and width >= min(WIDEST, n - 1):
            raise NotConvergedError(f"no residual below {RESIDUAL} after {rounds} rounds of {width} vectors")
        width = min(2 * width, WIDEST, n - 1)
    got = block.join(strength, "src").select("src", F.transform(F.slice("x", 1, need), lambda v: v / F.sqrt("s")).alias("x"))
    return {r.src: np.array(r.x)[::-1] for r in got.toLocalIterator()}


def circle_gap(f: float, beta: float, linked: bool, n: int) -> float:
    """The expected gap of neighbours on the circle: linked ones are nearer."""
    x = np.linspace(0, math.pi, 1001)[1:]
    mean = 2 * math.pi / n
    y = np.exp(-x / mean) / (1 + (f * x) ** (beta if linked else -beta))
    w = np.ones(len(x))
    w[-1] = 0.5
    return float((w * x * y).sum() / max(1e-300, (w * y).sum() + (0.5 if linked else 0.0)))


def class_kappa(p: Params, spark) -> DataFrame:
    """(degree, kappa): a row a class."""
    return spark.createDataFrame([(int(k), float(x)) for k, x in p.kappa.items()], "degree long, kappa double")


def lagged_gaps(order: DataFrame, by: list, angle: str) -> DataFrame:
    """order with the angular gap to the row before, in a circle."""
    return ordered.before(order, by, angle, "before").withColumn("gap", G.circular_distance(F.col(angle), F.col("before")))


def spread_angles(order: DataFrame, by: list, gap: str) -> DataFrame:
    """order with theta: the gaps up to each row, stretched to the whole circle; the last row is at 0."""
    got, total = ordered.running(order, by, gap, "sum")
    theta = F.col("sum") * F.lit(2 * math.pi / total)
    return got.withColumn("running", theta).withColumn("theta", F.when(F.col("sum") >= F.lit(total * (1 - 1e-12)), F.lit(0.0)).otherwise(theta)).drop("sum")


def first_circle(edges: DataFrame, props: DataFrame, p: Params, vectors: dict[int, np.ndarray]) -> DataFrame:
    """(vid, theta) on the circle by the order of the eigenmap, leaves around their parents, gaps by the model."""
    spark = edges.sparkSession
    core = spark.createDataFrame([(int(v), float(math.atan2(x[0], x[1]) + math.pi)) for v, x in vectors.items()], "anchor long, raw double")
    w = Window.partitionBy("parent")  # the leaves of one vertex
    hung = graph.leaves(edges).withColumn("rank", F.row_number().over(w.orderBy("leaf"))).withColumn("half", F.floor(F.count("*").over(w) / 2))
    hung = hung.join(core, F.col("parent") == F.col("anchor")).select(F.col("leaf").alias("vid"), "raw", "anchor", F.when(F.col("rank") <= F.col("half"), -1).otherwise(1).alias("side"))
    order = core.select(F.col("anchor").alias("vid"), "raw", "anchor", F.lit(0).alias("side")).unionByName(hung)
    known = order.join(props.select("vid", "degree"), "vid").join(F.broadcast(class_kappa(p, spark)), "degree").withColumn("own", F.struct("vid", "raw", "kappa"))
    by = ["raw", "anchor", "side", "vid"]
    met = ordered.before(known, by, "own", "last").withColumn("src", F.least("vid", "last.vid")).withColumn("dst", F.greatest("vid", "last.vid"))
    met = met.join(edges.select("src", "dst", F.lit(True).alias("linked")), ["src", "dst"], "left")

    def gaps(f: pd.Series, linked: pd.Series) -> pd.Series:
        return pd.Series([circle_gap(x, p.beta, bool(y), p.n) for x, y in zip(f, linked, strict=True)])

    f = F.lit(p.n / (2 * math.pi * p.mu)) / (F.col("kappa") * F.col("last.kappa"))
    model = F.pandas_udf(gaps, "double")(f, F.coalesce("linked", F.lit(False)))
    return spread_angles(met.select("vid", "raw", "anchor", "side", F.greatest(model, G.circular_distance(F.col("raw"), F.col("last.raw"))).alias("gap")), by, "gap").select("vid", "theta")


def first_sphere(edges: DataFrame, props: DataFrame, p: Params, vectors: dict[int, np.ndarray], seed: int) -> DataFrame:
    """(vid, pos): the eigenmap's directions, leaves at a drawn distance of their parents."""
    rng, out = np.random.default_rng(seed), {}
    for v in sorted(vectors):
        x = vectors[v][: p.dim + 1]
        out[v] = x / max(1e-300, np.linalg.norm(x))
    kappa = {r.vid: p.kappa[r.degree] for r in props.select("vid", "degree").collect()}
    for r in sorted(graph.leaves(edges).collect()):
        c = p.big_r / (p.mu * kappa[r.parent] * kappa[r.leaf]) ** (1 / p.dim)
        far = special.drawn_distance(rng.random(1), np.array([c]), p.beta, p.dim)[0]
        side = rng.standard_normal(p.dim)
        x = np.append(math.cos(far), math.sin(far) * side / np.linalg.norm(side))
        s = out[r.parent] + np.eye(p.dim + 1)[0]
        out[r.leaf] = 2 * s * (s @ x) / max(1e-300, s @ s) - x
    return edges.sparkSession.createDataFrame([(int(v), (x * p.big_r).tolist()) for v, x in out.items()], "vid long, pos array<double>")


def centre_of(unit: np.ndarray, kappa: np.ndarray, dim: int) -> tuple[np.ndarray, float]:
    """(weighted mean direction of neighbours, half the largest angle to one of them; at least a quarter turn on the circle)."""
    centre = (unit / kappa[:, None] ** 2).sum(0)
    centre = centre / max(1e-300, np.linalg.norm(centre))
    return centre, max(math.pi if dim == 1 else 0.0, float(np.arccos(np.clip(unit @ centre, -1, 1)).max())) / 2


def unlinked(cand: np.ndarray, i: int, others: list[int], unit: np.ndarray, kappa: np.ndarray, p: Params) -> np.ndarray:
    """What i's pairs with others, none of which is its neighbour, add to the likelihood at each candidate place."""
    x = np.maximum(p.big_r * np.arccos(np.clip(cand @ unit[others].T, -1, 1)) / (p.mu * kappa[others] * kappa[i]) ** (1 / p.dim), 1e-12)
    return -np.log1p(1 / special.power(x, p.beta)).sum(1)


def place_scores(cand: np.ndarray, i: int, unit: np.ndarray, kappa: np.ndarray, friends: list[int], p: Params) -> np.ndarray:
    """What i's pairs add to the likelihood at each candidate place."""
    scale = (p.mu * kappa * kappa[i]) ** (1 / p.dim)
    total, step = np.empty(len(cand)), max(1, 2_000_000 // len(unit))
    for lo in range(0, len(cand), step):
        x = np.maximum(p.big_r * np.arccos(np.clip(cand[lo : lo + step] @ unit.T, -1, 1)) / scale, 1e-12)
        t = -np.log1p(1 / special.power(x, p.beta))
        t[:, i] = 0
        total[lo : lo + step] = t.sum(1) - p.beta * np.log(x[:, friends]).sum(1)
    return total


@dataclass
class Near:
    """For places on the sphere, vertices that may be near: those nearest to the nearest of some landmarks, and the greatest.
    What they add to a likelihood bounds what all do from above, wherever they have moved since, as no pair adds more than 0."""

    landmarks: np.ndarray
    members: np.ndarray  # a row a landmark

    @staticmethod
    def of(unit: np.ndarray, kappa: np.ndarray, marks: int = 512, each: int = 192, great: int = 64) -> Near:
        n = len(unit)
        order = np.argsort(-kappa, kind="stable")
        top, rest = order[: min(great, n)], order[min(great, n) :]
        marked = unit[np.linspace(0, n - 1, min(marks, n)).astype(int)]
        if len(rest) <= each:
            return Near(marked, np.tile(order, (len(marked), 1)))
        close = np.stack([np.argpartition(-(unit[rest] @ m), each)[:each] for m in marked])
        return Near(marked, np.hstack([rest[close], np.tile(top, (len(marked), 1))]))


def bounded_scores(cand: np.ndarray, i: int, unit: np.ndarray, kappa: np.ndarray, friends: list[int], p: Params, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """(score, kind) of each place: kind 2 with the score of place_scores, among them the greatest; others with a bound that the
    score does not exceed: 0 by what friends add, 1 by what near vertices do, too."""
    friends_ = np.asarray(friends, np.int64)

    def x(c: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.maximum(p.big_r * np.arccos(np.clip(c, -1, 1)) / (p.mu * kappa[others] * kappa[i]) ** (1 / p.dim), 1e-12)

    score = -np.log1p(special.power(x(cand @ unit[friends_].T, friends_), p.beta)).sum(1)  # a link's own term and its pair's
    kind = np.zeros(len(cand), np.int8)
    raise_bound = 1e-9 * (1 + np.abs(score))  # rounding
    score += raise_bound
    settle(score, kind, cand, i, unit, kappa, friends, p, 1)
    left = np.flatnonzero((kind == 0) & (score >= score[kind == 2].max()))
    if len(left):
        skip = np.zeros(len(unit), bool)
        skip[friends_], skip[i] = True, True
        for part in np.array_split(left, max(1, len(left) // 512)):
            m = near.members[(cand[part] @ near.landmarks.T).argmax(1)]
            t = -np.log1p(1 / special.power(x((cand[part][:, None, :] * unit[m]).sum(2), m), p.beta))
            t[skip[m]] = 0
            score[part] += t.sum(1)
        kind[left] = 1
    settle(score, kind, cand, i, unit, kappa, friends, p)
    return score, kind


def settle(score: np.ndarray, kind: np.ndarray, cand: np.ndarray, i: int, unit: np.ndarray, kappa: np.ndarray, friends: list[int], p: Params, most: int | None = None) -> None:
    """Evaluate places by falling bound, until none could exceed the greatest score (or the most rounds)."""
    for k in range(len(cand) if most is None else most):
        best = score[kind == 2].max(initial=-math.inf)
        left = np.flatnonzero((kind < 2) & (score >= best))
        if not len(left):
            return
        size = 1 if k == 0 else 4 if k < 4 else 32
        take = left[np.argsort(-score[left], kind="stable")[:size]]
        score[take], kind[take] = place_scores(cand[take], i, unit, kappa, friends, p), 2


def neighbour_centres(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, mean, deviation) of every vertex's neighbours on the circle, as refinement takes them."""
    near = graph.adjacency(edges).join(vertices.select(F.col("vid").alias("u"), "kappa", "theta"), "u").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("u", "kappa", "theta"))).alias("x"))

    def run(batches):
        for b in batches:
            out = []
            for v, x in zip(b["v"], b["x"], strict=True):
                t = np.array([y["theta"] for y in x])
                c, d = centre_of(np.stack([np.cos(t), np.sin(t)], 1), np.array([y["kappa"] for y in x]), 1)
                out.append((v, math.atan2(c[1], c[0]) % (2 * math.pi), d))
            yield pd.DataFrame(out, columns=["vid", "mean", "deviation"])

    return near.select("v", "x").mapInPandas(run, "vid long, mean double, deviation double")


def score_places(vertices: DataFrame, edges: DataFrame, candidates: DataFrame, p: Params) -> DataFrame:
    """candidates (vid, c, theta) to (vid, c, ll), all other vertices at their places. Where hidden degrees are few, by classes;
    else places and neighbours go to the executors once, as the N^2 evaluations of a pass bound N."""
    if layout := pairs.classes(vertices, 1, None):
        return score_places_by_class(layout, vertices, edges, candidates, p)
    rows = sorted(map(tuple, vertices.select("vid", "kappa", "theta").collect()))
    at = {r[0]: i for i, r in enumerate(rows)}
    kappa, theta = (np.array([r[k] for r in rows]) for k in (1, 2))
    near: list[list[int]] = [[] for _ in rows]
    for a, b in edges.select("src", "dst").collect():
        near[at[a]].append(at[b])
        near[at[b]].append(at[a])
    sent = vertices.sparkSession.sparkContext.broadcast((at, kappa, np.stack([np.cos(theta), np.sin(theta)], 1), near))

    def run(batches):
        at, kappa, unit, near = sent.value
        for b in batches:
            out = []
            for v, cs, ts in zip(b["vid"], b["cs"], b["ts"], strict=True):
                t = np.array(ts)
                ll = place_scores(np.stack([np.cos(t), np.sin(t)], 1), at[v], unit, kappa, near[at[v]], p)
                out.append(pd.DataFrame({"vid": v, "c": cs, "ll": ll}))
            yield pd.concat(out) if out else pd.DataFrame({"vid": [], "c": [], "ll": []})

    each = candidates.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("c", "theta"))).alias("x")).select("vid", F.col("x.c").alias("cs"), F.col("x.theta").alias("ts"))
    return each.repartition(64).mapInPandas(run, "vid long, c long, ll double")


def score_places_by_class(layout: circle.Layout, vertices: DataFrame, edges: DataFrame, candidates: DataFrame, p: Params) -> DataFrame:
    """score_places by sums over classes: all vertices at the candidate places, less the vertex itself, and what links add."""
    spark, scale = vertices.sparkSession, F.lit(p.big_r / p.mu)
    own = vertices.select(F.col("vid").alias("own"), "kappa", F.col("theta").alias("held"))
    tried = stored(candidates.join(own, F.col("vid") == F.col("own")).select("vid", "c", "kappa", "theta", "held", F.monotonically_increasing_id().alias("row")), "tried")
    places = circle.Layout(tried.select("kappa", "theta", F.col("row").alias("vid")))

    def no_link(x):
        return -np.log1p(np.maximum(x, 1e-12) ** -p.beta)

    def x(a, b, k):
        return F.greatest(F.lit(1e-12), scale * G.circular_distance(F.col(a), F.col(b)) / (F.col("kappa") * F.col(k)))

    everywhere = circle.sums(layout, spark, p.big_r, p.mu, no_link, places.path, places.kinds).withColumnRenamed("vid", "row")
    itself = tried.select("row", F.log1p(F.pow(x("theta", "held", "kappa"), F.lit(-p.beta))).alias("x"))
    near = graph.adjacency(edges).join(vertices.select(F.col("vid").alias("u"), F.col("kappa").alias("ku"), F.col("theta").alias("at")), "u")
    links = tried.join(near, F.col("vid") == F.col("v")).select("row", (-F.lit(p.beta) * F.log(x("theta", "at", "ku"))).alias("x"))
    total = everywhere.unionByName(itself).unionByName(links).groupBy("row").agg(F.sum("x").alias("ll"))
    return tried.select("vid", F.col("c").cast("long").alias("c"), "row").join(total, "row").select("vid", "c", "ll")


def best_candidates(scored: DataFrame) -> DataFrame:
    """(vid, c, ll) to (vid, best, ll): the best candidate, of equal ones the least, which is the place held."""
    b = scored.groupBy("vid").agg(F.max(F.struct("ll", (-F.col("c")).alias("c"))).alias("b"))
    return b.select("vid", (-F.col("b.c")).alias("best"), F.col("b.ll").alias("ll"))


def refine(vertices: DataFrame, edges: DataFrame, layers: DataFrame, p: Params, config: EmbedConfig) -> DataFrame:
    """One pass from the inmost onion layer out: each vertex in turn takes the likeliest of candidates around its neighbours, and
    its own place, given all moves before. Beyond SEQUENTIAL vertices only candidates are evaluated in full whose bound reaches the
    best score. On spheres and beyond ALONE batches of consecutive vertices, no two of which are neighbours, are scored by tasks against the
    places before the batch; then, in order, what the batch's earlier moves change in a vertex's scores is put right. So the result
    is the one of the pass one by one, whatever the batches. Places are one array of N rows that goes with the tasks; N is bounded
    by the N^2 that a pass costs."""
    spark, dim = vertices.sparkSession, p.dim
    place = "theta" if dim == 1 else "pos"
    rows = {r.vid: (r.kappa, r[place]) for r in vertices.collect()}
    ids = np.array(sorted(rows))
    at = {v: i for i, v in enumerate(ids.tolist())}
    kappa = np.array([rows[v][0] for v in ids.tolist()])
    unit = np.array([[math.cos(rows[v][1]), math.sin(rows[v][1])] if dim == 1 else np.array(rows[v][1]) / p.big_r for v in ids.tolist()])
    near: list[list[int]] = [[] for _ in ids]
    for r in edges.collect():
        near[at[r.src]].append(at[r.dst])
        near[at[r.dst]].append(at[r.src])
    rng = np.random.default_rng(config.seed)
    order = [at[r.vid] for r in sorted(layers.collect(), key=lambda r: (-r.layer, rng.random()))]
    tries = int(config.candidates * max(1.0, math.log(len(ids))))
    seed, size = config.seed, max(1, -(-len(order) // config.batches))

    kappa_of = spark.sparkContext.broadcast(kappa)

    def candidates(i: int, unit: np.ndarray, friends: list[int]) -> np.ndarray:
        kappa = kappa_of.value
        g = np.random.default_rng([seed, i])
        centre, dev = centre_of(unit[friends], kappa[friends], dim)
        if dim == 1:
            t = math.atan2(centre[1], centre[0]) + dev * g.standard_normal(tries)
            cand = np.stack([np.cos(t), np.sin(t)], 1)
        else:
            cand = centre + dev * g.standard_normal((tries, dim + 1))
            cand /= np.linalg.norm(cand, axis=1, keepdims=True)
        if (cand == cand[:1]).all():  # a single neighbour: of one place's equal scores no bound rules out any
            cand = cand[:1]
        return np.concatenate([unit[i][None, :], cand])

    if len(order) <= SEQUENTIAL:
        for i in order:
            cand = candidates(i, unit, near[i])
            unit[i] = cand[int(place_scores(cand, i, unit, kappa, near[i], p).argmax())]
    elif dim == 1 and len(order) <= ALONE:
        for k, i in enumerate(order):
            if k % size == 0:
                around = Near.of(unit, kappa)
            cand = candidates(i, unit, near[i])
            score, kind = bounded_scores(cand, i, unit, kappa, near[i], p, around)
            unit[i] = cand[int(np.where(kind == 2, score, -math.inf).argmax())]
    else:
        sc = spark.sparkContext
        near_of, around, done = sc.broadcast(near), None, 0
        at_, reach = 0, len(order)
        while at_ < reach:
            if around is None or at_ - done >= size:
                around, done = sc.broadcast(Near.of(unit, kappa)), at_
            group, close = [], set()
            while at_ < reach and len(group) < size and order[at_] not in close:
                group.append(order[at_])
                close.update(near[order[at_]])
                at_ += 1
            before = sc.broadcast(unit.copy())

            def scored(i: int, before=before, around=around) -> tuple[np.ndarray, np.ndarray]:
                places, friends = before.value, near_of.value[i]
                return bounded_scores(candidates(i, places, friends), i, places, kappa_of.value, friends, p, around.value)

            found = sc.parallelize(group, min(len(group), 64)).map(scored).collect()  # of one batch
            moved: list[int] = []
            for i, (score, kind) in zip(group, found, strict=True):
                cand = candidates(i, unit, near[i])  # no neighbour is in the batch: as the task saw them
                if moved and (by := np.flatnonzero(kind)).size:  # a friends' bound holds wherever others are
                    score[by] += unlinked(cand[by], i, moved, unit, kappa, p) - unlinked(cand[by], i, moved, before.value, kappa, p)
                    settle(score, kind, cand, i, unit, kappa, near[i], p)
                k = int(np.where(kind == 2, score, -math.inf).argmax())
                if k:
                    unit[i] = cand[k]
                    moved.append(i)
            before.unpersist()
    out = [(int(v), float(k), float(math.atan2(x[1], x[0]) % (2 * math.pi)) if dim == 1 else (x * p.big_r).tolist()) for v, k, x in zip(ids, kappa, unit, strict=True)]
    return spark.createDataFrame(out, f"vid long, kappa double, {place} {'double' if dim == 1 else 'array<double>'}")


def with_radius(vertices: DataFrame, p: Params) -> DataFrame:
    """vertices with hyp_rad, all shifted up where the least would be negative."""
    low, high = vertices.agg(F.min("kappa"), F.max("kappa")).first()
    r = G.hyperbolic_radius(F.col("kappa"), low, p.dim, p.n, p.mu)
    least = vertices.where(F.col("kappa") == high).select(r.alias("r")).first()[0]
    return vertices.withColumn("hyp_rad", G.hyperbolic_radius(F.col("kappa"), low, p.dim, p.n, p.mu, max(0.0, -least)))


def embed(edges: DataFrame, config: EmbedConfig | None = None, start: tuple[DataFrame, Params] | None = None) -> Embedding:
    """edges (src, dst) of one component - else MultipleComponentsError - to coordinates; start resumes from earlier ones."""
    config = config or EmbedConfig()
    clock, timings = time.perf_counter(), {}

    def mark(name: str) -> None:
        nonlocal clock
        timings[name], clock = time.perf_counter() - clock, time.perf_counter()
        log.info("%-12s %10.2f seconds", name, timings[name])

    for option, value in asdict(config).items():
        log.info("%-12s %s", option, value)
    edges = stored(edges.select("src", "dst"), "edges")
    graph.require_connected(edges)
    props = stored(graph.properties(edges), "properties")
    mark("initialise")
    degree = props.select("vid", "degree")
    if start:
        now, p = start
    else:
        c = props.where("degree > 1").agg(F.avg("clustering")).first()[0] or 0.0
        p = infer.infer_parameters(graph.class_spectra(props), c, config.dim, config.beta, config.seed)
        mark("parameters")
        spark = edges.sparkSession
        if config.only_kappas:
            return Embedding(degree.join(F.broadcast(class_kappa(p, spark)), "degree").select("vid", "kappa"), p, timings)
        vectors = eigenmap(weights(edges, props, p), config.dim, config.seed)
        places = first_circle(edges, props, p, vectors) if config.dim == 1 else first_sphere(edges, props, p, vectors, config.seed)
        place = "theta" if config.dim == 1 else "pos"
        now = stored(places.join(degree, "vid").join(F.broadcast(class_kappa(p, spark)), "degree").select("vid", "kappa", place), "places")
        mark("positions")
    if not config.fast:
        now = refine(stored(now, "start"), edges, graph.onion(edges), p, config)
        mark("refine")
    if config.post_beta:
        now, p = infer.refit_beta(now, degree, p, config.seed)
    elif config.post_kappa:
        now = infer.refit_kappas(now, degree, p, config.seed)
    mark("kappas")
    return Embedding(with_radius(now, p), p, timings)


def theta_density(vertices: DataFrame, bins: int = 25) -> DataFrame:
    """bin, n, theta (the bin's centre), inf_density, th_density, of every bin."""
    n = vertices.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("theta") / F.lit(2 * math.pi / bins))).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    total = vertices.count()
    return vertices.sparkSession.range(bins).withColumnRenamed("id", "bin").join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), ((F.col("bin") + 0.5) * F.lit(2 * math.pi / bins)).alias("theta"), (F.coalesce("n", F.lit(0)) / F.lit(max(1, total))).alias("inf_density"), F.lit(1.0 / bins).alias("th_density"))


def theta_histogram(vertices: DataFrame, bins: int = 25) -> DataFrame:
    """bin, n, low (the bin's lower end), theta (the mean angle in it), share, of the bins that hold a vertex; the last bin holds its upper end."""
    width = 2 * math.pi / bins
    n = vertices.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("theta") / F.lit(width))).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("theta").alias("theta"))
    return n.select("bin", "n", (F.col("bin") * F.lit(width)).alias("low"), "theta", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))  # a row a bin


def log_likelihood(vertices: DataFrame, edges: DataFrame, p: Params) -> float:
    return pairs.vertex_log_likelihood(vertices, edges, p.dim, p.beta, p.big_r, p.mu, p.n).agg(F.sum("ll")).first()[0] / 2
