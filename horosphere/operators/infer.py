"""Inference of the model's parameters. On degree classes, whose number is small, in NumPy on the driver; on vertices, by the all-pairs operators."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.functions import geometry as G
from horosphere.functions import special
from horosphere.operators import graph, pairs
from horosphere.sources.shared import stored

log = logging.getLogger(__name__)


@dataclass
class Params:
    dim: int
    beta: float
    mu: float
    n: int
    mean_degree: float
    clustering: float = 0.0
    kappa: dict[int, float] = field(default_factory=dict)  # by degree

    @property
    def big_r(self) -> float:
        return G.radius(self.dim, self.n)


def class_degrees(kappa: np.ndarray, n_k: np.ndarray, mu: float, beta: float, dim: int, compat: bool = False, integral=special.linked_probability) -> np.ndarray:
    """Expected degree of each class: the others of its own class, and all of the other classes."""
    p = integral(kappa[:, None], kappa[None, :], float(n_k.sum()), mu, beta, dim, compat)
    return p @ n_k - np.diag(p)


def class_kappas(k: np.ndarray, n_k: np.ndarray, beta: float, dim: int, rng, tol: float = 1e-2, rounds: int = 500, compat: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """(kappa, expected degree) of each degree class, and mu."""
    mu = G.density(dim, beta, float((k * n_k).sum() / n_k.sum()))
    kappa = k.astype(float)
    for _ in range(rounds):
        exp = class_degrees(kappa, n_k, mu, beta, dim, compat)
        if np.abs(exp - k).max() <= tol:
            break
        kappa = np.abs(kappa + (k - exp) * rng.random(len(k)))
    else:
        log.warning("class degrees did not converge in %d rounds", rounds)
    return kappa, exp, mu


def cumulated(weight: np.ndarray) -> np.ndarray:
    """Rows of weights to cumulated shares, the last 1; shares of at most 1e-10 are dropped."""
    p = weight / weight.sum(1, keepdims=True)
    p[p <= 1e-10] = 0
    c = p.cumsum(1)
    return c / c[:, -1:]


def drawn_class(steps: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The first place at which the cumulated shares reach u; beyond the last, the last."""
    return np.minimum(np.searchsorted(steps, u), len(steps) - 1)


def draw_neighbours(vertices: DataFrame, k: np.ndarray, cdf: np.ndarray) -> DataFrame:
    """vertices (vid, k, u) to (vid, k2): a neighbour's class for each; cdf has a row and a column for each class k."""
    at = {int(x): i for i, x in enumerate(k)}

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"vid": b["vid"], "k2": [int(k[drawn_class(cdf[at[c]], u)]) for c, u in zip(b["k"], b["u"], strict=True)]})

    return vertices.select("vid", "k", "u").mapInPandas(run, "vid long, k2 long")


def neighbour_cdf(k: np.ndarray, n_k: np.ndarray, kappa: np.ndarray, mu: float, beta: float, dim: int) -> np.ndarray:
    """(class, neighbour's class) cumulated probabilities, the last 1; entries of at most 1e-10 are dropped."""
    return cumulated(special.linked_probability(kappa[:, None], kappa[None, :], float(n_k.sum()), mu, beta, dim) * n_k)


def class_clustering(k: np.ndarray, n_k: np.ndarray, kappa: np.ndarray, mu: float, beta: float, dim: int, rng, points: int = 600) -> np.ndarray:
    """Expected local clustering of each class of degree over 1, by Monte Carlo; 0 of others."""
    n, big_r = float(n_k.sum()), G.radius(dim, float(n_k.sum()))
    cdf, out = neighbour_cdf(k, n_k, kappa, mu, beta, dim), np.zeros(len(k))
    for i in np.flatnonzero(k > 1):
        a, b = (drawn_class(cdf[i], rng.random(points)) for _ in range(2))
        scale = lambda x, y: big_r / (mu * x * y) ** (1 / dim)
        za, zb = (special.drawn_distance(rng.random(points), scale(kappa[i], kappa[c]), beta, dim) for c in (a, b))
        if dim == 1:
            d = np.where(rng.random(points) < 0.5, za + zb, np.abs(za - zb))
            d = np.minimum(d, 2 * math.pi - d)
        else:
            side = rng.standard_normal((2, points, dim))
            side /= np.linalg.norm(side, axis=2, keepdims=True)
            d = np.arccos(np.clip(np.cos(za) * np.cos(zb) + np.sin(za) * np.sin(zb) * (side[0] * side[1]).sum(1), -1, 1))
        x = scale(kappa[a], kappa[b]) * d
        out[i] = np.where(d < 1e-10, 1.0, 1 / (1 + x**beta)).mean()
    return out


def search_beta(evaluate, target: float, start: float, low: float, high: float, tol: float) -> float:
    """Bracket and bisect for evaluate(beta) near target; evaluate rises with beta. The beta returned is the last one that was
    evaluated, so that what evaluate keeps belongs to it."""
    beta, lo, hi = start, low, None
    for _ in range(60):
        got, done = evaluate(beta), beta
        if abs(got - target) < tol:
            return done
        if got > target:
            hi = beta
            beta = (hi + lo) / 2
            if beta < low + 0.01:
                log.warning("beta at its lower bound")
                evaluate(low + 0.01)
                return low + 0.01
        else:
            lo = beta
            beta = 1.5 * beta if hi is None else (hi + lo) / 2
            if beta > high:
                log.warning("beta at its upper bound")
                evaluate(high)
                return high
    log.warning("clustering did not converge in 60 rounds")
    return done


def infer_parameters(classes: DataFrame, clustering: float, dim: int = 1, beta: float | None = None, seed: int = 1, tol: float = 1e-2) -> Params:
    """classes (degree, n_k) - a row a class - to beta, mu and kappa by degree."""
    rows = sorted((r.degree, r.n_k) for r in classes.select("degree", "n_k").collect())
    k, n_k = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    state: dict = {}

    def evaluate(b: float) -> float:
        rng = np.random.default_rng([seed, 1])
        kappa, _, mu = class_kappas(k, n_k, b, dim, rng)
        c = class_clustering(k, n_k, kappa, mu, b, dim, rng)
        state.update(kappa=kappa, mu=mu)
        return float((c * n_k).sum() / max(1.0, n_k[k > 1].sum()))

    if beta is None:
        beta = search_beta(evaluate, clustering, max(2, dim) + np.random.default_rng(seed).random(), float(max(1, dim)), 25.0 if dim == 1 else dim + 100.0, tol)
    else:
        evaluate(beta)
    n = int(n_k.sum())
    return Params(dim, beta, state["mu"], n, float((k * n_k).sum() / n), clustering, dict(zip(k.astype(int).tolist(), state["kappa"].tolist(), strict=True)))


def refit_kappas(vertices: DataFrame, degree: DataFrame, p: Params, seed: int = 1, tol: float = 0.5, rounds: int = 500) -> DataFrame:
    """vertices with kappa refitted at their positions until each expected degree is within tol of the degree. Places go to the
    executors once and kappas with every round, as arrays of N numbers, which the N^2 evaluations of a round bound."""
    spark, place = vertices.sparkSession, "theta" if p.dim == 1 else "pos"
    rows = vertices.join(degree, "vid").select("vid", F.col("kappa").cast("double").alias("kappa"), F.col("degree").cast("double").alias("degree"), place).toArrow().combine_chunks().sort_by("vid")
    vid, kappa, due = (rows[c].to_numpy() for c in ("vid", "kappa", "degree"))
    at = rows[place].to_numpy() if p.dim == 1 else rows[place].combine_chunks().flatten().to_numpy().reshape(len(vid), -1)
    sent = spark.sparkContext.broadcast(at)
    for r in range(rounds):
        exp = pairs.expected_at(spark, sent, kappa, p.dim, p.beta, p.big_r, p.mu)
        if not len(vid) or np.abs(exp - due).max() <= tol:
            break
        kappa = np.abs(kappa + (due - exp) * pairs.uniforms(vid, seed * 1000 + r))
    else:
        log.warning("vertex degrees did not converge in %d rounds", rounds)
    sent.unpersist()
    got = spark.createDataFrame(pa.table({"vid": vid, "kappa": kappa}), "vid long, kappa double")
    return stored(vertices.select(F.col("vid"), place).join(got, "vid").select("vid", "kappa", place), "kappas")


def refit_beta(vertices: DataFrame, degree: DataFrame, p: Params, seed: int = 1, graphs: int = 5, tol: float = 0.05) -> tuple[DataFrame, Params]:
    """Joint refit of beta and kappas against the clustering of simulated graphs at fixed positions."""
    state: dict = {}
    many = degree.where("degree > 1").count()

    def evaluate(b: float) -> float:
        q = Params(p.dim, b, G.density(p.dim, b, p.mean_degree), p.n, p.mean_degree, p.clustering)
        v = refit_kappas(vertices, degree, q, seed)
        sim = stored(pairs.simulate(v, q.dim, b, q.big_r, q.mu, graphs, seed, q.n), "simulated")
        d = sim.select("g", F.explode(F.array("src", "dst")).alias("vid")).groupBy("g", "vid").agg(F.count("*").alias("k"))
        t = graph.triangles(sim, "g").join(d, ["g", "vid"]).where("k > 1")
        state.update(v=v, q=q)
        return float(t.agg(F.sum(2.0 * F.col("nb_triang") / (F.col("k") * (F.col("k") - 1)))).first()[0] or 0.0) / graphs / max(1, many)

    search_beta(evaluate, p.clustering, p.beta, float(max(1, p.dim)), 25.0 if p.dim == 1 else p.dim + 100.0, tol)
    return state["v"], state["q"]
