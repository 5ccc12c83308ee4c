"""Rotations that bring two coordinate sets together: candidates are rows, each scored by a NumPy kernel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of the first block in which a turn is scored, and of the largest.
FIRST, LARGEST = 32, 8192


def rotation_to_first(v: np.ndarray) -> np.ndarray:
    """A rotation that takes v's direction to the first axis."""
    n = len(v)
    u = v / np.linalg.norm(v)
    e = np.eye(n)[0]
    s = u + e
    if s @ s < 1e-24:
        m = np.eye(n)
        m[0, 0] = m[1, 1] = -1
        return m
    return 2 * np.outer(s, s) / (s @ s) - np.eye(n)


def spin(n: int, i: int, j: int, t: float) -> np.ndarray:
    """A turn by t in the plane of axes i and j."""
    m = np.eye(n)
    m[i, i] = m[j, j] = math.cos(t)
    m[i, j], m[j, i] = -math.sin(t), math.sin(t)
    return m


def euler(a: float, b: float, c: float) -> np.ndarray:
    return spin(3, 0, 1, c) @ spin(3, 2, 0, b) @ spin(3, 1, 2, a)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1), -1, 1))


def paired(real: DataFrame, inferred: DataFrame, cutoff_percent: float = 0.5, min_degree: int | None = None) -> DataFrame:
    """real (name, pos, realdeg) and inferred (name, pos) met by name: (name, real, inf) of degrees from the cutoff."""
    top = real.agg(F.max("realdeg")).first()[0] or 0
    least = min_degree if min_degree is not None else top * cutoff_percent / 100
    return real.where(F.col("realdeg") >= least).select("name", F.col("pos").alias("real")).join(inferred.select("name", F.col("pos").alias("inf")), "name")


def inverse(m: np.ndarray) -> np.ndarray:
    """The rotation back."""
    return m.T


def mean_distances(pairs: DataFrame, turns: np.ndarray) -> DataFrame:
    """pairs (real, inf) to (k, distance): the mean angular distance of both sets after turn k of the second. Sums of batches,
    a row a turn, meet in one shuffle."""

    def run(batches):
        for b in batches:
            if len(b):
                x, y = np.array(b["real"].tolist()), np.array(b["inf"].tolist())
                yield pd.DataFrame({"k": np.arange(len(turns)), "s": [distances(x, y @ t.T).sum() for t in turns], "n": len(b)})

    sums = pairs.select("real", "inf").mapInPandas(run, "k long, s double, n long")
    return sums.groupBy("k").agg((F.sum("s") / F.sum("n")).alias("distance"))


def least_mean(x: np.ndarray, y: np.ndarray, turns: np.ndarray, bound: float) -> tuple[int, float]:
    """The turn of y (unit rows) that brings it nearest to x, and the mean angular distance then; (-1, inf) where none stays
    within bound. Points go in growing blocks, and a turn goes as soon as its sum exceeds what bound allows on all points:
    as distances are not negative, no turn within bound is lost."""
    alive, sums, lo, size = np.arange(len(turns)), np.zeros(len(turns)), 0, FIRST
    limit = bound * len(x) * (1 + 1e-9)
    while lo < len(x) and len(alive):
        a, b = x[lo : lo + size], y[lo : lo + size]
        sums = sums + np.array([distances(a, b @ t.T).sum() for t in turns[alive]])
        stay = ~(sums > limit)
        alive, sums = alive[stay], sums[stay]
        lo, size = lo + size, min(LARGEST, 4 * size)
    if not len(alive):
        return -1, math.inf
    k = int(np.argmin(sums))
    return int(alive[k]), float(sums[k] / len(x))


def align(pairs: DataFrame, spins: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """(rotation of the real set, rotation of the inferred set, mean angular distance): every vertex in turn goes to the
    first axis in both sets, the inferred set spins about it. All N matched points are candidates and are compared; both
    sets are one array of N rows each that goes to the executors once, as N^2 comparisons bound N. A candidate that cannot
    beat the best so far is left before its last point."""
    rows = sorted(pairs.collect())
    real, inf = np.array([r.real for r in rows]), np.array([r.inf for r in rows])
    real, inf = real / np.linalg.norm(real, axis=1, keepdims=True), inf / np.linalg.norm(inf, axis=1, keepdims=True)
    d = real.shape[1]
    angles = np.linspace(0, 2 * math.pi, spins)
    turns = np.array([spin(d, d - 2, d - 1, t) for t in angles] if d == 3 else [spin(d, 1, 2, a) @ spin(d, 2, 3, b) for a in angles[:: max(1, spins // 20)] for b in angles[:: max(1, spins // 20)]])
    spark = pairs.sparkSession
    sets = spark.sparkContext.broadcast((real, inf))

    def run(batches):
        real, inf = sets.value
        bound = math.inf
        for b in batches:
            for i in b["id"]:
                a, c = rotation_to_first(real[i]), rotation_to_first(inf[i])
                # the turns go with the candidate's rotation, so that only the points looked at are turned
                k, score = least_mean(real, inf, np.array([a.T @ t @ c for t in turns]), bound)
                if k >= 0:
                    bound = min(bound, score)
                    yield pd.DataFrame({"i": [i], "k": [k], "score": [score]})

    best = spark.range(len(rows)).repartition(max(1, min(len(rows), 64))).mapInPandas(run, "i long, k int, score double").orderBy("score", "i").first()
    return rotation_to_first(real[best.i]), turns[best.k] @ rotation_to_first(inf[best.i]), best.score


def align_files(spark, real: str, inferred: str, dim: int = 2, cutoff_percent: float = 0.5, spins: int = 50, min_degree: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """align() of two coordinate files, the first with degrees."""
    from horosphere.sources import text

    return align(paired(text.read_positions(spark, real, dim, True), text.read_positions(spark, inferred, dim), cutoff_percent, min_degree).select("name", "real", "inf"), spins)


def align_files_with_labels(spark, real: str, inferred: str, labels: str, dim: int = 2, cutoff_percent: float = 0.5, spins: int = 50) -> tuple[tuple[np.ndarray, np.ndarray, float], DataFrame]:
    """align_files(), and (name, real, inf, label) of the points met."""
    from horosphere.sources import text

    met = paired(text.read_positions(spark, real, dim, True), text.read_positions(spark, inferred, dim), cutoff_percent)
    return align(met.select("name", "real", "inf"), spins), text.with_labels(met, text.read_labels(spark, labels))


def spherical(x: np.ndarray) -> np.ndarray:
    """Hyperspherical angles of rows; the last in [0, 2 pi)."""
    tail = np.sqrt(np.cumsum((x**2)[:, ::-1], axis=1)[:, ::-1])
    a = np.arccos(np.clip(x[:, :-1] / np.maximum(tail[:, :-1], 1e-300), -1, 1))
    a[:, -1] = np.where(x[:, -1] < 0, 2 * math.pi - a[:, -1], a[:, -1])
    return a


def fix_spin(real: np.ndarray, inf: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Both sets (3-vectors) spun about the first axis to the greatest Pearson correlation of the last angles, the inferred
    set's angles mirrored where a correlation is negative: (angles of the real set, angles of the inferred set)."""
    best = max((spin(3, 1, 2, t) for t in np.linspace(0, 2 * math.pi, steps)), key=lambda m: abs(np.corrcoef(spherical(real @ m.T)[:, 1], spherical(inf @ m.T)[:, 1])[0, 1]))
    a, b = spherical(real @ best.T), spherical(inf @ best.T)
    if np.corrcoef(a[:, 0], b[:, 0])[0, 1] < 0:
        b[:, 0] = math.pi - b[:, 0]
    if np.corrcoef(a[:, 1], b[:, 1])[0, 1] < 0:
        b[:, 1] = 2 * math.pi - b[:, 1]
    return a, b


def euler_scan(real: np.ndarray, inf: np.ndarray, steps: int = 20, euclidean: bool = False) -> np.ndarray:
    """The turn, of steps^3 Euler angles applied to both sets, of the greatest correlation: of the last angle, or summed over axes."""

    def score(m: np.ndarray) -> float:
        x, y = real @ m.T, inf @ m.T
        if euclidean:
            return sum(abs(np.corrcoef(x[:, i], y[:, i])[0, 1]) for i in range(3))
        return abs(np.corrcoef(spherical(x)[:, 1], spherical(y)[:, 1])[0, 1])

    grid = np.linspace(0, 2 * math.pi, steps)
    return max((euler(a, b, c) for a in grid for b in grid for c in grid), key=score)


def apply(coordinates: DataFrame, m: np.ndarray, column: str = "pos") -> DataFrame:
    """The rotation fitted on some vertices, on all."""
    from horosphere.functions.geometry import apply_rows

    return coordinates.withColumn(column, apply_rows(m.tolist(), F.col(column)))
