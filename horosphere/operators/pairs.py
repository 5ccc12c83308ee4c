"""Sums over all pairs of vertices.

On the circle, more than DIRECT vertices of few distinct hidden degrees are summed by classes (circle.py), at a cost that grows
with N times the classes. All others go by blocks:
Vertices are packed into blocks of arrays, which lie in the shared folder in SIDES runs; a task reads two runs, and one NumPy
kernel sums each pair of their blocks. No row per pair is ever made, nothing is broadcast, no block is shuffled for each block it
meets, and what a task sums is one row a vertex before it is shuffled. What N vertices cost - N^2 evaluations - is the
operator's own; blocks spread it evenly.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.functions.special import power, power_into
from horosphere.operators import circle
from horosphere.sources.shared import new_path, read_arrow

BLOCK = 2048
#: Runs of blocks, of which every two are a task.
SIDES = 16
#: Vertices up to which all pairs are evaluated whatever the classes.
DIRECT = 1000


def classes(vertices: DataFrame, dim: int, count: int | None) -> circle.Layout | None:
    """Vertices of the circle laid out by class, where classes are few."""
    if dim != 1 or (vertices.count() if count is None else count) <= DIRECT:
        return None
    layout = circle.Layout(vertices)
    return layout if layout.few else None


def packed(vertices: DataFrame, columns: list[str], count: int) -> DataFrame:
    """A row (block, and an array for each column) for each block of about BLOCK vertices."""
    blocks = max(1, -(-count // BLOCK))
    part = F.pmod(F.xxhash64("vid"), F.lit(blocks)).cast("int")
    rows = F.sort_array(F.collect_list(F.struct("vid", *columns)))  # a block is bounded by its making
    return vertices.withColumn("block", part).groupBy("block").agg(rows.alias("rows")).select("block", *(F.col(f"rows.{c}").alias(c) for c in ["vid", *columns]))


def laid_out(blocks: DataFrame, count: int) -> tuple[str, int]:
    """(path, number) of at most SIDES runs of blocks, each in files of its own: pairs of runs are read by tasks, so that no
    block is copied for every block it meets."""
    n = max(1, -(-count // BLOCK))
    each = -(-n // SIDES)
    sides = -(-n // each)
    path = new_path(blocks.sparkSession, "blocks")
    blocks.withColumn("side", F.floor(F.col("block") / each).cast("int")).repartitionByRange(sides, "side").write.parquet(path)
    return path, sides


def angles(row: dict, dim: int) -> np.ndarray:
    """Angular distances of all vertices of block a (rows) and b (columns)."""
    if dim == 1:
        ta, tb = row["theta_a"], row["theta_b"]
        return np.pi - np.abs(np.pi - np.abs(ta[:, None] - tb[None, :]))
    pa_, pb = row["pos_a"], row["pos_b"]
    cos = (pa_ @ pb.T) / np.linalg.norm(pa_, axis=1)[:, None] / np.linalg.norm(pb, axis=1)[None, :]
    return np.where(np.abs(cos - 1) < 1e-10, 0.0, np.arccos(np.clip(cos, -1, 1)))


def rescaled(row: dict, dim: int, big_r: float, mu: float) -> np.ndarray:
    ka, kb = row["kappa_a"], row["kappa_b"]
    return big_r * angles(row, dim) / (mu * ka[:, None] * kb[None, :]) ** (1 / dim)


def upper(row: dict) -> np.ndarray:
    """Whether a pair counts: each unordered pair once."""
    n, m = len(row["vid_a"]), len(row["vid_b"])
    return np.triu(np.ones((n, m), bool), 1) if row["block_a"] == row["block_b"] else np.ones((n, m), bool)


def _row(batch: pa.RecordBatch, i: int) -> dict:
    """A row's numbers, and its arrays of numbers or of equally long arrays as NumPy's."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        x = column[i]
        if not pa.types.is_list(column.type):
            out[name] = x.as_py()
        elif pa.types.is_list(column.type.value_type):
            out[name] = x.values.flatten().to_numpy(zero_copy_only=False).reshape(len(x.values), -1)
        else:
            out[name] = x.values.to_numpy(zero_copy_only=False)
    return out


def both_sums(row: dict, x: np.ndarray) -> dict:
    """What all pairs of two blocks add to each vertex."""
    return {"vid": np.append(row["vid_a"], row["vid_b"]), "x": np.append(x.sum(1), x.sum(0))}


def over_pairs(vertices: DataFrame, dim: int, kernel: Callable[[dict], dict], schema: str, count: int | None = None) -> DataFrame:
    """What kernel makes, as arrays by column, of every pair of blocks of vertices (vid, kappa, theta or pos)."""
    count = vertices.count() if count is None else count
    place = "theta" if dim == 1 else "pos"
    path, sides = laid_out(packed(vertices.select("vid", "kappa", place), ["kappa", place], count), count)
    columns = ["block", "vid", "kappa", place]
    kind = vertices.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def side(k: int) -> list[dict]:
        got = read_arrow(path, columns, ("side", k)).combine_chunks()
        return sorted((_row(b, i) for b in got.to_batches() for i in range(len(b))), key=lambda r: r["block"])

    def run(batches):
        for b in batches:
            for job in b.to_pylist():
                left = side(job["a"])
                right = left if job["a"] == job["b"] else side(job["b"])
                for x in left:
                    for y in right:
                        if x["block"] <= y["block"]:
                            made = kernel({**{f"{k}_a": v for k, v in x.items()}, **{f"{k}_b": v for k, v in y.items()}})
                            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    spark = vertices.sparkSession
    jobs = [(a, b) for a in range(sides) for b in range(a, sides)]
    return spark.sparkContext.parallelize(jobs, len(jobs)).toDF("a int, b int").mapInArrow(run, schema)


def expected_degrees(vertices: DataFrame, dim: int, beta: float, big_r: float, mu: float, count: int | None = None) -> DataFrame:
    """vid, exp_deg: the sum of connection probabilities to all others."""
    if layout := classes(vertices, dim, count):
        return circle.sums(layout, vertices.sparkSession, big_r, mu, lambda x: 1 / (1 + x**beta)).withColumnRenamed("x", "exp_deg").groupBy("vid").agg(F.sum("exp_deg").alias("exp_deg"))

    def kernel(row):
        p = np.where(upper(row), 1 / (1 + rescaled(row, dim, big_r, mu) ** beta), 0)
        return both_sums(row, p)

    return over_pairs(vertices, dim, kernel, "vid long, x double", count).groupBy("vid").agg(F.sum("x").alias("exp_deg"))


def expected_at(spark, places, kappa: np.ndarray, dim: int, beta: float, big_r: float, mu: float) -> np.ndarray:
    """expected_degrees of vertices by their number, places (a broadcast array of angles, or of points) and hidden degrees: tasks
    take runs of rows against all later ones in tiles that stay in a core's cache."""
    n, tile, wide = len(kappa), 64, 512
    weight = kappa ** (-beta / dim)  # x^beta is the product of both ends' and of their distance's
    sent, unit = spark.sparkContext.broadcast(weight), power(np.array([big_r / mu ** (1 / dim)]), beta)[0]

    def work(jobs):
        at, u, total = places.value, sent.value, np.zeros(n)
        if dim > 1:
            at = at / np.linalg.norm(at, axis=1, keepdims=True)
        room = [np.empty(tile * wide) for _ in range(3)]  # used again for every tile
        for lo in jobs:
            hi = min(n, lo + tile)
            own = unit * u[lo:hi, None]
            for a in range(lo, n, wide):
                b = min(n, a + wide)
                d, x, spare = (r[: (hi - lo) * (b - a)].reshape(hi - lo, b - a) for r in room)
                if dim == 1:
                    np.subtract(at[lo:hi, None], at[None, a:b], out=d)
                    for _ in range(2):
                        np.abs(d, out=d)
                        np.subtract(np.pi, d, out=d)
                else:
                    np.matmul(at[lo:hi], at[a:b].T, out=x)
                    np.arccos(np.clip(x, -1, 1, out=d), out=d)
                    d[np.abs(x - 1) < 1e-10] = 0
                power_into(d, beta, x, spare)
                x *= own
                x *= u[None, a:b]
                x += 1
                np.divide(1, x, out=x)
                if a < hi:  # each unordered pair once
                    x[np.arange(a, b)[None, :] <= np.arange(lo, hi)[:, None]] = 0
                total[lo:hi] += x.sum(1)
                total[a:b] += x.sum(0)
        return [total]

    starts = list(range(0, n, tile))
    tasks = max(1, min(len(starts) // 4, 32))
    order = [lo for k in range(tasks) for lo in starts[k::tasks]]  # long and short rows in every task
    got = spark.sparkContext.parallelize(order, tasks).mapPartitions(work)
    total = np.zeros(n)
    for part in got.toLocalIterator() if n > 1_000_000 else got.collect():
        total += part
    sent.unpersist()
    return total


def uniforms(keys: np.ndarray, salt: int) -> np.ndarray:
    """geometry.uniform of whole numbers."""
    import hashlib

    return np.array([int(hashlib.md5(f"{k}:{salt}".encode()).hexdigest()[:8], 16) / 4294967296.0 for k in keys.tolist()])


def vertex_log_likelihood(vertices: DataFrame, edges: DataFrame, dim: int, beta: float, big_r: float, mu: float, count: int | None = None) -> DataFrame:
    """vid, ll: the term of no link over all pairs, and what each link adds, as two sums; of two vertices in one place minus
    infinity, since there the model draws every link."""
    from horosphere.functions import geometry as G

    def no_link(x):
        with np.errstate(over="ignore"):
            return -np.log1p(np.maximum(x, 1e-300) ** -beta)

    def kernel(row):
        return both_sums(row, np.where(upper(row), no_link(rescaled(row, dim, big_r, mu)), 0))

    if layout := classes(vertices, dim, count):
        everywhere = circle.sums(layout, vertices.sparkSession, big_r, mu, no_link)
    else:
        everywhere = over_pairs(vertices, dim, kernel, "vid long, x double", count)
    x = with_ends(edges, vertices, dim)
    gain = -F.lit(beta) * F.log(F.greatest(F.lit(1e-300), G.chi(F.col("distance"), F.col("ka"), F.col("kb"), dim, big_r, mu)))
    links = x.select(F.explode(F.array("src", "dst")).alias("vid"), gain.alias("x"))
    return everywhere.unionByName(links).groupBy("vid").agg(F.sum("x").alias("ll"))


def with_ends(edges: DataFrame, vertices: DataFrame, dim: int) -> DataFrame:
    """edges with ka, kb and the angular distance of their ends."""
    from horosphere.functions import geometry as G

    place = "theta" if dim == 1 else "pos"
    a = vertices.select(F.col("vid").alias("src"), F.col("kappa").alias("ka"), F.col(place).alias("pa"))
    b = vertices.select(F.col("vid").alias("dst"), F.col("kappa").alias("kb"), F.col(place).alias("pb"))
    d = G.circular_distance(F.col("pa"), F.col("pb")) if dim == 1 else G.angle(F.col("pa"), F.col("pb"))
    return edges.join(a, "src").join(b, "dst").withColumn("distance", d)


def link_probabilities(edges: DataFrame, vertices: DataFrame, dim: int, beta: float, big_r: float, mu: float) -> DataFrame:
    """(src, dst, p) of every edge."""
    from horosphere.functions import geometry as G

    return with_ends(edges, vertices, dim).select("src", "dst", G.probability(G.chi(F.col("distance"), F.col("ka"), F.col("kb"), dim, big_r, mu), beta).alias("p"))


def strong_links(links: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Of links (src, dst, p): those that the model finds likely, for drawing; and (weak), the number of the others."""
    return links.where(F.col("p") >= least), links.agg(F.count_if(F.col("p") < least).alias("weak"))


def log_histogram(vertices: DataFrame, edges: DataFrame, dim: int, beta: float, big_r: float, mu: float, bins: int = 99, count: int | None = None) -> DataFrame:
    """bin, n, rescaled_dist, conn_prob of the bins, even in the logarithm between the decades that bound the data, that hold a
    pair, over all ordered pairs. A first pass over the pairs finds the bounds."""
    from horosphere.functions import geometry as G

    def ends(row):
        x = rescaled(row, dim, big_r, mu)[upper(row)]
        x = x[x > 0]
        return {"low": [float(x.min())], "high": [float(x.max())]} if len(x) else {"low": [], "high": []}

    spark = vertices.sparkSession
    if layout := classes(vertices, dim, count):
        low, high = circle.bounds(layout, spark, big_r, mu) or (None, None)
    else:
        low, high = over_pairs(vertices, dim, ends, "low double, high double", count).agg(F.min("low"), F.max("high")).first()
    if low is None:
        return spark.createDataFrame([], "bin int, n long, rescaled_dist double, conn_prob double")
    edge = np.logspace(math.floor(math.log10(low)), math.ceil(math.log10(high)), bins + 1)

    def kernel(row):
        x = rescaled(row, dim, big_r, mu)[upper(row)]
        x = x[(x >= edge[0]) & (x <= edge[-1])]
        k = np.minimum(np.searchsorted(edge, x, side="right") - 1, bins - 1)
        n, s = np.bincount(k, minlength=bins), np.bincount(k, x, minlength=bins)
        at = np.flatnonzero(n)
        return {"bin": at, "n": 2 * n[at], "x": 2 * s[at]}

    def bin_of(x):
        return np.where(x < edge[0], -1, np.where(x > edge[-1], bins, np.minimum(np.searchsorted(edge, x, side="right") - 1, bins - 1)))

    if layout:
        every = circle.histogram(layout, spark, big_r, mu, edge[1:], bin_of, bins).select("bin", (2 * F.col("n")).alias("n"), (2 * F.col("x")).alias("x"))
    else:
        every = over_pairs(vertices, dim, kernel, "bin int, n long, x double", count).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    chi = G.chi(F.col("distance"), F.col("ka"), F.col("kb"), dim, big_r, mu)
    steps = F.array(*(F.lit(float(v)) for v in edge))
    at = F.least(F.lit(bins - 1), F.size(F.filter(steps, lambda v: v <= F.col("chi"))) - 1)
    linked = with_ends(edges, vertices, dim).select(chi.alias("chi")).where(F.col("chi") >= float(edge[0])).groupBy(at.cast("int").alias("bin")).agg((2 * F.sum("chi")).alias("l"))
    return every.join(linked, "bin", "left").select("bin", "n", (F.col("x") / F.col("n")).alias("rescaled_dist"), (F.coalesce("l", F.lit(0.0)) / F.col("x")).alias("conn_prob"))


def connection_histogram(vertices: DataFrame, edges: DataFrame, dim: int, beta: float, big_r: float, mu: float, count: int | None = None) -> DataFrame:
    """bin, n, mean rescaled distance, share of linked pairs, and the model's: 801 bins of 0.05 decades from 10^-20."""
    from horosphere.functions import geometry as G

    def bin_of(x):
        return np.where(x > 0, np.clip(np.ceil((np.log10(np.maximum(x, 1e-300)) + 20) / 0.05), 0, 800), 0).astype(int)

    def kernel(row):
        x = rescaled(row, dim, big_r, mu)[upper(row)]
        b = bin_of(x)
        n, s = np.bincount(b, minlength=801), np.bincount(b, x, minlength=801)
        at = np.flatnonzero(n)
        return {"bin": at, "n": n[at], "x": s[at]}

    if layout := classes(vertices, dim, count):
        edge = 10.0 ** (np.arange(800) * 0.05 - 20)
        every = circle.histogram(layout, vertices.sparkSession, big_r, mu, edge, bin_of, 801)
    else:
        every = over_pairs(vertices, dim, kernel, "bin int, n long, x double", count).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    chi = G.chi(F.col("distance"), F.col("ka"), F.col("kb"), dim, big_r, mu)
    at = F.when(chi > 0, F.least(F.lit(800), F.greatest(F.lit(0), F.ceil((F.log10(chi) + 20) / 0.05)))).otherwise(F.lit(0)).cast("int")
    linked = with_ends(edges, vertices, dim).groupBy(at.alias("bin")).agg(F.count("*").alias("linked"))
    mean = F.col("x") / F.col("n")
    return every.join(linked, "bin", "left").select("bin", "n", mean.alias("rescaled_dist"), (F.coalesce("linked", F.lit(0)) / F.col("n")).alias("inf_conn_prob"), G.probability(mean, beta).alias("th_conn_prob"))


def portable(salt: int) -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
    """Uniforms of pairs (graph, lesser vid, greater vid) that any engine with MD5 gives alike; see geometry.uniform."""

    def uniform(g: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        import hashlib

        return np.array([int(hashlib.md5(f"{g}-{a}-{b}:{salt}".encode()).hexdigest()[:8], 16) / 4294967296.0 for a, b in zip(i.tolist(), j.tolist(), strict=True)])

    return uniform


def simulate(vertices: DataFrame, dim: int, beta: float, big_r: float, mu: float, graphs: int = 1, seed: int = 1, count: int | None = None, uniform: Callable | None = None) -> DataFrame:
    """(g, src, dst): graphs drawn from the model, every pair by its own probability; reproducible from the seed and ids, or
    from uniform(g, src, dst), which is asked a row of pairs at a time."""
    if uniform is None and (layout := classes(vertices, dim, count)):
        return circle.simulate(layout, vertices.sparkSession, beta, big_r, mu, graphs, seed)

    def kernel(row):
        p, use = 1 / (1 + rescaled(row, dim, big_r, mu) ** beta), upper(row)
        a, b, out = row["vid_a"], row["vid_b"], []
        for g in range(graphs):
            if uniform is None:
                i, j = np.nonzero((np.random.default_rng([seed, g, row["block_a"], row["block_b"]]).random(p.shape) < p) & use)
            else:
                i, j = np.nonzero(use)
                hit = uniform(g, np.minimum(a[i], b[j]), np.maximum(a[i], b[j])) < p[i, j]
                i, j = i[hit], j[hit]
            out.append((np.full(len(i), g), np.minimum(a[i], b[j]), np.maximum(a[i], b[j])))
        return {name: np.concatenate([x[k] for x in out]) for k, name in enumerate(("g", "src", "dst"))}

    return over_pairs(vertices, dim, kernel, "g int, src long, dst long", count)
