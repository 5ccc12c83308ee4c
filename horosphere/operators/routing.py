"""Greedy routing: runs are rows, and a superstep moves all of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.functions import geometry as G
from horosphere.operators import graph
from horosphere.operators.circle import spans
from horosphere.operators.ordered import numbered
from horosphere.sources.shared import new_path, read_batches, stored

#: Edges up to which runs go, and shortest paths are searched, in tasks that read the graph; beyond, by joins.
LOCAL_EDGES = graph.TASK_EDGES
#: Steps' ends that are united before they are written as one table.
UNITED = 40


def sample_runs(vertices: DataFrame, runs: int, seed: int = 1) -> DataFrame:
    """(run, s, t) with s <> t, uniform over the vertices."""
    spark, n = vertices.sparkSession, vertices.count()
    ids = numbered(vertices.select("vid"), ["vid"], "i")
    pick = spark.range(runs).select(F.col("id").alias("run"), F.floor(G.uniform(F.col("id"), seed) * n).cast("long").alias("a"), F.floor(G.uniform(F.col("id"), seed + 1) * (n - 1)).cast("long").alias("b"))
    pick = pick.withColumn("b", (F.col("a") + 1 + F.col("b")) % n)
    return pick.join(ids.toDF("s", "a"), "a").join(ids.toDF("t", "b"), "b").select("run", "s", "t")


def _distance(dim: int, a: str, b: str):
    if dim == 1:
        return G.hyperbolic_distance(F.col(f"{a}_r"), F.col(f"{b}_r"), G.circular_distance(F.col(f"{a}_p"), F.col(f"{b}_p")))
    return G.hyperbolic_distance(F.col(f"{a}_r"), F.col(f"{b}_r"), G.angle(F.col(f"{a}_p"), F.col(f"{b}_p"), 1e-15))


def distance_of(dim: int, ra: np.ndarray, rb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_distance of arrays."""
    if dim == 1:
        delta = np.pi - np.abs(np.pi - np.abs(a - b))
    else:
        c = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
        delta = np.where(np.abs(c - 1) < 1e-15, 0.0, np.arccos(np.clip(c, -1, 1)))
    inside = np.maximum(1.0, ((1 - np.cos(delta)) * np.cosh(ra + rb) + (1 + np.cos(delta)) * np.cosh(ra - rb)) / 2)
    d = np.where(delta == 0, np.abs(ra - rb), np.log(inside + np.sqrt(inside * inside - 1)))
    return np.where(np.isnan(d), np.inf, d)


def route(edges: DataFrame, vertices: DataFrame, runs: DataFrame, dim: int = 1, modified: bool = False, local: int = LOCAL_EDGES) -> DataFrame:
    """runs (run, s, t) over vertices (vid, hyp_rad, theta or pos) to (run, s, t, status, hops).

    Original: to the neighbour nearest to the target if that is nearer than where the run stands, else dropped. Modified:
    always to the nearest neighbour, dropped on returning to the place before the last. Ties go to the smaller vid.

    Both rules end by themselves. Each hop of the original is strictly nearer. In the modified one the place before the last
    is among the neighbours that the next is chosen from, so that of every second place (distance, vid) falls strictly until
    the run arrives or returns.

    Over graphs of at most so many edges runs go from their start to their end in tasks that read the graph; else a superstep
    moves all of them by joins."""
    if edges.count() <= local:
        return route_in_tasks(edges, vertices, runs, dim, modified)
    return route_by_joins(edges, vertices, runs, dim, modified)


def route_in_tasks(edges: DataFrame, vertices: DataFrame, runs: DataFrame, dim: int, modified: bool) -> DataFrame:
    """A task holds the graph, 4 bytes for each end of an edge, places, and the state of one batch of runs."""
    spark, place = edges.sparkSession, "theta" if dim == 1 else "pos"
    edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).write.parquet(links := new_path(spark, "graph"))
    at = [F.col(place).cast("double").alias("p0")] if dim == 1 else [F.col(place)[i].cast("double").alias(f"p{i}") for i in range(dim + 1)]
    vertices.select(F.col("vid").cast("long").alias("vid"), F.col("hyp_rad").cast("double").alias("r"), *at).write.parquet(places := new_path(spark, "places"))
    columns = ["vid", "r", *(f"p{i}" for i in range(len(at)))]

    def graph_here():
        rows = list(zip(*read_batches(places, columns), strict=True)) or [[np.zeros(0)]] * len(columns)
        vid, r, *p = (np.concatenate(x) for x in rows)
        order = np.argsort(vid, kind="stable")
        ids, r, p = vid[order].astype(np.int64), r[order], [x[order] for x in p]
        keys = []
        for src, dst in read_batches(links, ["src", "dst"]):
            a, b = (np.minimum(np.searchsorted(ids, x), max(0, len(ids) - 1)) for x in (src, dst))
            inside = (ids[a] == src) & (ids[b] == dst) if len(ids) else np.zeros(len(src), bool)
            a, b = a[inside], b[inside]
            keys += [a * len(ids) + b, b * len(ids) + a]
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        keys.clear()
        key.sort()
        start = np.searchsorted(key, np.arange(len(ids) + 1) * max(1, len(ids)))
        return ids, r, p[0] if dim == 1 else np.stack(p, 1), start, (key % max(1, len(ids))).astype(np.int32)

    def run(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            ids, r, p, start, near = held = held or graph_here()
            if not len(ids):
                continue
            number, s, t = (batch.column(c).to_numpy() for c in ("run", "s", "t"))
            cur, to = (np.minimum(np.searchsorted(ids, x), len(ids) - 1) for x in (s, t))
            known = (ids[cur] == s) & (ids[to] == t)
            number, s, t, cur, to = (x[known] for x in (number, s, t, cur, to))
            prev, hops, best = np.full(len(cur), -1), np.zeros(len(cur), np.int64), distance_of(dim, r[cur], r[to], p[cur], p[to])
            while True:
                size = start[cur + 1] - start[cur]
                if (size == 0).any():  # nowhere to go
                    number, s, t, cur, to, prev, hops, best, size = (x[size > 0] for x in (number, s, t, cur, to, prev, hops, best, size))
                if not len(cur):
                    break
                which, at_ = spans(start[cur], size)
                u, goal = near[at_], to[which]
                d = distance_of(dim, r[u], r[goal], p[u], p[goal])
                d[u == goal] = -1
                least = np.minimum.reduceat(d, np.cumsum(size) - size)
                ties = np.flatnonzero(d == least[which])  # neighbours rise by vid
                nxt = u[ties[np.unique(which[ties], return_index=True)[1]]].astype(np.int64)
                arrived = nxt == to
                stuck = ~arrived & ((nxt == prev) if modified else (least >= best))
                hops = hops + ~stuck
                end = arrived | stuck
                if end.any():
                    status = np.where(arrived[end], "arrived", "dropped")
                    yield pa.RecordBatch.from_arrays([pa.array(number[end], pa.int64()), pa.array(s[end], pa.int64()), pa.array(t[end], pa.int64()), pa.array(status.tolist(), pa.string()), pa.array(hops[end], pa.int64())], ["run", "s", "t", "status", "hops"])
                number, s, t, cur, to, prev, hops, best = (x[~end] for x in (number, s, t, nxt, to, cur, hops, least))

    each = runs.select(*(F.col(c).cast("long").alias(c) for c in ("run", "s", "t")))
    return stored(each.repartition(max(12, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "run long, s long, t long, status string, hops long"), "routed")


def route_by_joins(edges: DataFrame, vertices: DataFrame, runs: DataFrame, dim: int, modified: bool) -> DataFrame:
    adj = stored(graph.adjacency(edges), "adj")
    place = "theta" if dim == 1 else "pos"
    end = lambda n: vertices.select(F.col("vid").alias(n), F.col("hyp_rad").alias(f"{n}_r"), F.col(place).alias(f"{n}_p"))
    state = stored(runs.join(end("t"), "t").join(end("s").toDF("s", "c_r", "c_p"), "s").select("run", "s", "t", "t_r", "t_p", F.col("s").alias("cur"), F.lit(-1).cast("long").alias("prev"), F.lit(0).cast("long").alias("hops"), _distance(dim, "c", "t").alias("best")), "runs")
    done, parts = None, 0
    while True:
        step = state.join(adj, state.cur == adj.v).join(end("u"), "u").withColumn("d", F.when(F.col("u") == F.col("t"), F.lit(-1.0)).otherwise(_distance(dim, "u", "t")))
        moved = step.groupBy("run").agg(F.min(F.struct("d", "u")).alias("m"), *(F.first(c).alias(c) for c in ("s", "t", "t_r", "t_p", "cur", "prev", "hops", "best")))
        stuck = (F.col("m.u") == F.col("prev")) if modified else (F.col("m.d") >= F.col("best"))
        status = F.when(F.col("m.u") == F.col("t"), "arrived").when(stuck, "dropped").otherwise("on")
        moved = stored(moved.select("run", "s", "t", "t_r", "t_p", F.col("m.u").alias("next"), "cur", (F.col("hops") + F.when(status == "dropped", 0).otherwise(1)).alias("hops"), F.col("m.d").alias("best"), status.alias("status")), "runs")
        ends = dict(moved.groupBy(F.col("status") == "on").count().collect())
        if done is None or ends.get(False):
            ended = moved.where("status <> 'on'").select("run", "s", "t", "status", "hops")
            done, parts = ended if done is None else done.unionByName(ended), parts + 1
            if parts == UNITED:
                done, parts = stored(done, "routed"), 1
        if not ends.get(True):
            return done
        state = moved.where("status = 'on'").select("run", "s", "t", "t_r", "t_p", F.col("next").alias("cur"), F.col("cur").alias("prev"), "hops", "best")


def summary(routes: DataFrame, shortest: DataFrame, compat: bool = False) -> DataFrame:
    """routes and (s, t, dist) to p_s, mean_hop_length, mean_strech, max_strech, gr_score; no success gives nulls. compat
    counts a path's vertices instead of its edges."""
    x = routes.join(shortest, ["s", "t"], "left").withColumn("h", F.when(F.col("status") == "arrived", F.col("hops") + (1 if compat else 0)))
    stretch = F.col("h") / F.col("dist")
    return x.agg(F.avg(F.col("h").isNotNull().cast("double")).alias("p_s"), F.avg("h").alias("mean_hop_length"), F.avg(stretch).alias("mean_strech"), F.max(stretch).alias("max_strech"), (F.sum(1 / stretch) / F.count("*")).alias("gr_score"))


def distances_between(sources: np.ndarray, which: np.ndarray, targets: np.ndarray, start: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Hops from sources[which] to targets, pair by pair, -1 where there is no way; near[start[v] : start[v + 1]] are v's
    neighbours, of which each vertex has one at least. At most 64 sources are searched from at once, a bit each."""
    seen, bit = np.zeros(len(start) - 1, np.uint64), which.astype(np.uint64)
    np.bitwise_or.at(seen, sources, np.uint64(1) << np.arange(len(sources), dtype=np.uint64))
    front, level, dist, left = seen.copy(), 0, np.full(len(targets), -1, np.int64), np.arange(len(targets))
    while True:
        hit = (front[targets[left]] >> bit[left]) & np.uint64(1) > 0
        dist[left[hit]], left = level, left[~hit]
        if not len(left) or not front.any():
            return dist
        front = np.bitwise_or.reduceat(front[near], start[:-1]) & ~seen
        seen |= front
        level += 1


def shortest_paths(edges: DataFrame, runs: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(s, t, dist) of the runs whose target can be reached."""
    wanted, spark = runs.select("s", "t").distinct(), edges.sparkSession
    if edges.count() > local:
        reached = graph.bfs_by_joins(edges, runs.select("s").distinct())
        return wanted.join(reached.withColumnRenamed("vid", "t"), ["s", "t"])
    edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).write.parquet(path := new_path(spark, "graph"))

    def graph_here():
        ids = np.zeros(0, np.int64)
        for part in read_batches(path, ["src", "dst"]):
            ids = np.union1d(ids, np.concatenate(part))
        key = np.concatenate([np.zeros(0, np.int64), *(np.searchsorted(ids, x) * len(ids) + np.searchsorted(ids, y) for a, b in read_batches(path, ["src", "dst"]) for x, y in ((a, b), (b, a)))])
        key.sort()
        return ids, np.searchsorted(key, np.arange(len(ids) + 1) * max(1, len(ids))), (key % max(1, len(ids))).astype(np.int32)

    def run(batches):
        held = None
        for x in batches:
            if len(x):
                ids, start, near = held = held or graph_here()
            for lo in range(0, len(x), 64):
                part = x.iloc[lo : lo + 64]
                s, t = part["s"].to_numpy(np.int64), np.concatenate([np.asarray(v, np.int64) for v in part["ts"]])
                which = np.repeat(np.arange(len(s)), [len(v) for v in part["ts"]])
                dist = np.full(len(t), -1, np.int64)
                if len(ids):
                    at, to = (np.minimum(np.searchsorted(ids, v), len(ids) - 1) for v in (s, t))
                    known = (ids[at] == s)[which] & (ids[to] == t)
                    dist[known] = distances_between(at, which[known], to[known], start, near)
                dist[t == s[which]] = 0
                yield pd.DataFrame({"s": s[which][dist >= 0], "t": t[dist >= 0], "dist": dist[dist >= 0]})

    each = wanted.groupBy("s").agg(F.collect_list("t").alias("ts"))
    return stored(each, "wanted").repartition(64).mapInPandas(run, "s long, t long, dist long")
