"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Rows are dealt into shards of about SHARD vectors by a hash of their id. Within a shard equal vectors share one node, so a
vector that a third of all rows hold spreads over the shards and costs each one node. A node's level is geometric in a
hash of its smallest id. On every level a node's neighbours come from its nearest nodes there: those nearer to it than to
any neighbour chosen before, then the next nearest, and the links back. They are kept as flat arrays of node numbers,
-1 where there are fewer. A search descends greedily from the top and widens to a beam on the ground; blocks of queries
move in step. Each shard's best, measured in double precision on the original vectors, are merged by query.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as queries neither;
vectors of another length are indexed apart and meet queries of their own length only; of equal vectors all ids count,
the smallest first; null ids take no part; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horosphere.llm.common import map_arrow, stored, table

SHARD, LINKS, CANDIDATES, BEAM, STEP, QUERIES = 8192, 16, 48, 160, 4, 256
#: Ids of equal vectors kept with a node: as many as the largest k asked for, and one for the query itself.
SAME = 101


def hashed(ids: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1), from the ids alone."""
    z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54


def linked(x: np.ndarray, width: int) -> np.ndarray:
    """(n, 2 * width) neighbour numbers within x, -1 where there are fewer: width chosen from the nearest, then links back."""
    n = len(x)
    c = min(CANDIDATES, n - 1)
    out = np.full((n, 2 * width), -1, np.int32)
    if c <= 0:
        return out
    square = (x * x).sum(1)
    chosen, length = np.full((n, width), -1, np.int32), np.full((n, width), np.inf, np.float32)
    for lo in range(0, n, 256):
        hi = min(lo + 256, n)
        d = square[lo:hi, None] + square[None, :] - 2 * (x[lo:hi] @ x.T)
        d[np.arange(hi - lo), np.arange(lo, hi)] = np.inf
        near = np.argpartition(d, c - 1, axis=1)[:, :c]
        dn = np.take_along_axis(d, near, 1)
        order = np.argsort(dn, axis=1, kind="stable")
        near, dn = np.take_along_axis(near, order, 1), np.take_along_axis(dn, order, 1)
        y = x[near]
        s = square[near]
        between = s[:, :, None] + s[:, None, :] - 2 * (y @ y.transpose(0, 2, 1))
        keep = np.zeros(near.shape, bool)
        for j in range(c):
            keep[:, j] = ~((between[:, j, :j] < dn[:, j : j + 1]) & keep[:, :j]).any(1) & (keep[:, :j].sum(1) < width)
        rank = np.argsort(~keep, axis=1, kind="stable")[:, :width]  # the chosen first, then the nearest of the others
        w = rank.shape[1]
        chosen[lo:hi, :w], length[lo:hi, :w] = np.take_along_axis(near, rank, 1), np.take_along_axis(dn, rank, 1)
    out[:, :width] = chosen
    source, target = np.repeat(np.arange(n), width), chosen.ravel()
    real = target >= 0
    source, target, far = source[real], target[real], length.ravel()[real]
    mutual = (chosen[target] == source[:, None]).any(1)
    source, target, far = source[~mutual], target[~mutual], far[~mutual]
    order = np.lexsort((far, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    fits = place < width
    out[target[fits], width + place[fits]] = source[fits]
    return out


def build(ids: np.ndarray, x: np.ndarray) -> dict[str, bytes | int]:
    """One shard's graph as flat arrays: vectors, the ids of each node (SAME at most) and where they start, the nodes of each
    level (each level's are the first ones, since nodes are numbered by falling level), and each level's neighbours."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    key = x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, first, node, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    level = np.floor(-np.log(hashed(ids[first])) / np.log(LINKS)).astype(np.int64)
    rank = np.lexsort((ids[first], -level))
    back = np.empty(len(rank), np.int64)
    back[rank] = np.arange(len(rank))
    node, level, first, count = back[node.ravel()], level[rank], first[rank], count[rank]
    by_node = np.argsort(node, kind="stable")
    place = np.arange(len(node)) - np.searchsorted(node[by_node], node[by_node])
    vectors = x[first]
    flat = vectors.astype(np.float32)
    sizes = [int((level >= k).sum()) for k in range(int(level.max()) + 1)]
    return {
        "dim": x.shape[1],
        "vectors": vectors.tobytes(),
        "ids": ids[by_node][place < SAME].astype("<i8").tobytes(),
        "starts": np.concatenate([[0], np.cumsum(np.minimum(count, SAME))]).astype("<i8").tobytes(),
        "sizes": np.array(sizes, "<i8").tobytes(),
        "links": b"".join(linked(flat[:n], LINKS).tobytes() for n in sizes),
    }


class Graph:
    def __init__(self, row: dict):
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        self.flat = self.vectors.astype(np.float32)
        self.square = (self.flat * self.flat).sum(1)
        self.ids, self.starts = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["starts"], "<i8")
        self.links, at = [], 0
        for n in np.frombuffer(row["sizes"], "<i8").tolist():
            self.links.append(np.frombuffer(row["links"], np.int32, n * 2 * LINKS, at).reshape(n, -1))
            at += n * 2 * LINKS * 4

    def beam(self, q: np.ndarray, enter: np.ndarray, level: int, width: int, step: int) -> np.ndarray:
        """(queries, width) nodes found on a level, nearest first, -1 where there are fewer; enter: nodes to start from."""
        links, m = self.links[level], len(q)
        rows = np.arange(m)[:, None]
        seen = np.zeros((m, len(links) + 1), bool)  # the last column stands for no node
        seen[:, -1] = True
        found, far = np.full((m, width), -1, np.int64), np.full((m, width), np.inf, np.float32)
        todo = np.zeros((m, width), bool)
        new = enter
        while True:
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new = np.where(seen[rows, new], -1, new)
            seen[rows, new] = True
            d = self.square[new] - 2 * np.matmul(self.flat[new], q[:, :, None])[:, :, 0]
            d[new < 0] = np.inf
            everything, dist = np.concatenate([found, new], 1), np.concatenate([far, d], 1)
            fresh = np.concatenate([todo, new >= 0], 1)
            best = np.argpartition(dist, width - 1, axis=1)[:, :width] if dist.shape[1] > width else np.tile(np.arange(dist.shape[1]), (m, 1))
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(dist, best, 1), axis=1, kind="stable"), 1)
            found, far, todo = (np.take_along_axis(a, best, 1) for a in (everything, dist, fresh))
            found = np.where(np.isinf(far), -1, found)
            go = np.argsort(~todo, axis=1, kind="stable")[:, :step]  # the nearest that were not looked at
            real = np.take_along_axis(todo, go, 1)
            if not real.any():
                return found
            np.put_along_axis(todo, go, False, 1)
            at = np.where(real, np.take_along_axis(found, go, 1), -1)
            new = np.where(at[:, :, None] >= 0, links[at], -1).reshape(m, -1).astype(np.int64)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, beam: int = BEAM) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, distances) of its k nearest found but for its own id, nearest first, ties by id."""
        q32 = q.astype(np.float32)
        enter = np.tile(np.arange(min(len(self.links[-1]), 8)), (len(q), 1))
        for level in range(len(self.links) - 1, -1, -1):
            width = min(max(beam, 2 * k) if not level else 16, len(self.links[level]))
            enter = self.beam(q32, enter, level, width, STEP if not level else 2)
        out = []
        for v, mine, nodes in zip(q, own.tolist(), enter, strict=True):
            nodes = nodes[nodes >= 0][: 3 * k + 10]
            d = np.sqrt(((self.vectors[nodes] - v) ** 2).sum(1))
            ids = [self.ids[self.starts[i] : self.starts[i + 1]] for i in nodes.tolist()]
            far, ids = np.repeat(d, [len(i) for i in ids]), np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
            other = ids != mine
            far, ids = far[other], ids[other]
            order = np.lexsort((ids, far))[:k]
            out.append((ids[order], far[order]))
        return out


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (doubles), dim of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists(F.col("v"), lambda x: x != 0))


def index(points: DataFrame, shards: int) -> DataFrame:
    """points (id, v, dim) as a row (shard, and build()'s arrays) for each shard and length, stored in the shared folder."""

    def run(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        x = group["v"].combine_chunks()
        values = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        row = build(group["id"].to_numpy(), values) | {"shard": group["shard"][0].as_py()}
        return pa.Table.from_pylist([row], pa.schema([("shard", pa.int64()), ("dim", pa.int32()), *((n, pa.binary()) for n in ("vectors", "ids", "starts", "sizes", "links"))]))

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return stored(dealt.groupBy("dim", "shard").applyInArrow(run, "shard long, dim int, vectors binary, ids binary, starts binary, sizes binary, links binary"), "ann-index")


def search(graphs: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: queries (id, v, dim), in blocks, each sent to every shard."""
    if k >= SAME:
        raise ValueError(f"an index keeps {SAME} ids of equal vectors: k must be less")

    def blocks(group: pa.Table) -> pa.Table:
        x = group["v"].combine_chunks()
        x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
        return pa.table({"dim": pa.array([group["dim"][0].as_py()], pa.int32()), "q_ids": [group["id"].to_numpy().tobytes()], "q": [x.flatten().to_numpy(zero_copy_only=False).tobytes()]})

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1).to_pylist()[0]
                ids = np.frombuffer(row["q_ids"], "<i8")
                q = np.frombuffer(row["q"], np.float64).reshape(-1, row["dim"])
                graph = Graph(row)
                for lo in range(0, len(ids), QUERIES):
                    got = graph.search(q[lo : lo + QUERIES], ids[lo : lo + QUERIES], k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + QUERIES], [len(g[0]) for g in got])), pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got]))], ["query_id", "vec_id", "score"])

    block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-queries.count() // (2 * QUERIES)))))
    packed = queries.withColumn("block", block).groupBy("dim", "block").applyInArrow(blocks, "dim int, q_ids binary, q binary")
    everywhere = packed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = map_arrow(graphs.join(everywhere, ["dim", "shard"]).select("dim", "vectors", "ids", "starts", "sizes", "links", "q_ids", "q"), run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))  # k rows of each shard meet here
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    points = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    shards = max(1, -(-points.count() // SHARD))
    return search(index(points, shards), points.where("id % 100 = 0"), shards, 10)
