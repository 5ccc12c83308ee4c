"""Graphs as tables: vertices (vid, name), edges (src < dst, distinct), adj (v, u) both ways."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from horosphere.functions.geometry import uniform
from horosphere.operators.ordered import numbered
from horosphere.sources.shared import new_path, stored


class MultipleComponentsError(ValueError):
    """The graph is not connected; giant holds the largest component's edges, exit_code what a command returns."""

    exit_code = 12

    def __init__(self, giant: DataFrame):
        super().__init__("more than one component")
        self.giant = giant


def self_loops(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """What canonical() leaves out before it looks for repeats."""
    return pairs.where(F.col(a) == F.col(b))


def canonical(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Simple undirected edges: no self-loops, each once, src < dst."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def dictionary(named: DataFrame) -> DataFrame:
    """named (line, name1, name2) to (vid, name), in order of first appearance; lines are of any kind that has an order."""
    seen = named.select(F.explode(F.array(*(F.struct(F.struct("line", F.lit(i).alias("side")).alias("at"), F.col(f"name{i}").alias("name")) for i in (1, 2)))).alias("x")).select("x.*")
    first = seen.groupBy("name").agg(F.min("at").alias("at"))
    return numbered(first, ["at", "name"], "vid").select("vid", "name")


def encoded(named: DataFrame, vertices: DataFrame) -> DataFrame:
    one, two = (vertices.select(F.col("vid").alias(v), F.col("name").alias(n)) for v, n in (("a", "name1"), ("b", "name2")))
    return canonical(named.join(one, "name1").join(two, "name2"), "a", "b")


def adjacency(edges: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("u")), F.struct(F.col("dst").alias("v"), F.col("src").alias("u"))))
    return edges.select(both.alias("x")).select("x.*")


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy(F.col("v").alias("vid")).agg(F.count("*").alias("degree"))


def neighbour_degrees(edges: DataFrame) -> DataFrame:
    """vid, sum_deg_n, avg_deg_n."""
    d = degrees(edges)
    return adjacency(edges).join(d.withColumnRenamed("vid", "u"), "u").groupBy(F.col("v").alias("vid")).agg(F.sum("degree").alias("sum_deg_n"), F.avg("degree").alias("avg_deg_n"))


#: Edges beyond which triangles are counted by tasks that read the edges between three groups of vertices, and those of two groups.
WEDGE_EDGES, GROUP_EDGES = 1_000_000, 1_000_000


def triangles(edges: DataFrame, key: str | None = None, most: int = WEDGE_EDGES) -> DataFrame:
    """vid (and key, of several graphs at once), nb_triang: edges point to the end of greater degree, so that wedges stay few.
    Wedges are rows up to so many edges of one graph of whole-number ids; beyond, they are not shuffled."""
    keys = [key] if key else []
    out = pointed(edges, keys)
    if not keys and all(isinstance(out.schema[c].dataType, IntegralType) for c in "ab"):
        out = stored(out, "pointed")
        if (n := out.count()) > most:
            return triangles_by_groups(out, max(2, math.ceil(math.sqrt(n / GROUP_EDGES))))
    wedge = out.join(out.withColumnRenamed("b", "c"), [*keys, "a"]).where("b <> c")
    closed = wedge.join(out.select(*keys, F.col("a").alias("b"), F.col("b").alias("c")), [*keys, "b", "c"])
    return closed.select(*keys, F.explode(F.array("a", "b", "c")).alias("vid")).groupBy(*keys, "vid").agg(F.count("*").alias("nb_triang"))


def pointed(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) of every edge: from the end of less degree, of equal ones the lesser."""
    both = edges.select(*keys, F.explode(F.array("src", "dst")).alias("vid"))
    d = both.groupBy(*keys, "vid").agg(F.count("*").alias("k"))
    e = edges.join(d.withColumnsRenamed({"vid": "src", "k": "ks"}), [*keys, "src"]).join(d.withColumnsRenamed({"vid": "dst", "k": "kd"}), [*keys, "dst"])
    up = (F.col("ks") < F.col("kd")) | ((F.col("ks") == F.col("kd")) & (F.col("src") < F.col("dst")))
    return e.select(*keys, F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))


def triangles_by_groups(out: DataFrame, groups: int) -> DataFrame:
    """Vertices fall into groups by hash; a task for every three reads the pointed edges (a, b) between them and counts the
    triangles a -> b -> c, a -> c of one vertex in each. An edge is read by so many tasks as there are groups, thrice."""
    kind, g = out.schema["a"].dataType, lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(groups)).cast("int")
    path = new_path(out.sparkSession, "groups")
    long = out.select((g("a") * groups + g("b")).alias("block"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    long.repartitionByRange("block", "a").sortWithinPartitions("block", "a", "b").write.parquet(path)

    def block(i: int, j: int):
        import numpy as np

        from horosphere.sources.shared import read_arrow

        e = read_arrow(path, ["a", "b"], ("block", i * groups + j))
        a, b = e["a"].to_numpy(), e["b"].to_numpy()
        order = np.lexsort((b, a))
        return a[order], b[order]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from horosphere.operators.circle import chunks, spans

        for jobs in batches:
            for job in jobs.to_pylist():
                (a, b), (a2, c), (p, q) = block(job["i"], job["j"]), block(job["i"], job["k"]), block(job["j"], job["k"])
                if not len(a) or not len(a2) or not len(p):
                    continue
                heads, first = np.unique(p, return_index=True)  # of the closing edges: number of the head, and tails by number
                tails, tail = np.unique(q, return_inverse=True)
                known = np.searchsorted(heads, p) * len(tails) + tail
                at = np.minimum(np.searchsorted(heads, b), len(heads) - 1)
                a, b, at = (x[heads[at] == b] for x in (a, b, at))
                to = np.minimum(np.searchsorted(tails, c), len(tails) - 1)
                a2, c, to = (x[tails[to] == c] for x in (a2, c, to))
                low, high = np.searchsorted(a2, a), np.searchsorted(a2, a, side="right")
                met, ends = np.zeros(len(a), np.int64), np.zeros(len(a2), np.int64)
                for part in chunks(high - low, 1 << 20) if len(a) else ():
                    which, place = spans(low[part], (high - low)[part])
                    wanted = at[part][which] * len(tails) + to[place]
                    hit = known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted
                    met[part] += np.bincount(which[hit], minlength=len(met[part]))
                    ends += np.bincount(place[hit], minlength=len(ends))
                vid, where = np.unique(np.concatenate([a, b, c]), return_inverse=True)
                n = np.bincount(where, np.concatenate([met, met, ends]), len(vid)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(vid[n > 0]), pa.array(n[n > 0])], ["vid", "n"])

    each = range(groups)
    jobs = [(i, j, k) for i in each for j in each for k in each]
    made = out.sparkSession.sparkContext.parallelize(jobs, len(jobs)).toDF("i int, j int, k int").mapInArrow(run, "vid long, n long")
    return made.groupBy(F.col("vid").cast(kind).alias("vid")).agg(F.sum("n").alias("nb_triang"))


def local_clustering(edges: DataFrame) -> DataFrame:
    """vid, degree, nb_triang, clustering (0 below two neighbours)."""
    k = F.col("degree")
    x = degrees(edges).join(triangles(edges), "vid", "left").fillna(0, ["nb_triang"])
    return x.withColumn("clustering", F.when(k > 1, 2.0 * F.col("nb_triang") / (k * (k - 1))).otherwise(F.lit(0.0)))


def properties(edges: DataFrame) -> DataFrame:
    """vid, degree, sum_deg_n, avg_deg_n, nb_triang, clustering (0 below two neighbours)."""
    return neighbour_degrees(edges).join(local_clustering(edges), "vid").select("vid", "degree", "sum_deg_n", "avg_deg_n", "nb_triang", "clustering")


def class_spectra(props: DataFrame) -> DataFrame:
    """degree, n_k, and class means of neighbour-degree sum and mean, triangles, clustering."""
    return props.groupBy("degree").agg(F.count("*").alias("n_k"), F.avg("sum_deg_n").alias("sum_deg_n"), F.avg("avg_deg_n").alias("avg_deg_n"), F.avg("nb_triang").alias("nb_triang"), F.avg("clustering").alias("clust"))


def ccdf(classes: DataFrame, k: str = "degree", n: str = "n_k") -> DataFrame:
    """The share of vertices of at least each degree; one row a class, so that the window's single task is small."""
    w = Window.orderBy(F.desc(k)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    return classes.withColumn("deg_dist", F.col(n) / F.sum(n).over(whole)).withColumn("ccdf", F.sum(n).over(w) / F.sum(n).over(whole))


#: Edges up to which a task of a search reads the whole graph: 4 bytes for each of its ends, and some times that as it is read; and
#: up to which the one of components does, which holds vertices only.
TASK_EDGES, COMPONENT_EDGES = 10_000_000, 40_000_000


def components(edges: DataFrame, most: int = COMPONENT_EDGES) -> DataFrame:
    """vid, component (its least vid). Graphs of whole-number ids and at most so many edges are read by one task."""
    kind = edges.schema["src"].dataType
    if isinstance(kind, IntegralType) and isinstance(edges.schema["dst"].dataType, IntegralType):
        here = stored(edges.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), "edges")
        if here.count() <= most:
            return components_in_a_task(here).select(*(F.col(c).cast(kind).alias(c) for c in ("vid", "component")))
        edges = here.select(*(F.col(c).cast(kind).alias(c) for c in ("src", "dst")))
    return components_by_rounds(edges)


def components_in_a_task(edges: DataFrame) -> DataFrame:
    """Roots that have an edge to a lesser root hang from the least of these, until no edge joins two roots. Edges are read a batch
    at a time, so that vertices alone are held."""
    edges.write.parquet(path := new_path(edges.sparkSession, "graph"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from horosphere.sources.shared import read_batches

        for b in batches:
            if not len(b):
                continue
            ids = np.zeros(0, np.int64)
            for src, dst in read_batches(path, ["src", "dst"]):
                ids = np.union1d(ids, np.concatenate([src, dst]))
            root = np.arange(len(ids), dtype=np.int32)
            for part in read_batches(path, ["src", "dst"]):  # an edge that is met joins its ends for good
                src, dst = (root[np.searchsorted(ids, x)] for x in part)
                while len(src):
                    apart = src != dst
                    src, dst = src[apart], dst[apart]
                    np.minimum.at(root, np.maximum(src, dst), np.minimum(src, dst))
                    while (root != (up := root[root])).any():
                        root = up
                    src, dst = root[src], root[dst]
            for lo in range(0, len(ids), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.int64()), pa.array(ids[root[part]], pa.int64())], ["vid", "component"])

    return edges.sparkSession.range(1).repartition(1).mapInArrow(run, "vid long, component long")


def components_by_rounds(edges: DataFrame) -> DataFrame:
    """Alternating large-star and small-star rounds, each stored. Whether a round changed anything is observed as it is written."""

    def kept(e: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = stored(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "links")
        return out, (seen.get["n"], seen.get["h"])

    links, before = kept(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        links, after = kept(small.distinct())
        if after == before:
            break
        before = after
    tops = links.select(F.col("v").alias("vid"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("vid"), F.col("v").alias("component")).unionByName(tops)


def giant_component(edges: DataFrame) -> tuple[DataFrame, int]:
    """(edges of the largest component - of equally large ones the one of the greater id -, number of components)."""
    c = stored(components(edges), "components")
    sizes = c.groupBy("component").count()
    n = sizes.count()
    best = sizes.orderBy(F.desc("count"), F.desc("component")).limit(1)
    inside = c.join(F.broadcast(best), "component", "left_semi").select("vid")
    return edges.join(inside, edges.src == inside.vid, "left_semi"), n


def require_connected(edges: DataFrame) -> None:
    giant, n = giant_component(edges)
    if n > 1:
        raise MultipleComponentsError(giant)


#: Edges up to which layers are peeled on the driver instead of by a round of jobs each.
LOCAL_EDGES = 200_000


def _peel(pairs: list) -> list[tuple[int, int, int]]:
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    left = {v: len(u) for v, u in near.items()}
    out, layer, core = [], 0, 0
    while left:
        layer, core = layer + 1, max(core, min(left.values()))
        gone = [v for v, k in left.items() if k <= core]
        for v in gone:
            del left[v]
            out.append((v, core, layer))
        for v in gone:
            for u in near[v]:
                if u in left:
                    left[u] -= 1
    return out


def onion(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """vid, coreness, layer: all vertices of the least remaining degree go at once, which is their coreness."""
    spark = edges.sparkSession
    few = edges.select("src", "dst").limit(local + 1).collect() if local else None
    if few is not None and len(few) <= local:
        return spark.createDataFrame(_peel(few), "vid long, coreness long, layer long")
    rest = stored(adjacency(edges), "adj")
    left = stored(degrees(edges), "left")
    done, layer, core = [], 0, 0
    while (least := left.agg(F.min("degree")).first()[0]) is not None:
        layer, core = layer + 1, max(core, least)
        peeled = stored(left.where(F.col("degree") <= core).select("vid", F.lit(core).cast("long").alias("coreness"), F.lit(layer).cast("long").alias("layer")), "layer")
        done.append(peeled)
        lost = rest.join(peeled.select(F.col("vid").alias("v")), "v", "left_semi").groupBy(F.col("u").alias("vid")).agg(F.count("*").alias("lost"))
        left = stored(left.join(peeled.select("vid"), "vid", "left_anti").join(lost, "vid", "left").select("vid", (F.col("degree") - F.coalesce("lost", F.lit(0))).alias("degree")), "left")
    out = done[0] if done else spark.createDataFrame([], "vid long, coreness long, layer long")
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def visiting_order(layers: DataFrame, seed: int) -> DataFrame:
    """(vid, place): the inmost layer first, by chance within a layer."""
    chance = layers.select("vid", (-F.col("layer")).alias("out"), uniform(F.col("vid"), seed).alias("u"))
    return numbered(chance, ["out", "u", "vid"], "place").select("vid", "place")


#: Levels of a search that are united before they are written as one table.
UNITED = 20


def bfs(edges: DataFrame, sources: DataFrame, most: int = TASK_EDGES) -> DataFrame:
    """sources (s) to (s, vid, dist). Graphs of at most so many edges are read by every task, which searches from its sources
    and keeps nothing; else one frontier for all sources is met by one join a level."""
    here = stored(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), "edges")
    return bfs_in_tasks(here, sources) if here.count() <= most else bfs_by_joins(here, sources)


def bfs_in_tasks(edges: DataFrame, sources: DataFrame) -> DataFrame:
    edges.write.parquet(path := new_path(edges.sparkSession, "graph"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from horosphere.sources.shared import read_arrow

        graph = None
        for b in batches:
            if graph is None and len(b):
                e = read_arrow(path, ["src", "dst"])
                src, dst = e["src"].to_numpy(), e["dst"].to_numpy()
                ids = np.unique(np.concatenate([src, dst]))
                src, dst = (np.searchsorted(ids, x).astype(np.int32) for x in (src, dst))
                a, other = np.concatenate([src, dst]), np.concatenate([dst, src])
                near = other[np.argsort(a, kind="stable")]
                start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(ids)))])
                graph = seen = np.full(len(ids), -1, np.int32)
                del e, src, dst, a, other
            for turn, s in enumerate(b.column("s").to_pylist()):
                at = int(np.searchsorted(ids, s)) if len(ids) else 0
                if at >= len(ids) or ids[at] != s:  # no edge: the source alone
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (s, s, 0)], ["s", "vid", "dist"])
                    continue
                front, level, held, n = np.array([at]), 0, [], 0
                seen[at] = turn
                while len(front):
                    held.append((front, level))
                    n += len(front)
                    size = start[front + 1] - start[front]
                    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[front], size)
                    new = near[place]
                    new = np.unique(new[seen[new] != turn])
                    seen[new] = turn
                    front, level = new, level + 1
                vid, dist = ids[np.concatenate([f for f, _ in held])], np.repeat([k for _, k in held], [len(f) for f, _ in held])
                for lo in range(0, n, 1 << 16):
                    v = vid[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), s), pa.int64()), pa.array(v, pa.int64()), pa.array(dist[lo : lo + (1 << 16)], pa.int64())], ["s", "vid", "dist"])
            if graph is not None:
                seen[:] = -1  # turns begin anew with a batch

    each = sources.select(F.col("s").cast("long").alias("s")).distinct()
    return stored(each, "sources").repartition(64).mapInArrow(run, "s long, vid long, dist long")


def bfs_by_joins(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """As edges go both ways, what a level reaches lies in the level before, in itself or is new: only two levels are looked back at."""
    adj = stored(adjacency(edges), "adj")
    frontier = stored(sources.select("s", F.col("s").alias("vid"), F.lit(0).cast("long").alias("dist")).distinct(), "bfs")
    reached, parts, last = frontier, 1, None
    for level in itertools.count(1):
        near = frontier.join(adj, frontier.vid == adj.v).select("s", F.col("u").alias("vid")).distinct()
        new = near.join(frontier.select("s", "vid"), ["s", "vid"], "left_anti")
        if last is not None:
            new = new.join(last.select("s", "vid"), ["s", "vid"], "left_anti")
        last, frontier = frontier, stored(new.withColumn("dist", F.lit(level).cast("long")), "bfs")
        if frontier.isEmpty():
            return reached
        reached, parts = reached.unionByName(frontier), parts + 1
        if parts == UNITED:
            reached, parts = stored(reached, "reached"), 1


def leaves(edges: DataFrame) -> DataFrame:
    """(parent, leaf) of core vertices and their neighbours of degree 1."""
    d = degrees(edges)
    one, more = d.where("degree = 1").select(F.col("vid").alias("u")), d.where("degree > 1").select(F.col("vid").alias("v"))
    return adjacency(edges).join(one, "u", "left_semi").join(more, "v", "left_semi").select(F.col("v").alias("parent"), F.col("u").alias("leaf"))
