"""Ensembles of simulated graphs against the observed one."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horosphere.operators import graph, pairs
from horosphere.operators.infer import Params
from horosphere.sources.shared import stored

STATS = ("degree", "sum_deg_n", "avg_deg_n", "nb_triang", "clustering")


def ensemble_size(n: int) -> int:
    return 1000 if n < 500 else 500 if n < 1000 else 100 if n < 10000 else 10


def simulated_properties(sim: DataFrame) -> DataFrame:
    """(g, src, dst) to the properties of each graph's vertices that have a neighbour."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("vid"), F.col("dst").alias("u")), F.struct(F.col("dst").alias("vid"), F.col("src").alias("u"))))
    adj = sim.select("g", ends.alias("x")).select("g", "x.*")
    d = adj.groupBy("g", "vid").agg(F.count("*").alias("degree"))
    n = adj.join(d.toDF("g", "u", "ku"), ["g", "u"]).groupBy("g", "vid").agg(F.sum("ku").alias("sum_deg_n"), F.avg("ku").alias("avg_deg_n"))
    x = d.join(n, ["g", "vid"]).join(graph.triangles(sim, "g"), ["g", "vid"], "left").fillna(0, ["nb_triang"])
    k = F.col("degree")
    return x.withColumn("clustering", F.when(k > 1, 2.0 * F.col("nb_triang") / (k * (k - 1))).otherwise(F.lit(0.0)))


def vertex_statistics(sim_props: DataFrame, graphs: int) -> DataFrame:
    """vid, avg_ and std_ (of the population) of each statistic over all graphs; absent counts as 0."""
    sums = sim_props.groupBy("vid").agg(*(f(F.col(c).cast("double") if p == 1 else F.col(c).cast("double") * F.col(c)).alias(f"{c}_{p}") for c in STATS for p, f in ((1, F.sum), (2, F.sum))))
    mean = {c: F.col(f"{c}_1") / graphs for c in STATS}
    return sums.select("vid", *(e for c in STATS for e in (mean[c].alias(f"avg_{c}"), F.sqrt(F.greatest(F.lit(0.0), F.col(f"{c}_2") / graphs - mean[c] * mean[c])).alias(f"std_{c}"))))


def class_statistics(sim_props: DataFrame, n: int) -> DataFrame:
    """degree, avg_ and std_ of each class statistic over the graphs in which the class occurs."""
    per = sim_props.groupBy("g", "degree").agg((F.count("*") / n).alias("deg_dist"), *(F.avg(c).alias(c) for c in STATS[1:]))
    return per.groupBy("degree").agg(*(f(c).alias(f"{p}_{c}") for c in ("deg_dist", *STATS[1:]) for p, f in (("avg", F.avg), ("std", F.stddev_pop))))


def ensemble_ccdf(sim_props: DataFrame, n: int) -> DataFrame:
    """degree from 0 to each graph's largest, avg_ccdf, std_ccdf over the graphs that reach it; graphs' absent vertices have degree 0."""
    counts = sim_props.groupBy("g", "degree").agg(F.count("*").alias("c"))
    axis = counts.groupBy("g").agg(F.max("degree").alias("top")).select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("d"))
    held = axis.join(counts.withColumnRenamed("degree", "d"), ["g", "d"], "left").fillna(0, ["c"])
    above = held.select("g", "d", (F.sum("c").over(Window.partitionBy("g").orderBy(F.desc("d"))) / n).alias("x"))
    return above.withColumn("x", F.when(F.col("d") == 0, F.lit(1.0)).otherwise(F.col("x"))).groupBy(F.col("d").alias("degree")).agg(F.avg("x").alias("avg_ccdf"), F.stddev_pop("x").alias("std_ccdf"))


def ks_test(a: DataFrame, b: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Two (degree, ccdf): the greatest difference at common degrees, the critical value for so many classes, the verdict."""
    d = a.join(b.withColumnRenamed("ccdf", "other"), "degree").agg(F.max(F.abs(F.col("ccdf") - F.col("other"))).alias("ks"))
    n, m = a.agg(F.count("*").alias("n")), b.agg(F.count("*").alias("m"))
    critical = F.lit(math.sqrt(-0.5 * math.log(alpha / 2))) * F.sqrt((F.col("n") + F.col("m")) / (F.col("n") * F.col("m")))
    one = d.withColumn("k", F.lit(1)).join(n.withColumn("k", F.lit(1)), "k").join(m.withColumn("k", F.lit(1)), "k")
    return one.select("ks", critical.alias("critical"), (F.col("ks") > critical).alias("rejected"))


def agreement(x: DataFrame, obs: str, avg: str, std: str) -> DataFrame:
    """Pearson correlation, chi square per vertex where the deviation is not 0, and the share beyond 1.5 deviations."""
    diff = F.col(obs) - F.col(avg)
    return x.agg(F.corr(obs, avg).alias("pearson"), (F.sum(F.when(F.col(std) > 0, diff * diff / (F.col(std) * F.col(std)))) / F.count("*")).alias("chi2"), F.avg(F.when(F.abs(diff) > 1.5 * F.col(std), 1.0).otherwise(0.0)).alias("zeta"))


def validate(vertices: DataFrame, edges: DataFrame, p: Params, seed: int = 1, graphs: int | None = None) -> dict[str, DataFrame]:
    """All tables of a validation: vertex_properties, ensemble_classes, observed_classes, ks, connection."""
    graphs = graphs or ensemble_size(p.n)
    sim = stored(pairs.simulate(vertices, p.dim, p.beta, p.big_r, p.mu, graphs, seed, p.n), "simulated")
    props, seen = stored(simulated_properties(sim), "simulated-properties"), stored(graph.properties(edges), "properties")
    classes = graph.ccdf(graph.class_spectra(seen))
    ens = ensemble_ccdf(props, p.n)
    return {
        "vertex_properties": seen.join(vertex_statistics(props, graphs), "vid", "left"),
        "ensemble_classes": class_statistics(props, p.n).join(ens, "degree", "full"),
        "observed_classes": classes,
        "ks": ks_test(ens.select("degree", F.col("avg_ccdf").alias("ccdf")), classes.select("degree", "ccdf")),
        "connection": pairs.connection_histogram(vertices, edges, p.dim, p.beta, p.big_r, p.mu, p.n),
    }
