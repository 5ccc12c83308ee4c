"""Every named query, and its SQL counterpart.

Most queries run on the graph of parts on consecutive lines of an order (first line's discount at least 0.09); geometry
runs on it with surrogate places: kappa is the degree, theta 2 pi times a portable uniform of the id, beta is 2.5.
"""

from __future__ import annotations

import math
import uuid
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horosphere.functions import geometry as G
from horosphere.functions import special
from horosphere.operators import align, embed, generate, graph, infer, ordered, pairs, routing, validate
from horosphere.operators.infer import Params
from horosphere.sources.shared import shared_dir, stored

BETA, PI = 2.5, math.pi


def edges(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """The graph of parts on consecutive lines, whole: whatever the discount."""
    x = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    a = (x if whole else x.where("l_discount >= 0.09")).select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    return graph.canonical(a.join(x.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst")), ["l_orderkey", "l_linenumber"]))


E_SQL = """e AS (SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS src, greatest(a.l_partkey, b.l_partkey) AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_discount >= 0.09 AND a.l_partkey <> b.l_partkey),
adj AS (SELECT src AS v, dst AS u FROM e UNION ALL SELECT dst, src FROM e), deg AS (SELECT v AS vid, count(*) AS degree FROM adj GROUP BY v)"""
T_SQL = """, tri AS (SELECT vid, count(*) AS nb_triang FROM (SELECT unnest([a.src, a.dst, b.dst]) AS vid FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst) GROUP BY vid),
nb AS (SELECT adj.v AS vid, sum(deg.degree)::BIGINT AS sum_deg_n, avg(deg.degree) AS avg_deg_n FROM adj JOIN deg ON adj.u = deg.vid GROUP BY adj.v),
prop AS (SELECT deg.vid, degree, sum_deg_n, avg_deg_n, coalesce(nb_triang, 0) AS nb_triang,
  CASE WHEN degree > 1 THEN 2.0::DOUBLE * coalesce(nb_triang, 0) / (degree * (degree - 1)) ELSE 0.0 END AS clustering FROM deg JOIN nb USING (vid) LEFT JOIN tri USING (vid))"""


def _uniform(key: str, salt: int) -> str:
    return f"(('0x' || substr(md5({key} || ':{salt}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


V_SQL = f""", par AS (SELECT n::DOUBLE AS n, n / (2 * pi()) AS big_r, 2.5::DOUBLE * sin(pi() / 2.5) / (2 * pi() * k) AS mu, k0 FROM (SELECT count(*) AS n, avg(degree) AS k, min(degree)::DOUBLE AS k0 FROM deg)),
vx AS (SELECT vid, degree::DOUBLE AS kappa, 2 * pi() * {_uniform("vid", 1)} AS theta FROM deg),
ends AS (SELECT src, dst, a.kappa AS ka, b.kappa AS kb, pi() - abs(pi() - abs(a.theta - b.theta)) AS distance FROM e JOIN vx a ON src = a.vid JOIN vx b ON dst = b.vid),
pr AS (SELECT a.vid AS i, b.vid AS j, big_r * (pi() - abs(pi() - abs(a.theta - b.theta))) / (mu * a.kappa * b.kappa) AS chi FROM vx a JOIN vx b ON a.vid < b.vid CROSS JOIN par)"""


def model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Params]:
    e = stored(edges(spark, sf), "edges")
    d = graph.degrees(e)
    n, k = d.agg(F.count("*"), F.avg("degree")).first()
    v = stored(d.select("vid", F.col("degree").cast("double").alias("kappa"), (F.lit(2 * PI) * G.uniform(F.col("vid"), 1)).alias("theta")), "vertices")
    return e, v, Params(1, BETA, G.density(1, BETA, k), n, k)


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    s = graph.class_spectra(graph.properties(edges(spark, sf)))
    return s.select("degree", "n_k", r6(F.col("avg_deg_n"), "avg_deg_n"), r6(F.col("nb_triang"), "nb_triang"), r6(F.col("clust"), "clust")).orderBy("degree")


_Q: dict = {}
_S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _S[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)


@query(f"WITH {E_SQL} SELECT src, dst FROM e")
def edges_canonical(spark, sf):
    return edges(spark, sf)


@query("SELECT count(*) AS loops FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey = b.l_partkey")
def self_loop_filter(spark, sf):
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    a = x.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    both = a.join(x.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst")), ["l_orderkey", "l_linenumber"])
    return graph.self_loops(both).agg(F.count("*").alias("loops"))


@query("WITH x AS (SELECT c_name AS name, min(o_orderkey) AS line FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name) SELECT row_number() OVER (ORDER BY line, name) - 1 AS vid, name FROM x")
def vertex_dictionary(spark, sf):
    o, c = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/customer.parquet")
    named = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("line"), F.col("c_name").alias("name1"), F.col("c_name").alias("name2"))
    return graph.dictionary(named)


@query(f"WITH {E_SQL} SELECT vid, degree FROM deg")
def degree(spark, sf):
    return graph.degrees(edges(spark, sf))


@query(f"WITH {E_SQL} SELECT count(*) AS n, round(avg(degree), 6) AS mean_degree, min(degree) AS min_degree, max(degree) AS max_degree, count(DISTINCT degree) AS classes FROM deg")
def degree_extrema(spark, sf):
    return graph.degrees(edges(spark, sf)).agg(F.count("*").alias("n"), r6(F.avg("degree"), "mean_degree"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.countDistinct("degree").alias("classes"))


@query(f"WITH {E_SQL} SELECT degree, count(*) AS n_k FROM deg GROUP BY degree")
def degree_classes(spark, sf):
    return graph.degrees(edges(spark, sf)).groupBy("degree").agg(F.count("*").alias("n_k"))


@query(f"WITH {E_SQL}{T_SQL} SELECT vid, sum_deg_n FROM nb")
def neighbor_degree_sum(spark, sf):
    return graph.neighbour_degrees(edges(spark, sf)).select("vid", "sum_deg_n")


@query(f"WITH {E_SQL}{T_SQL} SELECT vid, round(avg_deg_n, 6) AS avg_deg_n FROM nb")
def neighbor_degree_avg(spark, sf):
    return graph.neighbour_degrees(edges(spark, sf)).select("vid", r6(F.col("avg_deg_n"), "avg_deg_n"))


@query(f"WITH {E_SQL}{T_SQL} SELECT vid, nb_triang FROM tri")
def triangles(spark, sf):
    return graph.triangles(edges(spark, sf))


@query(f"WITH {E_SQL}{T_SQL} SELECT vid, round(clustering, 6) AS clustering FROM prop")
def local_clustering(spark, sf):
    return graph.properties(edges(spark, sf)).select("vid", r6(F.col("clustering"), "clustering"))


@query(f"WITH {E_SQL}{T_SQL} SELECT round(avg(clustering), 8) AS clustering FROM prop WHERE degree > 1")
def avg_clustering(spark, sf):
    return graph.properties(edges(spark, sf)).where("degree > 1").agg(F.round(F.avg("clustering"), 8).alias("clustering"))


@query(f"WITH {E_SQL}, c AS (SELECT degree, count(*) AS n_k FROM deg GROUP BY degree) SELECT degree, n_k, round(n_k / sum(n_k) OVER (), 6) AS deg_dist, round(sum(n_k) OVER (ORDER BY degree DESC) / sum(n_k) OVER (), 6) AS ccdf FROM c")
def degree_distribution_ccdf(spark, sf):
    c = graph.degrees(edges(spark, sf)).groupBy("degree").agg(F.count("*").alias("n_k"))
    return graph.ccdf(c).select("degree", "n_k", r6(F.col("deg_dist"), "deg_dist"), r6(F.col("ccdf"), "ccdf"))


@query(f"WITH {E_SQL}{T_SQL} SELECT degree, round(avg(sum_deg_n), 6) AS sum_deg_n, round(avg(avg_deg_n), 6) AS avg_deg_n FROM prop GROUP BY degree")
def knn_spectrum(spark, sf):
    return graph.class_spectra(graph.properties(edges(spark, sf))).select("degree", r6(F.col("sum_deg_n"), "sum_deg_n"), r6(F.col("avg_deg_n"), "avg_deg_n"))


@query(f"WITH {E_SQL}{T_SQL} SELECT degree, count(*) AS n_k, round(avg(nb_triang), 6) AS nb_triang, round(avg(clustering), 6) AS clust FROM prop GROUP BY degree")
def clustering_spectrum(spark, sf):
    return graph.class_spectra(graph.properties(edges(spark, sf))).select("degree", "n_k", r6(F.col("nb_triang"), "nb_triang"), r6(F.col("clust"), "clust"))


_REACH = f"WITH RECURSIVE {E_SQL}, r(vid, c) AS (SELECT vid, vid FROM deg UNION SELECT adj.u, r.c FROM r JOIN adj ON r.vid = adj.v), comp AS (SELECT vid, min(c) AS component FROM r GROUP BY vid)"


@query(f"{_REACH} SELECT vid, component FROM comp")
def connected_components(spark, sf):
    return graph.components(edges(spark, sf))


@query(f"{_REACH}, big AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component DESC LIMIT 1) SELECT src, dst FROM e JOIN comp ON src = vid JOIN big USING (component)")
def giant_component_edges(spark, sf):
    return graph.giant_component(stored(edges(spark, sf), "edges"))[0]


@query(f"WITH {E_SQL} SELECT adj.v AS parent, adj.u AS leaf FROM adj JOIN deg a ON adj.v = a.vid JOIN deg b ON adj.u = b.vid WHERE a.degree > 1 AND b.degree = 1")
def leaf_neighbors(spark, sf):
    return graph.leaves(edges(spark, sf))


@query("SELECT c_name AS name, row_number() OVER (ORDER BY strlen(c_name), c_name) AS rank FROM customer")
def name_ordering(spark, sf):
    from horosphere.sources.text import name_order

    return ordered.numbered(spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_name").alias("name")), name_order(), "rank", 1).select("name", "rank")


@query(f"WITH {E_SQL}{V_SQL} SELECT src, dst, round(distance, 6) AS distance FROM ends")
def circular_distance(spark, sf):
    e, v, _ = model(spark, sf)
    return pairs.with_ends(e, v, 1).select("src", "dst", r6(F.col("distance"), "distance"))


_EMB = "x AS (SELECT vec_id, list_transform(embedding, lambda t: t::DOUBLE) AS v FROM embeddings), y AS (SELECT a.vec_id AS a, b.vec_id AS b, a.v AS va, b.v AS vb FROM x a JOIN x b ON b.vec_id = a.vec_id + 1)"


def _neighbours(spark, sf):
    x = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return x.select(F.col("vec_id").alias("a"), F.col("v").alias("va")).join(x.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("v").alias("vb")), "a")


@query(f"WITH {_EMB} SELECT a, b, round(acos(least(1.0, greatest(-1.0, list_dot_product(va, vb) / sqrt(list_dot_product(va, va)) / sqrt(list_dot_product(vb, vb))))), 6) AS angle FROM y")
def vector_angle(spark, sf):
    return _neighbours(spark, sf).select("a", "b", r6(G.angle(F.col("va"), F.col("vb")), "angle"))


@query(f"WITH {_EMB} SELECT a, b, round(sqrt(list_sum(list_transform(list_zip(va, vb), lambda t: (t[1] - t[2]) ** 2))), 6) AS distance FROM y")
def euclidean_distance(spark, sf):
    return _neighbours(spark, sf).select("a", "b", r6(G.euclidean(F.col("va"), F.col("vb")), "distance"))


@query(f"WITH {_EMB} SELECT vec_id, i, round(v[i] * 10 / sqrt(list_dot_product(v, v)), 6) AS x FROM x, range(1, 65) t(i)")
def normalize_vectors(spark, sf):
    x = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return x.select("vec_id", F.posexplode(G.scaled(F.col("v"), 10.0)).alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), r6(F.col("x"), "x"))


_HYP = "x AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), h AS (SELECT *, acos(a / sqrt(a * a + b * b + c * c)) AS p1, CASE WHEN c < 0 THEN 2 * pi() - acos(b / sqrt(b * b + c * c)) ELSE acos(b / sqrt(b * b + c * c)) END AS p2 FROM x)"


def _three(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("v"))


@query(f"WITH {_HYP} SELECT vec_id, round(p1, 6) AS phi1, round(p2, 6) AS phi2 FROM h")
def hyperspherical(spark, sf):
    a = G.to_hyperspherical(F.col("v"), 2)
    return _three(spark, sf).select("vec_id", r6(a[0], "phi1"), r6(a[1], "phi2"))


@query(f"WITH {_HYP} SELECT vec_id, round(cos(p1), 6) AS x, round(sin(p1) * cos(p2), 6) AS y, round(sin(p1) * sin(p2), 6) AS z FROM h")
def cartesian_roundtrip(spark, sf):
    x = _three(spark, sf).withColumn("p", G.to_hyperspherical(F.col("v"), 2))
    c = G.to_cartesian(F.col("p"), 2)
    return x.select("vec_id", r6(c[0], "x"), r6(c[1], "y"), r6(c[2], "z"))


@query("WITH x AS (SELECT vec_id, list_transform(embedding[1:3], lambda t: t::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM x), s AS (SELECT vec_id, v, [1 + v[1] / n, v[2] / n, v[3] / n] AS s FROM u) SELECT vec_id, round(2 * s[1] * list_dot_product(s, v) / list_dot_product(s, s) - v[1], 6) AS x, round(2 * s[2] * list_dot_product(s, v) / list_dot_product(s, s) - v[2], 6) AS y, round(2 * s[3] * list_dot_product(s, v) / list_dot_product(s, s) - v[3], 6) AS z FROM s")
def rotation_axis(spark, sf):
    e1 = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    c = G.rotate_axis_to(e1, F.col("u"), F.col("v"))
    return _three(spark, sf).withColumn("u", G.scaled(F.col("v"), 1.0)).withColumn("c", c).select("vec_id", r6(F.col("c")[0], "x"), r6(F.col("c")[1], "y"), r6(F.col("c")[2], "z"))


@query("WITH x AS (SELECT vec_id, list_transform(embedding[1:3], lambda t: t::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda t: t / sqrt(list_dot_product(v, v))) AS v FROM x), y AS (SELECT a.vec_id, a.v AS a, b.v AS b, acos(least(1.0, greatest(-1.0, list_dot_product(a.v, b.v)))) AS w FROM u a JOIN u b ON b.vec_id = a.vec_id + 1) SELECT vec_id, i AS step, round((sin((1 - i / 49.0::DOUBLE) * w) * a[1] + sin(i / 49.0::DOUBLE * w) * b[1]) / sin(w), 6) AS x FROM y, range(0, 50) t(i)")
def slerp_points(spark, sf):
    x = _three(spark, sf).select("vec_id", G.scaled(F.col("v"), 1.0).alias("v"))
    y = x.select("vec_id", F.col("v").alias("a")).join(x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b")), "vec_id")
    y = y.select("vec_id", "a", "b", G.angle(F.col("a"), F.col("b")).alias("w"))  # once, not in every step
    return y.select("vec_id", F.posexplode(G.slerp(F.col("a"), F.col("b"), w=F.col("w"))).alias("step", "p")).select("vec_id", F.col("step").cast("long").alias("step"), r6(F.col("p")[0], "x"))


@query(f"WITH {E_SQL}{V_SQL} SELECT src, dst, round(big_r * distance / (mu * ka * kb), 6) AS chi, round(1 / (1 + (big_r * distance / (mu * ka * kb)) ** 2.5), 6) AS p FROM ends CROSS JOIN par")
def chi_probability(spark, sf):
    e, v, p = model(spark, sf)
    x = G.chi(F.col("distance"), F.col("ka"), F.col("kb"), 1, p.big_r, p.mu)
    return pairs.with_ends(e, v, 1).select("src", "dst", r6(x, "chi"), r6(G.probability(x, BETA), "p"))


@query(f"WITH {E_SQL}{V_SQL}, q AS (SELECT i, j, 1 / (1 + chi ** 2.5) AS p FROM pr) SELECT vid, round(sum(p), 5) AS exp_deg FROM (SELECT i AS vid, p FROM q UNION ALL SELECT j, p FROM q) GROUP BY vid")
def expected_degree(spark, sf):
    _, v, p = model(spark, sf)
    return pairs.expected_degrees(v, 1, BETA, p.big_r, p.mu, p.n).select("vid", F.round("exp_deg", 5).alias("exp_deg"))


_NODES = 400


def _classes(e) -> tuple[np.ndarray, np.ndarray]:
    """Degrees and numbers of vertices of the degree classes, on the driver: a row a class, whatever the graph's size."""
    rows = sorted(map(tuple, graph.degrees(e).groupBy("degree").agg(F.count("*").alias("n_k")).collect()))
    return np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)


@query(f"WITH {E_SQL}{V_SQL}, c AS (SELECT degree AS k, count(*) AS n_k FROM deg GROUP BY degree), p AS (SELECT a.k AS k, b.k AS k2, b.n_k - (a.k = b.k)::INT AS w, (SELECT avg(1 / (1 + ((n / (2 * mu * a.k * b.k)) * ((u + 0.5) / {_NODES})) ** 2.5)) FROM range({_NODES}) t(u)) AS p FROM c a CROSS JOIN c b CROSS JOIN par) SELECT k AS degree, round(sum(w * p), 5) AS exp_deg FROM p GROUP BY k")
def expected_degree_by_class(spark, sf):
    """By the midpoint sum, so that SQL evaluates the same; classes are few, one row each."""
    e, _, p = model(spark, sf)
    k, n_k = _classes(e)
    exp = infer.class_degrees(k, n_k, p.mu, BETA, 1, integral=partial(special.midpoint_probability, nodes=_NODES))
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(k, exp, strict=True)], "degree long, exp_deg double").select("degree", F.round("exp_deg", 5).alias("exp_deg"))


_LL = f"WITH {E_SQL}{V_SQL}, t AS (SELECT i, j, -ln(1 + greatest(chi, 1e-300) ** -2.5) AS x FROM pr UNION ALL SELECT src, dst, -2.5 * ln(greatest(big_r * distance / (mu * ka * kb), 1e-300)) FROM ends CROSS JOIN par)"


@query(f"{_LL} SELECT vid, round(sum(x), 4) AS ll FROM (SELECT i AS vid, x FROM t UNION ALL SELECT j, x FROM t) GROUP BY vid")
def loglikelihood_vertex(spark, sf):
    e, v, p = model(spark, sf)
    return pairs.vertex_log_likelihood(v, e, 1, BETA, p.big_r, p.mu, p.n).select("vid", F.round("ll", 4).alias("ll"))


@query(f"{_LL} SELECT round(sum(x), 2) AS ll FROM t")
def loglikelihood_total(spark, sf):
    e, v, p = model(spark, sf)
    return pairs.vertex_log_likelihood(v, e, 1, BETA, p.big_r, p.mu, p.n).agg(F.round(F.sum("ll") / 2, 2).alias("ll"))


_MEAN = f"WITH {E_SQL}{V_SQL}, m AS (SELECT v AS vid, atan2(sum(sin(theta) / (kappa * kappa)), sum(cos(theta) / (kappa * kappa))) AS a FROM adj JOIN vx ON u = vid GROUP BY v), w AS (SELECT vid, CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END AS mean FROM m)"


@query(f"{_MEAN} SELECT vid, round(mean, 6) AS mean FROM w")
def weighted_circular_mean(spark, sf):
    e, v, _ = model(spark, sf)
    return embed.neighbour_centres(v, e).select("vid", r6(F.col("mean"), "mean"))


@query(f"{_MEAN} SELECT w.vid, round(greatest(pi(), max(pi() - abs(pi() - abs(mean - theta)))) / 2, 6) AS deviation FROM w JOIN adj ON w.vid = adj.v JOIN vx ON adj.u = vx.vid GROUP BY w.vid")
def max_neighbor_deviation(spark, sf):
    e, v, _ = model(spark, sf)
    return embed.neighbour_centres(v, e).select("vid", r6(F.col("deviation"), "deviation"))


@query(f"WITH {E_SQL}{V_SQL}, b AS (SELECT i, j, chi, CASE WHEN chi > 0 THEN least(800, greatest(0, ceil((log10(chi) + 20) / 0.05)))::INT ELSE 0 END AS bin FROM pr) SELECT bin, count(*) AS n, round(avg(chi), 4) AS rescaled_dist, round(avg((src IS NOT NULL)::INT), 6) AS inf_conn_prob, round(1 / (1 + avg(chi) ** 2.5), 6) AS th_conn_prob FROM b LEFT JOIN e ON i = src AND j = dst GROUP BY bin")
def pconn_histogram(spark, sf):
    e, v, p = model(spark, sf)
    h = pairs.connection_histogram(v, e, 1, BETA, p.big_r, p.mu, p.n)
    return h.select("bin", "n", F.round("rescaled_dist", 4).alias("rescaled_dist"), r6(F.col("inf_conn_prob"), "inf_conn_prob"), r6(F.col("th_conn_prob"), "th_conn_prob"))


@query(f"WITH {E_SQL}{V_SQL}, b AS (SELECT least(24, floor(theta / (2 * pi() / 25)))::BIGINT AS bin, count(*) AS n FROM vx GROUP BY 1) SELECT i AS bin, coalesce(b.n, 0) AS n, round((i + 0.5) * 2 * pi() / 25, 6) AS theta, round(coalesce(b.n, 0) / par.n, 6) AS inf_density, 0.04::DOUBLE AS th_density FROM range(25) t(i) LEFT JOIN b ON i = bin CROSS JOIN par")
def theta_density(spark, sf):
    x = embed.theta_density(model(spark, sf)[1])
    return x.select("bin", "n", r6(F.col("theta"), "theta"), r6(F.col("inf_density"), "inf_density"), "th_density")


_HR = "hr AS (SELECT vid, theta, 2 * ln(n / (pi() * mu * k0 * k0)) - 2 * ln(kappa / k0) AS r FROM vx CROSS JOIN par)"


def _radii(spark, sf):
    e, v, p = model(spark, sf)
    low = v.agg(F.min("kappa")).first()[0]
    return e, v.withColumn("hyp_rad", G.hyperbolic_radius(F.col("kappa"), low, 1, p.n, p.mu)), p


@query(f"WITH {E_SQL}{V_SQL}, {_HR} SELECT vid, round(r, 6) AS hyp_rad FROM hr")
def hyperbolic_radius(spark, sf):
    return _radii(spark, sf)[1].select("vid", r6(F.col("hyp_rad"), "hyp_rad"))


@query(f"WITH {E_SQL}{V_SQL}, {_HR}, x AS (SELECT src, dst, a.r AS ra, b.r AS rb, pi() - abs(pi() - abs(a.theta - b.theta)) AS d FROM e JOIN hr a ON src = a.vid JOIN hr b ON dst = b.vid) SELECT src, dst, round(CASE WHEN d = 0 THEN abs(ra - rb) ELSE acosh(greatest(1.0, ((1 - cos(d)) * cosh(ra + rb) + (1 + cos(d)) * cosh(ra - rb)) / 2)) END, 5) AS distance FROM x")
def hyperbolic_distance(spark, sf):
    e, v, _ = _radii(spark, sf)
    a, b = (v.select(F.col("vid").alias(x), F.col("theta").alias(f"t{x}"), F.col("hyp_rad").alias(f"r{x}")) for x in ("src", "dst"))
    d = G.hyperbolic_distance(F.col("rsrc"), F.col("rdst"), G.circular_distance(F.col("tsrc"), F.col("tdst")))
    return e.join(a, "src").join(b, "dst").select("src", "dst", F.round(d, 5).alias("distance"))


_CDF = f"WITH {E_SQL}, c AS (SELECT degree AS k, count(*) AS n_k FROM deg GROUP BY degree), m AS (SELECT sum(k * n_k)::DOUBLE AS m FROM c), f AS (SELECT a.k, b.k AS k2, sum(b.k * b.n_k / m) OVER (PARTITION BY a.k ORDER BY b.k) AS hi FROM c a CROSS JOIN c b CROSS JOIN m WHERE a.k >= 2)"


def _cdf(e) -> tuple[np.ndarray, np.ndarray]:
    """The classes, and the cumulated shares of a neighbour's class in the uncorrelated graph."""
    k, n_k = _classes(e)
    return k, infer.cumulated(np.outer(np.ones(len(k)), k * n_k))


@query(f"{_CDF} SELECT k, k2, round(hi, 6) AS hi FROM f")
def conditional_cdf(spark, sf):
    k, cdf = _cdf(edges(spark, sf))
    rows = [(int(a), int(b), float(cdf[i, j])) for i, a in enumerate(k) if a >= 2 for j, b in enumerate(k)]
    return spark.createDataFrame(rows, "k long, k2 long, hi double").select("k", "k2", r6(F.col("hi"), "hi"))


@query(f"{_CDF}, u AS (SELECT vid, degree AS k, {_uniform('vid', 2)} AS u FROM deg WHERE degree >= 2) SELECT vid, coalesce(min(CASE WHEN hi >= u THEN k2 END), max(k2)) AS k2 FROM u JOIN f USING (k) GROUP BY vid")
def cdf_lookup(spark, sf):
    """The least class whose cumulated probability reaches a uniform; beyond the last, the last."""
    e = stored(edges(spark, sf), "edges")
    k, cdf = _cdf(e)
    return infer.draw_neighbours(graph.degrees(e).where("degree >= 2").select("vid", F.col("degree").alias("k"), G.uniform(F.col("vid"), 2).alias("u")), k, cdf)


@query(f"WITH {E_SQL}{V_SQL}, o AS (SELECT vid, theta, coalesce(lag(theta) OVER (ORDER BY theta, vid), last_value(theta) OVER (ORDER BY theta, vid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before, row_number() OVER (ORDER BY theta, vid) AS i FROM vx), g AS (SELECT *, pi() - abs(pi() - abs(theta - before)) AS gap FROM o) SELECT vid, round(gap, 6) AS gap, round(sum(gap) OVER (ORDER BY i) * 2 * pi() / sum(gap) OVER (), 6) AS running FROM g")
def gap_lag_running_theta(spark, sf):
    """Gaps along the circle and their running sum, a prefix sum over ranges of theta."""
    gaps = embed.lagged_gaps(model(spark, sf)[1].select("vid", "theta"), ["theta", "vid"], "theta")
    got = embed.spread_angles(gaps.select("vid", F.col("theta").alias("was"), "gap"), ["was", "vid"], "gap")
    return got.select("vid", r6(F.col("gap"), "gap"), r6(F.col("running"), "running"))


_HEAT = f"WITH {E_SQL}{V_SQL}, c AS (SELECT src, dst, 2 * sin(distance / 2) AS l FROM ends), h AS (SELECT src, dst, exp(-l * l / (SELECT avg(l * l) FROM c)) AS w FROM c)"


def _heat(spark, sf):
    e, v, _ = model(spark, sf)
    return embed.heat_kernel(pairs.with_ends(e, v, 1).select("src", "dst", F.col("distance").alias("d")))


@query(f"{_HEAT} SELECT src, dst, round(w, 6) AS w FROM h")
def heat_kernel_weights(spark, sf):
    return _heat(spark, sf).select("src", "dst", r6(F.col("w"), "w"))


@query(f"{_HEAT}, b AS (SELECT src AS i, dst AS j, w FROM h UNION ALL SELECT dst, src, w FROM h), s AS (SELECT i, sum(w) AS s FROM b GROUP BY i) SELECT i, j, round(-w / s, 6) AS l FROM b JOIN s USING (i) UNION ALL SELECT i, i, 1.0 FROM s")
def laplacian_rows(spark, sf):
    return embed.laplacian(_heat(spark, sf)).select("i", "j", r6(F.col("l"), "l"))


def _portable_graphs(spark, sf, graphs):
    """Graphs of the model over customers' nations: 25 vertices, each pair drawn by a portable uniform."""
    v = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("vid"), (F.lit(3.0) + F.col("n_regionkey")).alias("kappa"), (F.lit(2 * PI) * G.uniform(F.col("n_nationkey"), 1)).alias("theta"))
    mu, big_r = G.density(1, BETA, 5.0), G.radius(1, 25)
    return pairs.simulate(v, 1, BETA, big_r, mu, graphs, count=25, uniform=pairs.portable(3))


_GRAPHS = f"""nv AS (SELECT n_nationkey::BIGINT AS vid, 3.0::DOUBLE + n_regionkey AS kappa, 2 * pi() * {_uniform('n_nationkey', 1)} AS theta FROM nation),
np AS (SELECT g::INT AS g, a.vid AS src, b.vid AS dst, 1 / (1 + (25 / (2 * pi()) * (pi() - abs(pi() - abs(a.theta - b.theta))) / (2.5 * sin(pi() / 2.5) / (2 * pi() * 5.0) * a.kappa * b.kappa)) ** 2.5) AS p FROM nv a JOIN nv b ON a.vid < b.vid CROSS JOIN range(20) t(g)),
sim AS (SELECT g, src, dst FROM np WHERE {_uniform("(g || '-' || src || '-' || dst)", 3)} < p),
sadj AS (SELECT g, src AS vid, dst AS u FROM sim UNION ALL SELECT g, dst, src FROM sim), sdeg AS (SELECT g, vid, count(*) AS degree FROM sadj GROUP BY g, vid),
snb AS (SELECT a.g, a.vid, sum(d.degree)::DOUBLE AS sum_deg_n, avg(d.degree) AS avg_deg_n FROM sadj a JOIN sdeg d ON a.g = d.g AND a.u = d.vid GROUP BY a.g, a.vid),
stri AS (SELECT g, vid, count(*) AS nb_triang FROM (SELECT a.g, unnest([a.src, a.dst, b.dst]) AS vid FROM sim a JOIN sim b ON a.g = b.g AND a.dst = b.src JOIN sim c ON c.g = a.g AND c.src = a.src AND c.dst = b.dst) GROUP BY g, vid),
sp AS (SELECT g, vid, degree::DOUBLE AS degree, sum_deg_n, avg_deg_n, coalesce(nb_triang, 0)::DOUBLE AS nb_triang, CASE WHEN degree > 1 THEN 2.0::DOUBLE * coalesce(nb_triang, 0) / (degree * (degree - 1)) ELSE 0.0 END AS clustering FROM sdeg JOIN snb USING (g, vid) LEFT JOIN stri USING (g, vid))"""
_COLS = ("degree", "sum_deg_n", "avg_deg_n", "nb_triang", "clustering")


@query(f"WITH {_GRAPHS} SELECT g, src, dst FROM sim")
def bernoulli_graph(spark, sf):
    return _portable_graphs(spark, sf, 20)


@query(f"WITH {_GRAPHS} SELECT vid, " + ", ".join(f"round(sum({c}) / 20, 6) AS avg_{c}, round(sqrt(greatest(0.0, sum({c} * {c}) / 20 - (sum({c}) / 20) ** 2)), 4) AS std_{c}" for c in _COLS) + " FROM sp GROUP BY vid")
def ensemble_vertex_stats(spark, sf):
    x = validate.vertex_statistics(validate.simulated_properties(stored(_portable_graphs(spark, sf, 20), "sim")), 20)
    return x.select("vid", *(F.round(c, 6 if c[:3] == "avg" else 4).alias(c) for c in x.columns[1:]))


@query(f"WITH {_GRAPHS}, c AS (SELECT g, degree, count(*) / 25.0::DOUBLE AS deg_dist, " + ", ".join(f"avg({c}) AS {c}" for c in _COLS[1:]) + " FROM sp GROUP BY g, degree) SELECT degree::BIGINT AS degree, " + ", ".join(f"round(avg({c}), 6) AS avg_{c}, round(stddev_pop({c}), 5) AS std_{c}" for c in ("deg_dist", *_COLS[1:])) + " FROM c GROUP BY degree")
def ensemble_class_stats(spark, sf):
    x = validate.class_statistics(validate.simulated_properties(stored(_portable_graphs(spark, sf, 20), "sim")), 25)
    return x.select("degree", *(F.round(c, 6 if c[:3] == "avg" else 5).alias(c) for c in x.columns[1:]))


_ENS = f"WITH {_GRAPHS}, top AS (SELECT g, max(degree)::BIGINT AS m FROM sp GROUP BY g), ax AS (SELECT g, unnest(range(0, m + 1)) AS d FROM top), x AS (SELECT ax.g, d, CASE WHEN d = 0 THEN 1.0 ELSE count(sp.vid) / 25.0::DOUBLE END AS x FROM ax LEFT JOIN sp ON ax.g = sp.g AND sp.degree >= d GROUP BY ax.g, d), en AS (SELECT d AS degree, avg(x) AS avg_ccdf, stddev_pop(x) AS std_ccdf FROM x GROUP BY d)"


@query(f"{_ENS} SELECT degree, round(avg_ccdf, 6) AS avg_ccdf, round(std_ccdf, 5) AS std_ccdf FROM en")
def ensemble_ccdf(spark, sf):
    x = validate.ensemble_ccdf(validate.simulated_properties(stored(_portable_graphs(spark, sf, 20), "sim")), 25)
    return x.select("degree", r6(F.col("avg_ccdf"), "avg_ccdf"), F.round("std_ccdf", 5).alias("std_ccdf"))


@query(f"{_ENS}, o AS (SELECT d AS degree, x AS ccdf FROM x WHERE g = 0) SELECT round(max(abs(avg_ccdf - ccdf)), 6) AS ks, round(sqrt(-0.5 * ln(0.025)) * sqrt(((SELECT count(*) FROM en) + (SELECT count(*) FROM o)) / ((SELECT count(*) FROM en) * (SELECT count(*) FROM o))::DOUBLE), 6) AS critical FROM en JOIN o USING (degree)")
def ks_test(spark, sf):
    props = stored(validate.simulated_properties(stored(_portable_graphs(spark, sf, 20), "sim")), "props")
    ens = validate.ensemble_ccdf(props, 25).select("degree", F.col("avg_ccdf").alias("ccdf"))
    one = validate.ensemble_ccdf(props.where("g = 0"), 25).select("degree", F.col("avg_ccdf").alias("ccdf"))
    return validate.ks_test(ens, one).select(r6(F.col("ks"), "ks"), r6(F.col("critical"), "critical"))


@query(f"WITH {_GRAPHS}, s AS (SELECT vid, sum(degree) / 20 AS a, sqrt(greatest(0.0, sum(degree * degree) / 20 - (sum(degree) / 20) ** 2)) AS d FROM sp GROUP BY vid), x AS (SELECT kappa AS o, a, d FROM nv JOIN s USING (vid)) SELECT round(corr(o, a), 6) AS pearson, round(sum(CASE WHEN d > 0 THEN (o - a) ** 2 / (d * d) END) / count(*), 4) AS chi2, round(avg(CASE WHEN abs(o - a) > 1.5 * d THEN 1.0 ELSE 0.0 END), 6) AS zeta FROM x")
def pearson_chi2_zeta(spark, sf):
    s = validate.vertex_statistics(validate.simulated_properties(stored(_portable_graphs(spark, sf, 20), "sim")), 20)
    v = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("vid"), (F.lit(3.0) + F.col("n_regionkey")).alias("kappa"))
    x = validate.agreement(v.join(s, "vid"), "kappa", "avg_degree", "std_degree")
    return x.select(r6(F.col("pearson"), "pearson"), F.round("chi2", 4).alias("chi2"), r6(F.col("zeta"), "zeta"))


@query(f"""WITH RECURSIVE {E_SQL}, r(s, vid, dist) USING KEY (s, vid) AS (SELECT vid, vid, 0::BIGINT FROM deg WHERE vid % 100 = 0
  UNION SELECT r.s, adj.u, r.dist + 1 FROM r JOIN adj ON r.vid = adj.v LEFT JOIN recurring.r AS seen ON seen.s = r.s AND seen.vid = adj.u WHERE seen.vid IS NULL)
SELECT s, vid, dist FROM r""")
def bfs_lengths(spark, sf):
    """From every vertex whose id is divisible by 100 to all that it reaches."""
    e = stored(edges(spark, sf), "edges")
    return graph.bfs(e, graph.degrees(e).where("vid % 100 = 0").select(F.col("vid").alias("s")))


@query("WITH k AS (SELECT c_custkey, (1 - 1 / 1000.0) / (1 - 1000.0::DOUBLE ** ((2 - 2.7) / 1.7)) * 0.7 / 1.7 * 10 AS k0, " + _uniform("c_custkey", 4) + " AS u FROM customer) SELECT c_custkey AS vid, round(k0 * (1 - u * (1 - (1000.0::DOUBLE ** (1 / 1.7)) ** (1 - 2.7))) ** (1 / (1 - 2.7)), 5) AS kappa FROM k")
def powerlaw_kappas(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select(F.col("c_custkey").alias("vid"), F.round(G.power_law(G.uniform(F.col("c_custkey"), 4), 1000, 2.7, 10), 5).alias("kappa"))


@query(f"WITH {E_SQL}, m AS (SELECT count(*) AS n, avg(exp(-degree::DOUBLE)) AS m FROM deg) SELECT n, round(m, 6) AS m, round(n * m / (1 - m))::BIGINT AS extra FROM m")
def zero_degree_fix(spark, sf):
    m = generate.isolated(graph.degrees(edges(spark, sf)).select(F.col("degree").cast("double").alias("kappa")))
    return m.select("n", r6(F.col("m"), "m"), "extra")


@query(f"WITH x AS (SELECT n_nationkey AS vid, c, CASE WHEN c = 0 THEN 0.5 ELSE {_uniform("(n_nationkey || '-' || c)", 5)} END AS ll FROM nation CROSS JOIN range(20) t(c)) SELECT vid, c AS best, round(ll, 6) AS ll FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY ll DESC, c) AS k FROM x) WHERE k = 1")
def argmax_candidate(spark, sf):
    """The best of candidates, the present place (candidate 0) winning ties."""
    x = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("vid"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("c"))
    x = x.withColumn("ll", F.when(F.col("c") == 0, F.lit(0.5)).otherwise(G.uniform(F.concat_ws("-", "vid", "c"), 5)))
    return embed.best_candidates(x).select("vid", "best", r6(F.col("ll"), "ll"))


_TRIES = 8


@query(f"WITH {E_SQL}{V_SQL}, c AS (SELECT vid, kappa, c, CASE WHEN c = 0 THEN theta ELSE 2 * pi() * {_uniform("(vid || '-' || c)", 5)} END AS th FROM vx CROSS JOIN range({_TRIES}) t(c)), "
       "x AS (SELECT c.vid, c, b.vid AS u, greatest(big_r * (pi() - abs(pi() - abs(th - b.theta))) / (mu * c.kappa * b.kappa), 1e-12) AS x FROM c JOIN vx b ON c.vid <> b.vid CROSS JOIN par), "
       "s AS (SELECT x.vid, c, sum(-ln(1 + x ** -2.5) - CASE WHEN adj.u IS NULL THEN 0 ELSE 2.5 * ln(x) END) AS ll FROM x LEFT JOIN adj ON x.vid = adj.v AND x.u = adj.u GROUP BY x.vid, c) "
       "SELECT vid, c AS best, round(ll, 3) AS ll FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY ll DESC, c) AS k FROM s) WHERE k = 1")  # fmt: skip
def refine_candidates(spark, sf):
    """For every vertex the likeliest of its place and other candidates, all others at theirs."""
    e, v, p = model(spark, sf)
    c = v.select("vid", "theta", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_TRIES - 1).cast("long"))).alias("c"))
    c = c.select("vid", "c", F.when(F.col("c") == 0, F.col("theta")).otherwise(F.lit(2 * PI) * G.uniform(F.concat_ws("-", "vid", "c"), 5)).alias("theta"))
    return embed.best_candidates(embed.score_places(v, e, c, p)).select("vid", "best", F.round("ll", 3).alias("ll"))


@query("WITH x AS (SELECT vec_id, list_transform(embedding[1:3], lambda t: t::DOUBLE) AS v FROM embeddings), y AS (SELECT vec_id, v, k, k * 2 * pi() / 49 AS t FROM x CROSS JOIN range(50) r(k)), z AS (SELECT k, v, [v[1], cos(t) * v[2] - sin(t) * v[3], sin(t) * v[2] + cos(t) * v[3]] AS w FROM y) SELECT k, round(avg(acos(least(1.0, greatest(-1.0, list_dot_product(v, w) / list_dot_product(v, v))))), 5) AS distance FROM z GROUP BY k")
def mean_angular_distance(spark, sf):
    """Of a point set and its spins about the first axis, by candidate."""
    turns = np.array([align.spin(3, 1, 2, t) for t in np.linspace(0, 2 * PI, 50)])
    return align.mean_distances(_three(spark, sf).select(F.col("v").alias("real"), F.col("v").alias("inf")), turns).select("k", F.round("distance", 5).alias("distance"))


_ONION = f"""WITH RECURSIVE {E_SQL}, r(layer, core, vid, gone) AS (
  SELECT 0::BIGINT, 0::BIGINT, vid, FALSE FROM deg
  UNION ALL
  SELECT layer + 1, greatest(core, m), vid, k <= greatest(core, m) FROM (
    SELECT l.layer, l.core, l.vid, count(n.vid) AS k, min(count(n.vid)) OVER () AS m
    FROM r l JOIN adj ON adj.v = l.vid LEFT JOIN (SELECT vid FROM r WHERE NOT gone) n ON adj.u = n.vid WHERE NOT l.gone GROUP BY l.layer, l.core, l.vid))"""


@query(f"{_ONION} SELECT vid, core AS coreness, layer FROM r WHERE gone")
def coreness_onion(spark, sf):
    return graph.onion(stored(edges(spark, sf), "edges"))


@query(f"{_ONION} SELECT vid, row_number() OVER (ORDER BY layer DESC, {_uniform('vid', 6)}, vid) - 1 AS place FROM r WHERE gone")
def visiting_order(spark, sf):
    return graph.visiting_order(graph.onion(stored(edges(spark, sf), "edges")), 6)


_GIANT = f"{_REACH}, big AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component DESC LIMIT 1), ge AS (SELECT src, dst FROM e JOIN comp ON src = vid JOIN big USING (component)), ga AS (SELECT src AS v, dst AS u FROM ge UNION ALL SELECT dst, src FROM ge)"


def _route_sql(modified: bool) -> str:
    """Runs as rows; every step, the neighbour of the least (distance to the target, vid)."""
    d = "CASE WHEN {0}.theta = t.theta THEN abs({0}.r - t.r) ELSE acosh(greatest(1.0, ((1 - cos(pi() - abs(pi() - abs({0}.theta - t.theta)))) * cosh({0}.r + t.r) + (1 + cos(pi() - abs(pi() - abs({0}.theta - t.theta)))) * cosh({0}.r - t.r)) / 2)) END"
    stuck = "m.u = cur_prev" if modified else "m.d >= best"
    return f"""{_GIANT}{V_SQL}, {_HR}, gi AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT v AS vid FROM ga)),
rn AS (SELECT i AS run, floor({_uniform('i', 1)} * n)::BIGINT AS a, floor({_uniform('i', 2)} * (n - 1))::BIGINT AS b, n FROM range((SELECT 10 * count(*) FROM gi)) q(i) CROSS JOIN (SELECT count(*) AS n FROM gi)),
runs AS (SELECT run, x.vid AS s, y.vid AS t FROM rn JOIN gi x ON rn.a = x.i JOIN gi y ON (rn.a + 1 + rn.b) % rn.n = y.i),
w(run, s, t, cur, prev, hops, best, status) AS (
  SELECT run, s, t.vid, s, -1::BIGINT, 0::BIGINT, {d.format('c')}, 'on' FROM runs JOIN hr c ON s = c.vid JOIN hr t ON runs.t = t.vid
  UNION ALL
  SELECT run, s, t, m.u, cur, hops + CASE WHEN m.u <> t AND {stuck} THEN 0 ELSE 1 END, m.d, CASE WHEN m.u = t THEN 'arrived' WHEN {stuck} THEN 'dropped' ELSE 'on' END FROM (
    SELECT w.run, w.s, w.t, any_value(w.cur) AS cur, any_value(w.prev) AS cur_prev, any_value(w.hops) AS hops, any_value(w.best) AS best,
      min({{'d': CASE WHEN u.vid = w.t THEN -1.0 ELSE {d.format('u')} END, 'u': u.vid}}) AS m
    FROM w JOIN ga ON w.cur = ga.v JOIN hr u ON ga.u = u.vid JOIN hr t ON w.t = t.vid WHERE w.status = 'on' GROUP BY w.run, w.s, w.t)),
routed AS (SELECT run, s, t, status, hops FROM w WHERE status <> 'on')"""


def _routes(spark, sf, modified):
    e, v, _ = _radii(spark, sf)
    giant = stored(graph.giant_component(e)[0], "giant")
    inside = v.join(graph.degrees(giant).select("vid"), "vid", "left_semi")
    inside = stored(inside, "inside")
    runs = stored(routing.sample_runs(inside, 10 * inside.count()), "routed")
    return giant, runs, routing.route(giant, inside, runs, 1, modified)


@query(f"{_route_sql(False)} SELECT run, s, t, status, hops FROM routed")
def greedy_routing(spark, sf):
    return _routes(spark, sf, False)[2]


@query(f"{_route_sql(True)} SELECT run, s, t, status, hops FROM routed")
def greedy_routing_modified(spark, sf):
    return _routes(spark, sf, True)[2]


# shortest paths of the runs that arrive: as they are no longer than the longest of these, walks need not be either
@query(f"""{_route_sql(False)}, b(s, vid, l) AS (
  SELECT DISTINCT s, s, 0::BIGINT FROM routed WHERE status = 'arrived' UNION SELECT s, u, l + 1 FROM b JOIN ga ON b.vid = ga.v WHERE l < (SELECT max(hops) FROM routed WHERE status = 'arrived')),
short AS (SELECT s, vid AS t, min(l) AS dist FROM b GROUP BY s, vid), x AS (SELECT CASE WHEN status = 'arrived' THEN hops END AS h, CASE WHEN status = 'arrived' THEN dist END AS dist FROM routed LEFT JOIN short USING (s, t))
SELECT round(avg((h IS NOT NULL)::INT), 6) AS p_s, round(avg(h), 6) AS mean_hop_length, round(avg(h / dist), 6) AS mean_strech, round(max(h / dist), 6) AS max_strech, round(sum(dist / h) / count(*), 6) AS gr_score FROM x""")
def routing_summary(spark, sf):
    giant, _, got = _routes(spark, sf, False)
    got = routing.summary(got, routing.shortest_paths(giant, got.where("status = 'arrived'")))  # no other run's path is asked for
    return got.select(*(r6(F.col(c), c) for c in got.columns))


def _synthetic(spark, sf, dim=1, beta=2.5, seed=7, whole=False):
    """A graph of the model whose hidden degrees are the degrees of the whole part graph: that itself has hardly any clustering."""
    hidden = graph.degrees(edges(spark, sf, whole)).select("vid", F.concat(F.lit("v"), F.col("vid")).alias("name"), F.col("degree").cast("double").alias("kappa"))
    return generate.generate(stored(hidden, "degrees"), beta * dim, dim, seed=seed)


def _synthetic_giant(spark, sf, dim=1, whole=False):
    return stored(graph.giant_component(_synthetic(spark, sf, dim=dim, whole=whole).edges)[0], "giant")


@query()
def generate_s1(spark, sf):
    return _synthetic(spark, sf).vertices.select("vid", "name", "kappa", "theta", "hyp_rad", "real_deg", "exp_deg")


@query()
def generate_s2(spark, sf):
    return _synthetic(spark, sf, dim=2).vertices.select("vid", "name", "kappa", "pos", "hyp_rad", "real_deg", "exp_deg")


@query()
def infer_kappas_class(spark, sf):
    k, n_k = _classes(edges(spark, sf))
    kappa, exp, _ = infer.class_kappas(k, n_k, BETA, 1, np.random.default_rng(1))
    return spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(k, kappa, exp, strict=True)], "degree long, kappa double, exp_deg double")


@query()
def infer_beta(spark, sf):
    """From the degrees of all consecutive lines, whatever their discount."""
    props = stored(graph.local_clustering(_synthetic_giant(spark, sf, whole=True)), "properties")
    p = infer.infer_parameters(props.groupBy("degree").agg(F.count("*").alias("n_k")), props.where("degree > 1").agg(F.avg("clustering")).first()[0])
    return spark.createDataFrame([(p.beta, p.mu)], "beta double, mu double")


def _embedded(spark, sf, dim, **options):
    return embed.embed(_synthetic_giant(spark, sf, dim), embed.EmbedConfig(dim=dim, beta=2.5 * dim, **options))


@query()
def eigenmap_positions(spark, sf):
    return _embedded(spark, sf, 1, fast=True, post_kappa=False).coordinates


@query()
def refine_positions(spark, sf):
    return _embedded(spark, sf, 1, post_kappa=False).coordinates


@query()
def kappa_post_inference(spark, sf):
    return _embedded(spark, sf, 1, fast=True).coordinates


@query()
def embed_s1(spark, sf):
    return _embedded(spark, sf, 1).coordinates


@query()
def embed_s2(spark, sf):
    return _embedded(spark, sf, 2).coordinates


@query()
def align_rotation(spark, sf):
    """A point set against a turned copy of itself: the distance that the best rotation leaves."""
    x = _three(spark, sf).select(F.col("vec_id").cast("string").alias("name"), "v")
    turned = x.select("name", G.apply_rows(align.euler(0.4, 1.1, 2.0).tolist(), F.col("v")).alias("inf"))
    _, _, score = align.align(x.select("name", F.col("v").alias("real")).join(turned, "name"))
    return spark.createDataFrame([(score,)], "distance double")


_GRID = 2_000_000


@query(f"""WITH x AS (SELECT unnest([0.1::DOUBLE, 1.0, 10.0, 1000.0]) AS x), u AS (SELECT (i + 0.5::DOUBLE) / {_GRID} AS u FROM range({_GRID}) t(i)),
y AS (SELECT x, avg(1 / (1 + (x * u) ** 2.5)) AS p, 2 * avg(u / (1 + (x * u) ** 2.5)) AS d, pi() / 2 * avg(sin(pi() * u) / (1 + (x * pi() * u) ** 5)) AS p2, pi() / 2 * avg(pi() * u * sin(pi() * u) / (1 + (x * pi() * u) ** 5)) AS m2 FROM x CROSS JOIN u GROUP BY x)
SELECT x, round(p, 6) AS p, round(d, 6) AS d, round(p2, 6) AS p2, round(m2, 6) AS m2, round(pi() / 2 * d / p, 6) AS linked FROM y""")
def linked_integrals(spark, sf):
    """The model's integrals on a grid: 2F1 of the circle, the class integral of the sphere and its first moment, and the
    expected distance of linked vertices (of kappas such that the argument is x)."""
    x = np.array([0.1, 1.0, 10.0, 1000.0])
    linked = special.linked_distance(np.ones(4), 1 / x, 2.0, 1.0, 2.5, 1)
    rows = zip(x, special.mean_probability(x, 2.5), special.mean_distance(x, 2.5), special.class_probability(x, 5.0, 2), special.class_probability(x, 5.0, 2, moment=1), linked, strict=True)
    got = spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, p double, d double, p2 double, m2 double, linked double")
    return got.select("x", *(r6(F.col(c), c) for c in got.columns[1:]))


@query(f"WITH {E_SQL}{V_SQL} SELECT src, dst, round(p, 6) AS p FROM (SELECT src, dst, 1 / (1 + (big_r * distance / (mu * ka * kb)) ** 2.5) AS p FROM ends CROSS JOIN par) WHERE p >= 0.5")
def strong_links(spark, sf):
    e, v, p = model(spark, sf)
    return pairs.strong_links(pairs.link_probabilities(e, v, 1, BETA, p.big_r, p.mu))[0].select("src", "dst", r6(F.col("p"), "p"))


@query(f"WITH {E_SQL}{V_SQL} SELECT count(*) AS weak FROM (SELECT 1 / (1 + (big_r * distance / (mu * ka * kb)) ** 2.5) AS p FROM ends CROSS JOIN par) WHERE p < 0.5")
def weak_links(spark, sf):
    e, v, p = model(spark, sf)
    return pairs.strong_links(pairs.link_probabilities(e, v, 1, BETA, p.big_r, p.mu))[1]


@query(f"WITH {E_SQL}{V_SQL}, ends_ AS (SELECT floor(log10(min(chi) FILTER (chi > 0))) AS a, ceil(log10(max(chi))) AS z FROM pr), b AS (SELECT i, j, chi, least(98, floor((log10(chi) - a) / (z - a) * 99))::INT AS bin FROM pr CROSS JOIN ends_ WHERE chi >= 10 ** a) SELECT bin, 2 * count(*) AS n, round(avg(chi), 4) AS rescaled_dist, round(sum(CASE WHEN src IS NULL THEN 0 ELSE chi END) / sum(chi), 6) AS conn_prob FROM b LEFT JOIN e ON i = src AND j = dst GROUP BY bin")
def log_histogram(spark, sf):
    e, v, p = model(spark, sf)
    h = pairs.log_histogram(v, e, 1, BETA, p.big_r, p.mu, count=p.n)
    return h.select("bin", "n", F.round("rescaled_dist", 4).alias("rescaled_dist"), r6(F.col("conn_prob"), "conn_prob"))


@query(f"WITH {E_SQL}{V_SQL} SELECT least(24, floor(theta / (2 * pi() / 25)))::BIGINT AS bin, count(*) AS n, round(least(24, floor(theta / (2 * pi() / 25))) * 2 * pi() / 25, 6) AS low, round(avg(theta), 6) AS theta, round(count(*) / (SELECT count(*) FROM vx), 6) AS share FROM vx GROUP BY ALL")
def theta_histogram(spark, sf):
    x = embed.theta_histogram(model(spark, sf)[1])
    return x.select("bin", "n", *(r6(F.col(c), c) for c in ("low", "theta", "share")))


_A, _B, _C = 0.4, 1.1, 2.0


@query(f"WITH x AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), a AS (SELECT vec_id, x, cos({_A}) * y - sin({_A}) * z AS y, sin({_A}) * y + cos({_A}) * z AS z FROM x), b AS (SELECT vec_id, cos({_B}) * x + sin({_B}) * z AS x, y, -sin({_B}) * x + cos({_B}) * z AS z FROM a) SELECT b.vec_id, round(cos({_C}) * b.x - sin({_C}) * b.y, 6) AS x, round(sin({_C}) * b.x + cos({_C}) * b.y, 6) AS y, round(b.z, 6) AS z, round(x.x, 6) AS back FROM b JOIN x USING (vec_id)")
def apply_rotation(spark, sf):
    """A rotation on all points, and the first coordinate after its inverse."""
    m = align.euler(_A, _B, _C)
    turned = align.apply(_three(spark, sf).withColumn("pos", F.col("v")), m)
    both = align.apply(turned.withColumn("back", F.col("pos")), align.inverse(m), "back")
    return both.select("vec_id", *(r6(F.col("pos")[i], n) for i, n in enumerate("xyz")), r6(F.col("back")[0], "back"))


@query("WITH x AS (SELECT 'v' || vec_id AS name, vec_id, label, embedding[1]::DOUBLE AS a FROM embeddings), m AS (SELECT max(label) * 50 / 100.0 AS least FROM x) SELECT x.name, round(x.a, 6) AS real, round(-x.a, 6) AS inf FROM x CROSS JOIN m WHERE label >= least AND vec_id % 3 <> 0")
def matched_points(spark, sf):
    """Two coordinate sets met by name, of at least half the greatest degree (here a vector's label)."""
    x = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.concat(F.lit("v"), "vec_id").alias("name"), "vec_id", F.col("label").alias("realdeg"), F.slice("embedding", 1, 3).cast("array<double>").alias("pos"))
    got = align.paired(x, x.where("vec_id % 3 <> 0").select("name", F.transform("pos", lambda v: -v).alias("pos")), 50)
    return got.select("name", r6(F.col("real")[0], "real"), r6(F.col("inf")[0], "inf"))


@query("SELECT event_id, strftime(ts, '%Y/%m/%d ') || hour(ts) || strftime(ts, ':%M UTC') AS at FROM events")
def utc_times(spark, sf):
    from horosphere.sources import text

    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", text.utc(F.col("ts")).alias("at"))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _named(v):
    return v.withColumn("name", F.concat(F.lit("p"), F.col("vid")))


@query(f"{_GIANT} SELECT src, dst FROM ge")
def edge_file(spark, sf):
    """The giant component written as an edge list, read, its names numbered anew, and those brought back."""
    from horosphere.sources import text

    e = stored(graph.giant_component(stored(edges(spark, sf), "edges"))[0], "giant")
    text.write_edges(e, _named(graph.degrees(e).select("vid")), path := _folder(spark, "edge"))
    named = text.read_edges(spark, path)
    v = stored(graph.dictionary(named), "dictionary")
    back = v.select("vid", F.substring("name", 2, 20).cast("long").alias("was"))
    got = graph.encoded(named, v).join(back.toDF("src", "a"), "src").join(back.toDF("dst", "b"), "dst")
    return got.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


@query(f"WITH {E_SQL}{V_SQL}, {_HR} SELECT 'p' || vid AS name, round(kappa, 6) AS kappa, round(vx.theta, 6) AS theta, round(r, 6) AS hyp_rad FROM hr JOIN vx USING (vid)")
def coordinate_file(spark, sf):
    from horosphere.sources import text

    _, v, p = _radii(spark, sf)
    text.write_coordinates(_named(v), path := _folder(spark, "inf_coord"), 1, BETA, p.mu)
    return text.read_coordinates(spark, path, 1).select("name", *(r6(F.col(c), c) for c in ("kappa", "theta", "hyp_rad")))


@query(f"WITH {E_SQL}{V_SQL} SELECT 2.5::DOUBLE AS beta, round(mu, 8) AS mu, n FROM par")
def parameter_header(spark, sf):
    from horosphere.sources import text

    _, v, p = _radii(spark, sf)
    text.write_coordinates(_named(v), path := _folder(spark, "inf_coord"), 1, BETA, p.mu)
    got = text.read_parameters(spark, path)
    return spark.createDataFrame([(got["beta"], got["mu"], got["nb. vertices"])], "beta double, mu double, n double").select("beta", F.round("mu", 8).alias("mu"), "n")


@query(f"WITH {E_SQL}{V_SQL}, {_HR} SELECT row_number() OVER (ORDER BY vid) - 1 AS place, round(kappa, 6) AS kappa, round(vx.theta, 6) AS theta, round(r, 6) AS hyp_rad FROM hr JOIN vx USING (vid)")
def raw_coordinate_file(spark, sf):
    """Rows without names, in the order of ids."""
    from horosphere.sources import text

    _, v, p = _radii(spark, sf)
    text.write_coordinates(_named(v), path := _folder(spark, "inf_coord_raw"), 1, BETA, p.mu, raw=True)
    t = F.col("tokens")
    return ordered.numbered(text.rows(spark, path), ["line"], "place").select("place", *(r6(t[i].cast("double"), c) for i, c in enumerate(("kappa", "theta", "hyp_rad"))))


def _sphere(spark, sf, dim):
    x = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, dim + 1).cast("array<double>").alias("v"))
    return x.select(F.col("vec_id").alias("vid"), F.concat(F.lit("v"), "vec_id").alias("name"), (F.lit(1.0) + F.col("vec_id") % 7).alias("kappa"), G.hyperbolic_radius(F.lit(1.0) + F.col("vec_id") % 7, 1.0, dim, 100, 0.01).alias("hyp_rad"), G.scaled(F.col("v"), 10.0).alias("pos"))


def _sphere_sql(dim: int) -> str:
    big = f"(100 * {math.gamma((dim + 1) / 2)!r}::DOUBLE / (2 * pi() ** {(dim + 1) / 2})) ** (1 / {dim}.0::DOUBLE)"
    return f"WITH x AS (SELECT vec_id, 1.0::DOUBLE + vec_id % 7 AS kappa, list_transform(embedding[1:{dim + 1}], lambda t: t::DOUBLE) AS v FROM embeddings) SELECT 'v' || vec_id AS name, round(kappa, 6) AS kappa, round(2 * ln(2 * {big} / 0.01::DOUBLE ** (1 / {dim}.0::DOUBLE)) - 2 / {dim}.0::DOUBLE * ln(kappa), 6) AS hyp_rad, " + ", ".join(f"round(v[{i + 1}] * 10 / sqrt(list_dot_product(v, v)), 6) AS x{i}" for i in range(dim + 1)) + " FROM x"


def _sphere_file(spark, sf, dim):
    from horosphere.sources import text

    text.write_coordinates(_sphere(spark, sf, dim), path := _folder(spark, "inf_coord"), dim, 2.0 * dim, 0.01)
    return text.read_coordinates(spark, path, dim).select("name", r6(F.col("kappa"), "kappa"), r6(F.col("hyp_rad"), "hyp_rad"), *(r6(F.col("pos")[i], f"x{i}") for i in range(dim + 1)))


@query(_sphere_sql(2))
def coordinate_file_s2(spark, sf):
    return _sphere_file(spark, sf, 2)


@query(_sphere_sql(3))
def coordinate_file_s3(spark, sf):
    return _sphere_file(spark, sf, 3)


@query(f"WITH {E_SQL}{V_SQL} SELECT row_number() OVER (ORDER BY vid) - 1 AS vid, 'p' || vid AS name, round(kappa, 6) AS kappa, round(theta, 6) AS theta FROM vx")
def hidden_file(spark, sf):
    """Hidden variables with names and positions on the circle."""
    from horosphere.sources import text

    v = model(spark, sf)[1]
    text.write_table(_named(v).orderBy("vid"), path := _folder(spark, "hidden"), ["name", "kappa", "theta"])
    return text.read_hidden(spark, path, 1, names=True, positions=True).select("vid", "name", r6(F.col("kappa"), "kappa"), r6(F.col("theta"), "theta"))


@query("WITH x AS (SELECT vec_id, 1.0::DOUBLE + vec_id % 7 AS kappa, list_transform(embedding[1:3], lambda t: t::DOUBLE) AS v FROM embeddings) SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vid, 'v' || (row_number() OVER (ORDER BY vec_id) - 1) AS name, round(kappa, 6) AS kappa, " + ", ".join(f"round(v[{i + 1}] * 10 / sqrt(list_dot_product(v, v)), 6) AS x{i}" for i in range(3)) + " FROM x")
def hidden_file_s2(spark, sf):
    """Without names, which then are v and the row's number, with positions on the sphere."""
    from horosphere.sources import text

    text.write_table(_sphere(spark, sf, 2).orderBy("vid"), path := _folder(spark, "hidden"), ["kappa", "pos"])
    return text.read_hidden(spark, path, 2, names=False, positions=True).select("vid", "name", r6(F.col("kappa"), "kappa"), *(r6(F.col("pos")[i], f"x{i}") for i in range(3)))


@query("SELECT 'v' || vec_id AS name, round(embedding[1]::DOUBLE, 6) AS x, coalesce(b.label, (SELECT max_by(label, vec_id) FROM embeddings WHERE vec_id < 300)) AS label FROM embeddings a LEFT JOIN (SELECT vec_id, label FROM embeddings WHERE vec_id < 300) b USING (vec_id)")
def label_merge(spark, sf):
    """Coordinates and labels by place: row i of the labels belongs to vertex v<i>, the last row to all beyond."""
    from horosphere.sources import text

    x = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("pos"), F.col("label").cast("long").alias("label"))
    text.write_table(x.where("vec_id < 300").orderBy("vec_id"), path := _folder(spark, "labels"), ["pos", "label"])
    got = text.with_labels(x.select(F.concat(F.lit("v"), "vec_id").alias("name"), "pos"), text.read_labels(spark, path))
    return got.select("name", r6(F.col("pos")[0], "x"), F.col("label").cast("int").alias("label"))


def _through_file(name: str, columns: list[str]):
    """The named query's table written and read again."""

    def run(spark, sf):
        from horosphere.sources import text

        x = _Q[name](spark, sf).select(*columns)
        text.write_table(x, path := _folder(spark, name), header="")
        kinds = dict(x.dtypes)
        return text.rows(spark, path).select(*(F.col("tokens")[i].cast(kinds[c]).alias(c) for i, c in enumerate(columns)))

    return run


for _file, _of, _columns in (
    ("connection_file", "pconn_histogram", ["rescaled_dist", "inf_conn_prob", "th_conn_prob"]),
    ("theta_density_file", "theta_density", ["theta", "inf_density", "th_density"]),
    ("vertex_statistics_file", "ensemble_vertex_stats", ["vid", *(f"{p}_{c}" for c in _COLS for p in ("avg", "std"))]),
    ("class_statistics_file", "ensemble_class_stats", ["degree", *(f"{p}_{c}" for c in ("deg_dist", *_COLS[1:]) for p in ("avg", "std"))]),
    ("observed_statistics_file", "degree_distribution_ccdf", ["degree", "deg_dist", "ccdf"]),
    ("kappa_file", "powerlaw_kappas", ["kappa"]),
):
    _Q[_file] = _through_file(_of, _columns)
    _S[_file] = f"SELECT {', '.join(_columns)} FROM ({_S[_of]})"
