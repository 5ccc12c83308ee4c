import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from horosphere.functions import geometry as G
from horosphere.functions import special
from horosphere.operators import align, generate, graph, infer, pairs, routing
from horosphere.sources.shared import stored


def ring(spark, n, dim=1):
    return spark.range(n).select(F.col("id").alias("vid"), F.lit(5.0).alias("kappa"), (F.col("id") * (2 * math.pi / n)).alias("theta"))


def test_integrals_against_fine_sums():
    u = (np.arange(2_000_000) + 0.5) / 2_000_000
    for x in (0.3, 4.0, 250.0):
        f = 1 / (1 + (x * u) ** 2.5)
        assert math.isclose(float(special.mean_probability(x, 2.5)), f.mean(), rel_tol=1e-6)
        assert math.isclose(float(special.mean_distance(x, 2.5)), 2 * (u * f).mean(), rel_tol=1e-6)
        t = u * math.pi
        want = special.sphere_constant(3) * math.pi * (np.sin(t) ** 2 / (1 + (x * t) ** 8)).mean()
        assert math.isclose(float(special.class_probability(np.array(x), 8.0, 3)), want, rel_tol=1e-5)


def test_expected_degrees_of_a_ring(spark):
    v, mu = ring(spark, 30), 0.02
    got = [r.exp_deg for r in pairs.expected_degrees(v, 1, 2.5, G.radius(1, 30), mu).collect()]
    assert len(got) == 30
    assert max(got) - min(got) < 1e-9


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    v = ring(spark, 50)
    whole = {r.vid: r.exp_deg for r in pairs.expected_degrees(v, 1, 2.5, 8.0, 0.02).collect()}
    monkeypatch.setattr(pairs, "BLOCK", 7)
    parts = {r.vid: r.exp_deg for r in pairs.expected_degrees(v, 1, 2.5, 8.0, 0.02).collect()}
    assert whole.keys() == parts.keys()
    assert all(math.isclose(whole[k], parts[k], rel_tol=1e-9) for k in whole)


def test_blocks_are_not_copied_for_every_block_they_meet(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 10)
    plan = pairs.expected_degrees(ring(spark, 600), 1, 2.5, 95.0, 0.02, 600)._jdf.queryExecution().toString()
    assert "Join" not in plan and "RoundRobin" not in plan
    got = pairs.expected_degrees(ring(spark, 600), 1, 2.5, 95.0, 0.02, 600)
    assert got.count() == 600


def test_class_kappas_reach_their_degrees():
    k, n_k = np.array([1.0, 2, 3, 5, 8]), np.array([40.0, 30, 20, 8, 2])
    for dim in (1, 2):
        _, exp, _ = infer.class_kappas(k, n_k, 2.5 * dim, dim, np.random.default_rng(0))
        assert np.abs(exp - k).max() <= 1e-2


def test_coordinates_round_trip(spark):
    x = spark.createDataFrame([([0.3, -0.4, 0.5],), ([1.0, 0.0, 0.0],), ([-1.0, 2.0, -3.0],)], "v array<double>")
    c = G.to_cartesian(G.to_hyperspherical(F.col("v"), 2), 2)
    for r in x.select(G.scaled(F.col("v"), 1.0).alias("u"), c.alias("c")).collect():
        assert np.allclose(r.u, r.c, atol=1e-9)


def test_hyperbolic_distance_is_at_least_the_radial_one(spark):
    x = spark.range(50).select((F.rand(1) * 9).alias("a"), (F.rand(2) * 9).alias("b"), (F.rand(3) * math.pi).alias("d"))
    for r in x.select("a", "b", G.hyperbolic_distance(F.col("a"), F.col("b"), F.col("d")).alias("h")).collect():
        assert r.h >= abs(r.a - r.b) - 1e-6


def test_greedy_routing_on_a_ring_succeeds(spark):
    n = 12
    e = graph.canonical(spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")))
    v = ring(spark, n).withColumn("hyp_rad", F.lit(4.0))
    runs = stored(routing.sample_runs(v, 40), "runs")
    assert runs.where("s = t").count() == 0
    for modified in (False, True):
        s = routing.summary(routing.route(e, v, runs, 1, modified), routing.shortest_paths(e, runs)).first()
        assert s.p_s == 1.0 and s.max_strech == 1.0


def test_generated_degrees_follow_the_model(spark):
    got = generate.generate(generate.power_law(spark, 300, 2.7, 10, 3), 2.5, 1, seed=3)
    v = got.vertices.agg(F.sum("real_deg"), F.sum("exp_deg")).first()
    assert abs(v[0] - v[1]) < 6 * math.sqrt(v[1])
    assert got.edges.where("src >= dst").count() == 0


def test_alignment_undoes_a_rotation(spark):
    x = generate.sphere_points(25, 2, 1)
    m = align.euler(0.7, 0.2, 1.9)
    df = spark.createDataFrame([(f"v{i}", a.tolist(), (m @ a).tolist()) for i, a in enumerate(x)], "name string, real array<double>, inf array<double>")
    assert align.align(df, 100)[2] < 0.05


@pytest.mark.parametrize("dim", [1, 2])
def test_embedding_beats_chance(spark, dim):
    from horosphere.operators.embed import EmbedConfig, embed, log_likelihood

    got = generate.generate(generate.power_law(spark, 80, 2.7, 8, 5), 2.5 * dim, dim, seed=5)
    e = stored(graph.giant_component(got.edges)[0], "giant")
    r = embed(e, EmbedConfig(dim=dim, beta=2.5 * dim, post_kappa=False))
    place = "theta" if dim == 1 else "pos"
    chance = r.coordinates.select("vid", "kappa", (F.rand(1) * 2 * math.pi).alias("theta") if dim == 1 else G.scaled(G.random_direction(2, 5), r.params.big_r).alias("pos"))
    assert log_likelihood(r.coordinates.select("vid", "kappa", place), e, r.params) > log_likelihood(stored(chance, "chance"), e, r.params)


def test_subspace_iteration_spans_what_the_dense_solver_finds(spark, monkeypatch):
    from horosphere.operators import embed

    n = 20
    w = graph.canonical(spark.range(n).select(F.col("id").alias("src"), F.explode(F.array((F.col("id") + 1) % n, (F.col("id") + 2) % n)).alias("dst"))).withColumn("w", F.lit(1.0))
    a = embed.eigenmap(w, 1)
    monkeypatch.setattr(embed, "DENSE", 0)
    b = embed.eigenmap(w, 1, rounds=25)
    x, y = (np.array([m[i] for i in range(n)]) for m in (a, b))
    q, _ = np.linalg.qr(x)
    assert np.linalg.norm(y - q @ (q.T @ y)) < 1e-2 * np.linalg.norm(y)


def test_catalog_queries_have_distinct_names():
    from horosphere.plans import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 55


def test_align_rotation_reads_every_vector(spark, tmp_path):
    from horosphere.plans import catalog

    x = generate.sphere_points(30, 2, 4)
    spark.createDataFrame([(1000 + i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert catalog.queries()["align_rotation"](spark, str(tmp_path)).first().distance < 0.1


def test_least_mean_is_the_brute_force_one():
    rng = np.random.default_rng(2)
    x = generate.sphere_points(700, 2, 6)
    y = x @ align.euler(0.3, 1.0, 2.0).T + 0.2 * rng.standard_normal(x.shape)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    turns = np.array([align.euler(a, b, 2.0).T for a in np.linspace(0, 3, 9) for b in np.linspace(0, 3, 9)])
    want = [align.distances(x, y @ t.T).mean() for t in turns]
    for bound in (math.inf, min(want)):
        k, score = align.least_mean(x, y, turns, bound)
        assert k == int(np.argmin(want))
        assert math.isclose(score, min(want), rel_tol=1e-12)
    assert align.least_mean(x, y, turns, 0.99 * min(want))[0] == -1


def test_routes_of_more_than_200_hops_arrive(spark):
    n = 206
    e = stored(graph.canonical(spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))), "path")
    v = spark.range(n).select(F.col("id").alias("vid"), F.lit(4.0).alias("hyp_rad"), (F.col("id") * (math.pi / n)).alias("theta"))
    runs = spark.createDataFrame([(0, 0, n - 1), (1, 100, 97)], "run long, s long, t long")
    got = stored(routing.route(e, stored(v, "places"), runs), "got")
    assert sorted(map(tuple, got.collect())) == [(0, 0, n - 1, "arrived", n - 1), (1, 100, 97, "arrived", 3)]
    assert routing.summary(got, routing.shortest_paths(e, runs)).first().max_strech == 1.0


@pytest.mark.parametrize(("dim", "modified"), [(1, False), (1, True), (2, False), (2, True)])
def test_routes_in_tasks_are_those_by_joins(spark, monkeypatch, dim, modified):
    made = generate.generate(generate.power_law(spark, 120, 2.7, 4, 5), 2.5 * dim, dim, seed=5)
    e, v = stored(made.edges, "edges"), stored(made.vertices, "vertices")
    runs = spark.range(600).select(F.col("id").alias("run"), (F.col("id") * 7 % 110).alias("s"), (F.col("id") * 11 % 125).alias("t")).where("s <> t")
    want = sorted(map(tuple, routing.route(e, v, runs, dim, modified, 0).collect()))
    monkeypatch.setattr(routing, "route_by_joins", None)
    assert sorted(map(tuple, routing.route(e, v, runs, dim, modified).collect())) == want
    assert {r[3] for r in want} == {"arrived", "dropped"}


def test_routing_summary_asks_for_paths_of_arrived_runs_only(spark, monkeypatch):
    from horosphere.plans import catalog

    made, asked = routing.shortest_paths, []
    monkeypatch.setattr(routing, "shortest_paths", lambda e, r, *a: (asked.append(r), made(e, r, *a))[1])
    assert catalog.queries()["routing_summary"](spark, "/root/testdata/sf0.001").count() == 1
    assert asked[0].where("status <> 'arrived'").count() == 0


def test_shortest_paths_in_memory_are_those_by_joins(spark):
    e = stored(generate.generate(generate.power_law(spark, 80, 2.7, 3, 5), 2.5, 1, seed=5).edges, "edges")
    runs = spark.range(200).select(F.col("id").alias("run"), (F.col("id") * 7 % 90).alias("s"), (F.col("id") * 11 % 95).alias("t")).where("s <> t")
    by_joins, here = (sorted(map(tuple, routing.shortest_paths(e, runs, n).select("s", "t", "dist").collect())) for n in (1, 1000))
    assert by_joins == here and len(here) > 20


def test_shortest_paths_are_searched_by_many_tasks_64_sources_at_once(spark):
    n = 150
    e = stored(graph.canonical(spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))), "path")
    runs = spark.range(n).select(F.col("id").alias("run"), F.col("id").alias("s"), (F.col("id") * 37 % n).alias("t"))
    got = routing.shortest_paths(e, runs)
    assert got.rdd.getNumPartitions() == 64
    assert sorted(map(tuple, got.select("s", "t", "dist").collect())) == [(i, i * 37 % n, abs(i - i * 37 % n)) for i in range(n)]


def test_routing_takes_its_runs_from_the_vertices(spark, tmp_path):
    from horosphere.plans import catalog

    lines = [(o, k, p, 0.1) for o in range(5) for k, p in ((1, o), (2, o + 1))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert catalog.queries()["greedy_routing"](spark, str(tmp_path)).count() == 60


def test_batches_of_refinement_do_not_lower_the_likelihood(spark, monkeypatch):
    from horosphere.operators import embed
    from horosphere.operators.infer import Params

    monkeypatch.setattr(embed, "SEQUENTIAL", 0)
    n = 24  # a ring in its place: alone, each vertex would still find a better one
    e = stored(graph.canonical(spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))), "ring")
    v, p = stored(ring(spark, n), "places"), Params(1, 2.5, 0.02, n, 2.0)
    was = embed.log_likelihood(v, e, p)
    got = embed.refine(v, e, graph.onion(e), p, embed.EmbedConfig(batches=1))
    assert embed.log_likelihood(got, e, p) >= was


def test_eigenmap_says_where_it_does_not_converge(spark, monkeypatch):
    from horosphere.operators import embed

    n = 60
    w = graph.canonical(spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))).withColumn("w", F.lit(1.0))
    monkeypatch.setattr(embed, "DENSE", 0)
    monkeypatch.setattr(embed, "WIDEST", 5)
    with pytest.raises(embed.NotConvergedError):
        embed.eigenmap(w, 1, rounds=3)


def test_eigenmap_in_a_task_is_the_dense_solvers(spark, monkeypatch):
    from horosphere.operators import embed

    n = 400
    w = graph.canonical(spark.range(n).select(F.col("id").alias("src"), F.explode(F.array((F.col("id") + 1) % n, (F.col("id") * F.col("id") + 3) % n)).alias("dst")))
    w = stored(w.withColumn("w", 0.5 + G.uniform(F.col("src") * 1000 + F.col("dst"), 3)), "weights")
    a = embed.eigenmap(w, 1)
    monkeypatch.setattr(embed, "DENSE", 0)
    b = embed.eigenmap(w, 1, rounds=1)
    x, y = (np.array([m[i] for i in range(n)]) for m in (a, b))
    assert all(min(np.abs(x[:, k] - y[:, k]).max(), np.abs(x[:, k] + y[:, k]).max()) < 1e-7 for k in range(2))


@pytest.mark.parametrize(("dim", "beta"), [(1, 2.5), (1, 2.3), (2, 5.0)])
def test_expected_degrees_of_arrays_are_those_of_tables(spark, dim, beta):
    n, place = 300, "theta" if dim == 1 else "pos"
    pos = G.scaled(F.array(*(G.uniform(F.col("id"), k) - 0.5 for k in (4, 5, 6))), 5.0)
    v = spark.range(n).select(F.col("id").alias("vid"), (3.0 + F.col("id") % 7).alias("kappa"), (2 * math.pi * G.uniform(F.col("id"), 1) if dim == 1 else pos).alias(place))
    want = [x for _, x in sorted(map(tuple, pairs.expected_degrees(v, dim, beta, G.radius(dim, n), 0.02, n).collect()))]
    rows = v.orderBy("vid").collect()
    at = spark.sparkContext.broadcast(np.array([r[place] for r in rows]))
    assert np.allclose(pairs.expected_at(spark, at, np.array([r.kappa for r in rows]), dim, beta, G.radius(dim, n), 0.02), want, rtol=1e-12)
    assert pairs.uniforms(np.arange(n), 1003).tolist() == [r.u for r in spark.range(n).select("id", G.uniform(F.col("id"), 1003).alias("u")).orderBy("id").collect()]


@pytest.mark.parametrize("dim", [1, 2])
def test_bounded_scores_find_the_greatest(dim):
    from horosphere.operators import embed
    from horosphere.operators.infer import Params

    rng, n = np.random.default_rng(4), 3000
    unit = generate.sphere_points(n, dim, 5)
    kappa = rng.uniform(1, 9, n)
    p = Params(dim, 2.5 * dim, G.density(dim, 2.5 * dim, 5.0), n, 5.0)
    near, moved = embed.Near.of(unit, kappa), unit.copy()
    moved[::7] = generate.sphere_points(len(unit[::7]), dim, 6)  # sets of near vertices may be old
    for i in range(0, n, 300):
        friends = np.argsort(-(unit @ unit[i]))[1:8].tolist()
        centre, dev = embed.centre_of(moved[friends], kappa[friends], dim)
        cand = centre + dev * rng.standard_normal((300, dim + 1))
        cand = np.vstack([moved[i], cand / np.linalg.norm(cand, axis=1, keepdims=True)])
        score, kind = embed.bounded_scores(cand, i, moved, kappa, friends, p, near)
        want = embed.place_scores(cand, i, moved, kappa, friends, p)
        assert np.where(kind == 2, score, -math.inf).argmax() == want.argmax()
        assert (score >= want - 1e-6).all() and (kind == 2).sum() < len(cand)


def test_embedding_queries_take_their_vertices_from_the_tables(spark, tmp_path):
    from horosphere.plans import catalog

    lines = [(o, k, p, 0.1) for o in range(40) for k, p in ((1, o), (2, (o + 1) % 40), (3, (o + 2) % 40))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.queries()["generate_s1"](spark, str(tmp_path))
    assert 40 <= got.count() < 80
    assert got.where("vid < 40 and kappa in (2, 3, 4)").count() == 40


def test_infer_beta_reads_lines_of_every_discount(spark, tmp_path, monkeypatch):
    from horosphere.plans import catalog

    made, seen = catalog.generate.generate, []
    monkeypatch.setattr(catalog.generate, "generate", lambda hidden, *a, **k: (seen.append(hidden.agg(F.count("*"), F.sum("kappa")).first()), made(hidden, *a, **k))[1])
    lines = [(o, k, p % 40, o % 11 / 100) for o in range(40) for k, p in ((1, o), (2, o + 1), (3, o + 3), (4, o + 6))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.queries()["infer_beta"](spark, str(tmp_path)).first()
    assert tuple(seen[0]) == (40, 240.0) and 1 < got.beta < 25  # of 120 lines of three steps, each is an edge


def test_numbers_lags_and_sums_over_ranges(spark):
    from horosphere.operators import ordered

    df = spark.range(500).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 5).cast("double").alias("v")).repartition(7)
    rows = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, ordered.numbered(df, ["k"], "n", 3).select("k", "n").collect())) == [(k, i + 3) for i, (k, _) in enumerate(rows)]
    lag = ordered.before(df, ["k"], "v", "b").select("k", "b")
    assert sorted(map(tuple, lag.collect())) == [(k, rows[i - 1][1]) for i, (k, _) in enumerate(rows)]
    run, total = ordered.running(df, ["k"], "v", "s")
    assert total == sum(v for _, v in rows)
    assert np.allclose([s for _, s in sorted(map(tuple, run.select("k", "s").collect()))], np.cumsum([v for _, v in rows]))
    assert ordered.numbered(df.limit(0), ["k"], "n").count() == 0


@pytest.mark.parametrize("batches", [1, 7])
def test_refinement_in_batches_is_the_pass_one_by_one(spark, monkeypatch, batches):
    from horosphere.operators import embed
    from horosphere.operators.infer import Params

    got = generate.generate(generate.power_law(spark, 150, 2.7, 6, 5), 2.5, 1, seed=5)
    e = stored(graph.giant_component(got.edges)[0], "giant")
    inside = graph.degrees(e).select("vid")
    v = stored(got.vertices.join(inside, "vid").select("vid", F.lit(5.0).alias("kappa"), (F.lit(2 * math.pi) * G.uniform(F.col("vid"), 9)).alias("theta")), "places")
    p, layers = Params(1, 2.5, 0.02, v.count(), 6.0), stored(graph.onion(e), "layers")
    config = embed.EmbedConfig(candidates=10, batches=batches)
    one = {r.vid: r.theta for r in embed.refine(v, e, layers, p, config).collect()}
    monkeypatch.setattr(embed, "SEQUENTIAL", 0)
    many = {r.vid: r.theta for r in embed.refine(v, e, layers, p, config).collect()}
    assert one.keys() == many.keys()
    assert all(math.isclose(one[k], many[k], abs_tol=1e-9) for k in one)


def test_refinement_on_the_sphere_keeps_its_radius(spark):
    from horosphere.operators import embed
    from horosphere.operators.infer import Params

    n = 12
    p = Params(2, 5.0, 0.02, n, 2.0)
    e = stored(graph.canonical(spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))), "ring")
    x = generate.sphere_points(n, 2, 3) * p.big_r
    v = spark.createDataFrame([(i, 3.0, a.tolist()) for i, a in enumerate(x)], "vid long, kappa double, pos array<double>")
    got = embed.refine(v, e, graph.onion(e), p, embed.EmbedConfig(dim=2, candidates=3)).collect()
    assert len(got) == n
    assert np.allclose([np.linalg.norm(r.pos) for r in got], p.big_r)


@pytest.mark.parametrize("target", [0.1, 5.0, 1e9, -1.0])
def test_beta_search_returns_what_it_evaluated_last(target):
    seen = []

    def evaluate(b):
        seen.append(b)
        return b

    assert infer.search_beta(evaluate, target, 2.3, 1.0, 25.0, 1e-3) == seen[-1]
    assert 1.0 <= seen[-1] <= 25.0


def test_neighbour_centres_agree_with_sums(spark):
    from horosphere.operators import embed

    v = stored(ring(spark, 20).withColumn("kappa", F.col("vid") % 4 + 1.0), "v")
    e = stored(graph.canonical(spark.range(20).select(F.col("id").alias("src"), F.explode(F.array((F.col("id") + 1) % 20, (F.col("id") + 3) % 20)).alias("dst"))), "e")
    near = graph.adjacency(e).join(v.toDF("u", "kappa", "theta"), "u")
    w = 1 / (F.col("kappa") * F.col("kappa"))
    want = {r.v: r.m % (2 * math.pi) for r in near.groupBy("v").agg(F.atan2(F.sum(w * F.sin("theta")), F.sum(w * F.cos("theta"))).alias("m")).collect()}
    assert all(math.isclose(want[r.vid], r["mean"], abs_tol=1e-9) for r in embed.neighbour_centres(v, e).collect())


def test_s3_points_align(spark):
    x = generate.sphere_points(14, 3, 2)
    m = align.spin(4, 0, 1, 0.4) @ align.spin(4, 1, 2, 1.1) @ align.spin(4, 2, 3, 0.8)
    df = spark.createDataFrame([(f"v{i}", a.tolist(), (m @ a).tolist()) for i, a in enumerate(x)], "name string, real array<double>, inf array<double>")
    assert align.align(df, 40)[2] < 0.5


def test_spin_and_euler_scan(spark):
    x = generate.sphere_points(40, 2, 3)
    a, b = align.fix_spin(x, x)
    assert np.allclose(a, b)
    m = align.euler_scan(x, x, 4)
    assert np.allclose(m @ align.inverse(m), np.eye(3))


def test_random_points_at_an_angle(spark):
    rows = spark.range(30).select(G.random_at_angle(2, F.lit(0.7), 1).alias("v")).collect()
    assert all(math.isclose(math.acos(r.v[0]), 0.7) and math.isclose(sum(x * x for x in r.v), 1) for r in rows)


def test_sql_functions_equal_the_columns(spark):
    G.register(spark)
    x = spark.range(1, 9).select((F.col("id") * 0.7).alias("a"), (F.col("id") * 0.3).alias("b"))
    got = x.selectExpr("hs_circular_distance(a, b) AS d", "hs_probability(a, 2.5D) AS p", "hs_hyperbolic_distance(a, b, b) AS h", "a", "b")
    for r in got.select("*", G.circular_distance(F.col("a"), F.col("b")).alias("d2"), G.probability(F.col("a"), 2.5).alias("p2"), G.hyperbolic_distance(F.col("a"), F.col("b"), F.col("b")).alias("h2")).collect():
        assert (r.d, r.p, r.h) == (r.d2, r.p2, r.h2)


def some_places(spark):
    from horosphere.operators.infer import Params

    got = generate.generate(generate.power_law(spark, 150, 2.7, 6, 5), 2.5, 1, seed=5)
    e = stored(graph.giant_component(got.edges)[0], "giant")
    inside = graph.degrees(e).select("vid")
    v = stored(got.vertices.join(inside, "vid").select("vid", F.lit(5.0).alias("kappa"), (F.lit(2 * math.pi) * G.uniform(F.col("vid"), 9)).alias("theta")), "places")
    return v, e, stored(graph.onion(e), "layers"), Params(1, 2.5, 0.02, v.count(), 6.0)


@pytest.mark.parametrize("alone", [0, 10**6])
def test_refinement_with_bounds_is_the_pass_of_every_candidate(spark, monkeypatch, alone):
    from horosphere.operators import embed

    v, e, layers, p = some_places(spark)
    config = embed.EmbedConfig(candidates=10)
    one = {r.vid: r.theta for r in embed.refine(v, e, layers, p, config).collect()}
    monkeypatch.setattr(embed, "SEQUENTIAL", 0)
    monkeypatch.setattr(embed, "ALONE", alone)
    if alone:  # no batches, and none of their jobs
        monkeypatch.setattr(embed, "unlinked", None)
    many = {r.vid: r.theta for r in embed.refine(v, e, layers, p, config).collect()}
    assert one.keys() == many.keys()
    assert all(math.isclose(one[k], many[k], abs_tol=1e-9) for k in one)


def test_krylov_resolves_a_long_ring_in_few_rounds():
    from horosphere.operators import embed

    n = 3000  # eigenvalues cos(2 pi k / n), each twice but the first: the greatest lie within 1e-5
    link = np.random.default_rng(2).uniform(0.5, 1.5, n)
    s = link + np.roll(link, 1)
    both = link / np.sqrt(s * np.roll(s, -1))
    top = np.sqrt(s / s.sum())

    def times(x):
        return np.roll(x, -1, 1) * both + np.roll(x * both, 1, 1)

    x = embed.krylov(times, top, 2, 1, 60, 150)
    dense = np.zeros((n, n))
    dense[np.arange(n), (np.arange(n) + 1) % n] = dense[(np.arange(n) + 1) % n, np.arange(n)] = both
    want = np.linalg.eigh(dense)[0][-3:-1][::-1]
    assert x is not None
    assert np.allclose((x * times(x.T).T).sum(0), want, atol=1e-10)
    assert np.allclose(x.T @ x, np.eye(2), atol=1e-9)
    assert np.abs(top @ x).max() < 1e-9


@pytest.mark.parametrize("beta", [0.5, 1.0, 2.5, 4.0, 5.0, 7.5, 2.7])
def test_powers_in_place_are_powers(beta):
    x = np.random.default_rng(1).uniform(0, 4, (7, 9))
    was, out, spare = x.copy(), np.empty_like(x), np.empty_like(x)
    assert (special.power_into(x, beta, out, spare) == special.power(x, beta)).all()
    assert (x == was).all()


@pytest.mark.parametrize("dim", [1, 2])
def test_expected_degrees_make_no_array_a_tile(spark, monkeypatch, dim):
    n, beta = 700, 2.5 * dim
    at = np.random.default_rng(3).uniform(0, 2 * math.pi, n) if dim == 1 else generate.sphere_points(n, dim, 3)
    kappa = np.random.default_rng(4).uniform(1, 9, n)
    d = np.pi - np.abs(np.pi - np.abs(at[:, None] - at[None, :])) if dim == 1 else np.arccos(np.clip(at @ at.T, -1, 1))
    x = 1 / (1 + (40.0 * d / (0.05 * kappa[:, None] * kappa[None, :]) ** (1 / dim)) ** beta)
    np.fill_diagonal(x, 0)
    power = special.power
    monkeypatch.setattr(pairs, "power", lambda v, b: power(v, b) if v.ndim == 1 else None)  # whole tiles go in place
    got = pairs.expected_at(spark, spark.sparkContext.broadcast(at), kappa, dim, beta, 40.0, 0.05)
    assert np.allclose(got, x.sum(1), rtol=1e-9)


def test_equal_candidates_are_evaluated_once(spark, monkeypatch):
    from horosphere.operators import embed
    from horosphere.operators.infer import Params

    p = Params(2, 5.0, 0.02, 2, 1.0)
    v = spark.createDataFrame([(0, 2.0, [p.big_r, 0.0, 0.0]), (1, 2.0, [0.0, p.big_r, 0.0])], "vid long, kappa double, pos array<double>")
    e = spark.createDataFrame([(0, 1)], "src long, dst long")
    sizes, scores = [], embed.place_scores
    monkeypatch.setattr(embed, "place_scores", lambda cand, *rest: (sizes.append(len(cand)), scores(cand, *rest))[1])
    got = {r.vid: r.pos for r in embed.refine(v, e, graph.onion(e), p, embed.EmbedConfig(dim=2)).collect()}
    assert max(sizes) <= 2
    assert np.allclose(got[0], got[1])  # alone with its neighbour, a vertex goes where that is
