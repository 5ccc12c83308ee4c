"""Sums by classes against sums over pairs."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from horosphere.operators import circle, embed, pairs
from horosphere.operators.infer import Params
from horosphere.sources.shared import stored

P = Params(1, 2.5, 0.05, 1200, 4.0)


@pytest.fixture(scope="module")
def places(spark):
    x = np.random.default_rng(4)
    rows = [(i, float(k), float(t)) for i, (k, t) in enumerate(zip(x.integers(1, 4, 1200), x.random(1200) * 2 * math.pi, strict=True))]
    v = stored(spark.createDataFrame(rows, "vid long, kappa double, theta double"), "places")
    e = stored(spark.range(1199).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), "edges")
    return v, e


def both(monkeypatch, make):
    """Rows by classes, and by blocks; the blocks must not have been used for the first."""
    with monkeypatch.context() as m:
        m.setattr(pairs, "over_pairs", None)
        one = sorted(map(tuple, make().collect()))
    monkeypatch.setattr(pairs, "DIRECT", 10**9)
    return one, sorted(map(tuple, make().collect()))


def test_expected_degrees_by_class(monkeypatch, places):
    one, two = both(monkeypatch, lambda: pairs.expected_degrees(places[0], 1, P.beta, P.big_r, P.mu))
    assert np.allclose(one, two, rtol=1e-11)


def test_likelihood_by_class(monkeypatch, places):
    one, two = both(monkeypatch, lambda: pairs.vertex_log_likelihood(*places, 1, P.beta, P.big_r, P.mu).select("vid", "ll"))
    assert np.allclose(one, two, rtol=1e-11)


def test_connection_histogram_by_class(monkeypatch, places):
    one, two = both(monkeypatch, lambda: pairs.connection_histogram(*places, 1, P.beta, P.big_r, P.mu))
    assert [r[:2] for r in one] == [r[:2] for r in two]
    assert np.allclose(one, two, rtol=1e-9)


def test_log_histogram_by_class(monkeypatch, places):
    one, two = both(monkeypatch, lambda: pairs.log_histogram(*places, 1, P.beta, P.big_r, P.mu))
    assert [r[:2] for r in one] == [r[:2] for r in two]
    assert np.allclose(one, two, rtol=1e-9)


def test_candidates_by_class(monkeypatch, places):
    v, e = places
    c = v.select("vid", F.explode(F.array(F.lit(0), F.lit(1))).alias("c"), "theta").withColumn("theta", F.when(F.col("c") == 0, F.col("theta")).otherwise(F.pmod(F.col("theta") * 3, F.lit(2 * math.pi))))
    monkeypatch.setattr(embed, "place_scores", None)
    got = {r[:2]: r[2] for r in map(tuple, embed.score_places(v, e, c, P).collect())}
    rows = sorted(map(tuple, v.collect()))
    kappa, theta = (np.array([r[k] for r in rows]) for k in (1, 2))
    assert len(got) == 2400
    for i in range(0, 1200, 7):
        for k, t in enumerate((theta[i], theta[i] * 3 % (2 * math.pi))):
            x = np.maximum(P.big_r * circle.distance(t, theta) / (P.mu * kappa * kappa[i]), 1e-12)
            links = [j for j in (i - 1, i + 1) if 0 <= j < 1200]
            assert math.isclose(got[i, k], -np.log1p(np.delete(x, i) ** -P.beta).sum() - P.beta * np.log(x[links]).sum(), rel_tol=1e-9)


def test_graphs_drawn_by_class_have_the_expected_degrees(places, monkeypatch):
    v, _ = places
    monkeypatch.setattr(pairs, "over_pairs", None)
    got = stored(pairs.simulate(v, 1, P.beta, P.big_r, P.mu, 10, 3), "got")
    assert got.where("src >= dst").count() == 0
    assert got.distinct().count() == got.count()
    due = pairs.expected_degrees(v, 1, P.beta, P.big_r, P.mu).agg(F.sum("exp_deg")).first()[0] / 2 * 10
    assert abs(got.count() - due) < 5 * math.sqrt(due)


@pytest.mark.parametrize("turns", [997, 2048])  # many pairs in one place, opposite, and exactly between two bins
def test_counts_on_a_lattice(turns):
    a = np.sort(np.random.default_rng(1).integers(0, turns, 1500) * (2 * math.pi / turns))
    scale, edge = turns / (2 * math.pi), np.array([0.5, 1.0, 2.0, 8.0, 100.0])
    bin_of = lambda x: np.searchsorted(edge, x, side="left")
    x = (scale * circle.distance(a[:, None], a[None, :]))[np.triu_indices(1500, 1)]
    n, s = (sum(z) for z in zip(*(circle.binned(a, lo, min(1500, lo + 400), circle.Around(a), True, edge, scale, bin_of, 6) for lo in range(0, 1500, 400)), strict=True))
    assert n.tolist() == np.bincount(bin_of(x), minlength=6).tolist()
    assert np.allclose(s, np.bincount(bin_of(x), x, minlength=6))


def test_likelihood_of_two_vertices_in_one_place_is_that_of_sql(spark, tmp_path):
    """Ids whose angles agree: the model has no chance of leaving them unlinked."""
    duckdb = pytest.importorskip("duckdb")
    from horosphere.plans import catalog

    seen, pair = {}, None
    for i in range(1, 400_000):
        h = hashlib.md5(f"{i}:1".encode()).hexdigest()[:8]
        if h in seen:
            pair = (seen[h], i)
            break
        seen[h] = i
    a, b = pair
    lines = [(o, k, p, 0.1) for o, ends in enumerate([(a, 1), (b, 2), (1, 2), (2, 3)]) for k, p in enumerate(ends, 1)]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_discount double").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{path}/*.parquet'")
    for name in ("loglikelihood_vertex", "loglikelihood_total"):
        got = sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect()))
        assert got == sorted(con.execute(catalog.oracle_sql()[name]).fetchall())
        assert any(r[-1] == -math.inf for r in got)
