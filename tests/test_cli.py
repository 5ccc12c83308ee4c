"""The commands by round trips: what is written is read by the next one."""

import math
import os

import pytest

from horosphere import cli
from horosphere.operators import align, graph
from horosphere.sources import text


@pytest.fixture(scope="module")
def generated(spark, tmp_path_factory):
    """A graph of the model by the command, from kappas without names."""
    d = tmp_path_factory.mktemp("net")
    (d / "net.hidden").write_text("# kappas\n" + "".join(f"{3 + i % 5}.0\n" for i in range(40)))
    assert cli.main(["generate", str(d / "net.hidden"), "-b", "3.5", "-v", "-s", "3"], spark) == 0
    return d


def test_generate_writes_what_can_be_read(spark, generated):
    made = text.rows(spark, str(generated / "net.gen_coord")).count()
    assert made >= 40
    given = text.read_hidden(spark, str(generated / "net.gen_coord"), 1, native=True)
    assert given.columns == ["vid", "name", "kappa", "theta"] and given.count() == made
    assert text.read_parameters(spark, str(generated / "net.gen_coord"))["beta"] == 3.5
    assert cli.main(["generate", str(generated / "net.gen_coord"), "-b", "3.5", "-a", "-o", str(generated / "again")], spark) == 0
    assert text.read_edges(spark, str(generated / "again.edge")).count() > 20


@pytest.fixture(scope="module")
def giant(spark, generated):
    """The giant component's edges, which the command writes where there is more than one component, or all edges."""
    out = str(generated / "first")
    code = cli.main(["embed", str(generated / "net.edge"), "-o", out, "-f", "-k", "-q", "-b", "3.5"], spark)
    assert code in (0, graph.MultipleComponentsError.exit_code)
    return f"{out}_GC.edge" if code else str(generated / "net.edge")


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_embed_from_edges_to_coordinates(spark, giant, tmp_path, dim):
    out = str(tmp_path / "e")
    assert cli.embed(giant, output_name=out, fast_mode=True, clean_mode=True, beta=2.5 * dim, dimension=dim, seed=2, post_kappa=False, spark=spark) == 0
    names = graph.dictionary(text.read_edges(spark, giant)).count()
    got = text.read_coordinates(spark, f"{out}.inf_coord", dim)
    assert got.count() == names and got.where("kappa is null or hyp_rad is null").count() == 0
    p = text.read_parameters(spark, f"{out}.inf_coord")
    assert p["beta"] == 2.5 * dim and p["nb. vertices"] == names
    assert text.rows(spark, f"{out}.inf_coord_raw").count() == names
    log = open(f"{out}.inf_log").read()
    assert "initialise" in log and "UTC" in log and "seed" in log
    head = [x for f in sorted(os.listdir(f"{out}.inf_coord")) if f.startswith("part") for x in open(f"{out}.inf_coord/{f}").read().splitlines() if x.startswith("#")]
    assert any("beta:" in x and head.index(x) == 8 for x in head) and any("FAST" in x for x in head)


def test_embed_validates_refines_and_resumes(spark, giant, tmp_path, capsys):
    out = str(tmp_path / "v")
    assert cli.main(["embed", giant, "-o", out, "-b", "3.5", "-q"], spark) == 0
    assert not os.path.exists(f"{out}.inf_log")
    again = str(tmp_path / "w")
    assert cli.main(["embed", giant, "-o", again, "-r", f"{out}.inf_coord", "-f", "-k", "-v", "-a"], spark) == 0
    assert text.rows(spark, f"{again}.inf_pconn").count() > 3
    assert text.rows(spark, f"{again}.inf_theta_density").count() == 25
    assert {len(r.tokens) for r in text.rows(spark, f"{again}.inf_vprop").collect()} >= {16}
    assert text.rows(spark, f"{again}.obs_vstat").count() > 1 and text.rows(spark, f"{again}.inf_vstat").count() > 1
    a, b = (sorted(map(tuple, text.read_coordinates(spark, f"{x}.inf_coord", 1).select("name", "theta").collect())) for x in (out, again))
    assert a == b
    assert cli.main(["route", "1", f"{out}.inf_coord", giant, "0", "200"], spark) == 0
    assert "p_s" in capsys.readouterr().out


def test_embed_writes_kappas_only(spark, giant, tmp_path):
    out = str(tmp_path / "k")
    assert cli.main(["embed", giant, "-o", out, "-e", "-q", "-b", "3.5"], spark) == 13
    assert text.rows(spark, f"{out}.kappas").count() == graph.dictionary(text.read_edges(spark, giant)).count()


def test_joint_refit_keeps_beta_and_kappas_together(spark):
    from pyspark.sql import functions as F

    from horosphere.functions import geometry as G
    from horosphere.operators import generate, infer
    from horosphere.operators.infer import Params
    from horosphere.sources.shared import stored

    got = generate.generate(generate.power_law(spark, 50, 2.7, 6, 4), 2.5, 1, seed=4)
    degree = stored(graph.degrees(got.edges), "degree")
    v = stored(got.vertices.join(degree.select("vid"), "vid").select("vid", "kappa", "theta"), "places")
    n, k = degree.agg(F.count("*"), F.avg("degree")).first()
    now, p = infer.refit_beta(v, degree, Params(1, 2.5, G.density(1, 2.5, k), n, k, 0.3), graphs=2, tol=0.2)
    assert now.count() == n and math.isclose(p.mu, G.density(1, p.beta, k))


def test_alignment_of_files_and_labels(spark, tmp_path):
    from horosphere.operators import generate

    x, m = generate.sphere_points(20, 2, 5), align.euler(0.5, 0.2, 1.0)
    row = lambda v: " ".join(f"{c:.9f}" for c in v)
    (tmp_path / "real").write_text("".join(f"v{i} 5 2.5 {row(v)} {3 + i % 3} 4.0\n" for i, v in enumerate(x)))
    (tmp_path / "inferred").write_text("".join(f"v{i} 5 {row(m @ v)}\n" for i, v in enumerate(x)))
    (tmp_path / "labels").write_text("".join(f"{row(v)} {i % 4}\n" for i, v in enumerate(x[:15])))
    assert align.align_files(spark, str(tmp_path / "real"), str(tmp_path / "inferred"), 2, spins=100)[2] < 0.07
    (_, _, score), met = align.align_files_with_labels(spark, str(tmp_path / "real"), str(tmp_path / "inferred"), str(tmp_path / "labels"), 2, spins=100)
    label = {r.name: r.label for r in met.collect()}
    assert score < 0.07 and len(label) == 20
    assert label["v3"] == "3" and label["v19"] == label["v14"] == "2"
