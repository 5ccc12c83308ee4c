import math

import pytest

from horosphere.operators import graph


def edges(spark, pairs):
    return graph.canonical(spark.createDataFrame([tuple(map(int, p)) for p in pairs], "src long, dst long"))


def rows(df, key="vid"):
    return {r[key]: r for r in df.collect()}


def complete(n):
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


@pytest.mark.parametrize(("n", "triangles"), [(3, 1), (5, 6)])
def test_cliques(spark, n, triangles):
    e = edges(spark, complete(n))
    got = rows(graph.properties(e))
    assert len(got) == n
    assert all((r.degree, r.nb_triang, r.clustering) == (n - 1, triangles, 1.0) for r in got.values())
    assert all(r.coreness == n - 1 and r.layer == 1 for r in graph.onion(e).collect())


@pytest.mark.parametrize("local", [0, 1000])
def test_star_and_path(spark, local):
    star = edges(spark, [(0, i) for i in range(1, 7)])
    assert rows(graph.properties(star))[0].degree == 6
    assert {r.vid: (r.coreness, r.layer) for r in graph.onion(star, local).collect()} == {0: (1, 2), **{i: (1, 1) for i in range(1, 7)}}
    path = edges(spark, [(i, i + 1) for i in range(4)])
    assert {r.vid: r.layer for r in graph.onion(path, local).collect()} == {0: 1, 4: 1, 1: 2, 3: 2, 2: 3}
    reached = graph.bfs(path, spark.createDataFrame([(0,)], "s long"))
    assert {r.vid: r.dist for r in reached.collect()} == {i: i for i in range(5)}


def test_components(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 0), (7, 8)])
    assert {r.vid: r.component for r in graph.components(e).collect()} == {0: 0, 1: 0, 2: 0, 7: 7, 8: 7}
    giant, n = graph.giant_component(e)
    assert n == 2
    assert sorted(map(tuple, giant.collect())) == [(0, 1), (0, 2), (1, 2)]
    with pytest.raises(graph.MultipleComponentsError):
        graph.require_connected(e)


def test_long_chain_converges(spark):
    e = edges(spark, [(i, i + 1) for i in range(300)])
    assert {r.component for r in graph.components(e).collect()} == {0}


def test_ccdf_starts_at_one(spark):
    c = graph.ccdf(graph.class_spectra(graph.properties(edges(spark, complete(4) + [(3, 9)])))).orderBy("degree").collect()
    assert c[0].ccdf == 1.0
    assert math.isclose(sum(r.deg_dist for r in c), 1.0)


def test_text_round_trip(spark, tmp_path):
    from horosphere.sources import text

    (tmp_path / "g.edge").write_text("# c\n\n  a  b extra\n#x y\nb a\na a\nc\nb c\n")
    named = text.read_edges(spark, str(tmp_path / "g.edge"))
    v = graph.dictionary(named)
    assert {r.name: r.vid for r in v.collect()} == {"a": 0, "b": 1, "c": 2}
    e = graph.encoded(named, v)
    assert sorted(map(tuple, e.select("src", "dst").collect())) == [(0, 1), (1, 2)]
    places = v.selectExpr("name", "1.5D + vid AS kappa", "0.25D * vid AS theta", "3.0D AS hyp_rad", "vid")
    text.write_coordinates(places, str(tmp_path / "c"), 1, 2.5, 0.01)
    back = text.read_coordinates(spark, str(tmp_path / "c"), 1)
    assert sorted(map(tuple, back.collect())) == [("a", 1.5, 0.0, 3.0), ("b", 2.5, 0.25, 3.0), ("c", 3.5, 0.5, 3.0)]
    assert text.read_parameters(spark, str(tmp_path / "c"))["beta"] == 2.5


def test_searches_in_tasks_are_those_by_joins_and_write_no_level(spark, monkeypatch):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (4, 9), (20, 30), (30, 40)], "src long, dst long")
    s = spark.createDataFrame([(1,), (9,), (30,), (77,), (1,)], "s long")
    tags, want = [], sorted(map(tuple, graph.bfs(e, s, 0).collect()))
    made = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, tag: (tags.append(tag), made(df, tag))[1])
    assert sorted(map(tuple, graph.bfs(e, s).collect())) == want
    assert len(want) == 5 + 5 + 3 + 1
    assert set(tags) == {"edges", "sources"}


def test_components_of_one_task_are_those_by_rounds(spark, monkeypatch):
    import random

    draw = random.Random(3)
    e = edges(spark, {(draw.randrange(400), 1000 + draw.randrange(300)) for _ in range(350)} | {(i, i + 7) for i in range(2000, 2300)})
    want = sorted(map(tuple, graph.components_by_rounds(e).collect()))
    assert len({c for _, c in want}) > 20
    monkeypatch.setattr(graph, "components_by_rounds", None)
    assert sorted(map(tuple, graph.components(e).collect())) == want
    assert graph.components(e.limit(0)).collect() == []
    narrow = graph.components(e.selectExpr("int(src) src", "int(dst) dst"))
    assert [f.dataType.simpleString() for f in narrow.schema] == ["int", "int"]


def test_a_graph_is_generated_without_its_components(spark, monkeypatch):
    from horosphere.plans import catalog

    monkeypatch.setattr(graph, "components", None)
    assert catalog.generate_s1(spark, "/root/testdata/sf0.001").count() > 0


def test_triangles_by_groups_are_those_by_wedges(spark):
    import random

    draw = random.Random(5)
    e = edges(spark, {tuple(sorted(draw.sample(range(90), 2))) for _ in range(900)} | {(0, i) for i in range(200, 260)})
    want = sorted(map(tuple, graph.triangles(e).collect()))
    assert len(want) > 80
    assert sorted(map(tuple, graph.triangles(e, most=100).collect())) == want
    for groups in (1, 3):
        assert sorted(map(tuple, graph.triangles_by_groups(graph.pointed(e, []), groups).collect())) == want


def test_components_read_edges_a_batch_at_a_time(spark, monkeypatch):
    from horosphere.sources import shared

    made = shared.read_batches
    monkeypatch.setattr(shared, "read_arrow", None)
    monkeypatch.setattr(shared, "read_batches", lambda path, columns: made(path, columns, 3))
    e = edges(spark, {(i, i + 1) for i in range(0, 40) if i % 10 != 9} | {(3, 35)})
    got = dict(map(tuple, graph.components(e).collect()))
    assert {c: sum(x == c for x in got.values()) for c in set(got.values())} == {0: 20, 10: 10, 20: 10}
