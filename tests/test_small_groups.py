"""Small groups are finished by tasks, large ones by rounds: both give the same rows, and small ones write no tables of rounds."""

import random

from geoframe.operators import geometry, graph, lines, mesh
from geoframe.plans import storage


def written(monkeypatch) -> list[str]:
    names, write = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name: (names.append(name), write(df, name))[1])
    return names


def test_trees(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(case, i, *[float(rnd.randrange(4)) for _ in "xyz"]) for case in (1, 2) for i in range(25)] + [(3, 1, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "case_id long, point_id long, x double, y double, z double")
    names = written(monkeypatch)
    small = sorted(map(tuple, graph.min_spanning_tree(points, 2.0).collect()))
    assert len(small) == 48 and names == ["mst-sizes"]
    monkeypatch.setattr(graph, "SMALL_TREE", 0)
    assert sorted(map(tuple, graph.min_spanning_tree(points, 2.0).collect())) == small


def test_chains(spark, monkeypatch):
    rnd = random.Random(5)
    rows = []
    for case in range(3):
        ids = rnd.sample(range(100), 21)
        rows += [(case, *rnd.sample(pair, 2)) for part in (ids[:9], ids[9:20]) for pair in zip(part, part[1:])]
    edges = spark.createDataFrame(rows, "case_id long, a long, b long")
    names = written(monkeypatch)
    small = sorted(map(tuple, lines.ordered_by_edges(edges).collect()))
    assert len(small) == 60 and names == ["chain-sizes"]
    monkeypatch.setattr(lines, "SMALL_CHAINS", 0)
    assert sorted(map(tuple, lines.ordered_by_edges(edges).collect())) == small
    ring = spark.createDataFrame([(9, 1, 2), (9, 2, 3), (9, 3, 1)], "case_id long, a long, b long")
    monkeypatch.setattr(lines, "SMALL_CHAINS", 10)
    assert not lines.ordered_by_edges(ring).collect()


def test_parts_of_cases(spark, monkeypatch):
    rnd = random.Random(7)
    rows = [(case, i, j, k, rnd.choice([10, 30, 40, None]), "x", 5) for case in (1, 2, 3, None) for i in range(4) for j in range(4) for k in range(3)]
    image = spark.createDataFrame(rows, "case_id long, i long, j long, k long, value long, note string, pred int")
    names = written(monkeypatch)
    key = lambda r: tuple((v is None, v) for v in r)
    for keep in (1, 2):
        monkeypatch.setattr(geometry, "SMALL_CASE", 200)
        small = sorted(map(tuple, geometry.cleaned_prediction(image, "value", 30, keep).collect()), key=key)
        assert len(small) == len(rows) and names == ["voxels", "case-sizes"]
        assert {r[0] for r in small if r[-1]} == {1, 2, 3} and all(r[4] >= 30 for r in small if r[-1])
        for limit in (0, 24):
            monkeypatch.setattr(geometry, "SMALL_CASE", limit)
            assert sorted(map(tuple, geometry.cleaned_prediction(image, "value", 30, keep).collect()), key=key) == small
        names.clear()


def test_components_of_groups(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(key, *rnd.choices(range(30), k=2)) for key in (1, 2, 3) for _ in range(20)] + [(None, 1, 2), (1, None, 2), (4, 7, 7)]
    edges = spark.createDataFrame(rows, "mesh_id long, a long, b long")
    names = written(monkeypatch)
    small = sorted(map(tuple, graph.components_in_groups(edges, "mesh_id").collect()))
    assert names == ["group-sizes"] and (4, 7, 7) in small and len(small) == len({(k, v) for k, a, b in rows if None not in (k, a, b) for v in (a, b)})
    monkeypatch.setattr(graph, "SMALL_GRAPH", 10)
    assert sorted(map(tuple, graph.components_in_groups(edges, "mesh_id").collect())) == small
    text = edges.selectExpr("mesh_id", "cast(a + 100 as string) as a", "cast(b + 100 as string) as b")
    assert sorted((k, int(v) - 100, int(c) - 100) for k, v, c in graph.components_in_groups(text, "mesh_id").collect()) == small
    assert not graph.components_in_groups(edges.limit(0), "mesh_id").collect()


def test_open_ends_need_no_rounds(spark, monkeypatch):
    names = written(monkeypatch)
    faces = spark.createDataFrame([(m, f, *v) for m in (1, 2) for f, v in enumerate([(0, 1, 2), (0, 2, 3), (5, 6, 7)])], "mesh_id long, fid long, v0 long, v1 long, v2 long")
    vertices = spark.createDataFrame([(m, v, float(v % 2), float(v // 2), 0.0) for m in (1, 2) for v in range(8)], "mesh_id long, vid long, x double, y double, z double")
    assert sorted((r.mesh_id, r.loop, r.n_points) for r in mesh.cap_loops(faces, vertices).collect()) == [(1, 0, 4), (1, 5, 3), (2, 0, 4), (2, 5, 3)]
    assert names == ["border", "group-sizes", "loop-points"]
