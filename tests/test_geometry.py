"""Operators without SQL, against closed forms and plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoframe.functions import columns as C
from geoframe.operators import geometry, graph, lines, mesh, nearest, scores, spatial, voxels


def cube(spark):
    corners = [(0, i, float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)]
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    faces = [(0, 2 * n + s, *((q[0], q[1], q[2]) if s == 0 else (q[0], q[2], q[3]))) for n, q in enumerate(quads) for s in (0, 1)]
    return spark.createDataFrame(faces, "mesh_id long, fid long, v0 long, v1 long, v2 long"), spark.createDataFrame(corners, "mesh_id long, vid long, x double, y double, z double")


def points(spark, rows):
    return spark.createDataFrame(rows, "case_id long, line_id long, seq long, point_id long, x double, y double, z double, radius double, bifurc int")


def test_unit_cube(spark):
    faces, vertices = cube(spark)
    assert math.isclose(mesh.mesh_area(faces, vertices).first().area, 6) and math.isclose(mesh.mesh_volume(faces, vertices).first().volume, 1)
    assert mesh.edges(faces).count() == 18 and mesh.edges(faces).where("degree <> 2").count() == 0
    angles = sorted(round(r.angle, 6) for r in mesh.dihedrals(faces, vertices).collect())
    assert angles == [0.0] * 6 + [90.0] * 12
    assert mesh.mesh_components(faces).select("component").distinct().count() == 1
    assert mesh.cap_loops(faces, vertices).count() == 0
    loops = mesh.cap_loops(faces.where("fid not in (2, 3)"), vertices).collect()
    assert len(loops) == 1 and math.isclose(loops[0].area, 1) and loops[0].n_points == 4


def test_inside_and_raster_of_cube(spark):
    faces, vertices = cube(spark)
    rows = [(0, n, x, y, z) for n, (x, y, z) in enumerate([(0.3, 0.4, 0.5), (0.3, 0.4, 1.5), (0.3, 0.4, -0.5), (1.2, 0.4, 0.5), (0.5, 0.5, 0.5)])]
    got = geometry.points_in_mesh(spark.createDataFrame(rows, "mesh_id long, point_id long, x double, y double, z double"), faces, vertices, 0.7)
    assert [r.inside for r in got.orderBy("point_id").collect()] == [True, False, False, False, True]
    big = vertices.select("mesh_id", "vid", *[(F.col(c) * 4 + 0.5).alias(c) for c in "xyz"])
    assert geometry.rasterize_mesh(faces, big, 1.0, 2.0).count() == 64


def test_distance_to_cube(spark):
    faces, vertices = cube(spark)
    rnd = random.Random(1)
    rows = [(0, n, *(rnd.uniform(-2, 3) for _ in range(3))) for n in range(80)]
    got = {r.point_id: r.distance for r in geometry.nearest_on_surface(spark.createDataFrame(rows, "mesh_id long, point_id long, x double, y double, z double"), faces, vertices).collect()}
    for _, n, *p in rows:
        outside = math.sqrt(sum(max(-c, c - 1, 0) ** 2 for c in p))
        inside = min(min(c, 1 - c) for c in p)
        assert math.isclose(got[n], outside if outside > 0 else inside, abs_tol=1e-9)


def test_straight_line(spark):
    line = points(spark, [(1, 0, i, i, float(i), 0.0, 0.0, 1.0, -1) for i in range(40)])
    assert lines.arc_length(line).agg(F.max("s")).first()[0] == 39
    assert lines.tangents(line).where("tx = 1 and ty = 0 and tz = 0").count() == 40
    assert [r.seq for r in lines.walk_steps(line, 2.5).orderBy("seq").collect()] == list(range(0, 40, 3))
    assert lines.resample_line(line, 14).count() == 14 and lines.resample_spacing(line, 2.0).count() == 20


def test_walk_is_the_plain_loop(spark):
    rnd = random.Random(5)
    rows, x = [], 0.0
    for i in range(120):
        x += rnd.choice([0.0, 0.3, 1.1])
        rows.append((0, 0, i, i, x, 0.0, 0.0, rnd.choice([0.2, 0.5, 1.0]), rnd.choice([-1, 2])))
    got = [r.seq for r in lines.walk_steps(points(spark, rows), 1.5, slower_large=0.5, large=0.4, slower_bifurcation=0.7).orderBy("seq").collect()]
    want, p = [0], 0
    while p + 1 < len(rows):
        radius, bif = rows[p + 1][7], rows[p + 1][8]
        step = 1.5 * radius * (0.5 if radius >= 0.4 else 1) * (0.7 if bif == 2 else 1)
        q = next((q for q in range(p + 1, len(rows)) if round(rows[q][4], 9) >= round(rows[p][4] + step, 9)), None)
        if q is None:
            break
        want.append(p := q)
    assert got == want


@pytest.mark.parametrize("last_edges", [0, 40, 200_000])
def test_components_are_smallest_reachable(spark, monkeypatch, last_edges):
    """By rounds alone, by rounds and one task at the end, and by one task."""
    monkeypatch.setattr(graph, "LAST_EDGES", last_edges)
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(260)] + [(1000, 1000 + i) for i in range(200)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges + [(None, 5)], "src long, dst long")).collect()}
    assert got == {v: root(v) for v in parent}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_nearest_thin_and_spanning_tree(spark):
    rnd = random.Random(3)
    at = {i: tuple(rnd.uniform(0, 30) for _ in range(3)) for i in range(90)}
    df = spark.createDataFrame([(0, i, *p) for i, p in at.items()], "case_id long, point_id long, x double, y double, z double")
    kept = []
    for i in sorted(at):
        if all(math.dist(at[i], at[k]) >= 6 for k in kept):
            kept.append(i)
    assert sorted(r.point_id for r in spatial.thin_points(df, 6.0).collect()) == kept
    right = df.where("point_id % 5 = 0").withColumnRenamed("point_id", "right_id")
    near = nearest.nearest_point(df.withColumnRenamed("point_id", "left_id"), right).collect()
    assert len(near) == 90 and all(math.isclose(r.distance, min(math.dist(at[r.left_id], at[k]) for k in range(0, 90, 5)), abs_tol=1e-9) for r in near)
    inside, total = {0}, 0.0
    while len(inside) < len(at):
        d, j = min((math.dist(at[i], at[j]), j) for i in inside for j in at if j not in inside)
        inside.add(j)
        total += d
    tree = graph.min_spanning_tree(df, 4.0).collect()
    assert len(tree) == 89 and math.isclose(sum(r.weight for r in tree), total)


def test_similar_vectors_counts_all(spark):
    rnd = random.Random(4)
    rows = [(0, i, *(lambda v: [c / math.hypot(*v) for c in v])([rnd.gauss(0, 1) for _ in range(3)])) for i in range(200)]
    got = geometry.similar_vectors(spark.createDataFrame(rows, "case_id long, point_id long, x double, y double, z double"), 0.95).collect()
    pivots = {}
    for _, i, *v in rows:
        p = next((p for p in pivots if math.dist(v, rows[p][2:]) < math.sqrt(0.1)), i)
        pivots[p] = pivots.get(p, 0) + 1
    assert {r.pivot: r.n for r in got} == pivots


def test_tails_and_rotation(spark):
    assert math.isclose(scores.tail("normal", 1.959963985, None), 0.05, rel_tol=1e-6)
    assert math.isclose(scores.tail("chi2", 5.991464547, 2), 0.05, rel_tol=1e-6) and math.isclose(scores.tail("chi2", 18.307038, 10), 0.05, rel_tol=1e-5)
    assert math.isclose(scores.tail("t", 2.228138852, 10), 0.05, rel_tol=1e-6) and math.isclose(scores.tail("binomial", 1, 6), 14 / 64)
    p = tuple(F.lit(v) for v in (1.0, 2.0, 3.0))
    turned = C.rigid_rotate(p, tuple(F.lit(v) for v in (0.0, 0.0, 1.0)), F.radians(F.lit(180.5)), tuple(F.lit(0.0) for _ in range(3)))
    assert tuple(spark.range(1).select(*turned).first()) == (1.0, 2.0, 3.0)


def test_normal_error_is_the_angle_to_the_nearest_face(spark):
    faces, vertices = cube(spark)
    flat = vertices.where("vid in (0, 1, 2, 3)")
    base = faces.where("fid < 2")
    tilted = flat.withColumn("z", F.col("x") + 0.01)
    got = geometry.normal_error(base, flat, base, tilted).first()
    assert math.isclose(got.mean, 45, abs_tol=1e-6) and math.isclose(got.max, 45, abs_tol=1e-6) and got.std < 1e-6


def test_crops_by_draws(spark):
    rows = spark.createDataFrame([(case, i, j, k, 100 * i + 10 * j + k, int(case == 1 and (i, j, k) == (6, 0, 3))) for case in (0, 1) for i in range(7) for j in range(5) for k in range(4)], "case_id long, i long, j long, k long, value long, label int")
    size = {"i": 3, "j": 2, "k": 9}
    for crop in (voxels.random_crop, voxels.mask_crop):
        for tag in "abc":
            by_case = {}
            for r in crop(rows, size, tag).collect():
                by_case.setdefault(r.case_id, []).append(r)
            for case, got in by_case.items():
                assert sorted((r.i, r.j, r.k) for r in got) == [(i, j, k) for i in range(3) for j in range(2) for k in range(4)]
                assert len({r.value - (100 * r.i + 10 * r.j + r.k) for r in got}) == 1
                assert crop is voxels.random_crop or case == 0 or sum(r.label for r in got) == 1
            assert by_case.keys() == {0, 1}
    none = rows.withColumn("case_id", F.lit(None).cast("long")).where("label = 0")
    assert voxels.random_crop(none, size, "a").count() > 0 and voxels.centre_crop(rows.limit(0), size).count() == 0


def test_smoothing_keeps_a_flat_grid(spark):
    vertices = spark.createDataFrame([(0, a * 4 + b, float(a), float(b), 0.0) for a in range(4) for b in range(4)], "mesh_id long, vid long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 2 * (a * 3 + b) + s, *((a * 4 + b, a * 4 + b + 4, a * 4 + b + 1) if s == 0 else (a * 4 + b + 4, a * 4 + b + 5, a * 4 + b + 1))) for a in range(3) for b in range(3) for s in (0, 1)], "mesh_id long, fid long, v0 long, v1 long, v2 long")
    for method in ("laplacian", "taubin"):
        assert mesh.smooth(faces, vertices, method, 2, 0.1, -0.1).where("z <> 0").count() == 0


def test_missing_columns_are_named(spark):
    from geoframe.operators.catalog import fields_of_record

    with pytest.raises(ValueError, match="case_id"):
        fields_of_record(spark.createDataFrame([("a",)], "x string"), {"anatomy": "x"})
