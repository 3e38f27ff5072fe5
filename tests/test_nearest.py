"""Nearest neighbours, boxes and submeshes against loops: clusters, far points, ties, boxes of very different size."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoframe.operators import geometry, mesh, nearest, spatial


def cloud(rnd, n):
    """Half in a tight cluster, some on one spot, some far away."""
    out = []
    for i in range(n):
        kind = i % 10
        if kind < 5:
            out.append(tuple(rnd.gauss(3, 0.01) for _ in range(3)))
        elif kind < 7:
            out.append((1.0, 2.0, 3.0))
        elif kind < 9:
            out.append(tuple(rnd.uniform(-20, 20) for _ in range(3)))
        else:
            out.append(tuple(rnd.uniform(-1, 1) * 10 ** rnd.randrange(1, 8) for _ in range(3)))
    return out


def test_nearest_point(spark):
    rnd = random.Random(8)
    left, right = [(c, i, *p) for c in (0, 1, None) for i, p in enumerate(cloud(rnd, 150))], [(c, i, *p) for c in (0, 1, 2) for i, p in enumerate(cloud(rnd, 300))]
    left.append((0, 999, float("nan"), 0.0, 0.0))
    schema = "case_id long, {} long, x double, y double, z double"
    got = nearest.nearest_point(spark.createDataFrame(left, schema.format("left_id")), spark.createDataFrame(right, schema.format("right_id")).repartition(3)).collect()
    assert len(got) == 300 and {r.case_id for r in got} == {0, 1}
    at = {(c, i): p for c, i, *p in left}
    for r in got:
        p = at[r.case_id, r.left_id]
        d, i = min((sum((a - b) * (a - b) for a, b in zip(p, q)), i) for c, i, *q in right if c == r.case_id)
        assert r.right_id == i and math.isclose(r.distance, math.sqrt(d), rel_tol=1e-12)
    assert nearest.nearest_point(spark.createDataFrame(left, schema.format("left_id")), spark.createDataFrame([], schema.format("right_id"))).count() == 0


def test_points_in_boxes(spark):
    rnd = random.Random(2)
    points = [(c, i, *p) for c in (0, 1) for i, p in enumerate(cloud(rnd, 120))]
    boxes = []
    for b in range(40):
        side = 10.0 ** rnd.randrange(-3, 7)
        lo = [rnd.uniform(-side, 3) for _ in range(3)]
        boxes.append((b % 2, b, *lo, *(v + side * rnd.random() for v in lo)))
    boxes += [(0, 90, 1.0, 2.0, 3.0, 1.0, 2.0, 3.0), (0, 91, 5.0, 5.0, 5.0, 4.0, 6.0, 6.0)]
    ends = [f"{e}{c}" for e in ("lo", "hi") for c in "xyz"]
    df = spark.createDataFrame(points, "case_id long, point_id long, x double, y double, z double")
    bf = spark.createDataFrame(boxes, "case_id long, box_id long, " + ", ".join(f"{e} double" for e in ends))
    for closed in (True, False):
        got = sorted((r.box_id, r.point_id) for r in spatial.points_in_boxes(df, bf, closed).collect())
        inside = lambda v, lo, hi: lo <= v <= hi if closed else lo < v < hi  # noqa: B023, E731
        want = [(b, i) for k, b, *e in boxes for c, i, *p in points if c == k and all(inside(v, e[a], e[a + 3]) for a, v in enumerate(p))]
        assert got == sorted(want)


@pytest.fixture(scope="module")
def grid(spark):
    """A bent sheet of 9 x 9 vertices."""
    at = {i * 9 + j: (float(i), float(j), math.sin(i) + 0.1 * j) for i in range(9) for j in range(9)}
    tris = []
    for i in range(8):
        for j in range(8):
            a = i * 9 + j
            tris += [(a, a + 9, a + 1), (a + 9, a + 10, a + 1)]
    vertices = spark.createDataFrame([(5, v, *p) for v, p in at.items()], "mesh_id long, vid long, x double, y double, z double")
    faces = spark.createDataFrame([(5, n, *t) for n, t in enumerate(tris)], "mesh_id long, fid long, v0 long, v1 long, v2 long")
    return at, tris, vertices, faces


def test_submesh_model_last_visit_wins(spark, grid):
    at, tris, vertices, faces = grid
    visits = [(0, 0, 2.0, 2.0, 0.9), (0, 1, 3.0, 3.0, 1.5), (1, 0, 4.0, 3.0, 1.2), (1, 1, 7.0, 7.0, 0.2)]
    visited = spark.createDataFrame([(5, rank, seq, x, y, 0.0, r) for rank, seq, x, y, r in visits], "mesh_id long, line_rank int, seq int, x double, y double, z double, radius double")

    def model(points, edges, local):
        if len(points) % 2 == 0:
            return points[:1]
        return points * 0.5 + edges.shape[0] + local.shape[0] / 100

    got = {r.vid: (r.x, r.y, r.z) for r in mesh.apply_submesh_model(faces, vertices, mesh.boxes_along_walk(visited), model).collect()}
    want = dict(at)
    for _, _, x, y, r in visits:
        inside = {v for v, p in at.items() if all(abs(a - b) <= 2 * r for a, b in zip(p, (x, y, 0.0)))}
        whole = [t for t in tris if set(t) <= inside]
        used = sorted({v for t in whole for v in t})
        place = {v: n for n, v in enumerate(used)}
        edges = {tuple(sorted((t[a], t[b]))) for t in whole for a, b in ((0, 1), (1, 2), (0, 2))}
        if used:
            new = model(np.array([at[v] for v in used]), np.array(sorted(edges)), np.array([[place[v] for v in t] for t in whole]))
            if len(new) == len(used):
                want |= {v: tuple(p) for v, p in zip(used, new)}
    assert want != at and all(math.isclose(a, b, abs_tol=1e-12) for v in at for a, b in zip(got[v], want[v]))


def test_sampled_faces_are_those_of_the_cumulated_areas(spark, grid):
    import hashlib

    at, tris, vertices, faces = grid
    areas = [np.linalg.norm(np.cross(np.subtract(at[b], at[a]), np.subtract(at[c], at[a]))) / 2 for a, b, c in tris]
    upto = np.cumsum(areas) / sum(areas) * 200
    got = {r.draw: r.fid for r in mesh.sample_surface(faces, vertices, 200).collect()}
    for draw in range(200):
        u = int(hashlib.md5(f"5_{draw}_42-face".encode()).hexdigest()[:16], 16) % 10000 / 10000
        near = upto[min(np.searchsorted(upto, draw + u, "right"), len(tris) - 1)]
        assert got[draw] == np.searchsorted(upto, draw + u, "right") or abs(near - draw - u) < 1e-9
    assert len(got) == 200


def test_components_of_wide_masks_equal_numpys(spark):
    rnd = random.Random(1)
    cells = [(f"c{c}", f, rnd.choice([1, 2])) for c in range(7) for f in rnd.sample(range(200_000), 60)] + [(f"c{c}", 5, c % 3) for c in range(7)]
    got = {r.case_id: r.scores for r in geometry.pca_shapes(spark.createDataFrame(cells, "case_id string, feature long, label int"), 2).collect()}
    wide = sorted({f for _, f, _ in cells})
    x = np.zeros((7, len(wide)))
    for c, f, v in cells:
        x[int(c[1:]), wide.index(f)] += v
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for k in range(2):
        assert np.allclose(np.abs([got[f"c{c}"][k] for c in range(7)]), np.abs(x @ axes[k]))


def test_diverged_settings_stop(spark, grid):
    _, _, vertices, faces = grid
    got = {r.config: r for r in geometry.param_sweep(faces, vertices, [{"name": "calm", "iterations": 2}, {"name": "none", "iterations": 0}, {"name": "wild", "iterations": 9, "lam": 40.0}]).collect()}
    assert got["calm"].status == got["none"].status == "ok" and got["wild"].status == "diverged" and got["wild"].area is None
    assert math.isclose(got["none"].area, mesh.mesh_area(faces, vertices).first().area)
    calm = mesh.smooth(faces, vertices, "laplacian", 2)
    assert math.isclose(got["calm"].area, mesh.mesh_area(faces, calm).first().area)
    assert mesh.smooth(faces, vertices.withColumn("extra", F.lit(1)), "taubin", 1).count() == 81
