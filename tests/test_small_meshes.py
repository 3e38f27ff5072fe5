"""Small meshes are worked on in tasks; the same meshes by steps over tables give the same rows, odd ones included."""

import math

import pytest
from pyspark.sql import functions as F

from geoframe.operators import geometry, mesh, small_meshes
from geoframe.plans import storage
from geoframe.plans.views import view

SMALL = "/root/testdata/sf0.001"
CONFIGS = [
    {"name": "none", "iterations": 0},
    {"name": "plain", "iterations": 3},
    {"name": "taubin", "method": "taubin", "iterations": 2, "lam": 0.1, "mu": -0.1},
    {"name": "wild", "iterations": 4, "lam": 90.0},
]


def odd_meshes(spark):
    """Meshes with a null corner, a null coordinate, no faces, a face without its vertices, a flat face, a face twice, infinite places, no id."""
    faces, vertices = (view(spark, SMALL, name).where("mesh_id <= 2") for name in ("v_face", "v_vertex"))
    inf = math.inf
    tris = [(11, 0, 0, 1, None), (12, 0, 0, 1, 2), (14, 0, 0, 1, 7), (14, 1, 0, 1, 2), (15, 0, 0, 1, 2), (15, 1, 0, 0, 1), (16, 0, 0, 1, 2), (16, 1, 0, 1, 2), (17, 0, 0, 1, 2), (None, 0, 0, 1, 2), (18, 0, 0, 1, 2)]
    places = [(m, v, float(v % 2), float(v // 2), float((m or 0) % 3 + v)) for m in (11, 13, 14, 16, 17, None) for v in range(4)]
    places += [(12, 0, 0.0, 0.0, None), (12, 1, 1.0, 0.0, 0.0), (12, 2, 0.0, 1.0, 0.0), *[(15, v, float(v), 0.0, 0.0) for v in range(3)], (17, 9, inf, 0.0, 0.0)]
    faces = faces.unionByName(spark.createDataFrame(tris, "mesh_id long, fid long, v0 long, v1 long, v2 long"))
    return faces, vertices.unionByName(spark.createDataFrame(places, "mesh_id long, vid long, x double, y double, z double"))


def rows_of(df):
    said = lambda v: round(v, 9) + 0.0 if isinstance(v, float) and math.isfinite(v) else repr(v) if isinstance(v, float) else v
    return sorted((tuple(map(said, r)) for r in df.collect()), key=str)


@pytest.mark.parametrize("sweep", [mesh.smooth_sweep, geometry.param_sweep])
def test_sweep_in_tasks_and_by_steps(spark, monkeypatch, sweep):
    faces, vertices = odd_meshes(spark)
    small = rows_of(sweep(faces, vertices, CONFIGS))
    monkeypatch.setattr(small_meshes, "SMALL_MESH", -1)
    assert rows_of(sweep(faces, vertices, CONFIGS)) == small and {r[-1] for r in small} == {"ok", "diverged"}


@pytest.mark.parametrize("name", ["n4_param_sweep", "n4_sweep_diverges", "n3_smooth_taubin"])
def test_sweeps_write_no_vertices(spark, monkeypatch, name):
    import __spark_entry__

    names, write = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, folder: (names.append(folder), write(df, folder))[1])
    __spark_entry__.queries()[name](spark, SMALL)
    assert set(names) == {"mesh-sizes", "large-meshes"}


def test_nearest_in_tasks_and_by_blocks(spark, monkeypatch):
    """Meshes of the views, and a cube with a flat face, points on it, off it and not finite, points of no mesh, faces without points."""
    import random

    rnd = random.Random(3)
    faces, vertices = (view(spark, SMALL, name).where("mesh_id <= 3") for name in ("v_face", "v_vertex"))
    flat = spark.createDataFrame([(4, 0, 0, 1, 2), (4, 1, 0, 1, 3), (5, 0, 0, 1, 2)], faces.schema)
    places = [(4, 0, 0.0, 0.0, 0.0), (4, 1, 2.0, 0.0, 0.0), (4, 2, 0.0, 2.0, 0.0), (4, 3, 1.0, 0.0, 0.0), (5, 0, 0.0, 0.0, 0.0), (5, 1, math.nan, 0.0, 0.0), (5, 2, 0.0, 1.0, 0.0)]
    faces, vertices = faces.unionByName(flat), vertices.unionByName(spark.createDataFrame(places, vertices.schema))
    asked = [(m, n, rnd.uniform(-2, 17), rnd.uniform(-2, 17), rnd.uniform(-1, 6)) for m in (1, 2, 4, 5, 9) for n in range(40)]
    asked += [(m, 40 + n, float(n), float(n % 3), float(n % 5)) for m in (1, 4) for n in range(15)] + [(1, 90, math.nan, 0.0, 0.0), (2, 7, 3.0, 3.0, 2.0), (None, 91, 0.0, 0.0, 0.0), (2, 92, None, 0.0, 0.0)]
    points = spark.createDataFrame(asked, "mesh_id long, point_id long, x double, y double, z double")
    names, write = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, folder: (names.append(folder), write(df, folder))[1])
    small = sorted(map(tuple, geometry.nearest_on_surface(points, faces, vertices).collect()))
    assert len(small) == 2 * 40 + 40 + 30 and names == ["pairs-of-meshes", "nearest-faces"]
    for limit in (0, 1400 * 1050):
        monkeypatch.setattr(small_meshes, "MOST_PAIRS", limit)
        assert sorted(map(tuple, geometry.nearest_on_surface(points, faces, vertices).collect())) == small
