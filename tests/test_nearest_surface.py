"""The registered search for nearest faces against plain numpy over all faces."""

from collections import defaultdict

import numpy as np

import __spark_entry__ as entry
from geoframe.plans.queries_geometry import _spots
from geoframe.plans.views import view

SF = "/root/testdata/sf0.001"


def distances(p, tri):
    """From p to each triangle: to its inside where p is over it, else to its nearest edge."""
    best = np.full(len(tri), np.inf)
    for k in range(3):
        a, b = tri[:, k], tri[:, (k + 1) % 3]
        t = np.clip(((p - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1), 0, 1)
        best = np.minimum(best, np.linalg.norm(p - a - t[:, None] * (b - a), axis=1))
    u, v, w = tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0], p - tri[:, 0]
    n = np.cross(u, v)
    s, t = (np.cross(w, v) * n).sum(1) / (n * n).sum(1), (np.cross(u, w) * n).sum(1) / (n * n).sum(1)
    over = (s >= 0) & (t >= 0) & (s + t <= 1)
    return np.where(over, np.minimum(best, np.abs((w * n).sum(1)) / np.linalg.norm(n, axis=1)), best)


def test_j13_every_point_has_its_nearest_face(spark):
    at = {(r.mesh_id, r.vid): (r.x, r.y, r.z) for r in view(spark, SF, "v_vertex").collect()}
    faces = defaultdict(dict)
    for r in view(spark, SF, "v_face").collect():
        faces[r.mesh_id][r.fid] = [at[r.mesh_id, v] for v in (r.v0, r.v1, r.v2)]
    meshes = {m: (np.array(list(f)), np.array(list(f.values()))) for m, f in faces.items()}
    got = {(r.mesh_id, r.point_id): r for r in entry.queries()["j13_nearest_on_surface"](spark, SF).collect()}
    spots = _spots(spark, SF).collect()
    assert len(spots) == len(got) > 0
    for s in spots:
        fids, tri = meshes[s.mesh_id]
        all_of_it, r = distances(np.array([s.x, s.y, s.z]), tri), got[s.mesh_id, s.point_id]
        assert abs(r.distance - all_of_it.min()) < 2e-6
        assert all_of_it[fids == r.fid][0] - all_of_it.min() < 1e-9
