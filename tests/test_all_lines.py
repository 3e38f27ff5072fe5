"""Queries without SQL over boxes of all lines and all cases, against plain loops."""

import math
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from geoframe.plans.views import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    """Points of each case, in the order of their lines."""
    found = defaultdict(list)
    for r in view(spark, SF, "v_line").orderBy("line_id", "seq").collect():
        found[r.case_id].append(r)
    return found


def boxes_of(lines, half, radii=0):
    for case, points in lines.items():
        for b in points:
            h = half + radii * b.radius
            yield case, b, [p for p in points if all(getattr(b, c) - h <= getattr(p, c) <= getattr(b, c) + h for c in "xyz")]


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_k17_pieces_of_all_boxes(spark, lines):
    want = set()
    for case, b, inside in boxes_of(lines, 6):
        pieces = []
        for p in inside:
            last = pieces[-1][-1] if pieces else None
            if last and (last.line_id, last.seq + 1) == (p.line_id, p.seq):
                pieces[-1].append(p)
            else:
                pieces.append([p])
        best = max(pieces, key=lambda ps: (len(ps), -min(p.point_id for p in ps)))
        want |= {(case, f"{b.line_id}_{b.seq}", p.point_id) for p in best}
    got = [(r.case_id, r.box_id, r.point_id) for r in run(spark, "k17_local_centerline")]
    assert len(got) == len(want) and set(got) == want


def test_k8_and_k9_trajectories_of_all_boxes(spark, lines):
    want = {}
    for case, b, inside in boxes_of(lines, 0, 8):
        half = 8 * b.radius
        by_line = defaultdict(list)
        for p in inside:
            by_line[p.line_id].append([(getattr(p, c) - (getattr(b, c) - half)) / (2 * half) for c in "xyz"])
        for line, unit in by_line.items():
            for angle in (0.0, math.pi / 2):
                turned = [(x, 0.5 + math.cos(angle) * (y - 0.5) - math.sin(angle) * (z - 0.5), 0.5 + math.sin(angle) * (y - 0.5) + math.cos(angle) * (z - 0.5)) for x, y, z in unit]
                for plane, axis, other in (("z", 2, 1), ("y", 1, 2)):
                    kept = [(t[0], t[other]) for t in turned if 0.35 < t[axis] < 0.65 and 0 <= t[0] <= 1 and 0 <= t[other] <= 1]
                    if len(kept) < 4:
                        continue
                    for j in range(20):
                        at = j * (len(kept) - 1) / 19.0
                        a, z = kept[int(at)], kept[min(int(at) + 1, len(kept) - 1)]
                        want[f"{case}_{b.line_id}_{b.seq}", round(angle, 6), plane, line, j * 228 // 20] = [a[k] + (at - int(at)) * (z[k] - a[k]) for k in (0, 1)]
    key = lambda r: (r.sample_id, r.angle, r.plane, r.line_id, r.frame)
    got = run(spark, "k8_plane_trajectories")
    assert len(got) == len(want) and {key(r) for r in got} == want.keys()
    assert all(abs(r.u - want[key(r)][0]) < 2e-6 and abs(r.v - want[key(r)][1]) < 2e-6 for r in got)
    back = run(spark, "k9_deproject_trajectories")
    assert len(back) == len(want) and {key(r) for r in back} == want.keys()
    for r in back:
        u, v = want[key(r)]
        y, z = (v - 0.5, 0.0) if r.plane == "z" else (0.0, v - 0.5)
        c, s = math.cos(r.angle), math.sin(r.angle)
        assert max(abs(r.ux - u), abs(r.uy - (0.5 + c * y + s * z)), abs(r.uz - (0.5 - s * y + c * z))) < 3e-6


def test_e21_distances_of_all_cases(spark, lines):
    far = {}
    for case, points in lines.items():
        sides = [p for p in points if p.point_id % 3 == 0], [p for p in points if p.point_id % 3]
        if all(sides):
            far[case] = max(min(math.dist((p.x, p.y, p.z), (q.x, q.y, q.z)) for q in sides[1 - k]) for k in (0, 1) for p in sides[k])
    got = {r.case_id: r.distance for r in run(spark, "e21_evaluate_case")}
    assert {0, 1} <= far.keys() <= got.keys()
    assert all(abs(d - far.get(c, math.inf)) < 1e-5 if c in far else d == math.inf for c, d in got.items())
