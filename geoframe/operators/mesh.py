"""Triangle meshes as vertices (mesh_id, vid, x, y, z) and faces (mesh_id, fid, v0, v1, v2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.functions.columns import angle_deg, cross, dot, norm, normalise, sub, unit_hash, vec
from geoframe.operators import small_meshes
from geoframe.operators.graph import components_in_groups
from geoframe.operators.ranges import group_number, group_total, quantiles
from geoframe.operators.spatial import points_in_boxes
from geoframe.plans.storage import stored_large, tasks_for

#: Sides of open ends that one task joins with their corners; faces whose edges one task brings together; faces that one task
#: compares with those in the same cells.
SIDES, FACES, CROSSED = 100_000, 100_000, 100_000


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """faces with the coordinates x0 .. z2 of their corners."""
    out = faces
    for n in range(3):
        own = vertices.select("mesh_id", F.col("vid").alias(f"v{n}"), *[F.col(c).alias(f"{c}{n}") for c in "xyz"])
        out = out.join(own.hint("merge"), ["mesh_id", f"v{n}"])
    return out


def point(n: int):
    return vec(f"x{n}", f"y{n}", f"z{n}")


def doubled_normal():
    return cross(sub(point(1), point(0)), sub(point(2), point(0)))


def face_geometry(faces: DataFrame, vertices: DataFrame, **more: Column) -> DataFrame:
    """Per face its unit normal nx, ny, nz (null if it has no area) and area; more columns by its corners."""
    cornered = corners(faces, vertices)
    n = doubled_normal()
    staged = cornered.select("mesh_id", "fid", "v0", "v1", "v2", *[c.alias(f"__{a}") for a, c in zip("xyz", n)], *[c.alias(name) for name, c in more.items()])
    length = norm(vec("__x", "__y", "__z"))
    return staged.select("mesh_id", "fid", "v0", "v1", "v2", *[c.alias(f"n{a}") for a, c in zip("xyz", normalise(vec("__x", "__y", "__z")))], (length / 2).alias("area"), *more)


def mesh_area(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    return face_geometry(faces, vertices).groupBy("mesh_id").agg(F.sum("area").alias("area"))


def mesh_volume(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Volume by signed tetrahedra; exact for a closed mesh with one winding."""
    cornered = corners(faces, vertices)
    return cornered.groupBy("mesh_id").agg(F.abs(F.sum(dot(point(0), cross(point(1), point(2))) / 6)).alias("volume"))


def edge_rows(faces: DataFrame) -> DataFrame:
    """Each face's three undirected edges (a < b)."""
    pairs = F.explode(F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))]))
    return faces.select("mesh_id", "fid", pairs.alias("e")).select("mesh_id", "fid", "e.a", "e.b")


def edges(faces: DataFrame) -> DataFrame:
    """Distinct edges with the number of faces on each: 1 on the boundary, over 2 where the mesh is no surface."""
    return edge_rows(faces).groupBy("mesh_id", "a", "b").agg(F.count("*").alias("degree"))


def mesh_components(faces: DataFrame) -> DataFrame:
    """Vertices of faces (mesh_id, vid) with component: the least vertex that edges lead to."""
    linked = stored_large(edge_rows(faces).select("mesh_id", "a", "b").distinct(), "mesh-edges")
    return components_in_groups(linked, "mesh_id").withColumnRenamed("node", "vid")


def cap_loops(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Open ends: boundary loops with their centre and the area of the triangles from it to the loop's edges."""
    border = stored_large(edges(faces).where("degree = 1"), "border")
    label = components_in_groups(border, "mesh_id").select("mesh_id", F.col("node").alias("vid"), F.col("component").alias("loop"))
    placed = stored_large(label.hint("merge").join(vertices, ["mesh_id", "vid"]).select("mesh_id", "vid", "loop", *"xyz"), "loop-points")
    centre = placed.groupBy("mesh_id", "loop").agg(*[F.avg(c).alias(f"{c}0") for c in "xyz"], F.count("*").alias("n_points"))
    n = tasks_for(border, SIDES)
    sides = border
    for v, end, more in (("a", 1, ["loop"]), ("b", 2, [])):
        own = placed.select("mesh_id", F.col("vid").alias(v), *more, *[F.col(c).alias(f"{c}{end}") for c in "xyz"])
        sides = sides.repartition(n, "mesh_id", v).join(own.repartition(n, "mesh_id", v).hint("merge"), ["mesh_id", v])
    area = sides.join(centre.hint("merge"), ["mesh_id", "loop"]).groupBy("mesh_id", "loop").agg(F.sum(norm(doubled_normal()) / 2).alias("area"))
    return centre.join(area.hint("merge"), ["mesh_id", "loop"]).select("mesh_id", "loop", "n_points", *[F.col(f"{c}0").alias(c) for c in "xyz"], "area")


def sided_faces(faces: DataFrame, vertices: DataFrame) -> tuple[DataFrame, int]:
    """face_geometry() with the lengths d0, d1, d2 of the sides from v0, v1, v2 on, written and dealt by meshes; and to how many tasks."""
    sides = {f"d{p}": norm(sub(point(p), point(q))) for p, q in ((0, 1), (1, 2), (2, 0))}
    rows = stored_large(face_geometry(faces, vertices, **sides), "sided-faces")
    n = tasks_for(rows, FACES)
    return rows.repartition(n, "mesh_id"), n


def bends_of(sided: DataFrame) -> DataFrame:
    """Per edge with two faces (of some area) the angle between their normals, and its length; of dealt faces where they are."""
    pairs = F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.col(d).alias("d")) for p, q, d in (("v0", "v1", "d0"), ("v1", "v2", "d1"), ("v2", "v0", "d2"))])
    rows = sided.where("area > 0").select("mesh_id", "fid", "nx", "ny", "nz", F.explode(pairs).alias("e")).select("mesh_id", "fid", "nx", "ny", "nz", "e.*")
    # Numbers, not structs, are picked, as those are aggregated without a sort.
    picked = [f(f"n{c}", "fid").alias(f"{name}{c}") for name, f in (("p", F.min_by), ("q", F.max_by)) for c in "xyz"]
    both = rows.groupBy("mesh_id", "a", "b").agg(F.count("*").alias("n"), F.max("d").alias("d"), *picked).where("n = 2")
    return both.select("mesh_id", "a", "b", angle_deg(vec("px", "py", "pz"), vec("qx", "qy", "qz")).alias("angle"), "d")


def dihedrals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per edge with two faces (of some area) the angle between their normals."""
    return bends_of(sided_faces(faces, vertices)[0]).drop("d")


def dihedral_p95(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    return quantiles(dihedrals(faces, vertices), ["mesh_id"], "angle", {"p95": 0.95})


def vertex_curvature(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per vertex mean curvature by half of edge length times dihedral angle over a third of the area around it, and that area."""
    sided, n = sided_faces(faces, vertices)
    weight = F.radians("angle") * F.col("d") / 4
    ends = bends_of(sided).select("mesh_id", F.explode(F.array("a", "b")).alias("vid"), weight.alias("w")).groupBy("mesh_id", "vid").agg(F.sum("w").alias("w"))
    area = sided.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"), (F.col("area") / 3).alias("area")).groupBy("mesh_id", "vid").agg(F.sum("area").alias("area"))
    area, ends = (rows.repartition(n, "mesh_id", "vid") for rows in (area, ends))
    return area.join(ends.hint("merge"), ["mesh_id", "vid"], "left").select("mesh_id", "vid", F.coalesce(F.try_divide("w", "area"), F.lit(0.0)).alias("curvature"), "area")


def curvature_rms(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Root of the area-weighted mean square of vertex curvature."""
    c = F.col("curvature")
    return vertex_curvature(faces, vertices).groupBy("mesh_id").agg(F.sqrt(F.try_divide(F.sum(F.col("area") * c * c), F.sum("area"))).alias("curvature_rms"))


def curvature_variation(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Mean, deviation and maximum over vertices of the deviation of curvature among a vertex and its neighbours."""
    own = stored_large(vertex_curvature(faces, vertices), "curvature")
    linked = edges(faces).select("mesh_id", F.explode(F.array(F.struct(F.col("a").alias("vid"), F.col("b").alias("near")), F.struct(F.col("b").alias("vid"), F.col("a").alias("near")))).alias("p")).select("mesh_id", "p.*")
    ring = linked.union(own.select("mesh_id", "vid", F.col("vid").alias("near")))
    spread = ring.join(own.select("mesh_id", F.col("vid").alias("near"), "curvature"), ["mesh_id", "near"]).groupBy("mesh_id", "vid").agg(F.stddev_pop("curvature").alias("d"))
    return spread.groupBy("mesh_id").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.max("d").alias("max"))


def aspect_ratio(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Longest over shortest side of each triangle: mean, deviation and maximum."""
    sides = [norm(sub(point(a), point(b))) for a, b in ((0, 1), (1, 2), (2, 0))]
    ratio = corners(faces, vertices).select("mesh_id", F.try_divide(F.greatest(*sides), F.least(*sides)).alias("r"))
    return ratio.groupBy("mesh_id").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.max("r").alias("max"))


def self_intersections(faces: DataFrame, vertices: DataFrame, cell_size: float) -> DataFrame:
    """Per mesh the faces that cross another one with which they share no vertex: an edge of one passes through the other.

    Faces meet in cells. Two that lie in several common cells are compared in the first of them alone, so pairs are neither
    written nor told apart, and only if their boxes meet. Meshes are dealt to tasks once; corners and cells are joined there.
    """
    n = faces.count() // CROSSED + 1
    celled = corners(*(rows.repartition(n, "mesh_id") for rows in (faces, vertices)))
    place = lambda v: F.floor(v / cell_size).cast("long")
    for c in "xyz":
        lo, hi = (f(*[F.col(f"{c}{n}") for n in range(3)]) for f in (F.least, F.greatest))
        celled = celled.withColumns({f"__lo{c}": lo, f"__hi{c}": hi}).withColumn(f"__{c}", F.explode(F.sequence(place(lo), place(hi))))
    cells = [f"__{c}" for c in "xyz"]
    other = celled.select("mesh_id", *cells, *[F.col(n).alias(f"o_{n}") for n in celled.columns if n not in ("mesh_id", *cells)])
    met = celled.join(other.hint("merge"), ["mesh_id", *cells]).where("fid < o_fid")
    for c in "xyz":
        first = F.col(f"__{c}") == place(F.greatest(f"__lo{c}", f"o___lo{c}"))
        met = met.where(first & (F.col(f"__lo{c}") <= F.col(f"o___hi{c}")) & (F.col(f"o___lo{c}") <= F.col(f"__hi{c}")))
    pairs = met.where(" and ".join(f"v{i} <> o_v{j}" for i in range(3) for j in range(3)))
    own, their = ([vec(*[f"{o}{c}{n}" for c in "xyz"]) for n in range(3)] for o in ("", "o_"))
    side = lambda u, v, w, x: dot(sub(x, u), cross(sub(v, u), sub(w, u)))

    def passes(p, q, a, b, c) -> Column:
        s = [side(p, q, a, b), side(p, q, b, c), side(p, q, c, a)]
        return (side(a, b, c, p) * side(a, b, c, q) < 0) & (((s[0] > 0) & (s[1] > 0) & (s[2] > 0)) | ((s[0] < 0) & (s[1] < 0) & (s[2] < 0)))

    crossing = F.lit(False)
    for edges_of, through in ((own, their), (their, own)):
        for p, q in ((0, 1), (1, 2), (2, 0)):
            crossing = crossing | passes(edges_of[p], edges_of[q], *through)
    # A column and not a filter, which would become part of the join and too long a loop for Java to compile.
    found = pairs.select("mesh_id", F.explode(F.when(crossing, F.array("fid", "o_fid"))).alias("fid"))
    return found.distinct().groupBy("mesh_id").agg(F.count("*").alias("n_crossing"))


def mesh_stats(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per mesh: points, cells, bounding box, area, volume."""
    box = vertices.groupBy("mesh_id").agg(F.count("*").alias("n_points"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    cells = faces.groupBy("mesh_id").agg(F.count("*").alias("n_cells"))
    return box.join(cells, "mesh_id").join(mesh_area(faces, vertices), "mesh_id").join(mesh_volume(faces, vertices), "mesh_id")


def mesh_centroid(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("mesh_id").agg(*[F.avg(c).alias(c) for c in "xyz"])


def union_bounds(vertices: DataFrame, margin: float = 0.0) -> DataFrame:
    """One box around all meshes, with a margin."""
    return vertices.agg(*[(F.min(c) - margin).alias(f"lo{c}") for c in "xyz"], *[(F.max(c) + margin).alias(f"hi{c}") for c in "xyz"])


def mesh_range(vertices: DataFrame, limit: float) -> DataFrame:
    """Per mesh its greatest extent; diverged if over the limit or not finite."""
    extents = [F.max(c) - F.min(c) for c in "xyz"]
    bad = F.max(F.greatest(*[(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).cast("int") for c in "xyz"]))
    return vertices.groupBy("mesh_id").agg(F.greatest(*extents).alias("extent"), bad.alias("bad")).select("mesh_id", "extent", F.when((F.col("bad") == 1) | (F.col("extent") > limit), "diverged").otherwise("ok").alias("status"))


def sample_surface(faces: DataFrame, vertices: DataFrame, n: int, tag: str = "42") -> DataFrame:
    """n points on each mesh, dense by area: hashed draws pick a face by cumulative area and a place in it."""
    # Sums of decimals don't depend on their order, so spans of neighbours meet exactly however faces are dealt.
    area = (norm(doubled_normal()) / 2).cast("decimal(38,18)")
    cornered = stored_large(corners(faces, vertices).withColumn("area", area).where("area > 0"), "areas")
    upto = group_total(cornered, ["mesh_id"], ["fid"], F.col("area"), "below")
    total = cornered.groupBy("mesh_id").agg(F.sum("area").cast("double").alias("total"))
    place = lambda c: c.cast("double") / F.col("total") * n
    # Draw d falls on the face whose span of the cumulated shares holds (d + u) / n: one draw a stratum, so spans give draws.
    spans = upto.join(total.hint("merge"), "mesh_id").withColumn("lo", place(F.col("below"))).withColumn("hi", place(F.col("below") + F.col("area")))
    draws = spans.select("*", F.explode(F.sequence(F.floor("lo").cast("long"), F.floor("hi").cast("long"))).alias("draw"))
    u = F.col("draw") + unit_hash("mesh_id", "draw", F.lit(f"{tag}-face"))
    hit = draws.where((u >= F.col("lo")) & (u < F.col("hi")) & (F.col("draw") < n))
    r, s = F.sqrt(unit_hash("mesh_id", "draw", F.lit(f"{tag}-r"))), unit_hash("mesh_id", "draw", F.lit(f"{tag}-s"))
    placed = [((1 - r) * F.col(f"{c}0") + r * (1 - s) * F.col(f"{c}1") + r * s * F.col(f"{c}2")).alias(c) for c in "xyz"]
    return hit.select("mesh_id", "draw", "fid", *placed)


def vertex_normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per vertex the unit mean of the unit normals of its faces."""
    summed = face_geometry(faces, vertices).select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid"), "nx", "ny", "nz").groupBy("mesh_id", "vid").agg(*[F.sum(f"n{c}").alias(f"s{c}") for c in "xyz"])
    return summed.select("mesh_id", "vid", *[n.alias(f"n{c}") for c, n in zip("xyz", normalise(vec("sx", "sy", "sz")))])


def surface_to_voxels(vertices: DataFrame, spacing: float) -> DataFrame:
    """The voxels under the vertices."""
    return vertices.select("mesh_id", *[F.rint(F.col(c) / spacing).cast("long").alias(i) for c, i in zip("xyz", "ijk")]).distinct()


def slice_integral(faces: DataFrame, vertices: DataFrame, field: str, mean: bool = True) -> DataFrame:
    """Integral of a vertex field over each mesh by its faces' means; over the total area if mean."""
    area = face_geometry(faces, vertices)
    for n in range(3):
        area = area.join(vertices.select("mesh_id", F.col("vid").alias(f"v{n}"), F.col(field).alias(f"f{n}")), ["mesh_id", f"v{n}"])
    total = F.sum(F.col("area") * (F.col("f0") + F.col("f1") + F.col("f2")) / 3)
    return area.groupBy("mesh_id").agg((F.try_divide(total, F.sum("area")) if mean else total).alias("integral"))


def face_centres(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    return corners(faces, vertices).select("mesh_id", "fid", *[((F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3).alias(c) for c in "xyz"])


def outer_faces(cells: DataFrame) -> DataFrame:
    """Triangles of tetrahedra (mesh_id, cid, v0 .. v3) that only one has."""
    sides = F.explode(F.array(*[F.array_sort(F.array(*[f"v{i}" for i in range(4) if i != out])) for out in range(4)]))
    return cells.select("mesh_id", sides.alias("s")).groupBy("mesh_id", "s").count().where("count = 1").select("mesh_id", *[F.col("s")[i].alias(f"v{i}") for i in range(3)])


def faces_of_vertices(faces: DataFrame, kept: DataFrame) -> DataFrame:
    """Faces all of whose vertices are among kept (mesh_id, vid)."""
    out = faces
    for n in range(3):
        out = out.join(kept.select("mesh_id", F.col("vid").alias(f"v{n}")).hint("merge"), ["mesh_id", f"v{n}"], "left_semi")
    return out


def compact(faces: DataFrame) -> DataFrame:
    """Faces with vertex ids 0, 1, 2 .. in order of the old ones, per mesh."""
    used = faces.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    ids = group_number(used, ["mesh_id"], ["vid"], "new")
    out = faces
    for n in range(3):
        out = out.join(ids.select("mesh_id", F.col("vid").alias(f"v{n}"), F.col("new").alias(f"n{n}")).hint("merge"), ["mesh_id", f"v{n}"])
    return out.select("mesh_id", "fid", *[F.col(f"n{n}").alias(f"v{n}") for n in range(3)])


def submesh_in_box(faces: DataFrame, vertices: DataFrame, box: tuple[float, ...]) -> DataFrame:
    """Faces with all vertices in the closed box (lo x, y, z, hi x, y, z), with compact ids."""
    inside = F.lit(True)
    for a, c in enumerate("xyz"):
        inside = inside & F.col(c).between(box[a], box[a + 3])
    return compact(faces_of_vertices(faces, vertices.where(inside)))


def clip_to_volume(faces: DataFrame, vertices: DataFrame, bounds: DataFrame, margin: float = 10.0) -> DataFrame:
    """Faces inside their mesh's bounds (mesh_id, lox .. hiz) shrunk by the margin."""
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & F.col(c).between(F.col(f"lo{c}") + margin, F.col(f"hi{c}") - margin)
    return faces_of_vertices(faces, vertices.join(bounds, "mesh_id").where(inside))


def face_label_filter(faces: DataFrame, label: str, value: int) -> DataFrame:
    """Faces without the label, compact."""
    return compact(faces.where(F.col(label) != value))


def append_meshes(faces: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One mesh (mesh_id 0) of all: ids moved on by the vertices and faces of the meshes before."""
    sizes = vertices.groupBy("mesh_id").agg((F.max("vid") + 1).alias("n")).join(faces.groupBy("mesh_id").agg((F.max("fid") + 1).alias("m")), "mesh_id")
    offsets = group_total(group_total(sizes, [], ["mesh_id"], F.col("n"), "dv"), [], ["mesh_id"], F.col("m"), "df").select("mesh_id", "dv", "df")
    moved_faces = faces.join(offsets, "mesh_id").select(F.lit(0).cast("long").alias("mesh_id"), (F.col("fid") + F.col("df")).alias("fid"), *[(F.col(f"v{n}") + F.col("dv")).alias(f"v{n}") for n in range(3)])
    moved = vertices.join(offsets, "mesh_id").select(F.lit(0).cast("long").alias("mesh_id"), (F.col("vid") + F.col("dv")).alias("vid"), "x", "y", "z")
    return moved_faces, moved


def smoothing_weights(faces: DataFrame, vertices: DataFrame, method: str) -> DataFrame:
    """(mesh_id, vid, near, w) of a smoothing method. laplacian: 1 to each neighbour.

    taubin: cot/2 of the angles across the edge in the mesh as given, and to the vertex itself minus their total.
    """
    if method == "laplacian":
        both = F.array(F.struct(F.col("a").alias("vid"), F.col("b").alias("near")), F.struct(F.col("b").alias("vid"), F.col("a").alias("near")))
        linked = edge_rows(faces).select("mesh_id", F.explode(both).alias("p")).select("mesh_id", "p.*").distinct()
        return linked.withColumn("w", F.lit(1.0))
    cornered = corners(faces, vertices)
    cots = None
    for o, p, q in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        u, v = sub(point(p), point(o)), sub(point(q), point(o))
        part = cornered.select("mesh_id", F.col(f"v{p}").alias("vid"), F.col(f"v{q}").alias("near"), F.try_divide(dot(u, v), norm(cross(u, v))).alias("w"))
        both = part.union(part.select("mesh_id", "near", "vid", "w"))
        cots = both if cots is None else cots.union(both)
    cots = cots.groupBy("mesh_id", "vid", "near").agg((F.sum(F.coalesce("w", F.lit(0.0))) / 2).alias("w"))
    own = cots.groupBy("mesh_id", "vid").agg((-F.sum("w")).alias("w"))
    return cots.union(own.select("mesh_id", "vid", F.col("vid").alias("near"), "w"))


def diagonals(vertices: DataFrame, by: list[str]) -> DataFrame:
    """Per group the diagonal of the box around its vertices, infinite if one isn't finite."""
    square = lambda c: (F.max(c) - F.min(c)) * (F.max(c) - F.min(c))
    bad = F.bool_or(F.isnan("x") | F.isnan("y") | F.isnan("z"))
    length = F.sqrt(square("x") + square("y") + square("z"))
    return vertices.groupBy(*by).agg(F.when(bad | F.isnan(length), float("inf")).otherwise(length).alias("diagonal"))


def smooth_sweep(faces: DataFrame, vertices: DataFrame, configs: list[dict], factor: float = 50.0) -> DataFrame:
    """Vertices of every mesh under every configuration (name, method, iterations, lam, mu): config, mesh_id, vid, x, y, z, status.

    laplacian: a share lam of the way to the mean of the neighbours. taubin: V += lam * L(V), then V -= -mu * L(V), where L
    is the mean (not the sum) over a vertex's edges of weight times neighbour.

    The configuration is a group key: all that still run take a step in the same job. A mesh whose diagonal passes factor
    times its first one, or isn't finite, has diverged under that configuration: it stops there, its status says so.

    Meshes are dealt to tasks, which take all their steps; large ones go by smooth_by_steps().
    """
    rows = config_rows(configs)
    few_faces, few, many = small_meshes.split_by_size(faces, vertices)

    def columns(vids, places, corners):
        found = small_meshes.swept(vids, places, corners, rows, factor)
        n, every = len(vids), np.concatenate([places[:0], *[p for p, _ in found]])
        names = {"config": pa.array(np.repeat([r[0] for r in rows], n), pa.string()), "vid": np.tile(vids, len(rows))}
        return names | {c: every[:, i] for i, c in enumerate("xyz")} | {"status": pa.array(np.repeat([status for _, status in found], n), pa.string())}

    vid = vertices.schema["vid"].dataType.simpleString()
    moved = small_meshes.together(few_faces, few, columns, f"config string, vid {vid}, x double, y double, z double, status string")
    moved = moved.select("config", "mesh_id", "vid", "x", "y", "z", "status")
    return moved if many is None else moved.unionByName(smooth_by_steps(*of_meshes(many, faces, vertices), configs, factor))


def config_rows(configs: list[dict]) -> list[tuple]:
    return [(str(c["name"]), c.get("method", "laplacian"), int(c.get("iterations", 3)), float(c.get("lam", 0.5)), float(c.get("mu", -0.53))) for c in configs]


def of_meshes(meshes: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The rows of tables that belong to the given meshes."""
    return [t.join(meshes, "mesh_id", "left_semi") for t in tables]


def smooth_by_steps(faces: DataFrame, vertices: DataFrame, configs: list[dict], factor: float = 50.0) -> DataFrame:
    """smooth_sweep() over written tables, a step for all meshes and configurations at a time."""
    spark, rows = faces.sparkSession, config_rows(configs)
    table = spark.createDataFrame(rows, "config string, method string, iterations int, lam double, mu double")
    steps = F.when(F.col("method") == "laplacian", F.col("iterations")).otherwise(2 * F.col("iterations"))
    weights = None
    for method in sorted({r[1] for r in rows}):
        one = smoothing_weights(faces, vertices, method).withColumn("method", F.lit(method))
        weights = one if weights is None else weights.unionByName(one)
    weights = stored_large(weights, "smoothing-edges")
    n = tasks_for(weights)
    weights = weights.repartition(n, "method", "mesh_id", "near")
    first = stored_large(diagonals(vertices, ["mesh_id"]).withColumnRenamed("diagonal", "first"), "diagonals")
    # Every mesh under every configuration is what a sweep is; the configurations are a short list.
    now = vertices.select("mesh_id", "vid", "x", "y", "z").crossJoin(F.broadcast(table.withColumn("steps", steps))).withColumn("status", F.lit("ok"))
    columns = ["config", "mesh_id", "vid", "x", "y", "z", "status"]
    done = now.where("steps <= 0").select(*columns)
    for step in range(max((r[2] * (1 if r[1] == "laplacian" else 2) for r in rows), default=0)):
        active = now.where((F.col("steps") > step) & (F.col("status") == "ok"))
        near = active.select("config", "method", "mesh_id", F.col("vid").alias("near"), "x", "y", "z").repartition(n, "method", "mesh_id", "near")
        means = weights.join(near.hint("merge"), ["method", "mesh_id", "near"]).repartition(n, "config", "mesh_id", "vid").groupBy("config", "mesh_id", "vid").agg(*[(F.sum(F.col("w") * F.col(c)) / F.count("*")).alias(f"l{c}") for c in "xyz"])
        plain = F.col("method") == "laplacian"
        rate = F.when(plain | F.lit(step % 2 == 0), F.col("lam")).otherwise(F.col("mu"))
        place = [F.coalesce(F.col(c) + rate * (F.col(f"l{c}") - F.when(plain, F.col(c)).otherwise(0.0)), F.col(c)).alias(c) for c in "xyz"]
        kept = ["config", "method", "iterations", "lam", "mu", "steps"]
        moved = stored_large(active.repartition(n, "config", "mesh_id", "vid").join(means.hint("merge"), ["config", "mesh_id", "vid"], "left").select("mesh_id", "vid", *place, *kept), "smoothed")
        gone = diagonals(moved, ["config", "mesh_id"]).join(first, "mesh_id").where(F.col("diagonal") > factor * F.col("first"))
        marked = moved.join(gone.select("config", "mesh_id", F.lit("diverged").alias("__gone")).hint("merge"), ["config", "mesh_id"], "left")
        now = marked.withColumn("status", F.coalesce("__gone", F.lit("ok"))).drop("__gone")
        done = done.unionByName(now.where((F.col("steps") <= step + 1) | (F.col("status") != "ok")).select(*columns))
    return done


def smooth(faces: DataFrame, vertices: DataFrame, method: str = "laplacian", iterations: int = 3, lam: float = 0.5, mu: float = -0.53) -> DataFrame:
    """Vertices (mesh_id, vid, x, y, z) after so many rounds of one method, wherever they end up: see smooth_sweep()."""
    config = {"name": "", "method": method, "iterations": iterations, "lam": lam, "mu": mu}
    return smooth_sweep(faces, vertices, [config], float("inf")).select("mesh_id", "vid", "x", "y", "z")


def boxes_along_walk(visited: DataFrame, factor: float = 2.0, radius_add: float = 0.0, radius_scale: float = 1.0) -> DataFrame:
    """Boxes (mesh_id, box_id, lox .. hiz) around visited points (mesh_id, line_rank, seq, x, y, z, radius), numbered in the order of
    the visits: longest line first, each from its start. A side is twice factor times the radius."""
    half = factor * (F.col("radius") + radius_add) * radius_scale
    ends = [(F.col(c) + sign * half).alias(f"{end}{c}") for end, sign in (("lo", -1), ("hi", 1)) for c in "xyz"]
    return group_number(visited, ["mesh_id"], ["line_rank", "seq"], "box_id").select("mesh_id", "box_id", *ends)


def submeshes(faces: DataFrame, vertices: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each box (mesh_id, box_id, lox .. hiz) the faces that lie in it whole (box_id, faces' columns) and their vertices."""
    inside = stored_large(points_in_boxes(vertices.select("mesh_id", "vid", "x", "y", "z"), boxes, key="mesh_id").select("mesh_id", "box_id", "vid", "x", "y", "z"), "in-boxes")
    corner = faces.select("*", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    whole = corner.join(inside.select("mesh_id", "box_id", "vid"), ["mesh_id", "vid"]).groupBy("mesh_id", "box_id", "fid", "v0", "v1", "v2").agg(F.count("*").alias("n"))
    kept = stored_large(whole.where("n = 3").drop("n"), "box-faces")
    used = kept.select("mesh_id", "box_id", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return kept, inside.join(used.hint("merge"), ["mesh_id", "box_id", "vid"])


def apply_submesh_model(faces: DataFrame, vertices: DataFrame, boxes: DataFrame, fn) -> DataFrame:
    """fn(vertices n x 3, edges m x 2, faces k x 3; numpy) -> new vertices, for the submesh of every box (mesh_id, box_id, lox .. hiz).

    A box is a group: no task gets more than a few boxes' faces. A result with another number of vertices is left out. Where
    boxes overlap the last one, by box_id, wins; vertices in none stay. Every box sees the mesh as it was given, so the
    result doesn't depend on which boxes run first.
    """
    import numpy as np
    import pandas as pd

    box_faces, box_vertices = submeshes(faces, vertices, boxes)

    def run(points: pd.DataFrame, tris: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("vid")
        ids = points["vid"].to_numpy()
        at = points[["x", "y", "z"]].to_numpy()
        local = np.searchsorted(ids, tris.sort_values("fid")[["v0", "v1", "v2"]].to_numpy())
        pairs = np.sort(np.concatenate([local[:, [0, 1]], local[:, [1, 2]], local[:, [0, 2]]]), axis=1)
        new = np.asarray(fn(at, np.unique(pairs, axis=0), local), float) if len(ids) else at
        if len(new) != len(ids):
            return points.iloc[:0]
        return points.assign(x=new[:, 0], y=new[:, 1], z=new[:, 2])

    by = ["mesh_id", "box_id"]
    columns = [*by, "vid", "x", "y", "z"]
    moved = box_vertices.select(*columns).groupBy(*by).cogroup(box_faces.groupBy(*by)).applyInPandas(run, box_vertices.select(*columns).schema)
    last = moved.groupBy("mesh_id", "vid").agg(F.max_by(F.struct("x", "y", "z"), "box_id").alias("new"))
    merged = vertices.join(last.hint("merge"), ["mesh_id", "vid"], "left")
    return merged.select("mesh_id", "vid", *[F.coalesce(f"new.{c}", c).alias(c) for c in "xyz"])
