"""Surfaces, planes, local pieces and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoframe.functions import columns as C
from geoframe.operators import geometry as G
from geoframe.operators import lines, mesh, metrics, scores, voxels
from geoframe.plans.queries_grids import CORNERS, MESH, TAUBIN, VOX, _mesh, _vox
from geoframe.plans.queries_lines import BOXES, LINE, SEGMENT, _boxes
from geoframe.plans.registry import query, rounded
from geoframe.plans.storage import MOST, ROWS
from geoframe.plans.views import ctes, view

SPOTS = ", pts as (select e.vec_id as point_id, s_suppkey as mesh_id, floor(abs(embedding[1]::double) * 97 % 14) + 0.25::double as x, floor(abs(embedding[2]::double) * 89 % 14) + 0.37::double as y, floor(abs(embedding[3]::double) * 83 % 6)::double as z from embeddings e join supplier on vec_id % 10 = s_suppkey % 10) "


def _spots(spark, d):
    at = lambda i, m, n: F.floor(F.abs(F.col("embedding")[i].cast("double")) * m % n)
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("point_id"), (F.col("vec_id") % 10).alias("r"), (at(0, 97, 14) + 0.25).alias("x"), (at(1, 89, 14) + 0.37).alias("y"), at(2, 83, 6).cast("double").alias("z"))
    meshes = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("mesh_id"), (F.col("s_suppkey") % 10).alias("r"))
    # Either file is one task; both are dealt by the number of pairs.
    tasks = min(rows.count() * meshes.count() // 10 // ROWS + 1, MOST)
    return rows.repartition(tasks).join(meshes.repartition(tasks), "r").drop("r")


def _crosses(a, b):
    return f"((y{a} > y) <> (y{b} > y) and coalesce(x < x{a} + (x{b} - x{a}) * ((y - y{a}) / nullif(y{b} - y{a}, 0)), false))"


COVER = f"(({_crosses(0, 1)})::int + ({_crosses(1, 2)})::int + ({_crosses(2, 0)})::int) % 2 = 1"


@query(CORNERS + SPOTS + f", hit as (select p.mesh_id, point_id, count_if(z0 - (a * (x - x0) + b * (y - y0)) / c > z) % 2 = 1 as inside from pts p join n0 t on p.mesh_id = t.mesh_id where {COVER} group by 1, 2) select p.mesh_id, p.point_id, coalesce(inside, false) as inside from pts p left join hit on hit.mesh_id = p.mesh_id and hit.point_id = p.point_id")
def p15_points_in_mesh(spark, d):
    return G.points_in_mesh(_spots(spark, d), *_mesh(spark, d), 4.0).select("mesh_id", "point_id", "inside")


@query()
def p17_clip_outside_caps(spark, d):
    faces, vertices = _mesh(spark, d)
    ends = vertices.where("vid = 8").select("mesh_id", "x", "y", "z", F.lit(2.0).alias("radius"), F.lit(-1.0).alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"))
    return G.clip_outside_caps(faces, vertices, ends.withColumn("x", F.col("x") + 3), 2.0)


@query()
def j13_nearest_on_surface(spark, d):
    return rounded(G.nearest_on_surface(_spots(spark, d), *_mesh(spark, d)), "distance")


@query(
    MESH
    + """, s as (select mesh_id, unnest([v0, v1, v2]) as right_id, case when fid % 5 = 0 then 2 when fid % 7 = 0 then 6 end as label from v_face),
 touched as (select mesh_id, right_id, min(label) as new from s where label is not null group by 1, 2),
 near as (select a.mesh_id, a.vid, arg_min(b.vid, ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z - 0.25) ** 2, b.vid)) as right_id from v_vertex a join v_vertex b on a.mesh_id = b.mesh_id group by 1, 2),
 asked as (select mesh_id, fid, unnest([v0, v1, v2]) as vid, unnest([0, 1, 2]) as n from v_face where fid % 3 = 0),
 chosen as (select mesh_id, fid, arg_min(new, n) as new from asked join near using (mesh_id, vid) join touched using (mesh_id, right_id) group by 1, 2)
 select mesh_id, fid, case when new = 2 then 9 when new = 6 then 10 when fid % 3 = 0 then 3 else 1 end as label from v_face left join chosen using (mesh_id, fid)"""
)
def j18_transfer_labels(spark, d):
    faces, vertices = _mesh(spark, d)
    target = faces.withColumn("label", F.when(F.col("fid") % 3 == 0, 3).otherwise(1))
    source = faces.withColumn("label", F.when(F.col("fid") % 5 == 0, 2).when(F.col("fid") % 7 == 0, 6).otherwise(1))
    moved = vertices.withColumn("z", F.col("z") + 0.25)
    return G.transfer_labels(target, vertices, source, moved).select("mesh_id", "fid", "label")


@query()
def j19_similar_vectors(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("point_id"), F.col("label").alias("case_id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    unit = C.normalise(C.vec("x", "y", "z"))
    return G.similar_vectors(rows.select("point_id", "case_id", *[u.alias(c) for c, u in zip("xyz", unit)]).where("x is not null"))


RAYS = """, box as (select mesh_id, min(x) as lox, max(x) as hix, min(y) as loy, max(y) as hiy from v_vertex group by 1),
 ci as (select *, unnest(range(ceil(lox / 1.5)::bigint, floor(hix / 1.5)::bigint + 1)) as i from box), ij as (select mesh_id, i, unnest(range(ceil(loy / 1.5)::bigint, floor(hiy / 1.5)::bigint + 1)) as j from ci),
 rays as (select *, i * 1.5::double as x, j * 1.5::double as y from ij) """


@query(
    CORNERS
    + RAYS
    + f""", hit as (select r.mesh_id, i, j, fid, z0, (a * (x - x0) + b * (y - y0)) / c as rise from rays r join n0 t on r.mesh_id = t.mesh_id where {COVER}),
 sheets as (select mesh_id, i, j, fid, z0 - rise as z from hit union all select mesh_id, i, j, fid + 10000, z0 + 3 - rise from hit),
 spans as (select *, row_number() over w as n, lead(z) over w as up from sheets window w as (partition by mesh_id, i, j order by z, fid)),
 s as (select mesh_id, i, j, ceil(z / 1.5)::bigint as a, floor(up / 1.5)::bigint as b from spans where n % 2 = 1 and up is not null) select mesh_id, i, j, unnest(range(a, b + 1)) as k from s where a <= b"""
)
def v17_rasterize_mesh(spark, d):
    # Each height field and the same three higher: sheets that a column enters and leaves.
    faces, vertices = _mesh(spark, d)
    lid = vertices.withColumns({"vid": F.col("vid") + 1000, "z": F.col("z") + 3})
    lids = faces.withColumns({"fid": F.col("fid") + 10000, **{f"v{n}": F.col(f"v{n}") + 1000 for n in range(3)}})
    return G.rasterize_mesh(faces.union(lids), vertices.union(lid.select(*vertices.columns)), 1.5, 4.0)


@query()
def m16_local_surface(spark, d):
    return rounded(G.local_surface(*_mesh(spark, d), (8.0, 8.0, 2.0), 5.0), "area")


@query()
def k17_local_centerline(spark, d):
    points = view(spark, d, "v_line")
    return G.local_centerline(points, _boxes(points))


#: Points whose boxes one task fills; a point is in some sixty samples.
SAMPLED = 10_000


def _local(spark, d):
    # Points and boxes of a case meet in a task, and their samples stay there.
    points = view(spark, d, "v_line")
    points = points.repartition(points.count() // SAMPLED + 1, "case_id")
    return G.unit_points(points, _boxes(points, 0.0, 8.0)).withColumn("sample_id", F.concat_ws("_", "case_id", "box_id"))


@query()
def k8_plane_trajectories(spark, d):
    return rounded(G.plane_trajectories(_local(spark, d), within=["case_id"]), "angle", "u", "v")


@query()
def k9_deproject_trajectories(spark, d):
    return rounded(G.deproject_trajectories(G.plane_trajectories(_local(spark, d), within=["case_id"])), "angle", "u", "v", "ux", "uy", "uz")


@query(LINE + BOXES + "select v.point_id, box_id, b.case_id, round((x - lox) / 12, 6) as x, round((z - loz) / 12, 6) as z from v_line v join boxes b on v.case_id = b.case_id and x between lox and hix and y between loy and hiy and z between loz and hiz")
def f12_project_plane(spark, d):
    points = view(spark, d, "v_line")
    unit = G.unit_points(points, _boxes(points)).select("point_id", "box_id", "case_id", *[F.col(f"u{c}").alias(c) for c in "xyz"])
    return rounded(G.project_plane(unit, "y"), "x", "z")


@query(LINE + ", e as (select case_id, point_id as a, lead(point_id) over (partition by case_id order by point_id) as b from v_line), n as (select case_id, point_id as node, row_number() over (partition by case_id order by point_id) - 1 as seq, min(point_id) over (partition by case_id) as start from v_line) select case_id, start, node, seq from n")
def k10_order_points_by_edges(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("case_id").orderBy("point_id")
    edges = view(spark, d, "v_line").select("case_id", F.col("point_id").alias("a"), F.lead("point_id").over(w).alias("b")).where("b is not null")
    turned = edges.select("case_id", F.when(F.col("a") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("a") % 2 == 0, F.col("b")).otherwise(F.col("a")).alias("b"))
    return lines.ordered_by_edges(turned)


@query()
def k15_cluster_points(spark, d):
    rows = view(spark, d, "v_point").select("point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return G.cluster_points(rows, 8).select("point_id", "cluster")


@query()
def v13_straighten(spark, d):
    points = view(spark, d, "v_line").withColumns({"x": F.col("x") % 12, "y": F.col("y") % 12, "z": F.col("z") % 4})
    return rounded(G.straighten(points, view(spark, d, "v_vox"), 1), "value")


@query(VOX + ", t as (select unnest(range(8)) as t), g as (select distinct case_id, a.t as a, b.t as b from v_vox, t a, t b) select g.case_id, g.a::int as a, g.b::int as b, round(avg(value), 6) as value from g join v_vox v on v.case_id = g.case_id and v.i in (g.a + 1, g.a + 2) and v.j = g.b and v.k = 1 group by 1, 2, 3")
def v22_oblique_slice(spark, d):
    return rounded(G.oblique_slice(view(spark, d, "v_vox"), (1.5, 0, 1), (1, 0, 0), (0, 1, 0), 8), "value")


@query(VOX + ", p as (select * from v_vox where k = 1), t as (select unnest(range(23)) as t), s as (select case_id, max(i) as ni, max(j) as nj from p group by 1), g as (select case_id, a.t as a, b.t as b, round(a.t * ni / 22.0::double, 9) as x, round(b.t * nj / 22.0::double, 9) as y from s, t a, t b), c as (select g.*, p.value, (case when p.i = floor(x) then 1 - (x - floor(x)) else x - floor(x) end) * (case when p.j = floor(y) then 1 - (y - floor(y)) else y - floor(y) end) as w from g join p on p.case_id = g.case_id and p.i between floor(x) and floor(x) + 1 and p.j between floor(y) and floor(y) + 1) select case_id, a::int as a, b::int as b, round(sum(w * value) / sum(w), 6) as value from c where w > 0 group by 1, 2, 3")
def v21_resize_planes(spark, d):
    return rounded(G.resize_planes(view(spark, d, "v_vox").where("k = 1").select("case_id", "i", "j", "value"), 23), "value")


@query(VOX + "select t.case_id, t.i, t.j, t.k, s.value from v_vox t join v_vox s on s.case_id = t.case_id and s.i = t.j and s.j = 11 - t.i and s.k = t.k")
def v10_rotate_volume(spark, d):
    return G.rotate_volume(view(spark, d, "v_vox"), (0, 0, 1), 90.0, (5.5, 5.5, 0.0))


@query()
def v12_outlet_boxes(spark, d):
    planes = voxels.boundary_planes(_vox(spark, d).where("gt = 1"))
    flat = planes.select("case_id", "axis", "side", F.when(F.col("axis") == "i", F.col("j")).otherwise(F.col("i")).alias("a"), F.when(F.col("axis") == "k", F.col("j")).otherwise(F.col("k")).alias("b"))
    return G.outlet_boxes(flat, 8)


@query("with l as (select distinct doc_id as case_id from labels), i as (select distinct doc_id as case_id from documents), s as (select distinct page_id as case_id from pages), dn as (select distinct item_id as case_id from benchmark) select c_custkey as case_id, case when dn.case_id is not null then 'skipped' when i.case_id is null or (l.case_id is null and s.case_id is null) then 'dropped' else 'kept' end as status, case when dn.case_id is null and i.case_id is not null then case when l.case_id is not null then 'volume' when s.case_id is not null then 'surface' end end as truth_from from customer left join l on l.case_id = c_custkey left join i on i.case_id = c_custkey left join s on s.case_id = c_custkey left join dn on dn.case_id = c_custkey")
def v18_whole_case_samples(spark, d):
    one = lambda t, c: spark.read.parquet(f"{d}/{t}.parquet").select(F.col(c).alias("case_id"))
    return G.whole_case_samples(view(spark, d, "v_case"), one("documents", "doc_id"), one("labels", "doc_id"), one("pages", "page_id"), one("benchmark", "item_id"))


def _volumes(spark, d):
    k = F.col("c_custkey")
    size = F.array(k % 7 + 3, k % 5 + 3, F.lit(9).cast("long"))
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("case_id"), size.alias("size"), F.array((k % 3 + 1) / 2.0, F.lit(1.0), F.lit(2.0)).alias("spacing"), F.array((k % 10).cast("double"), F.lit(1.0), F.lit(-2.0)).alias("origin"), F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)]).alias("direction"))


@query("select c_custkey as case_id, (c_custkey % 3 + 1) / 2.0::double as spacing_x, 1.0::double as spacing_y, 2.0::double as spacing_z, c_custkey % 7 + 3 as size_x, c_custkey % 5 + 3 as size_y, 9::bigint as size_z from customer")
def v19_header_survey(spark, d):
    return voxels.header_survey(_volumes(spark, d))


@query("select c_custkey as case_id, [round((c_custkey % 3 + 1) / 2.0::double * 0.1, 9), 0.1, 0.2] as spacing, [round(-(c_custkey % 10) * 0.1::double, 9) + 0.0, -0.1, -0.2] as origin from customer")
def f16_header_transform(spark, d):
    moved = G.header_transform(_volumes(spark, d), 0.1, ras=True)
    tidy = lambda c: F.transform(c, lambda v: F.round(v, 9) + F.lit(0.0)).alias(c)
    return moved.select("case_id", tidy("spacing"), tidy("origin"))


@query("select c_custkey as case_id, true as same_size, c_custkey % 3 = 1 as same_spacing, true as same_origin, true as same_direction, true as ras from customer")
def f18_compare_headers(spark, d):
    a = _volumes(spark, d)
    return G.compare_headers(a, a.withColumn("spacing", F.array(F.lit(1.0), F.lit(1.0), F.lit(2.0))))


@query("select o_orderkey as id, 'case_' || (o_orderkey % 10) as case_id, (1 - (o_orderkey % 5 + 0.5::double)) * 64 as pixel from orders")
def f13_f22_samples(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.concat_ws("_", F.lit("case"), F.col("o_orderkey") % 10, F.col("o_orderkey"), F.lit("3")).alias("name"), (F.col("o_orderkey") % 5).alias("y"))
    return rows.select("id", C.sample_to_case("name").alias("case_id"), C.pixel_flip("y", 64).alias("pixel"))


@query(
    ctes("v_case") + """, c as (select count(*) as n from v_case), u as (select unnest(range(n)) as id, n from c), y as (select id, 1 - id / greatest(n - 1, 1)::double * 2 as y from u),
 f as (select *, sqrt(greatest(0, 1 - y * y)) as flat, id * pi() * (3 - sqrt(5)) as turn from y) select id, round(cos(turn) * flat, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(sin(turn) * flat, 6) + 0.0 as z from f"""
)
def f20_fibonacci_sphere(spark, d):
    """As many directions as cases."""
    n = view(spark, d, "v_case").count()
    return rounded(G.fibonacci_sphere(spark, n), "x", "y", "z")


WRAPPED = ctes("v_line", "v_vox") + ", p as (select case_id, line_id, seq, radius, x % 12 as x, y % 12 as y, z % 4 as z from v_line), g as (select *, lead(x) over w as x2, lead(y) over w as y2, lead(z) over w as z2, lead(radius) over w as r2 from p window w as (partition by case_id, line_id order by seq)), s as (select case_id, line_id, seq, (radius + r2) / 2 as mr, (x + x2) / 2 as mx, (y + y2) / 2 as my, (z + z2) / 2 as mz from g where x2 is not null and sqrt((x2 - x) ** 2 + (y2 - y) ** 2 + (z2 - z) ** 2) >= 1e-10) "
IN_BOX = " and ".join(f"{i} >= m{c} - (1.1 * mr + 0.1) and {i} <= m{c} + (1.1 * mr + 0.1)" for i, c in zip("ijk", "xyz"))


@query(WRAPPED + f", d as (select s.case_id, line_id, seq, mr, count_if(gt > 0) as a, count_if(pred > 0) as b, count_if(gt > 0 and pred > 0) as ab from s join v_vox v on v.case_id = s.case_id and {IN_BOX} group by 1, 2, 3, 4) select case_id, floor(mr)::bigint as bin, count(*) as n, case when count(*) >= 5 then round(avg(case when a > 0 and b > 0 then 2.0::double * ab / (a + b) end), 6) end as mean from d group by 1, 2")
def e3_dice_in_segment_boxes(spark, d):
    points = view(spark, d, "v_line").withColumns({"x": F.col("x") % 12, "y": F.col("y") % 12, "z": F.col("z") % 4})
    per = G.segment_dice(points, view(spark, d, "v_vox"))
    return rounded(scores.bucket_means(per.withColumn("bin", F.floor("mean_radius")), ["case_id", "bin"], value="dice"), "mean")


@query(WRAPPED + ", d as (select s.case_id, line_id, seq, mr, count_if(gt > 0) as a, count_if(pred > 0) as b from s join v_vox v on v.case_id = s.case_id and (i - mx) ** 2 + (j - my) ** 2 + (k - mz) ** 2 <= (3.0 * mr + 0.1) ** 2 group by 1, 2, 3, 4), r as (select *, case when a > 0 then (b - a)::double / a end as e from d) select case_id, floor(mr)::bigint as bin, count(*) as n, case when count(*) >= 5 then round(avg(case when abs(e) < 0.35 then e end), 6) end as mean from r group by 1, 2")
def e4_volume_error_by_radius(spark, d):
    points = view(spark, d, "v_line").withColumns({"x": F.col("x") % 12, "y": F.col("y") % 12, "z": F.col("z") % 4})
    per = G.segment_volume_error(points, view(spark, d, "v_vox"))
    kept = per.withColumn("error_rel", F.when(F.abs("error_rel") < 0.35, F.col("error_rel")))
    return rounded(scores.bucket_means(kept.withColumn("bin", F.floor("mean_radius")), ["case_id", "bin"], value="error_rel"), "mean")


@query()
def e10_normal_error(spark, d):
    faces, vertices = _mesh(spark, d)
    moved = vertices.withColumn("z", F.col("z") * 0.5 + 0.25)
    return rounded(G.normal_error(faces, vertices, faces, moved), "mean", "std", "max", digits=4)


@query(VOX + "select case_id, round(2.0::double * count_if(gt > 0 and pred > 0) / (count_if(gt > 0) + count_if(pred > 0)), 6) as dice, round(count_if(gt > 0) / count(*), 6) as share from v_vox group by 1")
def e12_score_table(spark, d):
    rows = view(spark, d, "v_vox")
    share = rows.groupBy("case_id").agg((F.count_if(F.col("gt") > 0) / F.count("*")).alias("share"))
    return rounded(metrics.score_table(["case_id"], metrics.dice(rows), share), "dice", "share")


@query()
def e21_evaluate_case(spark, d):
    rows, points = view(spark, d, "v_vox"), view(spark, d, "v_line")
    near = metrics.surface_distances(points.where("point_id % 3 = 0"), points.where("point_id % 3 <> 0"))
    share = metrics.point_overlap(points, points.where("point_id % 4 <> 0").select("case_id", *[F.rint(c).cast("long").alias(i) for c, i in zip("xyz", "ijk")]))
    return rounded(G.evaluate_case(rows, near, share.withColumnRenamed("share", "overlap")), "dice", "distance", "overlap")


NORMAL = " + ".join(f"(({a}1 - {a}0) * ({b}2 - {b}0) - ({b}1 - {b}0) * ({a}2 - {a}0)) ** 2" for a, b in ("xy", "yz", "zx"))


@query(
    TAUBIN
    + f""", ed as (select mesh_id, vid, near from cs), lp as (select v.mesh_id, v.vid, {", ".join(f"any_value(v.{c}) + 0.5::double * (avg(u.{c}) - any_value(v.{c})) as {c}" for c in "xyz")} from ed join v_vertex v using (mesh_id, vid) join v_vertex u on u.mesh_id = ed.mesh_id and u.vid = near group by 1, 2),
 al as (select 'none' as config, * from p0 union all select 'laplacian_1', * from lp union all select 'taubin_1', * from p2),
 tri as (select a.config, f.mesh_id, {", ".join(f"{t}.{c} as {c}{n}" for n, t in enumerate(("a", "b", "c")) for c in "xyz")} from v_face f join al a on a.mesh_id = f.mesh_id and a.vid = v0
  join al b on b.mesh_id = f.mesh_id and b.vid = v1 and b.config = a.config join al c on c.mesh_id = f.mesh_id and c.vid = v2 and c.config = a.config) select config, mesh_id, round(sum(sqrt({NORMAL})) / 2, 4) as area, 'ok' as status from tri group by 1, 2"""
)
def n4_param_sweep(spark, d):
    configs = [{"name": "none", "method": "laplacian", "iterations": 0}, {"name": "laplacian_1", "method": "laplacian", "iterations": 1}, {"name": "taubin_1", "method": "taubin", "iterations": 1, "lam": 0.1, "mu": -0.1}]
    return rounded(G.param_sweep(*_mesh(spark, d), configs), "area", digits=4)


@query(
    TAUBIN
    + f""", tri as (select f.mesh_id, {", ".join(f"{t}.{c} as {c}{n}" for n, t in enumerate(("a", "b", "c")) for c in "xyz")} from v_face f join p2 a on a.mesh_id = f.mesh_id and a.vid = v0 join p2 b on b.mesh_id = f.mesh_id and b.vid = v1 join p2 c on c.mesh_id = f.mesh_id and c.vid = v2),
 ok as (select mesh_id, round(sum(sqrt({NORMAL})) / 2, 4) as area from tri group by 1)
 select 'calm' as config, mesh_id, area, 'ok' as status from ok union all select 'wild', mesh_id, null, 'diverged' from ok"""
)
def n4_sweep_diverges(spark, d):
    configs = [{"name": "calm", "method": "taubin", "iterations": 1, "lam": 0.1, "mu": -0.1}, {"name": "wild", "method": "laplacian", "iterations": 4, "lam": 90.0}]
    return rounded(G.param_sweep(*_mesh(spark, d), configs), "area", digits=4)


@query()
def n7_pca_shapes(spark, d):
    rows = view(spark, d, "v_vox").select("case_id", F.expr("(i * 12 + j) * 4 + k").alias("feature"), F.col("gt").alias("label"))
    return G.pca_shapes(rows, 2).select("case_id", *[F.round(F.abs(F.col("scores")[n]), 6).alias(f"score_{n}") for n in range(2)])
