"""Voxels, meshes and graph jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoframe.functions import columns as C
from geoframe.operators import geometry, graph, mesh, metrics, report, voxels
from geoframe.plans.registry import query, rounded
from geoframe.plans.storage import stored_large
from geoframe.plans.views import ctes, view

VOX = ctes("v_vox")
MESH = ctes("v_vertex", "v_face")
KEY = "case_id, i, j, k"


def _vox(spark, d, label="gt"):
    return view(spark, d, "v_vox").withColumn("label", F.col(label))


def _mesh(spark, d):
    return view(spark, d, "v_face"), view(spark, d, "v_vertex")


@query(VOX + "select case_id, min(value) as min, max(value) as max, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, median(value) as median, count_if(value <> 0)::bigint as n_nonzero, count(*) as n_total from v_vox group by 1")
def a5_volume_stats(spark, d):
    return rounded(voxels.volume_stats(_vox(spark, d)), "mean", "std")


@query(VOX + "select case_id, gt as label, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (partition by case_id), 6) as percent from v_vox group by 1, 2")
def a6_label_histogram(spark, d):
    return rounded(voxels.label_histogram(_vox(spark, d)), "percent")


KINDS = (
    VOX
    + """, c as (select case_id, value as v, count(*) as n from v_vox group by 1, 2), r as (select *, row_number() over (partition by case_id order by v) as r from c),
 s as (select case_id, count(*) as n_distinct, sum(case when r <= 5 then n end) / sum(n) as share5 from r group by 1), sd as (select case_id, stddev_pop(value) as std from v_vox group by 1),
 kinds as (select case_id, n_distinct, case when n_distinct <= 10 then 'mask' when n_distinct <= 20 and share5 > 0.95 then 'mask' when n_distinct > 50 then 'image' when n_distinct > 20 and std > 10 then 'image' else 'unknown' end as kind from s join sd using (case_id)) """
)


@query(KINDS + "select * from kinds")
def a7_mask_or_image(spark, d):
    return voxels.mask_or_image(_vox(spark, d))


@query(KINDS + "select 'truths' as folder, case_id, kind from kinds where kind = 'image'")
def a8_misplaced_files(spark, d):
    kinds = voxels.mask_or_image(_vox(spark, d)).select("case_id", "kind")
    return voxels.misplaced_files(kinds.withColumn("folder", F.lit("truths")).unionByName(kinds.withColumn("folder", F.lit("images")).where("kind = 'image'")).select("folder", "case_id", "kind"))


@query(VOX + ", l as (select case_id, list_sort(list(distinct gt + pred)) as labels from v_vox group by 1), v as (select case_id, count(*) as n from v_vox group by 1) select (select count(*) from v) as n_volumes, (select count(distinct n) from v) as n_sizes, (select count_if(len(labels) > 2)::bigint from l) as n_multi")
def a9_fingerprint_summary(spark, d):
    rows = view(spark, d, "v_vox").withColumn("label", F.col("gt") + F.col("pred"))
    headers = rows.groupBy("case_id").agg(F.count("*").alias("size")).withColumn("spacing", F.lit(1.0))
    return report.fingerprint_summary(headers, rows, view(spark, d, "v_line")).select("n_volumes", "n_sizes", "n_multi")


@query(ctes("v_line", "v_vox") + ", r as (select case_id, quantile_cont(radius, 0.05) as p05, quantile_cont(radius, 0.5) as p50, quantile_cont(radius, 0.95) as p95, min(radius) as m from v_line group by 1), v as (select case_id, case_id * 0.5::double + 0.5 as c from (select distinct case_id from v_vox)) select case_id, least(c, 0.75) as finest, greatest(c, 0.75) as coarsest, round(p05, 6) as p05, p50, round(p95, 6) as p95, round(m / greatest(c, 0.75), 6) as ratio, m / greatest(c, 0.75) < 1 as under_resolved from r join v using (case_id)")
def a12_resolution_report(spark, d):
    cases = view(spark, d, "v_vox").select("case_id").distinct()
    volumes = cases.withColumn("spacing", F.array(F.lit(0.75), F.col("case_id") * 0.5 + 0.5))
    return rounded(voxels.resolution_report(volumes, view(spark, d, "v_line")), "p05", "p95", "ratio")


@query("select round(avg(l_quantity), 6) as \"GT_MEAN\", round(avg(l_tax), 6) as \"RADIUS\" from lineitem")
def a13_sample_stats_report(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("string").alias("GT_MEAN"), F.col("l_tax").cast("string").alias("RADIUS"))
    return rounded(report.sample_stats_report(rows, ["GT_MEAN", "RADIUS"]), "GT_MEAN", "RADIUS")


GRID = ", b as (select distinct case_id, i - 1 as i0, j - 1 as j0, k - 1 as k0 from v_vox where gt = 1 and pred = 1) "


def _cubes(rows):
    chosen = rows.where("gt = 1 and pred = 1").select("case_id", *[(F.col(c) - 1).alias(f"{c}0") for c in "ijk"]).distinct()
    return chosen.withColumns({f"n{c}": F.lit(3).cast("long") for c in "ijk"})


@query(VOX + GRID + ", t as (select unnest(range(3)) as t) select case_id, i0 + a.t as i, j0 + e.t as j, k0 + c.t as k, count(*) as n from b, t a, t e, t c group by 1, 2, 3, 4")
def a18_voxel_updates(spark, d):
    return voxels.voxel_updates(_cubes(view(spark, d, "v_vox")))


@query(VOX + f"select {KEY}, round((gt + pred) / 2.0::double, 6) as mean, greatest(gt, pred) as any from v_vox")
def a19_ensemble_average(spark, d):
    rows = view(spark, d, "v_vox")
    methods = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("label")) for m, c in (("a", "gt"), ("b", "pred"))])
    both = rows.select("case_id", *"ijk", F.explode(methods).alias("p")).select("case_id", "p.method", *"ijk", "p.label")
    return voxels.ensemble_average(both, 2)


@query(VOX + "select case_id, " + ", ".join(f"{f}({c}) as {f}_{c}" for c in "ijk" for f in ("min", "max")) + " from v_vox where gt = 1 group by 1")
def a20_bbox_of_label(spark, d):
    return voxels.bbox_of_label(_vox(spark, d), F.col("gt") == 1)


@query(VOX + "select case_id, " + ", ".join(f"trunc(avg({c}))::int as c{c}" for c in "ijk") + " from v_vox where gt = 1 group by 1")
def a21_centre_of_mass(spark, d):
    return voxels.centre_of_mass(_vox(spark, d), F.col("gt") == 1)


@query(VOX + ", b as (select distinct case_id, (i // 4) * 4 + j // 6 as box_id, (i // 4) * 4 as i0, (j // 6) * 6 as j0 from v_vox where gt = 1) select v.case_id, box_id, i - i0 as bi, j - j0 as bj, k as bk, value from v_vox v join b on v.case_id = b.case_id and i >= i0 and i < i0 + 5 and j >= j0 and j < j0 + 5")
def v1_extract_boxes(spark, d):
    return voxels.extract_boxes(view(spark, d, "v_vox"), _tiles(view(spark, d, "v_vox")), 4).select("case_id", "box_id", "bi", "bj", "bk", "value")


def _tiles(rows):
    tiled = rows.where("gt = 1").select("case_id", F.expr("(i div 4) * 4 + j div 6").alias("box_id"), F.expr("(i div 4) * 4").alias("i0"), F.expr("(j div 6) * 6").alias("j0")).distinct()
    return tiled.withColumns({"k0": F.lit(0).cast("long"), "ni": F.lit(5).cast("long"), "nj": F.lit(5).cast("long"), "nk": F.lit(4).cast("long")})


@query(VOX + ", b as (select distinct case_id, (i // 4) * 4 + j // 6 as box_id, (i // 4) * 4 as i0, (j // 6) * 6 as j0 from v_vox where gt = 1), x as (select v.case_id, box_id, value, gt from v_vox v join b on v.case_id = b.case_id and i >= i0 and i < i0 + 5 and j >= j0 and j < j0 + 5) select case_id, box_id, round(avg(value), 6) as \"IM_MEAN\", round(stddev_pop(value), 5) as \"IM_STD\", round(avg(case when gt > 0.1 then value end), 6) as \"BLOOD_MEAN\", round(avg(gt), 6) as \"GT_MEAN\", count(*) as n_voxels from x group by 1, 2")
def v2_sample_intensity_stats(spark, d):
    rows = _vox(spark, d)
    stats = voxels.sample_intensity_stats(voxels.extract_boxes(rows, _tiles(rows), 4))
    return rounded(rounded(stats.select("case_id", "box_id", "IM_MEAN", "IM_STD", "BLOOD_MEAN", "GT_MEAN", "n_voxels"), "IM_MEAN", "BLOOD_MEAN", "GT_MEAN"), "IM_STD", digits=5)


@query(VOX + f"select {KEY}, case when value = max(value) over (partition by case_id) then 1 else 0 end as one, case value % 3 when 1 then 10 when 2 then 20 else 0 end::bigint as mapped, dense_rank() over (partition by case_id order by value) - 1 as dense from v_vox")
def v3_binarize_remap(spark, d):
    rows = view(spark, d, "v_vox")
    one = voxels.binarize(rows.withColumn("one", F.col("value")), "one")
    mapped = voxels.remap_labels(one.withColumn("mapped", F.col("value") % 3), {1: 10, 2: 20}, "mapped")
    return voxels.dense_labels(mapped.withColumn("dense", F.col("value")), "dense").select("case_id", *"ijk", "one", F.col("mapped").cast("long").alias("mapped"), F.col("dense").cast("long").alias("dense"))


@query(VOX + f"select {KEY}, case when value % 5 in (1, 2) then value % 5 when pred > 0 then 9 else value % 5 end as label from v_vox")
def v4_overlay_labels(spark, d):
    rows = view(spark, d, "v_vox")
    first = rows.withColumn("label", F.col("value") % 5)
    return voxels.overlay_labels(first, rows.where("pred > 0").withColumn("label", F.col("pred")), [1, 2], 9)


@query(VOX + f"select {KEY}, case when gt > 0 then value else 0 end as value from v_vox")
def v5_apply_mask(spark, d):
    rows = _vox(spark, d)
    return voxels.apply_mask(rows.drop("label"), rows).select("case_id", *"ijk", "value")


@query(VOX + f"select {KEY}, case when i < 2 or i >= 10 or j < 2 or j >= 10 or k < 1 or k >= 3 then 0 else gt end as label from v_vox".replace("k < 1 or k >= 3", "k < 2 or k >= 2"))
def v6_erase_boundary(spark, d):
    return voxels.erase_boundary(_vox(spark, d), {"i": 12, "j": 12, "k": 4}, 2).select("case_id", *"ijk", "label")


@query(VOX + ", b as (select case_id, min(i) as a, max(i) as z from v_vox where value > 90 group by 1) select case_id, i - greatest(a - 1, 0) as i, j - greatest((select min(j) from v_vox w where w.case_id = v.case_id and value > 90) - 1, 0) as j, value from v_vox v join b using (case_id) where i between a - 1 and z + 1 and j between (select min(j) - 1 from v_vox w where w.case_id = v.case_id and value > 90) and (select max(j) + 1 from v_vox w where w.case_id = v.case_id and value > 90) and k between (select min(k) - 1 from v_vox w where w.case_id = v.case_id and value > 90) and (select max(k) + 1 from v_vox w where w.case_id = v.case_id and value > 90)")
def v7_crop_to_label(spark, d):
    return voxels.crop_to_label(_vox(spark, d), F.col("value") > 90, 1).select("case_id", "i", "j", "value")


@query("with v as (select s_suppkey as case_id, 20 + s_suppkey % 7 as n from supplier), t as (select unnest(range(3)) as t), g as (select case_id, unnest([least(t * 10, n - 10), least(t * 10 + 5, n - 10)]) as c from v, t where t < ceil(n / 10)), d as (select distinct case_id, c from g) select a.case_id, a.c as i0, b.c as j0, e.c as k0 from d a join d b using (case_id) join d e using (case_id)")
def v8_tile_patches(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("case_id"), *[(20 + F.col("s_suppkey") % 7).alias(f"n{c}") for c in "ijk"])
    return voxels.tile_patches(rows, 10)


@query(VOX + ", s as (select case_id, max(i) + 1 as ni, max(j) + 1 as nj, max(k) + 1 as nk from v_vox group by 1), t as (select unnest(range(8)) as t), g as (select case_id, a.t as ti, b.t as tj, c.t as tk, least(round_even(a.t * 1.5, 0)::bigint, ni - 1) as i, least(round_even(b.t * 1.5, 0)::bigint, nj - 1) as j, least(round_even(c.t * 1.5, 0)::bigint, nk - 1) as k from s, t a, t b, t c where a.t < ceil(ni / 1.5) and b.t < ceil(nj / 1.5) and c.t < ceil(nk / 1.5)) select case_id, ti as i, tj as j, tk as k, value from g join v_vox using (case_id, i, j, k)")
def v9_resample_nearest(spark, d):
    return voxels.resample_nearest(view(spark, d, "v_vox"), 1.5)


@query(VOX + f", p as (select {KEY} from v_vox where gt = 1) select {', '.join('p.' + c.strip() for c in KEY.split(','))}, round(avg(q.value), 6) as value from p join v_vox q on p.case_id = q.case_id and q.i in (p.i, p.i + 1) and q.j = p.j and q.k = p.k group by 1, 2, 3, 4")
def v9_gather_linear(spark, d):
    rows = view(spark, d, "v_vox")
    places = rows.where("gt = 1").select("case_id", *"ijk", (F.col("i") + 0.5).alias("px"), F.col("j").cast("double").alias("py"), F.col("k").cast("double").alias("pz"))
    named = places.select("case_id", *[F.col(c).alias(f"q{c}") for c in "ijk"], "px", "py", "pz")
    got = voxels.gather_linear(named, rows, ["case_id", "qi", "qj", "qk"])
    return rounded(got.select("case_id", *[F.col(f"q{c}").alias(c) for c in "ijk"], "value"), "value")


@query(VOX + ", m as (select *, max(i) over w as mi, max(j) over w as mj, max(k) over w as mk from v_vox window w as (partition by case_id)) select case_id, i, j, k, 'i' as axis from m where i = (mi + 1) // 2 union all select case_id, i, j, k, 'j' from m where j = (mj + 1) // 2 union all select case_id, i, j, k, 'k' from m where k = (mk + 1) // 2")
def v11_centre_planes(spark, d):
    return voxels.centre_planes(view(spark, d, "v_vox")).select("case_id", *"ijk", "axis")


@query(VOX + ", m as (select *, max(i) over w as mi, max(j) over w as mj, max(k) over w as mk from v_vox window w as (partition by case_id)) " + " union all ".join(f"select case_id, i, j, k, '{c}' as axis, '{s}' as side from m where {c} {o}" for c in "ijk" for s, o in (("low", "< 1"), ("high", f"> m{c} - 1"))))
def v11_boundary_planes(spark, d):
    return voxels.boundary_planes(view(spark, d, "v_vox")).select("case_id", *"ijk", "axis", "side")


@query(VOX + f", p as (select case_id, quantile_cont(value, 0.2) as lo, quantile_cont(value, 0.99) as hi from v_vox group by 1) select {KEY}, round(2 * (greatest(lo, least(hi, value)) - lo) / (hi - lo) - 1, 6) as mr, round(greatest(20.0::double, least(60.0, value)) / 20, 6) as ct from v_vox join p using (case_id)")
def v15_rescale(spark, d):
    rows = view(spark, d, "v_vox").withColumn("ct", voxels.ct_rescale("value", 20.0, 60.0)).withColumn("mr", F.col("value").cast("double"))
    return rounded(voxels.mr_rescale(rows, "mr").select("case_id", *"ijk", "mr", "ct"), "mr", "ct")


@query(VOX + "select case_id, j as i, max(i) over (partition by case_id) - i as j, k, value from v_vox")
def v20_flip_permute(spark, d):
    return voxels.flip_permute(view(spark, d, "v_vox"), "i", ("j", "i", "k")).select("case_id", *"ijk", "value")


@query()
def v14_augment(spark, d):
    return voxels.augment(view(spark, d, "v_vox"), "42").select("case_id", *"ijk", "value")


PADDED = VOX + ", s as (select case_id, max(i) + 1 as ni, max(j) + 1 as nj, max(k) + 1 as nk from v_vox group by 1), t as (select unnest(range(20)) as t), g as (select case_id, a.t as i, b.t as j, c.t as k, (greatest(ni, 15) - ni) // 2 as di, (greatest(nk, 7) - nk) // 2 as dk, greatest(ni, 15) as wi, greatest(nj, 5) as wj, greatest(nk, 7) as wk from s, t a, t b, t c where a.t < greatest(ni, 15) and b.t < greatest(nj, 5) and c.t < greatest(nk, 7)), p as (select g.*, coalesce(value, -1) as value from g left join v_vox v on v.case_id = g.case_id and v.i = g.i - di and v.j = g.j and v.k = g.k - dk) "


@query(PADDED + "select case_id, i - (wi - 10) // 2 as i, j - (wj - 7) // 2 as j, k, value from p where i - (wi - 10) // 2 between 0 and 9 and j - (wj - 7) // 2 between 0 and 6")
def v14_pad_and_centre_crop(spark, d):
    wide = voxels.padded(view(spark, d, "v_vox"), {"i": 15, "j": 5, "k": 7}, -1)
    return voxels.centre_crop(wide, {"i": 10, "j": 7, "k": 9})


@query(VOX + ", s as (select *, max(i) over w as mi, max(j) over w as mj, avg(value) over w as m, stddev_pop(value) over w as sd from v_vox window w as (partition by case_id)) select case_id, case case_id % 4 when 0 then i when 1 then mj - j when 2 then mi - i else j end as i, case case_id % 4 when 0 then j when 1 then i when 2 then mj - j else mi - i end as j, k, round((value - m) / sd, 6) + 0.0 as value from s")
def v14_turn_and_normalise(spark, d):
    turned = voxels.quarter_turns(view(spark, d, "v_vox"), F.col("case_id"))
    return rounded(voxels.normalised(turned).select("case_id", *"ijk", "value"), "value")


@query()
def v14_crops_by_draws(spark, d):
    rows = _vox(spark, d)
    size = {"i": 5, "j": 4, "k": 3}
    both = [f(rows, size, "42").withColumn("crop", F.lit(n)) for n, f in (("any", voxels.random_crop), ("mask", voxels.mask_crop))]
    return both[0].union(both[1]).select("crop", "case_id", *"ijk", "value", "gt")


NEIGHBOURS = VOX + ", f as (select distinct case_id, i, j, k from v_vox where gt = 1), o(a, b, c) as (values (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) "


@query(NEIGHBOURS + "select f.case_id, f.i, f.j, f.k, f.i + a as ni, f.j + b as nj, f.k + c as nk from f, o where not exists (select 1 from f g where g.case_id = f.case_id and g.i = f.i + a and g.j = f.j + b and g.k = f.k + c)")
def v16_exposed_faces(spark, d):
    return voxels.exposed_faces(_vox(spark, d).where("gt = 1"))


VOXEL_ID = "((case_id * 100 + i) * 100 + j) * 100 + k"
EDGES = NEIGHBOURS + f", n as (select *, {VOXEL_ID} as id from f), e as (select a.case_id, a.id as src, b.id as dst from n a join n b on a.case_id = b.case_id and b.id > a.id and abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1) "


def _edges(spark, d):
    rows = _vox(spark, d).where("gt = 1").select("case_id", F.expr(VOXEL_ID).alias("id"), *"ijk")
    return rows, voxels.neighbour_edges(rows)


@query(EDGES + "select * from e")
def j16_neighbour_voxels(spark, d):
    return _edges(spark, d)[1]


COMPONENTS = EDGES.replace("with ", "with recursive ", 1) + ", both_ways as (select src as s, dst as t from e union all select dst, src from e), reach(node, component) as (select id, id from n union select t, component from reach join both_ways on s = node where t > component), label as (select node, min(component) as component from reach group by 1) "


def _labels(spark, d):
    rows, edges = _edges(spark, d)
    loops = rows.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    return rows, graph.connected_components(edges.select("src", "dst").union(loops))


@query(COMPONENTS + "select node, component from label")
def n1_connected_components(spark, d):
    return _labels(spark, d)[1]


@query(COMPONENTS + ", seed as (select case_id, arg_min(id, (abs(i - 6) + abs(j - 6) + abs(k - 2), id)) as id from n group by 1), chosen as (select seed.case_id, component from seed join label on node = id) select n.case_id, n.id from n join label on node = n.id join chosen on chosen.case_id = n.case_id and chosen.component = label.component")
def n2_component_of_seed(spark, d):
    rows, labels = _labels(spark, d)
    seeds = rows.groupBy("case_id").agg(F.min_by("id", F.struct(F.abs(F.col("i") - 6) + F.abs(F.col("j") - 6) + F.abs(F.col("k") - 2), "id")).alias("id"))
    return graph.component_of_seed(rows.select("case_id", "id"), labels, seeds)


@query(COMPONENTS + ", s as (select case_id, component, count(*) as n from n join label on node = id group by 1, 2), top as (select * from (select *, row_number() over (partition by case_id order by n desc, component) as r from s) where r <= 2) select n.case_id, n.id, label.component from n join label on node = n.id join top on top.component = label.component")
def t5_largest_components(spark, d):
    rows, labels = _labels(spark, d)
    return graph.largest_components(rows.select("case_id", "id"), labels, 2)


PARTS = ", s as (select case_id, component, count(*) as n from n join label on node = id group by 1, 2), top as (select case_id, arg_min(component, (-n, component)) as component from s group by 1), one as (select n.* from n join label on node = n.id join top on top.component = label.component) "


@query(
    COMPONENTS.replace("gt = 1", "value >= 30")
    + PARTS
    + "select v.case_id, round(2.0::double * count_if(gt > 0 and one.id is not null) / (count_if(gt > 0) + count(one.id)), 6) as dice, count(one.id) as n_pred from v_vox v left join one on one.case_id = v.case_id and one.i = v.i and one.j = v.j and one.k = v.k group by 1"
)
def e21_cleaned_dice(spark, d):
    cleaned = stored_large(geometry.cleaned_prediction(view(spark, d, "v_vox"), "value", 30), "cleaned")
    sizes = cleaned.groupBy("case_id").agg(F.sum("pred").alias("n_pred"))
    return rounded(metrics.dice(cleaned).join(sizes, "case_id"), "dice")


@query(VOX + "select case_id, round(2.0::double * count_if(gt > 0 and pred > 0) / (count_if(gt > 0) + count_if(pred > 0)), 6) as dice from v_vox group by 1")
def e1_dice(spark, d):
    rows = view(spark, d, "v_vox")
    one = lambda c: rows.where(F.col(c) > 0).select("case_id", *"ijk", F.col(c).alias("label"))
    return rounded(metrics.dice(metrics.paired(one("pred"), one("gt"))), "dice")


@query(
    ctes("v_line", "v_vox")
    + """, p as (select case_id, point_id, x % 12 as x, y % 12 as y, z % 4 as z, radius from v_line),
 nn as (select case_id, gt, pred, arg_min(radius, ((i - x) ** 2 + (j - y) ** 2 + (k - z) ** 2, point_id)) as radius from v_vox join p using (case_id) where gt > 0 or pred > 0 group by case_id, i, j, k, gt, pred)
 select case_id, (radius >= 2)::int as bin, round(2.0::double * count_if(gt > 0 and pred > 0) / (count_if(gt > 0) + count_if(pred > 0)), 6) as dice from nn group by 1, 2"""
)
def e2_dice_by_radius(spark, d):
    points = view(spark, d, "v_line").withColumns({"x": F.col("x") % 12, "y": F.col("y") % 12, "z": F.col("z") % 4})
    return rounded(metrics.dice_by_radius(view(spark, d, "v_vox"), points, [1.0, 2.0, 3.1]), "dice")


@query(VOX + "select case_id, round(avg(gt), 6) as mean from v_vox group by 1 having avg(gt) > 0.3")
def p9_mean_threshold(spark, d):
    return rounded(voxels.mean_threshold_filter(_vox(spark, d), "label", 0.3), "mean")


@query(VOX + f"select {KEY}, value from v_vox where value between 20 and 40")
def p11_threshold_cells(spark, d):
    return view(spark, d, "v_vox").where(F.col("value").between(20, 40)).select("case_id", *"ijk", "value")


CORNERS = MESH + ", t as (select f.*, a.x as x0, a.y as y0, a.z as z0, b.x as x1, b.y as y1, b.z as z1, c.x as x2, c.y as y2, c.z as z2 from v_face f join v_vertex a on a.mesh_id = f.mesh_id and a.vid = v0 join v_vertex b on b.mesh_id = f.mesh_id and b.vid = v1 join v_vertex c on c.mesh_id = f.mesh_id and c.vid = v2), n0 as (select *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) as a, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) as b, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) as c from t), nn as (select *, sqrt(a * a + b * b + c * c) as n from n0) "


@query(CORNERS + "select mesh_id, fid, round(a / n, 6) + 0.0 as nx, round(b / n, 6) + 0.0 as ny, round(c / n, 6) + 0.0 as nz, round(n / 2, 6) as area from nn")
def m1_face_geometry(spark, d):
    return rounded(mesh.face_geometry(*_mesh(spark, d)).select("mesh_id", "fid", "nx", "ny", "nz", "area"), "nx", "ny", "nz", "area")


@query(CORNERS + "select mesh_id, round(sum(n / 2), 5) as area from nn group by 1")
def m2_mesh_area(spark, d):
    return rounded(mesh.mesh_area(*_mesh(spark, d)), "area", digits=5)


@query(CORNERS + "select mesh_id, round(abs(sum((x0 * (y1 * z2 - z1 * y2) + y0 * (z1 * x2 - x1 * z2) + z0 * (x1 * y2 - y1 * x2)) / 6)), 4) as volume from t group by 1")
def m3_mesh_volume(spark, d):
    return rounded(mesh.mesh_volume(*_mesh(spark, d)), "volume", digits=4)


EDGE = MESH + ", ed as (select mesh_id, fid, least(v0, v1) as a, greatest(v0, v1) as b from v_face union all select mesh_id, fid, least(v1, v2), greatest(v1, v2) from v_face union all select mesh_id, fid, least(v2, v0), greatest(v2, v0) from v_face) "


@query(EDGE + "select mesh_id, a, b, count(*) as degree from ed group by 1, 2, 3")
def m4_edges(spark, d):
    return mesh.edges(_mesh(spark, d)[0])


BEND = CORNERS + ", ed as (select mesh_id, fid, least(v0, v1) as p, greatest(v0, v1) as q from v_face union all select mesh_id, fid, least(v1, v2), greatest(v1, v2) from v_face union all select mesh_id, fid, least(v2, v0), greatest(v2, v0) from v_face), sides as (select ed.*, a / n as nx, b / n as ny, c / n as nz from ed join nn on nn.mesh_id = ed.mesh_id and nn.fid = ed.fid where n > 0), bend as (select s.mesh_id, s.p, s.q, degrees(acos(greatest(-1, least(1, s.nx * o.nx + s.ny * o.ny + s.nz * o.nz)))) as angle from sides s join sides o on s.mesh_id = o.mesh_id and s.p = o.p and s.q = o.q and s.fid < o.fid) "


@query(BEND + "select mesh_id, round(quantile_cont(angle, 0.95), 4) as p95 from bend group by 1")
def m6_dihedral_p95(spark, d):
    return rounded(mesh.dihedral_p95(*_mesh(spark, d)), "p95", digits=4)


LOOPS = EDGE.replace("with ", "with recursive ", 1) + ", bd as (select mesh_id, a, b from ed group by 1, 2, 3 having count(*) = 1), lk as (select mesh_id, a, b from bd union all select mesh_id, b, a from bd), reach(mesh_id, vid, loop) as (select distinct mesh_id, a, a from lk union select r.mesh_id, lk.b, r.loop from reach r join lk on lk.mesh_id = r.mesh_id and lk.a = r.vid where lk.b > r.loop), label as (select mesh_id, vid, min(loop) as loop from reach group by 1, 2), pl as (select label.*, x, y, z from label join v_vertex using (mesh_id, vid)), ce as (select mesh_id, loop, avg(x) as cx, avg(y) as cy, avg(z) as cz, count(*) as n_points from pl group by 1, 2), sd as (select p.mesh_id, p.loop, p.x - cx as ux, p.y - cy as uy, p.z - cz as uz, q.x - cx as vx, q.y - cy as vy, q.z - cz as vz from bd join pl p on p.mesh_id = bd.mesh_id and p.vid = bd.a join pl q on q.mesh_id = bd.mesh_id and q.vid = bd.b join ce on ce.mesh_id = p.mesh_id and ce.loop = p.loop), ar as (select mesh_id, loop, sum(sqrt((uy * vz - uz * vy) ** 2 + (uz * vx - ux * vz) ** 2 + (ux * vy - uy * vx) ** 2) / 2) as area from sd group by 1, 2) "


@query(LOOPS + "select mesh_id, loop, n_points, round(cx, 6) as x, round(cy, 6) as y, round(cz, 6) as z, round(area, 6) as area from ce join ar using (mesh_id, loop)")
def m5_cap_loops(spark, d):
    return rounded(mesh.cap_loops(*_mesh(spark, d)), "x", "y", "z", "area")


CURVATURE = BEND + ", w as (select d.mesh_id, p, q, radians(angle) * sqrt((g.x - h.x) ** 2 + (g.y - h.y) ** 2 + (g.z - h.z) ** 2) / 4 as w from bend d join v_vertex g on g.mesh_id = d.mesh_id and g.vid = p join v_vertex h on h.mesh_id = d.mesh_id and h.vid = q), en as (select mesh_id, unnest([p, q]) as vid, w from w), wv as (select mesh_id, vid, sum(w) as w from en group by 1, 2), ar as (select mesh_id, unnest([v0, v1, v2]) as vid, n / 6 as area from nn), av as (select mesh_id, vid, sum(area) as area from ar group by 1, 2), cv as (select av.mesh_id, av.vid, coalesce(w / area, 0) as cu, area from av left join wv using (mesh_id, vid)) "


@query(CURVATURE + "select mesh_id, round(sqrt(sum(area * cu * cu) / sum(area)), 6) as curvature_rms from cv group by 1")
def m7_curvature_rms(spark, d):
    return rounded(mesh.curvature_rms(*_mesh(spark, d)), "curvature_rms")


@query(CURVATURE + ", ring as (select mesh_id, p as vid, q as near from ed union select mesh_id, q, p from ed union select mesh_id, vid, vid from cv), sp as (select ring.mesh_id, ring.vid, stddev_pop(cu) as d from ring join cv on cv.mesh_id = ring.mesh_id and cv.vid = near group by 1, 2) select mesh_id, round(avg(d), 6) as mean, round(stddev_pop(d), 6) as std, round(max(d), 6) as max from sp group by 1")
def m8_curvature_variation(spark, d):
    return rounded(mesh.curvature_variation(*_mesh(spark, d)), "mean", "std", "max")


@query(CORNERS + ", s as (select mesh_id, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2 + (z1 - z0) ** 2) as a, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2 + (z2 - z1) ** 2) as b, sqrt((x0 - x2) ** 2 + (y0 - y2) ** 2 + (z0 - z2) ** 2) as c from t) select mesh_id, round(avg(greatest(a, b, c) / least(a, b, c)), 6) as mean, round(stddev_pop(greatest(a, b, c) / least(a, b, c)), 6) as std, round(max(greatest(a, b, c) / least(a, b, c)), 6) as max from s group by 1")
def m9_aspect_ratio(spark, d):
    return rounded(mesh.aspect_ratio(*_mesh(spark, d)), "mean", "std", "max")


@query()
def m10_self_intersections(spark, d):
    faces, vertices = _mesh(spark, d)
    # Each mesh and the same moved a little, so that they cross.
    moved = vertices.withColumns({"vid": F.col("vid") + 1000, "x": F.col("x") + 0.3, "z": F.col("z") * -1 + 4})
    shifted = faces.withColumns({"fid": F.col("fid") + 10000, **{f"v{n}": F.col(f"v{n}") + 1000 for n in range(3)}})
    return mesh.self_intersections(faces.union(shifted), vertices.union(moved.select(*vertices.columns)), 2.0)


@query(MESH + "select mesh_id, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) as extent, case when greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) > 14 then 'diverged' else 'ok' end as status from v_vertex group by 1")
def m11_mesh_range(spark, d):
    return mesh.mesh_range(view(spark, d, "v_vertex"), 14.0)


@query()
def m12_sample_surface(spark, d):
    return rounded(mesh.sample_surface(*_mesh(spark, d), 100), "x", "y", "z")


@query(CORNERS + ", ex as (select mesh_id, unnest([v0, v1, v2]) as vid, a / n as nx, b / n as ny, c / n as nz from nn), s as (select mesh_id, vid, sum(nx) as x, sum(ny) as y, sum(nz) as z from ex group by 1, 2) select mesh_id, vid, round(x / sqrt(x * x + y * y + z * z), 6) + 0.0 as nx, round(y / sqrt(x * x + y * y + z * z), 6) + 0.0 as ny, round(z / sqrt(x * x + y * y + z * z), 6) + 0.0 as nz from s")
def m13_vertex_normals(spark, d):
    return rounded(mesh.vertex_normals(*_mesh(spark, d)), "nx", "ny", "nz")


@query(MESH + "select distinct mesh_id, round_even(x / 2, 0)::bigint as i, round_even(y / 2, 0)::bigint as j, round_even(z / 2, 0)::bigint as k from v_vertex")
def m14_surface_to_voxels(spark, d):
    return mesh.surface_to_voxels(view(spark, d, "v_vertex"), 2.0)


@query(CORNERS + "select mesh_id, round(sum(n / 2 * (z0 + z1 + z2) / 3) / sum(n / 2), 6) as integral from nn group by 1")
def m15_slice_integral(spark, d):
    return rounded(mesh.slice_integral(*_mesh(spark, d), "z"), "integral")


@query(CORNERS + "select mesh_id, fid, round((x0 + x1 + x2) / 3, 6) as x, round((y0 + y1 + y2) / 3, 6) as y, round((z0 + z1 + z2) / 3, 6) as z from t")
def m17_face_centres(spark, d):
    return rounded(mesh.face_centres(*_mesh(spark, d)), "x", "y", "z")


@query(MESH + ", c as (select mesh_id, v0, v1, v2, v2 + 16 as v3 from v_face), s as (select mesh_id, unnest([list_sort([v1, v2, v3]), list_sort([v0, v2, v3]), list_sort([v0, v1, v3]), list_sort([v0, v1, v2])]) as s from c) select mesh_id, s[1] as v0, s[2] as v1, s[3] as v2 from s group by mesh_id, s having count(*) = 1")
def m18_outer_faces(spark, d):
    return mesh.outer_faces(view(spark, d, "v_face").withColumn("v3", F.col("v2") + 16))


INSIDE = MESH + ", k as (select mesh_id, vid from v_vertex where x between 2 and 9 and y between 3 and 12 and z between 0 and 3), kept as (select f.* from v_face f where (mesh_id, v0) in (select (mesh_id, vid) from k) and (mesh_id, v1) in (select (mesh_id, vid) from k) and (mesh_id, v2) in (select (mesh_id, vid) from k)) "


@query(INSIDE + ", u as (select distinct mesh_id, unnest([v0, v1, v2]) as vid from kept), r as (select *, row_number() over (partition by mesh_id order by vid) - 1 as n from u) select kept.mesh_id, fid, a.n as v0, b.n as v1, c.n as v2 from kept join r a on a.mesh_id = kept.mesh_id and a.vid = v0 join r b on b.mesh_id = kept.mesh_id and b.vid = v1 join r c on c.mesh_id = kept.mesh_id and c.vid = v2")
def p8_submesh_in_box(spark, d):
    return mesh.submesh_in_box(*_mesh(spark, d), (2.0, 3.0, 0.0, 9.0, 12.0, 3.0))


@query(MESH + ", k as (select mesh_id, vid from v_vertex where x between 2 and 9 and y between 3 and 12) select f.mesh_id, fid from v_face f where (mesh_id, v0) in (select (mesh_id, vid) from k) and (mesh_id, v1) in (select (mesh_id, vid) from k) and (mesh_id, v2) in (select (mesh_id, vid) from k)")
def p12_clip_to_volume(spark, d):
    faces, vertices = _mesh(spark, d)
    limits = {"lox": 1.0, "hix": 10.0, "loy": 2.0, "hiy": 13.0, "loz": -50.0, "hiz": 50.0}
    bounds = vertices.select("mesh_id").distinct().withColumns({k: F.lit(v) for k, v in limits.items()})
    return mesh.clip_to_volume(faces, vertices, bounds, 1.0).select("mesh_id", "fid")


@query(MESH + ", kept as (select * from v_face where fid % 3 <> 1), u as (select distinct mesh_id, unnest([v0, v1, v2]) as vid from kept), r as (select *, row_number() over (partition by mesh_id order by vid) - 1 as n from u) select kept.mesh_id, fid, a.n as v0 from kept join r a on a.mesh_id = kept.mesh_id and a.vid = v0")
def p10_face_label_filter(spark, d):
    return mesh.face_label_filter(view(spark, d, "v_face").withColumn("label", F.col("fid") % 3), "label", 1).select("mesh_id", "fid", "v0")


@query(MESH + "select mesh_id, count(*) as n_points, " + ", ".join(f"{f}({c}) as {f}_{c}" for c in "xyz" for f in ("min", "max")) + ", (select count(*) from v_face f where f.mesh_id = v.mesh_id) as n_cells from v_vertex v group by 1")
def a11_mesh_stats(spark, d):
    return mesh.mesh_stats(*_mesh(spark, d)).drop("area", "volume")


@query(MESH + "select mesh_id, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z from v_vertex group by 1")
def a22_mesh_centroid(spark, d):
    return rounded(mesh.mesh_centroid(view(spark, d, "v_vertex")), "x", "y", "z")


@query(MESH + "select " + ", ".join(f"min({c}) - 2 as lo{c}, max({c}) + 2 as hi{c}" for c in "xyz") + " from v_vertex")
def a26_union_bounds(spark, d):
    return mesh.union_bounds(view(spark, d, "v_vertex"), 2.0)


@query(MESH + ", r as (select mesh_id, row_number() over (order by mesh_id) - 1 as r from (select distinct mesh_id from v_face)) select 0::bigint as mesh_id, fid + r * 450 as fid, v0 + r * 256 as v0, v1 + r * 256 as v1, v2 + r * 256 as v2 from v_face join r using (mesh_id)")
def u6_append_meshes(spark, d):
    return mesh.append_meshes(*_mesh(spark, d))[0]


@query(CORNERS + ", m as (select mesh_id, sum(n / 2) as area from nn group by 1) select a.mesh_id, round(b.area - a.area, 4) as area_error, round((b.area - a.area) / a.area, 6) as area_rel from m a join m b on b.mesh_id = a.mesh_id % 5 + 1")
def e11_volume_area_error(spark, d):
    area = mesh.mesh_area(*_mesh(spark, d))
    other = area.select("mesh_id").withColumn("other", F.col("mesh_id") % 5 + 1).join(area.select(F.col("mesh_id").alias("other"), "area"), "other")
    return rounded(rounded(metrics.volume_area_error(other.select("mesh_id", "area"), area, "mesh_id", ["area"]).select("mesh_id", "area_error", "area_rel"), "area_error", digits=4), "area_rel")


LAPLACE = EDGE + ", lk as (select distinct mesh_id, a as vid, b as near from ed union select distinct mesh_id, b, a from ed), m as (select lk.mesh_id, lk.vid, avg(x) as lx, avg(z) as lz from lk join v_vertex v on v.mesh_id = lk.mesh_id and v.vid = near group by 1, 2) select v.mesh_id, vid, round(x + 0.5::double * (lx - x), 6) as x, round(z + 0.5::double * (lz - z), 6) as z from v_vertex v join m using (mesh_id, vid)"


@query(LAPLACE)
def n3_smooth_laplacian(spark, d):
    return rounded(mesh.smooth(*_mesh(spark, d), "laplacian", 1).select("mesh_id", "vid", "x", "z"), "x", "z")


def _cotangent(o, p, q):
    """Weights of the edge between corners p and q of each face, by the angle at corner o."""
    return f"select mesh_id, v{p} as vid, v{q} as near, (" + " + ".join(f"({c}{p} - {c}{o}) * ({c}{q} - {c}{o})" for c in "xyz") + ") / n as w from nn"


def _taubin_step(n, rate):
    moved = ", ".join(f"p.{c} + {rate}::double * l{c} as {c}" for c in "xyz")
    means = ", ".join(f"sum(w * {c}) / count(*) as l{c}" for c in "xyz")
    return f", m{n} as (select ws.mesh_id, ws.vid, {means} from ws join p{n} q on q.mesh_id = ws.mesh_id and q.vid = near group by 1, 2), p{n + 1} as materialized (select p.mesh_id, p.vid, {moved} from p{n} p join m{n} m on m.mesh_id = p.mesh_id and m.vid = p.vid)"


TAUBIN = (
    CORNERS
    + f""", ct as ({_cotangent(0, 1, 2)} union all {_cotangent(1, 2, 0)} union all {_cotangent(2, 0, 1)}), bo as (select * from ct union all select mesh_id, near, vid, w from ct),
 cs as (select mesh_id, vid, near, sum(w) / 2 as w from bo group by 1, 2, 3), ws as materialized (select * from cs union all select mesh_id, vid, vid, -sum(w) from cs group by mesh_id, vid),
 p0 as (select mesh_id, vid, x, y, z from v_vertex)"""
    + _taubin_step(0, 0.1)
    + _taubin_step(1, -0.1)
)


@query(TAUBIN + _taubin_step(2, 0.1) + _taubin_step(3, -0.1) + " select mesh_id, vid, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z from p4")
def n3_smooth_taubin(spark, d):
    return rounded(mesh.smooth(*_mesh(spark, d), "taubin", 2, 0.1, -0.1), "x", "y", "z")


BOXES = """, vis as (select mesh_id, x, y, z, 1 + vid % 3 as radius, row_number() over (partition by mesh_id order by vid % 2, vid) - 1 as box_id from v_vertex where vid % 37 = 0),
 ins as (select b.mesh_id, box_id, vid, v.x, v.y, v.z from vis b join v_vertex v on v.mesh_id = b.mesh_id and abs(v.x - b.x) <= 2 * radius and abs(v.y - b.y) <= 2 * radius and abs(v.z - b.z) <= 2 * radius),
 bf as (select f.mesh_id, a.box_id, fid, v0, v1, v2 from v_face f join ins a on a.mesh_id = f.mesh_id and a.vid = v0 join ins b on b.mesh_id = f.mesh_id and b.vid = v1 and b.box_id = a.box_id
  join ins c on c.mesh_id = f.mesh_id and c.vid = v2 and c.box_id = a.box_id),
 us as (select distinct mesh_id, box_id, unnest([v0, v1, v2]) as vid from bf), sm as (select ins.* from ins join us using (mesh_id, box_id, vid)),
 mv as (select mesh_id, vid, box_id, """ + ", ".join(f"({c} + avg({c}) over (partition by mesh_id, box_id)) / 2 as {c}" for c in "xyz") + " from sm), "


@query(
    ctes("v_vertex", "v_face").rstrip()
    + BOXES
    + "la as (select mesh_id, vid, "
    + ", ".join(f"arg_max({c}, box_id) as n{c}" for c in "xyz")
    + " from mv group by 1, 2) select mesh_id, vid, "
    + ", ".join(f"round(coalesce(n{c}, {c}), 6) as {c}" for c in "xyz")
    + " from v_vertex left join la using (mesh_id, vid)"
)
def x1_apply_submesh_model(spark, d):
    faces, vertices = _mesh(spark, d)
    visited = vertices.where("vid % 37 = 0").select("mesh_id", (F.col("vid") % 2).alias("line_rank"), F.col("vid").alias("seq"), "x", "y", "z", (1 + F.col("vid") % 3).alias("radius"))
    return rounded(mesh.apply_submesh_model(faces, vertices, mesh.boxes_along_walk(visited), _half), "x", "y", "z")


def _half(at, edges, tris):
    """A model for the query above: each vertex half way to the mean of its submesh."""
    return (at + at.mean(0)) / 2


GROW = EDGE.replace("with ", "with recursive ", 1) + ", lk as (select mesh_id, a, b from ed union select mesh_id, b, a from ed), g(mesh_id, vid, front, d) as (select mesh_id, vid, vid, 0 from v_vertex where vid in (17, 200) union select g.mesh_id, lk.b, front, d + 1 from g join lk on lk.mesh_id = g.mesh_id and lk.a = g.vid where d < 4) "


@query(GROW + "select mesh_id, vid, min(d)::bigint as distance, arg_min(front, (d, front)) as front from g group by 1, 2")
def n5_region_grow(spark, d):
    faces, vertices = _mesh(spark, d)
    return graph.region_grow(mesh.edges(faces), vertices.where("vid in (17, 200)").select("mesh_id", "vid", F.col("vid").alias("front")), 4)


@query()
def n6_min_spanning_tree(spark, d):
    points = view(spark, d, "v_line").select("case_id", "point_id", "x", "y", "z")
    return rounded(graph.min_spanning_tree(points, 12.0), "weight")
