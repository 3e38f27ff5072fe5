"""Centerlines and joins in space."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoframe.functions import columns as C
from geoframe.functions import tables
from geoframe.operators import lines, metrics, nearest, spatial, splits
from geoframe.plans.registry import query, rounded
from geoframe.plans.storage import tasks_of
from geoframe.plans.views import ctes, view

LINE = ctes("v_line")
STEP = "sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2 + (z - lag(z) over w) ** 2)"
W = "window w as (partition by case_id, line_id order by seq)"
ARC = LINE + f", st as (select *, coalesce({STEP}, 0) as step from v_line {W}), arc as (select *, sum(step) over (partition by case_id, line_id order by seq) as s from st) "
LENGTHS = ARC + ", len as (select case_id, line_id, count(*) as n_points, round(max(s), 6) as length from arc group by 1, 2) "


@query(ARC + "select point_id, round(s, 6) as s from arc")
def w1_arc_length(spark, d):
    return rounded(lines.arc_length(view(spark, d, "v_line")).select("point_id", "s"), "s")


TANGENT = LINE + f""", d as (select *, coalesce(lead(x) over w, x) - coalesce(lag(x) over w, x) as dx, coalesce(lead(y) over w, y) - coalesce(lag(y) over w, y) as dy,
 coalesce(lead(z) over w, z) - coalesce(lag(z) over w, z) as dz from v_line {W}), tan as (select *, sqrt(dx * dx + dy * dy + dz * dz) as n from d) """


@query(TANGENT + "select point_id, " + ", ".join(f"round(case when n = 0 then {v} else d{c} / n end, 6) + 0.0 as t{c}" for c, v in zip("xyz", (1.0, 0.0, 0.0))) + " from tan")
def w2_tangents(spark, d):
    return rounded(lines.tangents(view(spark, d, "v_line")).select("point_id", "tx", "ty", "tz"), "tx", "ty", "tz")


@query(LENGTHS + "select case_id, line_id, n_points, length, row_number() over (partition by case_id order by length desc, line_id desc) as line_rank from len")
def w3_rank_lines(spark, d):
    return rounded(lines.rank_lines(view(spark, d, "v_line")), "length").withColumn("line_rank", F.col("line_rank").cast("long"))


@query(LENGTHS + "select case_id, arg_min(line_id, (-length, line_id)) as line_id from len group by 1")
def w3_longest_line(spark, d):
    return lines.longest_line(view(spark, d, "v_line"))


ENDS = LINE + ", e as (select case_id, line_id, arg_min(radius, seq) as r0, arg_max(radius, seq) as r1, max(seq) as top from v_line group by 1, 2), oriented as (select v.* replace (case when r0 < r1 then top - seq else seq end as seq) from v_line v join e using (case_id, line_id)) "


@query(ENDS + "select point_id, seq from oriented")
def w4_orient_lines(spark, d):
    return lines.orient_lines(view(spark, d, "v_line")).select("point_id", "seq")


RANKED = LENGTHS + ", r as (select *, row_number() over (partition by case_id order by length desc, line_id desc) as line_rank from len), ranked as (select v.*, line_rank, v.point_id % 50 as shared from v_line v join r using (case_id, line_id)) "


def _ranked(spark, d):
    points = view(spark, d, "v_line")
    return points.join(lines.rank_lines(points).select("case_id", "line_id", "line_rank"), ["case_id", "line_id"]).withColumn("shared", F.col("point_id") % 50)


@query(RANKED + "select point_id, row_number() over (partition by case_id, shared order by line_rank, seq) = 1 as owned from ranked")
def w5_owner_line(spark, d):
    return lines.owner_line(_ranked(spark, d), "shared").select("point_id", "owned")


@query(RANKED + "select point_id from (select point_id, row_number() over (partition by case_id order by line_rank, seq) * 2 as n from ranked) where n <= 60")
def w6_cap_samples(spark, d):
    return lines.cap_samples(_ranked(spark, d), 60, 2).select("point_id")


@query(LINE + ", c as (select *, count(*) over (partition by case_id, line_id) as m from v_line), t as (select unnest(range(5)) as t) select case_id, line_id, t.t::bigint as t, round(x, 3) as x, round(y, 3) as y, round(z, 3) as z, round(radius, 3) as radius, (bifurc >= 0)::int as bif, (t.t = 4)::int as last from c join t on seq = floor(t.t * (m - 1) / 4.0) where m > 5")
def w12_even_subsample(spark, d):
    return lines.even_subsample(view(spark, d, "v_line"), 5)


SEGMENT = LINE + f""", s0 as (select case_id, line_id, seq, x, y, z, lead(x) over w as x2, lead(y) over w as y2, lead(z) over w as z2, (radius + lead(radius) over w) / 2 as mean_radius from v_line {W}),
 seg as (select *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) + (z2 - z) * (z2 - z)) as length, (x + x2) / 2 as mx, (y + y2) / 2 as my, (z + z2) / 2 as mz from s0 where x2 is not null), sg as (select * from seg where length >= 1e-10) """


@query(SEGMENT + "select case_id, line_id, seq, round(length, 6) as length, mx, my, mz, mean_radius from sg")
def k1_segments(spark, d):
    return rounded(lines.segments(view(spark, d, "v_line")).select("case_id", "line_id", "seq", "length", "mx", "my", "mz", "mean_radius"), "length")


@query(SEGMENT + ", n as (select *, count(*) over (partition by case_id) as n, row_number() over (partition by case_id order by line_id, seq) - 1 as r from sg) select case_id, line_id, seq from n where r % case when n < 20 then 1 else least(7, n // 20) end = 0")
def w13_stride_segments(spark, d):
    return lines.stride_segments(lines.segments(view(spark, d, "v_line")).select("case_id", "line_id", "seq"), 7, 20)


@query(LINE + "select point_id, x - 5 as u, (z - 7) - 0 as v from v_line")
def w14_local_frame(spark, d):
    frame = {"ox": 5.0, "oy": 6.0, "oz": 7.0, "tx": 0.0, "ty": -1.0, "tz": 0.0, "ax": 1.0, "ay": 0.0, "az": 0.0}
    points = view(spark, d, "v_line").withColumns({k: F.lit(v) for k, v in frame.items()})
    return rounded(lines.local_frame(points).select("point_id", "u", "v"), "u", "v")


@query(LINE + f"select case_id, line_id, seq * 2 as seq, x, y, z, radius, bifurc from v_line union all select * from (select case_id, line_id, seq * 2 + 1, (x + lead(x) over w) / 2 as x, (y + lead(y) over w) / 2, (z + lead(z) over w) / 2, (radius + lead(radius) over w) / 2, bifurc from v_line {W}) where x is not null")
def k2_subdivide(spark, d):
    return lines.subdivide(view(spark, d, "v_line"))


@query(LINE + f", p as (select *, coalesce(lead(x) over w, x) as x2, coalesce(lead(radius) over w, radius) as r2, max(seq) over (partition by case_id, line_id) as top from v_line {W}), t as (select unnest(range(7)) as t) select case_id, line_id, t.t::bigint as seq, round(x + (t.t * top / 6.0::double - p.seq) * (x2 - x), 6) as x, round(radius + (t.t * top / 6.0::double - p.seq) * (r2 - radius), 6) as radius from p join t on floor(t.t * top / 6.0::double) = p.seq")
def k3_resample_line(spark, d):
    return rounded(lines.resample_line(view(spark, d, "v_line"), 7).select("case_id", "line_id", "seq", "x", "radius"), "x", "radius")


@query(ARC + ", p as (select *, lead(x) over w as x2, lead(s) over w as s2 from arc " + W + "), q as (select *, unnest(range(ceil(s / 40)::bigint, ceil(s2 / 40)::bigint)) as k from p where s2 > s) select case_id, line_id, k as seq, round(x + (k * 40 - s) / (s2 - s) * (x2 - x), 4) as x from q")
def k3_resample_spacing(spark, d):
    return rounded(lines.resample_spacing(view(spark, d, "v_line"), 40.0).select("case_id", "line_id", "seq", "x"), "x", digits=4)


WALK = (
    ARC
    + f""", a as (select case_id, line_id, seq, s, 30.0::double * lead(radius) over w * case when lead(radius) over w >= 2 then 0.5::double else 1 end * case when lead(bifurc) over w = 2 then 0.5::double else 1 end as step from arc {W}),
 nx as (select a.case_id, a.line_id, a.seq, min(b.seq) as next_seq from a join arc b on a.case_id = b.case_id and a.line_id = b.line_id and b.seq > a.seq and round(b.s, 9) >= round(a.s + a.step, 9) group by 1, 2, 3) """
)


@query(WALK + "select * from nx")
def k4_successors(spark, d):
    return lines.successors(view(spark, d, "v_line"), 30.0, 0.5, 2.0, 0.5)


@query(WALK.replace("with ", "with recursive ", 1) + ", walk as (select case_id, line_id, seq from v_line where seq = 0 union all select w.case_id, w.line_id, nx.next_seq from walk w join nx on w.case_id = nx.case_id and w.line_id = nx.line_id and w.seq = nx.seq) select * from walk")
def k4_walk_steps(spark, d):
    return lines.walk_steps(view(spark, d, "v_line"), 30.0, slower_large=0.5, large=2.0, slower_bifurcation=0.5)


def _visited(spark, d):
    points = view(spark, d, "v_line")
    steps = lines.walk_steps(points, 30.0, slower_large=0.5, large=2.0, slower_bifurcation=0.5)
    return lines.tangents(points).join(steps, ["case_id", "line_id", "seq"])


@query()
def k5_place_samples(spark, d):
    return lines.place_samples(_visited(spark, d)).select("case_id", "line_id", "seq", "sub", "size_mult", "cx", "cy", "cz")


def sample_of_row(row, state):
    """place_samples() for one visited point, as a table function takes it; with the sample's number in its case."""
    import hashlib
    import math

    def draw(sub: int, tag: str) -> float:
        text = f"{row.case_id}_{row.line_id}_{row.seq}_{sub}_{tag}"
        return max(int(hashlib.md5(text.encode()).hexdigest()[:16], 16) % 10000 / 10000, 1e-4)

    def normal(sub: int, a: str, b: str) -> float:
        return math.sqrt(-2 * math.log(draw(sub, a))) * math.cos(2 * math.pi * draw(sub, b))

    def unit(v: tuple) -> tuple:
        n = math.sqrt(sum(c * c for c in v))
        return tuple(c / n for c in v) if n else (None,) * 3

    def across(a: tuple, b: tuple) -> tuple:
        return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]

    t = row.tx, row.ty, row.tz
    u = v = (None,) * 3
    if None not in t:
        u = unit(across(t, (1.0, 0.0, 0.0) if abs(t[2]) > 0.9 else (0.0, 0.0, 1.0)))
        v = across(t, u) if None not in u else u
    for sub in range(4 if row.bifurc == 2 else 2):
        size = 2.0 if sub == 0 else max(1.0, 2.0 + 0.5 * normal(sub, "size", "size2"))
        shift = (0.0 if sub == 0 else 0.3 * normal(sub, "shift", "shift2")) * row.radius
        turn = 2 * math.pi * draw(sub, "turn")
        centre = [None if p is None else c + shift * (math.cos(turn) * p + math.sin(turn) * q) for c, p, q in zip((row.x, row.y, row.z), u, v)]
        yield row.case_id, row.line_id, row.seq, sub, size, *centre, state.setdefault("n", 0)
        state["n"] += 1


@query()
def x2_sample_udtf(spark, d):
    schema = "case_id long, line_id long, seq long, sub int, size_mult double, cx double, cy double, cz double, number long"
    return rounded(tables.sampled(_visited(spark, d), sample_of_row, schema, ["case_id"], ["line_id", "seq"]), "size_mult", "cx", "cy", "cz")


VOLUME = {"size": [128, 128, 64], "spacing": [1.0, 1.0, 1.0], "origin": [-4.0, -4.0, -4.0]}


def _boxed(spark, d, points):
    sized = points.withColumns({k: F.array(*map(F.lit, v)) for k, v in VOLUME.items()})
    return lines.box_for_sample(sized, 5)


def _axis(c: str, extent: int) -> str:
    n, start = "greatest(ceil(3 * radius), 5)", f"round_even(({c} + 4 - 1.5::double * radius), 0)"
    return f"({start} + {n} - {extent} < {n} / 2 and -{start} < {n} / 2)", f"greatest({start}, 0)::bigint", f"least({n}, {extent} - greatest({start}, 0))::bigint"


AXES = [_axis(c, e) for c, e in zip("xyz", (128, 128, 64))]
OK = " and ".join(a[0] for a in AXES)


@query(LINE + f"select point_id, case when {OK} then [{', '.join(a[1] for a in AXES)}] end as box_index, case when {OK} then [{', '.join(a[2] for a in AXES)}] end as box_size from v_line")
def k6_box_for_sample(spark, d):
    points = view(spark, d, "v_line").withColumn("size_mult", F.lit(3.0))
    for c in "xyz":
        points = points.withColumn(f"c{c}", F.col(c))
    return _boxed(spark, d, points).select("point_id", "box_index", "box_size")


@query()
def k7_sample_rows(spark, d):
    return lines.sample_rows(_boxed(spark, d, lines.place_samples(_visited(spark, d))))


@query("with p as (select vec_id as point_id, label as case_id, floor(embedding[1]::double * 20) as x, floor(embedding[2]::double * 20) as y from embeddings) select case_id::bigint as case_id, point_id, min(point_id) over (partition by case_id, x, y) as new_id from p")
def k16_dedupe_points(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("point_id"), F.col("label").cast("long").alias("case_id"), *[F.floor(F.col("embedding")[i].cast("double") * 20).alias(c) for i, c in enumerate("xy")], F.lit(0).alias("z"))
    return lines.dedupe_points(rows)


@query(LENGTHS + ", best as (select case_id, arg_min(line_id, (-length, line_id)) as line_id from len group by 1), e as (select case_id, line_id, arg_min(radius, seq) as r0, arg_max(radius, seq) as r1, max(seq) as top from v_line group by 1, 2) select point_id, case when r0 < r1 then top - seq else seq end as seq, radius from v_line join best using (case_id, line_id) join e using (case_id, line_id)")
def k18_longest_line_path(spark, d):
    return lines.longest_line_path(view(spark, d, "v_line")).select("point_id", "seq", "radius")


@query(TANGENT + ", m as (select *, max(seq) over (partition by case_id, line_id) as top, min(line_id) over (partition by case_id) as low from tan) select case_id, line_id, 'start' as \"end\", point_x as x, radius from (select *, x as point_x from m) where seq = 0 and line_id = low union all select case_id, line_id, 'end', x, radius from m where seq = top")
def k13_endpoints(spark, d):
    return lines.endpoints(view(spark, d, "v_line")).select("case_id", "line_id", "end", "x", "radius")


@query(LINE + f", a as (select case_id, line_id, (x - 50) as a, lead(x - 50) over w as b from v_line {W}) select case_id, line_id, coalesce(bool_or(case when a <> b then a / (a - b) between 0 and 1 end), false) as crosses from a group by 1, 2")
def p13_plane_slab(spark, d):
    return lines.plane_slab(view(spark, d, "v_line"), (50.0, 0.0, 0.0), (1.0, 0.0, 0.0))


@query(LINE + "select point_id, x + y as total, 7 as fixed, radius as f from v_line")
def p14_with_point_array(spark, d):
    points = view(spark, d, "v_line")
    return points.withColumn("total", F.expr("x + y")).withColumn("fixed", F.lit(7)).withColumnRenamed("radius", "f").select("point_id", "total", "fixed", "f")


@query(LINE + "select case_id, line_id, x, y, z, radius from v_line where seq = 3")
def p18_point_at(spark, d):
    return lines.point_at(view(spark, d, "v_line"), 3)


@query(LINE + ", m as (select *, 0 as l from v_line where point_id % 2 = 0 union all select *, 1 from v_line where point_id % 3 = 0) select case_id, point_id, l as line_id, row_number() over (partition by case_id, l order by point_id) - 1 as seq from m")
def p19_explode_membership(spark, d):
    points = view(spark, d, "v_line").drop("line_id", "seq").withColumn("member", F.array((F.col("point_id") % 2 == 0).cast("int"), (F.col("point_id") % 3 == 0).cast("int")))
    return lines.explode_membership(points).select("case_id", "point_id", "line_id", "seq")


STATS = ", ".join(f"{n}({c}) as {n}_{c}" for c in "xyz" for n in ("min", "max"))


@query(SEGMENT + f", b as (select case_id, count(distinct point_id) as n_points, count(distinct line_id) as n_lines, {STATS}, min(radius) as min_radius, max(radius) as max_radius, round(avg(radius), 6) as mean_radius, round(stddev_pop(radius), 6) as std_radius, count(distinct case when bifurc > 0 then bifurc end) as n_bifurcations from v_line group by 1) select b.*, length from b left join (select case_id, round(sum(length), 4) as length from sg group by 1) using (case_id)")
def a10_centerline_stats(spark, d):
    return rounded(rounded(lines.centerline_stats(view(spark, d, "v_line")), "mean_radius", "std_radius"), "length", digits=4)


@query(LINE + ", c as (select case_id, line_id, avg(x) as mx, avg(y) as my, avg(z) as mz, count(*) as n from v_line group by 1, 2), r as (select case_id, line_id, sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) as f, n from v_line join c using (case_id, line_id)) select case_id, line_id, round(case when max(f) > 0 then min(f) / max(f) end, 5) as roundness, any_value(n) as n from r group by 1, 2")
def a27_contour_roundness(spark, d):
    return rounded(lines.contour_roundness(view(spark, d, "v_line"), ["case_id", "line_id"], 0.3, 4).select("case_id", "line_id", "roundness", "n"), "roundness", digits=5)


BOXES = ", boxes as (select case_id, concat_ws('_', line_id, seq) as box_id, x - 6 as lox, x + 6 as hix, y - 6 as loy, y + 6 as hiy, z - 6 as loz, z + 6 as hiz from v_line) "


def _boxes(points, half=6.0, radii=0.0):
    """A box around each point of each line, by a half side and so many times the radius; its id is line_id and seq."""
    half = half + radii * F.col("radius")
    return points.select("case_id", F.concat_ws("_", "line_id", "seq").alias("box_id"), *[(F.col(c) + s).alias(n + c) for c in "xyz" for n, s in (("lo", -half), ("hi", half))])


#: Ten cases of all lines between them: a case's points grow with the tables, and so does every pair of its lines.
WIDE = LINE + ", wide as (select * replace (line_id as case_id, case_id as line_id) from v_line)"


#: Points whose pairs with boxes one task makes.
PAIRED = 5_000


@query(WIDE + BOXES.replace("v_line", "wide") + "select v.case_id, point_id, box_id from wide v join boxes b on v.case_id = b.case_id and x between lox and hix and y between loy and hiy and z between loz and hiz")
def p6_points_in_box(spark, d):
    points = view(spark, d, "v_line").select(F.col("line_id").alias("case_id"), F.col("case_id").alias("line_id"), "seq", "point_id", "x", "y", "z", "radius")
    # Pairs grow with the square of the points.
    tasks = tasks_of(spark.read.parquet(f"{d}/events.parquet").count(), PAIRED)
    return spatial.points_in_boxes(points, _boxes(points), tasks=tasks).select("case_id", "point_id", "box_id")


@query(LINE + ", b as (select case_id, quantile_disc(x, 0.1) as lo, quantile_disc(x, 0.9) as hi from v_line group by 1), o as (select v.case_id, point_id from v_line v join b using (case_id) where not x between lo and hi) select case_id, count(*) as n_outside, list_sort(list(point_id))[1:100] as first_ids from o group by 1")
def p6_out_of_bounds(spark, d):
    points = view(spark, d, "v_line")
    ends = points.groupBy("case_id").agg(F.expr("percentile_disc(0.1) within group (order by x)").alias("lox"), F.expr("percentile_disc(0.9) within group (order by x)").alias("hix"))
    wide = ends.withColumns({f"{s}{c}": F.lit(v) for c in "yz" for s, v in (("lo", -1e9), ("hi", 1e9))})
    return spatial.out_of_bounds(points, wide)


@query(LINE + "select point_id from v_line where (x - 50) ** 2 + (y - 40) ** 2 + (z - 25) ** 2 <= 900")
def p7_inside_sphere(spark, d):
    return spatial.inside_sphere(view(spark, d, "v_line"), (50.0, 40.0, 25.0), 30.0).select("point_id")


@query(LINE + BOXES + ", tops as (select case_id, line_id, max(seq) as top from v_line group by 1, 2), caps as (select v.* from v_line v join tops t on t.case_id = v.case_id and t.line_id = v.line_id and seq in (0, top)), hit as (select distinct b.case_id, box_id from boxes b join caps v on v.case_id = b.case_id and x > lox and x < hix and y > loy and y < hiy and z > loz and z < hiz) select case_id, box_id from boxes where (case_id, box_id) not in (select (case_id, box_id) from hit)")
def j17_boxes_without_caps(spark, d):
    points = view(spark, d, "v_line")
    tops = points.groupBy("case_id", "line_id").agg(F.max("seq").alias("top"))
    caps = points.join(tops, ["case_id", "line_id"]).where("seq in (0, top)").select("case_id", "x", "y", "z")
    return spatial.boxes_without_caps(_boxes(points), caps).select("case_id", "box_id")


NEAREST = LINE + ", l as (select case_id, point_id, x, y, z from v_line where point_id % 3 = 0), r as (select case_id, point_id as right_id, x, y, z from v_line where point_id % 3 <> 0), nn as (select l.case_id, l.point_id as left_id, arg_min(right_id, ((l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2, right_id)) as right_id, min(sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2)) as distance from l join r using (case_id) group by 1, 2) "


def _sides(spark, d):
    points = view(spark, d, "v_line")
    return points.where("point_id % 3 = 0"), points.where("point_id % 3 <> 0")


def _nearest(spark, d):
    left, right = _sides(spark, d)
    return nearest.nearest_point(left.withColumnRenamed("point_id", "left_id"), right.withColumnRenamed("point_id", "right_id"))


@query(NEAREST + "select case_id, left_id, right_id, round(distance, 6) as distance from nn")
def j12_nearest_point(spark, d):
    return rounded(_nearest(spark, d), "distance")


@query("with p as (select vec_id as point_id, label::bigint as case_id, floor(embedding[1]::double * 100) as x, floor(embedding[2]::double * 100) as y from embeddings), c as (select case_id, row_number() over (partition by case_id order by point_id) as seq, x, y from p where point_id % 3 = 0), e as (select case_id, x, y, coalesce(lead(x) over (partition by case_id order by seq), first(x) over (partition by case_id order by seq)) as x2, coalesce(lead(y) over (partition by case_id order by seq), first(y) over (partition by case_id order by seq)) as y2 from c), q as (select distinct case_id, x + 0.5 as px, y + 0.5 as py from p where point_id % 3 = 1) select q.case_id, px::double as px, py::double as py, (select count(*) % 2 = 1 from e where e.case_id = q.case_id and (e.y > py) <> (e.y2 > py) and px < (e.x2 - e.x) * (py - e.y) / (e.y2 - e.y) + e.x) as inside from q")
def p16_points_in_polygon(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("point_id"), F.col("label").cast("long").alias("case_id"), *[F.floor(F.col("embedding")[i].cast("double") * 100).cast("double").alias(c) for i, c in enumerate("xy")])
    points = rows.where("point_id % 3 = 1").select("case_id", (F.col("x") + 0.5).alias("px"), (F.col("y") + 0.5).alias("py")).distinct()
    return spatial.points_in_polygon(points, rows.where("point_id % 3 = 0").withColumnRenamed("point_id", "seq"), ["case_id"])


@query(NEAREST + "select case_id, round(avg(distance), 6) as mean_distance from nn group by 1")
def k11_centerline_error(spark, d):
    left, right = _sides(spark, d)
    return rounded(metrics.centerline_error(right, left).select("case_id", "mean_distance"), "mean_distance")


@query(NEAREST + ", b as (select v.case_id, line_id as branch, bool_and(distance <= radius * 4) as caught from v_line v join nn on v.case_id = nn.case_id and point_id = left_id group by 1, 2) select case_id, round(100.0::double * count_if(caught) / (max(branch) + 1), 6) as percent from b group by 1")
def k12_branches_caught(spark, d):
    left, _ = _sides(spark, d)
    near = _nearest(spark, d).select("case_id", F.col("left_id").alias("point_id"), "distance")
    return rounded(metrics.branches_caught(left.withColumn("radius", F.col("radius") * 4).withColumn("branch", F.col("line_id")), near), "percent")


@query()
def k14_thin_points(spark, d):
    return spatial.thin_points(view(spark, d, "v_line"), 9.0).select("case_id", "point_id")


BACK = NEAREST + ", bb as (select r.case_id, r.right_id, min(sqrt((l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2)) as distance from l join r using (case_id) group by 1, 2), dd as (select case_id, 'ab' as way, distance from nn union all select case_id, 'ba', distance from bb) "


def _distances(spark, d):
    left, right = _sides(spark, d)
    return metrics.surface_distances(left, right)


@query(BACK + "select case_id, round(max(distance) filter (way = 'ab'), 6) as max_ab, round(max(distance) filter (way = 'ba'), 6) as max_ba, round(quantile_cont(distance, 0.95) filter (way = 'ab'), 6) as p_ab, round(quantile_cont(distance, 0.95) filter (way = 'ba'), 6) as p_ba from dd group by 1")
def e7_hausdorff(spark, d):
    return rounded(metrics.hausdorff(_distances(spark, d)).drop("p_mean"), "max_ab", "max_ba", "p_ab", "p_ba")


@query(BACK + "select case_id, round((avg(distance) filter (way = 'ab') + avg(distance) filter (way = 'ba')) / 2, 6) as assd from dd group by 1")
def e8_assd(spark, d):
    return rounded(metrics.assd(_distances(spark, d)), "assd")


@query(BACK + "select case_id, round(count_if(distance <= 8) / count(*), 6) as surface_dice from dd group by 1")
def e9_surface_dice(spark, d):
    return rounded(metrics.surface_dice(_distances(spark, d), 8.0), "surface_dice")


INSIDE = ", vox as (select distinct case_id, round_even(x, 0)::bigint as i, round_even(y, 0)::bigint as j, round_even(z, 0)::bigint as k from v_line where point_id % 4 <> 0) "


def _inside(points):
    return points.where("point_id % 4 <> 0").select("case_id", *[F.rint(c).cast("long").alias(i) for c, i in zip("xyz", "ijk")]).distinct()


@query(SEGMENT + INSIDE + f", m as (select v.*, (i is not null)::int as inn from v_line v left join vox on v.case_id = vox.case_id and v.x = i and v.y = j and v.z = k), e as (select case_id, line_id, seq, least(inn, lead(inn) over w) as two from m {W}) select case_id, round(sum(length * two) / sum(length), 6) as overlap from sg join e using (case_id, line_id, seq) group by 1")
def e5_centerline_overlap(spark, d):
    points = view(spark, d, "v_line")
    return rounded(metrics.centerline_overlap(points, _inside(points)), "overlap")


@query(LINE + INSIDE + "select v.case_id, round(avg((i is not null)::int), 6) as share from v_line v left join vox on v.case_id = vox.case_id and v.x = i and v.y = j and v.z = k group by 1")
def e6_point_overlap(spark, d):
    points = view(spark, d, "v_line")
    return rounded(metrics.point_overlap(points, _inside(points)), "share")


@query("select ''||n_name as name, row_number() over (order by c_name) - 1 + 7 as index, c_name from customer join nation on c_nationkey = n_nationkey")
def s8_numbered(spark, d):
    rows = view(spark, d, "v_case").join(spark.read.parquet(f"{d}/customer.parquet"), F.col("case_id") == F.col("c_custkey")).select(F.col("dataset").alias("name"), "c_name")
    return splits.numbered(rows, "c_name").withColumn("index", (F.col("index") + 7).cast("long"))


@query(LINE + "select point_id, round(50 + (y - 40) * -1, 6) as x, round(40 + (x - 50), 6) as y from v_line")
def f14_rigid_rotate(spark, d):
    axis = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    turned = C.rigid_rotate(C.vec("x", "y", "z"), axis, F.radians(F.lit(90.0)), (F.lit(50.0), F.lit(40.0), F.lit(0.0)))
    return rounded(view(spark, d, "v_line").select("point_id", turned[0].alias("x"), turned[1].alias("y")), "x", "y")
