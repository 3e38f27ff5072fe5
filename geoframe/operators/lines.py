"""Centerlines as rows (case_id, line_id, seq, point_id, x, y, z, radius, bifurc): lengths, tangents, order, walks and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoframe.functions.columns import cross, distance2, dot, norm, normalise, sub, unit_hash, vec
from geoframe.operators.ranges import group_number, group_total
from geoframe.plans.storage import stored_large, tasks_for


#: Edges of a case whose chains one task follows by itself; visited points of which a task joins the samples.
SMALL_CHAINS, SPOTS = 100_000, 100_000


class _Lines:
    """A line's points in order, or all of them; windows need a session, so they are made when used."""

    @property
    def ordered(self):
        return Window.partitionBy("case_id", "line_id").orderBy("seq")

    @property
    def whole(self):
        return Window.partitionBy("case_id", "line_id")


OF = _Lines()


def lagged(step: int, *names: str):
    return tuple(F.lag(n, step).over(OF.ordered) for n in names)


def arc_length(points: DataFrame) -> DataFrame:
    """points with s, the distance along the line."""
    step = F.coalesce(norm(sub(vec("x", "y", "z"), lagged(1, "x", "y", "z"))), F.lit(0.0))
    return points.withColumn("__step", step).withColumn("s", F.sum("__step").over(OF.ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def tangents(points: DataFrame) -> DataFrame:
    """points with the unit tangent tx, ty, tz: central differences, one-sided at ends; (1, 0, 0) for a lone or doubled point."""
    here = vec("x", "y", "z")
    before = tuple(F.coalesce(b, h) for b, h in zip(lagged(1, "x", "y", "z"), here))
    after = tuple(F.coalesce(a, h) for a, h in zip(lagged(-1, "x", "y", "z"), here))
    staged = points
    for n, d in zip(("__dx", "__dy", "__dz"), sub(after, before)):
        staged = staged.withColumn(n, d)
    unit = normalise(vec("__dx", "__dy", "__dz"))
    return staged.select(*points.columns, *[F.coalesce(u, F.lit(v)).alias(n) for u, v, n in zip(unit, (1.0, 0.0, 0.0), ("tx", "ty", "tz"))])


def line_lengths(points: DataFrame) -> DataFrame:
    """Per line: n_points and length."""
    return arc_length(points).groupBy("case_id", "line_id").agg(F.count("*").alias("n_points"), F.max("s").alias("length"))


def rank_lines(points: DataFrame) -> DataFrame:
    """Lines with line_rank in their case: longest first, of equal ones the higher id."""
    order = Window.partitionBy("case_id").orderBy(F.desc(F.round("length", 9)), F.desc("line_id"))
    return line_lengths(points).withColumn("line_rank", F.row_number().over(order))


def longest_line(points: DataFrame) -> DataFrame:
    """Per case the longest line, of equal ones the lowest id."""
    return line_lengths(points).groupBy("case_id").agg(F.max_by("line_id", F.struct(F.round("length", 9), -F.col("line_id"))).alias("line_id"))


def orient_lines(points: DataFrame) -> DataFrame:
    """points with seq counted from the end with the larger radius; a line with equal ends stays."""
    ends = points.groupBy("case_id", "line_id").agg(F.min_by("radius", "seq").alias("__first"), F.max_by("radius", "seq").alias("__last"), F.max("seq").alias("__top"))
    turned = F.when(F.col("__first") < F.col("__last"), F.col("__top") - F.col("seq")).otherwise(F.col("seq"))
    return points.join(ends, ["case_id", "line_id"]).withColumn("seq", turned).select(*points.columns)


def owner_line(points: DataFrame, key: str = "point_id") -> DataFrame:
    """points with owned: whether their line is the first, by line_rank, that holds the point."""
    first = Window.partitionBy("case_id", key).orderBy("line_rank", "seq")
    return points.withColumn("owned", F.row_number().over(first) == 1)


def cap_samples(rows: DataFrame, most: int, per_point: int = 1) -> DataFrame:
    """Rows of each case before the running count of samples exceeds most."""
    counted = group_total(rows, ["case_id"], ["line_rank", "seq"], F.lit(per_point), "__n")
    return counted.where(F.col("__n") + per_point <= most).drop("__n")


def segments(points: DataFrame) -> DataFrame:
    """Consecutive pairs: seq, ends, length, middle mx, my, mz and mean radius; none shorter than 1e-10."""
    after = lagged(-1, "x", "y", "z")
    staged = points.select("case_id", "line_id", "seq", "x", "y", "z", *[a.alias(n) for a, n in zip(after, ("x2", "y2", "z2"))], ((F.col("radius") + F.lead("radius").over(OF.ordered)) / 2).alias("mean_radius")).where("x2 is not null")
    a, b = vec("x", "y", "z"), vec("x2", "y2", "z2")
    middle = [((p + q) / 2).alias(n) for p, q, n in zip(a, b, ("mx", "my", "mz"))]
    return staged.select("*", norm(sub(b, a)).alias("length"), *middle).where("length >= 1e-10")


def subdivide(points: DataFrame) -> DataFrame:
    """Each line with the middle of every pair put in: seq doubles, radius is the mean, bifurc that of the first end."""
    first = points.select("case_id", "line_id", (F.col("seq") * 2).alias("seq"), "x", "y", "z", "radius", "bifurc")
    ahead = [((F.col(c) + F.lead(c).over(OF.ordered)) / 2).alias(c) for c in ("x", "y", "z", "radius")]
    between = points.select("case_id", "line_id", (F.col("seq") * 2 + 1).alias("seq"), *ahead, "bifurc").where("x is not null")
    return first.unionByName(between)


def resample_line(points: DataFrame, n: int) -> DataFrame:
    """n points per line, evenly spaced by index, between the line's points by proportion."""
    ahead = [F.coalesce(F.lead(c).over(OF.ordered), F.col(c)).alias(f"{c}2") for c in ("x", "y", "z", "radius")]
    pairs = points.select("*", *ahead, F.max("seq").over(OF.whole).alias("top"))
    # Every target place t * top / (n - 1) that lies in [seq, seq + 1), the last point also for the end.
    place = lambda t: t * F.col("top") / F.lit(n - 1.0)
    # These are between seq and seq + 1 times (n - 1) / top; one more on each side makes up for rounding.
    first = lambda s: F.when(F.col("top") > 0, s * F.lit(n - 1.0) / F.col("top")).otherwise(F.when(s > 0, n - 1.0).otherwise(0.0))
    span = F.sequence(F.greatest(F.floor(first(F.col("seq"))) - 1, F.lit(0)), F.least(F.ceil(first(F.col("seq") + 1)) + 1, F.lit(n - 1)))
    near = F.when(F.col("seq") <= F.col("top"), span)
    targets = F.filter(near, lambda t: F.floor(place(t)) == F.col("seq"))
    at = pairs.select("*", F.explode(targets).alias("t")).withColumn("u", place(F.col("t")) - F.col("seq"))
    mixed = [(F.col(c) + F.col("u") * (F.col(f"{c}2") - F.col(c))).alias(c) for c in ("x", "y", "z", "radius")]
    return at.select("case_id", "line_id", F.col("t").cast("long").alias("seq"), *mixed)


def resample_spacing(points: DataFrame, step: float) -> DataFrame:
    """Points every step along each line from its start."""
    along = arc_length(points)
    ahead = [F.lead(c).over(OF.ordered).alias(f"{c}2") for c in ("x", "y", "z", "radius", "s")]
    pairs = along.select("*", *ahead).where("s2 > s")
    ks = F.sequence(F.ceil(F.col("s") / step), F.ceil(F.col("s2") / step) - 1)
    at = pairs.where(F.ceil(F.col("s2") / step) > F.ceil(F.col("s") / step)).select("*", F.explode(ks).alias("k"))
    u = (F.col("k") * step - F.col("s")) / (F.col("s2") - F.col("s"))
    return at.select("case_id", "line_id", F.col("k").cast("long").alias("seq"), *[(F.col(c) + u * (F.col(f"{c}2") - F.col(c))).alias(c) for c in ("x", "y", "z", "radius")])


def even_subsample(points: DataFrame, n: int) -> DataFrame:
    """Of lines with more than n points, n by evenly spaced index, rounded to 3 digits; bif 1 from bifurc 0 up, last marked."""
    counted = points.withColumn("m", F.count("*").over(OF.whole)).where(F.col("m") > n)
    # seq is wanted if it is some floor(t * (m - 1) / (n - 1)); t is the least with at least seq there, or one off by rounding.
    about = F.ceil(F.col("seq") * F.lit(n - 1) / (F.col("m") - 1))
    tried = F.filter(F.sequence(F.greatest(about - 1, F.lit(0)), F.least(about + 1, F.lit(n - 1))), lambda t: F.floor(t * (F.col("m") - 1) / F.lit(n - 1)) == F.col("seq"))
    found = F.coalesce(F.array_min(tried) + 1, F.lit(0))
    rounded = [F.round(c, 3).alias(c) for c in ("x", "y", "z", "radius")]
    return counted.withColumn("t", found - 1).where("t >= 0").select("case_id", "line_id", F.col("t").cast("long").alias("t"), *rounded, (F.col("bifurc") >= 0).cast("int").alias("bif"), (F.col("t") == n - 1).cast("int").alias("last"))


def stride_segments(rows: DataFrame, stride: int, least: int) -> DataFrame:
    """Of each case's segments in order every stride-th, or denser so that about `least` stay; all if there are fewer."""
    sizes = rows.groupBy("case_id").agg(F.count("*").alias("__n"))
    counted = group_number(rows, ["case_id"], ["line_id", "seq"], "__r").join(sizes, "case_id")
    own = F.when(F.col("__n") < least, 1).otherwise(F.least(F.lit(stride), F.floor(F.col("__n") / least)))
    return counted.where(F.col("__r") % own == 0).drop("__n", "__r")


def local_frame(points: DataFrame) -> DataFrame:
    """points (p: x, y, z; origin ox, oy, oz; tangent tx, ty, tz; x-axis ax, ay, az) with plane coordinates u, v."""
    d, t, a = sub(vec("x", "y", "z"), vec("ox", "oy", "oz")), vec("tx", "ty", "tz"), vec("ax", "ay", "az")
    return points.withColumn("u", dot(d, a)).withColumn("v", dot(d, cross(t, a)))


def from_local_frame(points: DataFrame) -> DataFrame:
    """The inverse: u, v in the frame back to x, y, z."""
    t, a, o = vec("tx", "ty", "tz"), vec("ax", "ay", "az"), vec("ox", "oy", "oz")
    b = cross(t, a)
    for n, oc, ac, bc in zip("xyz", o, a, b):
        points = points.withColumn(n, oc + F.col("u") * ac + F.col("v") * bc)
    return points


def point_at(points: DataFrame, n: int) -> DataFrame:
    """The n-th point of each line and its radius."""
    return points.where(F.col("seq") == n).select("case_id", "line_id", "x", "y", "z", "radius")


def explode_membership(points: DataFrame, member: str = "member") -> DataFrame:
    """One row per (line, point) of a 0/1 membership array; seq counts the line's points by point_id."""
    rows = points.select("*", F.posexplode(member).alias("line_id", "__in")).where("__in = 1").drop("__in", member)
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy("case_id", "line_id").orderBy("point_id")) - 1).cast("long"))


def dedupe_points(points: DataFrame) -> DataFrame:
    """Old and new id of every point: coincident points share the lowest."""
    keep = points.groupBy("case_id", "x", "y", "z").agg(F.min("point_id").alias("new_id"))
    return points.join(keep, ["case_id", "x", "y", "z"]).select("case_id", "point_id", "new_id")


def longest_line_path(points: DataFrame, default_radius: float = 5.0) -> DataFrame:
    """The oriented longest line of each case with tangents; a missing radius gets the default."""
    chosen = points.join(longest_line(points), ["case_id", "line_id"], "left_semi").withColumn("radius", F.coalesce("radius", F.lit(default_radius)))
    return tangents(orient_lines(chosen))


def endpoints(points: DataFrame) -> DataFrame:
    """Line ends: the first point of each case's first line and the last of every line, with radius and outward tangent."""
    lowest = points.groupBy("case_id").agg(F.min("line_id").alias("low"))
    whole = tangents(points).withColumn("top", F.max("seq").over(OF.whole)).join(lowest, "case_id")
    first = whole.where("seq = 0 and line_id = low").select("case_id", "line_id", F.lit("start").alias("end"), "x", "y", "z", "radius", *[(-F.col(c)).alias(c) for c in ("tx", "ty", "tz")])
    return first.unionByName(whole.where("seq = top").select("case_id", "line_id", F.lit("end").alias("end"), "x", "y", "z", "radius", "tx", "ty", "tz"))


def plane_slab(points: DataFrame, origin: tuple[float, float, float], normal: tuple[float, float, float]) -> DataFrame:
    """Per line whether a segment of it crosses the plane; segments parallel to it don't."""
    o, n = tuple(map(F.lit, origin)), tuple(map(F.lit, normal))
    here = dot(sub(vec("x", "y", "z"), o), n)
    staged = points.withColumn("__a", here).withColumn("__b", F.lead("__a").over(OF.ordered))
    t = F.try_divide(F.col("__a"), F.col("__a") - F.col("__b"))
    return staged.withColumn("__t", t).groupBy("case_id", "line_id").agg(F.coalesce(F.bool_or(F.col("__t").between(0, 1)), F.lit(False)).alias("crosses"))


def successors(points: DataFrame, distance: float, slower_large: float = 1.0, large: float = 0.4, slower_bifurcation: float = 1.0) -> DataFrame:
    """Per point p of a line the point the walk goes to next: the first q > p with s[q] - s[p] at least the step.

    The step is the next point's radius times distance, times slower_large from a radius of `large` up, times
    slower_bifurcation at a bifurcation. A point from which no q is far enough has none.
    """
    along = arc_length(points).select("case_id", "line_id", "seq", "s", "radius", "bifurc")
    ahead_radius, ahead_bif = F.lead("radius").over(OF.ordered), F.lead("bifurc").over(OF.ordered)
    step = distance * ahead_radius * F.when(ahead_radius >= large, slower_large).otherwise(1.0) * F.when(ahead_bif == 2, slower_bifurcation).otherwise(1.0)
    targets = along.withColumn("target", F.col("s") + F.when(step > 0, step).otherwise(step * 0))
    # Points and targets in one order along the line: a target takes the next point after it.
    # Exploded, not united, so lines that are dealt to tasks stay where they are.
    ends = F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("kind")), F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("at"), F.lit(0).alias("kind"))))
    marks = targets.select("case_id", "line_id", "seq", F.explode(F.array_compact(ends)).alias("e")).select("case_id", "line_id", "e.at", "e.kind", "seq")
    order = Window.partitionBy("case_id", "line_id").orderBy(F.round("at", 9), "kind", "seq")
    reached = F.first(F.when(F.col("kind") == 1, F.col("seq")), ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = marks.withColumn("q", reached).where("kind = 0")
    top = Window.partitionBy("case_id", "line_id")
    return found.withColumn("__top", F.max("seq").over(top)).where("q is not null").select("case_id", "line_id", "seq", F.greatest("q", F.col("seq") + 1).alias("next_seq"))


def walk_steps(points: DataFrame, distance: float = 1.0, **slower) -> DataFrame:
    """Points (case_id, line_id, seq) that the walk from seq 0 visits, by pointer doubling: log2 of the longest line rounds.

    After a round the first 2, 4, 8 .. points of each walk are known and pointers lead as many steps on, all of them to
    points that are new, as walks only go ahead. A round writes those and the pointers; what is known isn't written again.
    """
    here, there = ["case_id", "line_id", "seq"], ["case_id", "line_id", "next_seq"]
    jump = stored_large(successors(points, distance, **slower), "walk-next")
    n = tasks_for(jump)
    visited = stored_large(points.where("seq = 0").select(*here).distinct(), "walk-visited")
    while True:
        more = stored_large(visited.repartition(n, *here).join(jump.repartition(n, *here).hint("merge"), here).select("case_id", "line_id", F.col("next_seq").alias("seq")), "walk-visited")
        if more.isEmpty():
            return visited
        visited = visited.unionByName(more)
        further = jump.select("case_id", "line_id", F.col("seq").alias("next_seq"), F.col("next_seq").alias("far")).repartition(n, *there)
        jump = stored_large(jump.repartition(n, *there).join(further.hint("merge"), there).select("case_id", "line_id", "seq", F.col("far").alias("next_seq")), "walk-next")


def perpendicular(t) -> tuple[tuple[Column, Column, Column], tuple[Column, Column, Column]]:
    """Two unit vectors at right angles to the unit tangent t."""
    z = t[2]
    flat = F.abs(z) > 0.9
    helper = (F.when(flat, 1.0).otherwise(0.0), F.lit(0.0), F.when(flat, 0.0).otherwise(1.0))
    u = normalise(cross(t, helper))
    return u, cross(t, u)


def place_samples(visited: DataFrame, n: int = 2, n_bifurcation: int = 4, mu: float = 2.0, sigma: float = 0.5, shift_sigma: float = 0.3) -> DataFrame:
    """Samples around visited points (case_id, line_id, seq, x, y, z, radius, bifurc, tx, ty, tz).

    Sample 0 is on the point with the mean size; the others have a size multiple and a shift across the line drawn from
    normal distributions by Box-Muller over hashes of the keys, so any run places the same.
    """
    count = F.when(F.col("bifurc") == 2, n_bifurcation).otherwise(n)
    rows = visited.select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("sub"))
    draw = lambda tag: F.greatest(unit_hash("case_id", "line_id", "seq", "sub", F.lit(tag)), F.lit(1e-4))
    normal = lambda a, b: F.sqrt(-2 * F.ln(draw(a))) * F.cos(2 * 3.141592653589793 * draw(b))
    first = F.col("sub") == 0
    size = F.when(first, mu).otherwise(F.greatest(F.lit(1.0), mu + sigma * normal("size", "size2")))
    shift = F.when(first, 0.0).otherwise(shift_sigma * normal("shift", "shift2"))
    turn = 2 * 3.141592653589793 * draw("turn")
    u, v = perpendicular(vec("tx", "ty", "tz"))
    staged = rows.withColumn("size_mult", size).withColumn("__shift", shift * F.col("radius")).withColumn("__turn", turn)
    for c, uc, vc in zip("xyz", u, v):
        staged = staged.withColumn(f"c{c}", F.col(c) + F.col("__shift") * (F.cos("__turn") * uc + F.sin("__turn") * vc))
    return staged.drop("__shift", "__turn")


def box_for_sample(samples: DataFrame, min_dim: int = 5) -> DataFrame:
    """samples (cx, cy, cz, radius, size_mult; volume arrays size, spacing, origin) with box_index and box_size per axis.

    The side is size_mult * radius in voxels, rounded up, at least min_dim; the start is rounded half even. A box over
    the upper edge by less than half its side is clipped, one under the lower edge moved to it; others are null.
    """
    side = F.col("size_mult") * F.col("radius")
    starts, sizes = [], []
    ok = F.lit(True)
    for a, c in enumerate(("cx", "cy", "cz")):
        spacing, origin, extent = F.col("spacing")[a], F.col("origin")[a], F.col("size")[a]
        n = F.greatest(F.ceil(side / spacing), F.lit(min_dim))
        start = F.rint((F.col(c) - origin - side / 2) / spacing).cast("long")
        over, under = start + n - extent, -start
        ok = ok & (over < n / 2) & (under < n / 2)
        low = F.greatest(start, F.lit(0))
        starts.append(low)
        sizes.append(F.least(n, extent - low))
    return samples.withColumn("box_index", F.when(ok, F.array(*starts))).withColumn("box_size", F.when(ok, F.array(*sizes)))


def sample_rows(samples: DataFrame) -> DataFrame:
    """One statistics row per sample: NAME case_N_sub, SIZE, VOL_CENT, TANGENT, BIFURCATION, NUM_VOX."""
    keys = ["case_id", "line_id", "seq"]
    visited = stored_large(samples.select(*keys).distinct(), "sample-spots")
    n = tasks_for(visited, SPOTS)
    spots = group_number(visited, ["case_id"], ["line_id", "seq"], "__n").repartition(n, *keys)
    voxels = F.aggregate("box_size", F.lit(1).cast("long"), lambda acc, x: acc * x)
    return samples.repartition(n, *keys).join(spots.hint("merge"), keys).select(F.concat_ws("_", F.col("case_id").cast("string"), "__n", "sub").alias("NAME"), (F.col("size_mult") * F.col("radius")).alias("SIZE"), F.array("cx", "cy", "cz").alias("VOL_CENT"), F.array("tx", "ty", "tz").alias("TANGENT"), F.col("bifurc").alias("BIFURCATION"), voxels.alias("NUM_VOX"), F.col("radius").alias("RADIUS"))


def centerline_stats(points: DataFrame) -> DataFrame:
    """Per case: points, lines, bounding box, radius min, max, mean and deviation, bifurcations, total length."""
    base = points.groupBy("case_id").agg(
        F.count_distinct("point_id").alias("n_points"),
        F.count_distinct("line_id").alias("n_lines"),
        *[f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))],
        F.min("radius").alias("min_radius"),
        F.max("radius").alias("max_radius"),
        F.avg("radius").alias("mean_radius"),
        F.stddev_pop("radius").alias("std_radius"),
        F.count_distinct(F.when(F.col("bifurc") > 0, F.col("bifurc"))).alias("n_bifurcations"),
    )
    return base.join(segments(points).groupBy("case_id").agg(F.sum("length").alias("length")), "case_id", "left")


def small_chains(edges) -> dict[str, list]:
    """The chains of one case's edges (case_id, a, b; pandas), no node of which has more than two: followed from each lower end."""
    near: dict = {}
    for a, b in zip(edges["a"].tolist(), edges["b"].tolist()):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    found, case = {"case_id": [], "start": [], "node": [], "seq": []}, edges["case_id"].iat[0]
    for start in [n for n, others in near.items() if len(others) == 1]:
        chain, last = [start, near[start][0]], start
        while len(near[chain[-1]]) == 2:
            p, q = near[chain[-1]]
            last, ahead = chain[-1], q if p == last else p
            chain.append(ahead)
        if start < chain[-1]:
            for name, v in (("case_id", [case] * len(chain)), ("start", [start] * len(chain)), ("node", chain), ("seq", range(len(chain)))):
                found[name].extend(v)
    return found


def ordered_by_edges(edges: DataFrame) -> DataFrame:
    """Chains (case_id, start, node, seq) from edges (case_id, a, b): from the end with the lower id along shared edges.

    Cases of at most SMALL_CHAINS edges are dealt to tasks, which follow their chains; larger ones, and those in which a node
    has more than two edges, go by chains_by_rounds().
    """
    import pandas as pd

    kind = {f.name: f.dataType.simpleString() for f in edges.schema}
    pairs = edges.select("case_id", "a", "b")
    ends = pairs.select("case_id", F.explode(F.array("a", "b")).alias("a"))
    sizes = stored_large(ends.groupBy("case_id", "a").agg(F.count("*").alias("n")).groupBy("case_id").agg(F.sum("n").alias("ends"), F.max("n").alias("most")), "chain-sizes")
    simple = (F.col("ends") <= 2 * SMALL_CHAINS) & (F.col("most") <= 2)
    schema = f"case_id {kind['case_id']}, start {kind['a']}, node {kind['a']}, seq long"
    chains = pairs.join(sizes.where(simple), "case_id", "left_semi").groupBy("case_id").applyInPandas(lambda case: pd.DataFrame(small_chains(case)), schema)
    many = sizes.where(~simple)
    return chains if many.isEmpty() else chains.union(chains_by_rounds(pairs.join(many, "case_id", "left_semi")))


def chains_by_rounds(edges: DataFrame) -> DataFrame:
    """ordered_by_edges() by list ranking: pointer doubling over directed arcs (from, to); each arc's next one leaves its head by the
    other edge."""
    both = edges.select("case_id", "a", "b").union(edges.select("case_id", "b", "a"))
    degree = both.groupBy("case_id", "a").agg(F.count("*").alias("n"))
    following = both.select("case_id", F.col("a").alias("b"), F.col("b").alias("c"))
    arcs = both.join(following, ["case_id", "b"], "left").where("c is null or c <> a")
    has_next = arcs.select("case_id", "a", "b", "c")
    heads = both.join(has_next, ["case_id", "a", "b"], "left").select("case_id", "a", "b", F.col("b").alias("na"), F.col("c").alias("nb"), F.lit(1).cast("long").alias("d"))
    ranks = stored_large(heads, "arc-ranks")
    while not ranks.where("nb is not null").isEmpty():
        ahead = ranks.select("case_id", F.col("a").alias("na"), F.col("b").alias("nb"), F.col("na").alias("ma"), F.col("nb").alias("mb"), F.col("d").alias("e"))
        ranks = stored_large(ranks.join(ahead, ["case_id", "na", "nb"], "left").select("case_id", "a", "b", F.coalesce("ma", "na").alias("na"), F.when(F.col("nb").isNotNull(), F.col("mb")).alias("nb"), (F.col("d") + F.coalesce("e", F.lit(0))).alias("d")), "arc-ranks")
    # d counts arcs to the end that `na` now names; an arc towards the higher end gives its tail's place.
    ends = degree.where("n = 1").select("case_id", F.col("a").alias("end")).hint("merge")
    span = ranks.join(ends.withColumnRenamed("end", "a"), ["case_id", "a"]).where(F.col("a") < F.col("na")).select("case_id", F.col("a").alias("start"), F.col("na").alias("na"), F.col("d").alias("total"))
    placed = ranks.join(span.hint("merge"), ["case_id", "na"]).select("case_id", "start", F.col("a").alias("node"), (F.col("total") - F.col("d")).alias("seq"))
    return placed.union(span.select("case_id", "start", "na", "total")).distinct()


def contour_roundness(points: DataFrame, keys: list[str], limit: float, least: int) -> DataFrame:
    """Per contour: least over greatest distance from its mean point; odd if that is under the limit or points are few."""
    centre = points.groupBy(*keys).agg(*[F.avg(c).alias(f"m{c}") for c in ("x", "y", "z")], F.count("*").alias("n"))
    far = F.sqrt(distance2(vec("x", "y", "z"), vec("mx", "my", "mz")))
    spread = points.join(centre, keys).groupBy(*keys).agg(F.try_divide(F.min(far), F.max(far)).alias("roundness"), F.first("n").alias("n"))
    return spread.withColumn("odd", (F.col("roundness") < limit) | (F.col("n") < least))
