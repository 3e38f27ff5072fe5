"""Overlap, distance and volume metrics between prediction and truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.operators.lines import segments
from geoframe.operators.nearest import nearest_point
from geoframe.operators.ranges import quantiles
from geoframe.plans.storage import stored


def dice(voxels: DataFrame, by: list[str] = ("case_id",)) -> DataFrame:
    """2 * both / (pred + gt) per group of voxels (gt, pred); NaN where both are empty."""
    gt, pred = F.col("gt") > 0, F.col("pred") > 0
    both = F.try_divide(2.0 * F.count_if(gt & pred), F.count_if(gt) + F.count_if(pred))
    return voxels.groupBy(*by).agg(F.coalesce(both, F.lit(float("nan"))).alias("dice"))


def paired(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """One row per voxel that either has (case_id, i, j, k, label): gt and pred, 0 where one lacks it."""
    key = ["case_id", "i", "j", "k"]
    a, b = pred.select(*key, F.col("label").alias("pred")), gt.select(*key, F.col("label").alias("gt"))
    return a.join(b, key, "full_outer").select(*key, F.coalesce("pred", F.lit(0)).alias("pred"), F.coalesce("gt", F.lit(0)).alias("gt"))


def dice_by_radius(voxels: DataFrame, points: DataFrame, edges: list[float]) -> DataFrame:
    """Dice per bin of the radius of each voxel's nearest centerline point; radii beyond the edges fall into the end bins."""
    fore = voxels.where("gt > 0 or pred > 0").withColumn("left_id", F.concat_ws("_", "i", "j", "k"))
    near = nearest_point(fore.select("case_id", "left_id", *[F.col(a).cast("double").alias(b) for a, b in zip("ijk", "xyz")]), points.select("case_id", F.col("point_id").alias("right_id"), "x", "y", "z"))
    radii = points.groupBy("case_id", F.col("point_id").alias("right_id")).agg(F.max("radius").alias("radius"))
    binned = near.join(radii, ["case_id", "right_id"])
    place = sum((F.col("radius") >= e).cast("int") for e in edges) - 1
    binned = binned.withColumn("bin", F.greatest(F.lit(0), F.least(place, F.lit(len(edges) - 2))))
    return dice(fore.join(binned.select("case_id", "left_id", "bin"), ["case_id", "left_id"]), ["case_id", "bin"])


def centerline_overlap(points: DataFrame, inside: DataFrame) -> DataFrame:
    """Length of segments whose ends are both inside (case_id, i, j, k) over the total; a segment between two point ids counts once."""
    from pyspark.sql.window import Window

    line = Window.partitionBy("case_id", "line_id").orderBy("seq")
    rows = points.select("case_id", "line_id", "seq", "point_id", *[F.rint(c).cast("long").alias(i) for c, i in zip("xyz", "ijk")])
    marked = rows.join(inside.select("case_id", "i", "j", "k").distinct().withColumn("__in", F.lit(1)), ["case_id", "i", "j", "k"], "left").withColumn("__in", F.coalesce("__in", F.lit(0)))
    ends = marked.select("case_id", "line_id", "seq", F.least(F.col("__in"), F.lead("__in").over(line)).alias("both"), F.col("point_id").alias("a"), F.lead("point_id").over(line).alias("b"))
    once = segments(points).select("case_id", "line_id", "seq", "length").join(ends, ["case_id", "line_id", "seq"]).groupBy("case_id", "a", "b").agg(F.max("both").alias("both"), F.max("length").alias("length"))
    return once.groupBy("case_id").agg(F.try_divide(F.sum(F.col("length") * F.col("both")), F.sum("length")).alias("overlap"))


def point_overlap(points: DataFrame, inside: DataFrame) -> DataFrame:
    """Share of each case's points whose voxel is inside."""
    rows = points.select("case_id", *[F.rint(c).cast("long").alias(i) for c, i in zip("xyz", "ijk")])
    marked = rows.join(inside.select("case_id", "i", "j", "k").distinct().withColumn("__in", F.lit(1)), ["case_id", "i", "j", "k"], "left")
    return marked.groupBy("case_id").agg(F.avg(F.coalesce("__in", F.lit(0))).alias("share"))


def surface_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distances from the points of a to the nearest of b, and back: case_id, way, distance."""
    named = lambda df, n: df.select("case_id", F.col("point_id").alias(n), "x", "y", "z")
    there = nearest_point(named(a, "left_id"), named(b, "right_id")).select("case_id", F.lit("ab").alias("way"), "distance")
    back = nearest_point(named(b, "left_id"), named(a, "right_id")).select("case_id", F.lit("ba").alias("way"), "distance")
    return there.unionByName(back)


def hausdorff(distances: DataFrame, share: float = 0.95) -> DataFrame:
    """Per case greatest and percentile distance there and back, and the mean of both percentiles."""
    distances = stored(distances, "distances")
    sums = distances.groupBy("case_id", "way").agg(F.max("distance").alias("max"))
    each = sums.join(quantiles(distances, ["case_id", "way"], "distance", {"p": share}), ["case_id", "way"])
    of = lambda c, w: F.max(F.when(F.col("way") == w, F.col(c))).alias(f"{c}_{w}")
    out = each.groupBy("case_id").agg(*[of(c, w) for c in ("max", "p") for w in ("ab", "ba")])
    return out.withColumn("p_mean", (F.col("p_ab") + F.col("p_ba")) / 2)


def assd(distances: DataFrame) -> DataFrame:
    """Half of the mean distance there and back."""
    pick = lambda w: F.avg(F.when(F.col("way") == w, F.col("distance")))
    return distances.groupBy("case_id").agg(((pick("ab") + pick("ba")) / 2).alias("assd"))


def surface_dice(distances: DataFrame, tau: float) -> DataFrame:
    """Share of points of both surfaces within tau of the other."""
    return distances.groupBy("case_id").agg((F.count_if(F.col("distance") <= tau) / F.count("*")).alias("surface_dice"))


def relative_error(pred: str, gt: str):
    """(pred - gt) / gt; null where gt is 0."""
    return F.try_divide(F.col(pred).cast("double") - F.col(gt), F.col(gt))


def volume_area_error(pred: DataFrame, gt: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Signed, absolute and relative error of each named measure."""
    both = pred.select(key, *[F.col(n).alias(f"{n}_pred") for n in names]).join(gt.select(key, *[F.col(n).alias(f"{n}_gt") for n in names]), key)
    for n in names:
        both = both.withColumn(f"{n}_error", F.col(f"{n}_pred") - F.col(f"{n}_gt")).withColumn(f"{n}_abs", F.abs(F.col(f"{n}_error"))).withColumn(f"{n}_rel", relative_error(f"{n}_pred", f"{n}_gt"))
    return both


def centerline_error(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Per case mean distance from truth points to the nearest predicted one, and mean radius error (0 where farther than the radius)."""
    near = nearest_point(gt.select("case_id", F.col("point_id").alias("left_id"), "x", "y", "z"), pred.select("case_id", F.col("point_id").alias("right_id"), "x", "y", "z"))
    radius = lambda df, n, r: df.groupBy("case_id", F.col("point_id").alias(n)).agg(F.max("radius").alias(r))
    both = near.join(radius(gt, "left_id", "rg"), ["case_id", "left_id"]).join(radius(pred, "right_id", "rp"), ["case_id", "right_id"])
    return both.groupBy("case_id").agg(F.avg("distance").alias("mean_distance"), F.avg(F.when(F.col("distance") > F.col("rg"), 0.0).otherwise(F.abs(F.col("rp") - F.col("rg")))).alias("radius_error"))


def branches_caught(points: DataFrame, distances: DataFrame) -> DataFrame:
    """Share in percent of branches (points: case_id, point_id, branch, radius) none of whose points is farther (distance) than its radius."""
    rows = points.join(distances, ["case_id", "point_id"]).groupBy("case_id", "branch").agg(F.bool_and(F.col("distance") <= F.col("radius")).alias("caught"))
    return rows.groupBy("case_id").agg((100.0 * F.count_if("caught") / (F.max("branch") + 1)).alias("percent"))


def score_table(keys: list[str], *tables: DataFrame) -> DataFrame:
    """One row per key with all metrics; NaN where a metric's table lacks the key."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, keys, "full_outer")
    return out.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in out.columns if c not in keys])
