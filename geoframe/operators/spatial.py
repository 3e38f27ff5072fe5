"""Joins in space, written as equal joins on grid cells with the exact test after them."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoframe.functions.columns import distance2, vec
from geoframe.operators.ranges import in_ranges, joined
from geoframe.plans.storage import stored_large, tasks_for

#: Points that one task compares with those of the cells around.
THINNED = 30_000


def cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def radius_bucket(df: DataFrame, value: str, edges: list[tuple[float, float | None]]) -> DataFrame:
    """df with lo and hi of the interval [lo, hi) that holds the value; rows in none are dropped. Few edges: one expression."""
    found = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(edges):
        inside = F.col(value) >= lo if hi is None else (F.col(value) >= lo) & (F.col(value) < hi)
        found = F.when(found.isNull() & inside, i).otherwise(found)
    pick = lambda side: F.element_at(F.array(*[F.lit(e[side]).cast("double") for e in edges]), F.col("__i") + 1)
    return df.withColumn("__i", found).where("__i is not null").withColumn("lo", pick(0)).withColumn("hi", pick(1)).drop("__i")


def interval_join(rows: DataFrame, intervals: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """rows with the columns of the interval [lo, hi) of their keys (intervals: keys, lo, hi, ..; a null hi has no end) that holds
    the value; rows in none are dropped. The intervals of a key don't overlap; between them there may be holes.

    Both sides are merged by their ends: in the order of keys and place the last interval that began is the only one that can
    hold a value. It is carried into later ranges of the order, so neither a key nor a value needs one task.
    """
    more = [c for c in intervals.columns if c not in keys]
    started = intervals.where("lo is not null").select(*keys, F.col("lo").cast("double").alias("__at"), F.lit(0).alias("__kind"), F.lit(0).cast("long").alias("__tie"), F.struct(*more).alias("__interval"), F.lit(None).cast(rows.schema).alias("__row"))
    asked = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__at"), F.lit(1).alias("__kind"), F.xxhash64(*rows.columns).alias("__tie"), F.lit(None).cast(started.schema["__interval"].dataType).alias("__interval"), F.struct(*rows.columns).alias("__row"))
    order = ["__at", "__kind", "__tie"]
    ranged = in_ranges(started.unionByName(asked), [*keys, *order])
    # The last interval that begins in each range, and of the ranges before it.
    lasts = ranged.groupBy("__range", *keys).agg(F.max_by("__interval", F.when(F.col("__kind") == 0, F.col("__at"))).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = stored_large(lasts.select("__range", *keys, F.last("__last", ignorenulls=True).over(earlier).alias("__carried")), "carried")
    upto = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = ranged.withColumn("__here", F.last("__interval", ignorenulls=True).over(upto)).where("__kind = 1")
    found = joined(held, carried, ["__range", *keys]).withColumn("__interval", F.coalesce("__here", "__carried"))
    inside = F.col("__interval").isNotNull() & (F.col("__interval.hi").isNull() | (F.col("__at") < F.col("__interval.hi")))
    return found.where(inside).select("__row.*", *[F.col("__interval")[c].alias(c) for c in more])


def points_in_boxes(points: DataFrame, boxes: DataFrame, closed: bool = True, key: str = "case_id", tasks: int | None = None) -> DataFrame:
    """Pairs of points (key, x, y, z) and boxes (key, box_id, lox, loy, loz, hix, hiy, hiz) that hold them; keys are not null.

    A box is looked for in cells whose side is the power of two from its own longest side up, so it lies in eight at most,
    however large or small. Points are in a cell of each size that a box of their key asks for. Boxes without finite ends hold nothing.
    Where many pairs come from few rows, cells are dealt to so many tasks.
    """
    ends = [f"{end}{c}" for end in ("lo", "hi") for c in "xyz"]
    finite = boxes.where(finite_point(*ends))
    side = F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"])
    level = F.when(side > 2.0**-30, F.ceil(F.log2(side))).otherwise(-30).cast("int")
    celled = finite.withColumn("__level", level).withColumn("__size", F.pow(F.lit(2.0), F.col("__level")))
    sizes = celled.select(key, "__level", "__size").distinct()
    placed = points.where(finite_point("x", "y", "z")).join(sizes.hint("merge"), key)
    for c in "xyz":
        at = lambda v: F.floor(F.col(v) / F.col("__size"))
        celled = celled.withColumn(f"__c{c}", F.explode(F.sequence(at(f"lo{c}"), at(f"hi{c}"))))
        placed = placed.withColumn(f"__c{c}", at(c))
    cells = [key, "__level", "__cx", "__cy", "__cz"]
    placed, celled = (rows.drop("__size").repartition(tasks, *cells) if tasks else rows.drop("__size") for rows in (placed, celled))
    pairs = placed.join(celled.hint("merge"), cells)
    for c in "xyz":
        inside = F.col(c).between(F.col(f"lo{c}"), F.col(f"hi{c}")) if closed else (F.col(c) > F.col(f"lo{c}")) & (F.col(c) < F.col(f"hi{c}"))
        pairs = pairs.where(inside)
    return pairs.drop("__level", "__cx", "__cy", "__cz")


def inside_sphere(points: DataFrame, centre: tuple[float, float, float], radius: float) -> DataFrame:
    return points.where(distance2(vec("x", "y", "z"), tuple(map(F.lit, centre))) <= radius * radius)


def out_of_bounds(points: DataFrame, bounds: DataFrame, most: int = 100) -> DataFrame:
    """Per case (bounds: case_id, lox .. hiz): points outside and the ids of the first of them."""
    outside = F.lit(False)
    for c in "xyz":
        outside = outside | ~F.col(c).between(F.col(f"lo{c}"), F.col(f"hi{c}"))
    rows = points.join(bounds, "case_id").where(outside).select("case_id", "point_id")
    # The limit on the rank is applied before the shuffle, too, so no task or list gets all points of a case.
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("point_id").asc_nulls_last()))).where(F.col("n") <= most)
    ids = first.groupBy("case_id").agg(F.sort_array(F.collect_list("point_id")).alias("first_ids"))
    return rows.groupBy("case_id").agg(F.count("*").alias("n_outside")).join(ids, "case_id")


def boxes_without_caps(boxes: DataFrame, caps: DataFrame) -> DataFrame:
    """The boxes that no cap point (case_id, x, y, z) lies strictly inside."""
    hit = points_in_boxes(caps, boxes, closed=False).select("case_id", "box_id").distinct()
    return boxes.join(hit, ["case_id", "box_id"], "left_anti")


def finite_point(*columns: str):
    """All coordinates are numbers of a size that squares."""
    return reduce(lambda a, b: a & b, [F.abs(F.col(c)) < 1e150 for c in columns])


def thin_points(points: DataFrame, t: float, key: str = "case_id") -> DataFrame:
    """The points (key, point_id, x, y, z) kept when each, by id, drops all later ones closer than t.

    Rounds: a point with no lower undecided neighbour within t is kept and its neighbours are dropped. Equals the greedy order.
    """
    points = stored_large(points.select(key, "point_id", *"xyz"), "thin-points")
    n, place = tasks_for(points, THINNED), [f"__c{c}" for c in "xyz"]
    celled = points.withColumns({f"__c{c}": cell(c, t) for c in "xyz"})
    # Of two neighbouring cells the lower looks into the higher, so each pair is met once.
    ahead = [d for d in product((-1, 0, 1), repeat=3) if d >= (0, 0, 0)]
    seen = F.explode(F.array(*[F.struct(*[(F.col(c) + s).alias(c) for c, s in zip(place, d)], F.lit(not any(d)).alias("own")) for d in ahead]))
    around = celled.select(key, F.col("point_id").alias("p"), *"xyz", seen.alias("__s")).select(key, "p", *"xyz", "__s.*")
    placed = celled.select(key, F.col("point_id").alias("q"), *[F.col(c).alias(f"r{c}") for c in "xyz"], *place)
    close = distance2(vec("x", "y", "z"), vec("rx", "ry", "rz")) < t * t
    met = around.repartition(n, key, *place).join(placed.repartition(n, key, *place).hint("merge"), [key, *place])
    pairs = met.where(close & F.when(F.col("own"), F.col("p") < F.col("q")).otherwise(F.col("p") != F.col("q")))
    conflicts = stored_large(pairs.select(key, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")), "conflicts")
    left, kept = stored_large(points.select(key, "point_id"), "thin-left"), None
    while True:
        blocked = conflicts.select(key, F.col("b").alias("point_id")).distinct().hint("merge")
        new = stored_large(left.join(blocked, [key, "point_id"], "left_anti"), "thin-kept")
        kept = new if kept is None else kept.union(new)
        if conflicts.isEmpty():
            return kept
        dropped = stored_large(conflicts.join(new.withColumnRenamed("point_id", "a"), [key, "a"], "left_semi").select(key, F.col("b").alias("point_id")).distinct(), "thin-dropped")
        gone = new.union(dropped).hint("merge")
        left = stored_large(left.join(gone, [key, "point_id"], "left_anti"), "thin-left")
        conflicts = stored_large(conflicts.join(gone.withColumnRenamed("point_id", "a"), [key, "a"], "left_anti").join(dropped.withColumnRenamed("point_id", "b"), [key, "b"], "left_anti"), "conflicts")


def points_in_polygon(points: DataFrame, contour: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, px, py) with inside: even-odd rule over the contour's closed edges (keys, seq, x, y).

    Edges and points meet in strips of y as high as the contour's edges are on average, so edges lie in about two strips each.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = contour.select(*keys, "x", "y", *[F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"{c}2") for c in ("x", "y")]).where("y <> y2")
    hit = (F.col("y") > F.col("py")) != (F.col("y2") > F.col("py"))
    cross_x = (F.col("x2") - F.col("x")) * (F.col("py") - F.col("y")) / (F.col("y2") - F.col("y")) + F.col("x")
    height = edges.groupBy(*keys).agg(F.avg(F.abs(F.col("y2") - F.col("y"))).alias("__h"))
    strip = lambda y: F.floor(y / F.col("__h")).cast("long")
    cut = edges.join(height, keys).withColumn("__s", F.explode(F.sequence(strip(F.least("y", "y2")), strip(F.greatest("y", "y2")))))
    placed = points.select(*keys, "px", "py").join(height, keys).withColumn("__s", strip(F.col("py")))
    crossings = placed.join(cut.drop("__h"), [*keys, "__s"]).where(hit & (F.col("px") < cross_x)).groupBy(*keys, "px", "py").agg(F.count("*").alias("n"))
    return points.join(crossings, [*keys, "px", "py"], "left").withColumn("inside", F.coalesce(F.col("n") % 2 == 1, F.lit(False))).drop("n")
