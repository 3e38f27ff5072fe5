"""Images and label volumes as rows (case_id, i, j, k, value, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoframe.functions.columns import finite, unit_hash
from geoframe.operators.ranges import joined, quantiles

INDEX = ("i", "j", "k")
FACES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))
AROUND = tuple((a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0))


def volume_stats(voxels: DataFrame, value: str = "value") -> DataFrame:
    """Per case: least, greatest, mean, deviation, median, voxels that aren't 0, voxels."""
    v = F.col(value)
    sums = voxels.groupBy("case_id").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count_if(v != 0).alias("n_nonzero"), F.count("*").alias("n_total"))
    return joined(sums, quantiles(voxels, ["case_id"], value, {"median": 0.5}), ["case_id"], "left")


def label_histogram(voxels: DataFrame, label: str = "label") -> DataFrame:
    """Per case and label: voxels and their share of the case in percent."""
    counts = voxels.groupBy("case_id", F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("case_id")))


def mask_or_image(voxels: DataFrame, is_float: bool = False, value: str = "value") -> DataFrame:
    """Per case what the values look like: mask, image or unknown. The rule's five values are the smallest distinct ones."""
    v = F.col(value)
    counts = voxels.groupBy("case_id", v.alias("v")).agg(F.count("*").alias("n"))
    # A rank that is filtered at once is cut before the shuffle, so a case of many values is no hot group.
    first = counts.withColumn("r", F.row_number().over(Window.partitionBy("case_id").orderBy("v"))).where("r <= 5").groupBy("case_id").agg(F.sum("n").alias("n5"))
    stats = counts.groupBy("case_id").agg(F.count("*").alias("n_distinct"), F.bool_and(F.col("v") == F.floor("v")).alias("whole"), F.sum("n").alias("n")).join(first, "case_id").withColumn("share5", F.col("n5") / F.col("n"))
    spread = voxels.groupBy("case_id").agg(F.stddev_pop(v).alias("std"))
    kind = (
        F.when((F.col("n_distinct") <= 10) & F.col("whole"), "mask")
        .when((F.col("n_distinct") <= 20) & F.col("whole") & (F.col("share5") > 0.95), "mask")
        .when(F.col("n_distinct") > 50, "image")
        .when(F.lit(is_float), "image")
        .when((F.col("n_distinct") > 20) & (F.col("std") > 10), "image")
        .otherwise("unknown")
    )
    return stats.join(spread, "case_id").select("case_id", "n_distinct", kind.alias("kind"))


def misplaced_files(kinds: DataFrame) -> DataFrame:
    """Of kinds (folder, case_id, kind) the masks in images and the images in truths."""
    return kinds.where("(folder = 'images' and kind = 'mask') or (folder = 'truths' and kind = 'image')")


def bbox_of_label(voxels: DataFrame, where: Column) -> DataFrame:
    """Per case the least and greatest index on each axis of the voxels that meet the condition."""
    return voxels.where(where).groupBy("case_id").agg(*[f(c).alias(f"{n}_{c}") for c in INDEX for n, f in (("min", F.min), ("max", F.max))])


def centre_of_mass(voxels: DataFrame, where: Column) -> DataFrame:
    """Per case the mean index of the voxels that meet the condition, cut to whole numbers."""
    return voxels.where(where).groupBy("case_id").agg(*[F.avg(c).cast("int").alias(f"c{c}") for c in INDEX])


def extract_boxes(voxels: DataFrame, boxes: DataFrame, block: int = 16) -> DataFrame:
    """Voxels inside each box (case_id, box_id, i0, j0, k0, ni, nj, nk), with indices from the box's corner (bi, bj, bk)."""
    celled = boxes
    for c in INDEX:
        celled = celled.withColumn(f"__b{c}", F.explode(F.sequence(F.floor(F.col(f"{c}0") / block).cast("long"), F.floor((F.col(f"{c}0") + F.col(f"n{c}") - 1) / block).cast("long"))))
    placed = voxels
    for c in INDEX:
        placed = placed.withColumn(f"__b{c}", F.floor(F.col(c) / block).cast("long"))
    pairs = placed.join(celled, ["case_id", *[f"__b{c}" for c in INDEX]])
    for c in INDEX:
        pairs = pairs.where((F.col(c) >= F.col(f"{c}0")) & (F.col(c) < F.col(f"{c}0") + F.col(f"n{c}"))).withColumn(f"b{c}", F.col(c) - F.col(f"{c}0"))
    return pairs.drop(*[f"__b{c}" for c in INDEX])


def sample_intensity_stats(boxed: DataFrame) -> DataFrame:
    """Per box of boxed voxels (value, label): statistics of the image, of the blood (label > 0.1) and of the label."""
    blood = F.when(F.col("label") > 0.1, F.col("value"))
    parts = [("IM", F.col("value")), ("BLOOD", blood), ("GT", F.col("label"))]
    return boxed.groupBy("case_id", "box_id").agg(*[f(c).alias(f"{n}_{s}") for n, c in parts for s, f in (("MEAN", F.avg), ("STD", F.stddev_pop), ("MIN", F.min), ("MAX", F.max))], F.count("*").alias("n_voxels"))


def with_case_sums(voxels: DataFrame, *sums: Column) -> DataFrame:
    """Voxels with aggregates of their case: a join with a row per case, so no task holds a whole volume. A null case_id is a case."""
    per = voxels.groupBy(F.col("case_id").alias("__case")).agg(*sums)
    return voxels.join(per, F.col("case_id").eqNullSafe(F.col("__case"))).drop("__case")


def binarize(voxels: DataFrame, label: str = "label") -> DataFrame:
    """label over its case's maximum, cut to whole numbers: 1 where it is the maximum."""
    share = F.coalesce(F.try_divide(F.col(label), F.col("__top")), F.lit(0)).cast("int")
    return with_case_sums(voxels, F.max(label).alias("__top")).withColumn(label, share).drop("__top")


def remap_labels(voxels: DataFrame, mapping: dict[int, int], label: str = "label") -> DataFrame:
    """Labels by the mapping; others stay."""
    given = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return voxels.withColumn(label, F.coalesce(F.try_element_at(given, F.col(label)), F.col(label)))


def dense_labels(voxels: DataFrame, label: str = "label") -> DataFrame:
    """Labels of each case as 0, 1, 2 .. by their order."""
    distinct = voxels.select("case_id", label).distinct().withColumn("__d", F.row_number().over(Window.partitionBy("case_id").orderBy(label)) - 1)
    return voxels.join(distinct, ["case_id", label]).withColumn(label, F.col("__d")).drop("__d")


def overlay_labels(first: DataFrame, vessel: DataFrame, keep: list[int], vessel_label: int) -> DataFrame:
    """One label per voxel of both: a kept label of first wins, then the vessel, then first's."""
    key = ["case_id", *INDEX]
    both = first.select(*key, F.col("label").alias("a")).join(vessel.select(*key, F.col("label").alias("b")), key, "full_outer")
    return both.select(*key, F.when(F.col("a").isin(keep), F.col("a")).when(F.col("b") > 0, vessel_label).otherwise(F.coalesce("a", F.lit(0))).alias("label"))


def apply_mask(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """value is 0 where the mask (label > 0) isn't."""
    key = ["case_id", *INDEX]
    inside = mask.where("label > 0").select(*key, F.lit(True).alias("__in"))
    return voxels.join(inside, key, "left").withColumn("value", F.when(F.col("__in"), F.col("value")).otherwise(0)).drop("__in")


def erase_boundary(voxels: DataFrame, sizes: dict[str, int], p: int, label: str = "label") -> DataFrame:
    """label is 0 within p voxels of the volume's faces."""
    border = F.lit(False)
    for c in INDEX:
        border = border | (F.col(c) < p) | (F.col(c) >= sizes[c] - p)
    return voxels.withColumn(label, F.when(border, 0).otherwise(F.col(label)))


def crop_to_label(voxels: DataFrame, where: Column, pad: int) -> DataFrame:
    """Voxels within pad of the box around those that meet the condition, with indices from its corner."""
    box = bbox_of_label(voxels, where)
    out = voxels.join(box, "case_id")
    for c in INDEX:
        out = out.where(F.col(c).between(F.col(f"min_{c}") - pad, F.col(f"max_{c}") + pad))
    for c in INDEX:
        out = out.withColumn(c, F.col(c) - F.greatest(F.col(f"min_{c}") - pad, F.lit(0)))
    return out.select(*voxels.columns)


def tile_patches(volumes: DataFrame, size: int) -> DataFrame:
    """Corners (case_id, i0, j0, k0) of patches that cover each volume (ni, nj, nk), and of those half a patch on, kept inside."""
    out = volumes
    for c in INDEX:
        at = F.sequence(F.lit(0).cast("long"), F.ceil(F.col(f"n{c}") / size) - 1)
        both = F.array_union(F.transform(at, lambda t: t * size), F.transform(at, lambda t: t * size + size // 2))
        out = out.withColumn("__at", F.explode(both)).withColumn(f"{c}0", F.least(F.col("__at"), F.greatest(F.col(f"n{c}") - size, F.lit(0))))
    return out.select("case_id", "i0", "j0", "k0").distinct()


def resampled_size(size, spacing, new_spacing) -> Column:
    return F.ceil(F.col(size) * F.col(spacing) / F.lit(new_spacing)).cast("long")


def resample_nearest(voxels: DataFrame, factor: float) -> DataFrame:
    """Volumes on a grid of `factor` times the spacing: each new voxel has the value of the nearest old one (half even)."""
    sizes = voxels.groupBy("case_id").agg(*[(F.max(c) + 1).alias(f"n{c}") for c in INDEX])
    grid = sizes
    for c in INDEX:
        n = F.ceil(F.col(f"n{c}") / factor).cast("int")
        grid = grid.withColumn(f"t{c}", F.explode(F.sequence(F.lit(0), n - 1)))
    wanted = grid.select("case_id", *[F.col(f"t{c}") for c in INDEX], *[F.least(F.rint(F.col(f"t{c}") * factor).cast("long"), F.col(f"n{c}") - 1).alias(c) for c in INDEX])
    return wanted.join(voxels, ["case_id", *INDEX]).select("case_id", *[F.col(f"t{c}").cast("long").alias(c) for c in INDEX], "value")


def gather_linear(places: DataFrame, voxels: DataFrame, key: list[str]) -> DataFrame:
    """Per place (key, case_id, px, py, pz in voxel units) the value between its eight voxels, by weight; missing ones are left out."""
    corners = places.withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(7))))
    weight = F.lit(1.0)
    for bit, (p, c) in enumerate(zip(("px", "py", "pz"), INDEX)):
        up = F.shiftright("__c", bit).bitwiseAND(F.lit(1))
        corners = corners.withColumn(c, (F.floor(p) + up).cast("long"))
        part = F.col(p) - F.floor(p)
        weight = weight * F.when(up == 1, part).otherwise(1 - part)
    weighed = corners.withColumn("__w", weight).where("__w > 0").join(voxels.select("case_id", *INDEX, "value"), ["case_id", *INDEX])
    return weighed.groupBy(*key).agg(F.try_divide(F.sum(F.col("__w") * F.col("value")), F.sum("__w")).alias("value"))


def centre_planes(voxels: DataFrame) -> DataFrame:
    """The three middle planes of each volume, with the axis they stand on."""
    sized = with_case_sums(voxels, *[F.floor((F.max(c) + 1) / 2).alias(f"__m{c}") for c in INDEX])
    on = F.filter(F.array(*[F.when(F.col(c) == F.col(f"__m{c}"), c) for c in INDEX]), lambda a: a.isNotNull())
    return sized.withColumn("axis", F.explode(on)).select(*voxels.columns, "axis")


def boundary_planes(voxels: DataFrame, deep: int = 1) -> DataFrame:
    """The six outer planes, so many voxels deep, with axis and side."""
    sized = with_case_sums(voxels, *[F.max(c).alias(f"__m{c}") for c in INDEX])
    sides = [(c, s, F.col(c) < deep if s == "low" else F.col(c) > F.col(f"__m{c}") - deep) for c in INDEX for s in ("low", "high")]
    on = F.filter(F.array(*[F.when(there, F.struct(F.lit(c).alias("axis"), F.lit(s).alias("side"))) for c, s, there in sides]), lambda a: a.isNotNull())
    return sized.withColumn("__on", F.explode(on)).select(*voxels.columns, "__on.axis", "__on.side")


def ct_rescale(value, low: float, high: float) -> Column:
    """Clamped to [low, high], over half their distance."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.col(value))) / ((high - low) / 2)


def mr_rescale(voxels: DataFrame, value: str = "value") -> DataFrame:
    """Per case clamped to its 20th and 99th percentile, scaled to [-1, 1]."""
    ends = quantiles(voxels, ["case_id"], value, {"__lo": 0.2, "__hi": 0.99})
    lo, hi = F.col("__lo"), F.col("__hi")
    clamped = F.greatest(lo, F.least(hi, F.col(value)))
    return voxels.join(ends, "case_id").withColumn(value, 2 * F.try_divide(clamped - lo, hi - lo) - 1).drop("__lo", "__hi")


def flip_permute(voxels: DataFrame, flips: str = "", order: tuple[str, str, str] = INDEX) -> DataFrame:
    """Mirror the axes in flips (against each case's size), then axes in the given order."""
    sized = with_case_sums(voxels, *[F.max(c).alias(f"__m{c}") for c in flips]) if flips else voxels
    moved = {c: (F.col(f"__m{c}") - F.col(c)) if c in flips else F.col(c) for c in INDEX}
    rest = [c for c in voxels.columns if c not in INDEX]
    turned = sized.select(*rest, *[moved[c].alias(f"__{c}") for c in INDEX])
    return turned.select(*rest, *[F.col(f"__{o}").alias(c) for c, o in zip(INDEX, order)]).select(*voxels.columns)


def augment(voxels: DataFrame, tag: str, p_flip: float = 0.5, p_gamma: float = 0.5, p_noise: float = 0.5, sigma: float = 0.05) -> DataFrame:
    """Per case and operation a hashed draw decides: flip along i, gamma of the scaled value, noise by Box-Muller over hashes."""
    on = lambda name, p: unit_hash("case_id", F.lit(f"{tag}-{name}")) < p
    sized = with_case_sums(voxels, F.min("value").alias("__lo"), F.max("value").alias("__hi"), F.max("i").alias("__mi"))
    scaled = F.coalesce(F.try_divide(F.col("value") - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    staged = sized.withColumn("__v", scaled).withColumn("i", F.when(on("flip", p_flip), F.col("__mi") - F.col("i")).otherwise(F.col("i"))).drop("__lo", "__hi", "__mi")
    gamma = 0.7 + 0.6 * unit_hash("case_id", F.lit(f"{tag}-g"))
    u, v = (F.greatest(unit_hash("case_id", "i", "j", "k", F.lit(f"{tag}-{n}")), F.lit(1e-4)) for n in ("u", "v"))
    noise = sigma * F.sqrt(-2 * F.ln(u)) * F.cos(2 * 3.141592653589793 * v)
    value = F.when(on("gamma", p_gamma), F.pow("__v", gamma)).otherwise(F.col("__v"))
    return staged.withColumn("value", value + F.when(on("noise", p_noise), noise).otherwise(0.0)).drop("__v")


def padded(voxels: DataFrame, size: dict[str, int], value: float = 0) -> DataFrame:
    """Every voxel (case_id, i, j, k, value) of grids at least so large; a volume lies in the middle, the odd voxel above it.

    Voxels that a volume lacks hold the given value.
    """
    grid = voxels.groupBy("case_id").agg(*[(F.max(c) + 1).alias(f"__n{c}") for c in INDEX])
    for c in INDEX:
        wide = F.greatest(F.col(f"__n{c}"), F.lit(size[c]))
        grid = grid.withColumn(f"__d{c}", F.floor((wide - F.col(f"__n{c}")) / 2)).withColumn(f"__t{c}", F.explode(F.sequence(F.lit(0).cast("long"), wide - 1)))
    asked = grid.select("case_id", *[F.col(f"__t{c}") for c in INDEX], *[(F.col(f"__t{c}") - F.col(f"__d{c}")).alias(c) for c in INDEX])
    own = voxels.select("case_id", *INDEX, "value", F.lit(True).alias("__own"))
    return asked.join(own, ["case_id", *INDEX], "left").select("case_id", *[F.col(f"__t{c}").alias(c) for c in INDEX], F.when(F.col("__own"), F.col("value")).otherwise(value).alias("value"))


def cropped(voxels: DataFrame, size: dict[str, int], start: dict[str, Column]) -> DataFrame:
    """Voxels of a box of that size, with indices from its corner; start may use __ni, __nj, __nk, the volume's size. An axis that is shorter stays whole."""
    out = with_case_sums(voxels, *[(F.max(c) + 1).alias(f"__n{c}") for c in INDEX])
    for c in INDEX:
        room = F.greatest(F.col(f"__n{c}") - size[c], F.lit(0))
        out = out.withColumn(f"__s{c}", F.greatest(F.lit(0), F.least(room, start[c].cast("long"))))
    for c in INDEX:
        out = out.where(F.col(c).between(F.col(f"__s{c}"), F.col(f"__s{c}") + size[c] - 1)).withColumn(c, F.col(c) - F.col(f"__s{c}"))
    return out.select(*voxels.columns)


def centre_crop(voxels: DataFrame, size: dict[str, int]) -> DataFrame:
    return cropped(voxels, size, {c: F.floor((F.col(f"__n{c}") - size[c]) / 2) for c in INDEX})


def random_crop(voxels: DataFrame, size: dict[str, int], tag: str) -> DataFrame:
    """Each case's box by hashed draws."""
    return cropped(voxels, size, {c: F.floor((F.col(f"__n{c}") - size[c]) * unit_hash("case_id", F.lit(f"{tag}-crop-{c}"))) for c in INDEX})


def mask_crop(voxels: DataFrame, size: dict[str, int], tag: str, label: str = "label") -> DataFrame:
    """A box around a hashed choice of each case's voxels with a label, the voxel anywhere in it; as random_crop() without any."""
    draw = unit_hash("case_id", *INDEX, F.lit(f"{tag}-mask"))
    chosen = F.min(F.when(F.col(label) > 0, F.struct(draw.alias("u"), *INDEX))).alias("__at")
    placed = with_case_sums(voxels, chosen)
    at = lambda c: F.col(f"__at.{c}") - F.floor(unit_hash("case_id", F.lit(f"{tag}-in-{c}")) * size[c])
    free = lambda c: F.floor((F.col(f"__n{c}") - size[c]) * unit_hash("case_id", F.lit(f"{tag}-crop-{c}")))
    return cropped(placed, size, {c: F.coalesce(at(c), free(c)) for c in INDEX}).select(*voxels.columns)


def quarter_turns(voxels: DataFrame, turns: Column, plane: tuple[str, str] = ("i", "j")) -> DataFrame:
    """Each case turned so many times by 90 degrees, the first axis of the plane towards the second."""
    a, b = plane
    out = with_case_sums(voxels, F.max(a).alias("__a"), F.max(b).alias("__b")).withColumn("__t", F.pmod(turns, F.lit(4)))
    low = {a: F.col("__a") - F.col(a), b: F.col("__b") - F.col(b)}
    pick = lambda *four: F.when(F.col("__t") == 0, four[0]).when(F.col("__t") == 1, four[1]).when(F.col("__t") == 2, four[2]).otherwise(four[3])
    turned = {a: pick(F.col(a), low[b], low[a], F.col(b)), b: pick(F.col(b), F.col(a), low[b], low[a])}
    return out.select(*[turned[c].alias(c) if c in turned else c for c in voxels.columns])


def normalised(voxels: DataFrame, value: str = "value") -> DataFrame:
    """Per case less the mean, over the deviation; 0 where all values are equal. Scaling by the range before would change nothing."""
    out = with_case_sums(voxels, F.avg(value).alias("__m"), F.stddev_pop(value).alias("__d"))
    z = F.coalesce(F.try_divide(F.col(value) - F.col("__m"), F.col("__d")), F.when(F.col(value).isNotNull(), 0.0))
    return out.withColumn(value, z).drop("__m", "__d")


def shifted(voxels: DataFrame, offsets) -> DataFrame:
    """Each voxel's index once per offset, as ni, nj, nk."""
    moves = F.explode(F.array(*[F.struct(*[F.lit(d).alias(c) for d, c in zip(o, INDEX)]) for o in offsets]))
    return voxels.select("*", moves.alias("__o")).select("*", *[(F.col(c) + F.col(f"__o.{c}")).alias(f"n{c}") for c in INDEX]).drop("__o")


def neighbour_edges(voxels: DataFrame, offsets=FACES) -> DataFrame:
    """Pairs (case_id, src, dst) of ids of voxels (case_id, id, i, j, k) that are neighbours; src < dst."""
    half = [o for o in offsets if o > (0, 0, 0)]
    near = shifted(voxels.select("case_id", "id", *INDEX), half).select("case_id", F.col("id").alias("src"), *[F.col(f"n{c}").alias(c) for c in INDEX])
    return near.join(voxels.select("case_id", F.col("id").alias("dst"), *INDEX), ["case_id", *INDEX]).select("case_id", "src", "dst")


def exposed_faces(voxels: DataFrame) -> DataFrame:
    """Per case the sides of label voxels (case_id, i, j, k) without a neighbour: the blocky surface, two triangles a side."""
    here = voxels.select("case_id", *INDEX).distinct()
    near = shifted(here, FACES)
    there = here.select("case_id", *[F.col(c).alias(f"n{c}") for c in INDEX])
    return near.join(there, ["case_id", "ni", "nj", "nk"], "left_anti")


def voxel_updates(boxes: DataFrame) -> DataFrame:
    """Per voxel in any of the boxes (case_id, i0, j0, k0, ni, nj, nk): how many cover it."""
    out = boxes
    for c in INDEX:
        out = out.withColumn(c, F.explode(F.sequence(F.col(f"{c}0"), F.col(f"{c}0") + F.col(f"n{c}") - 1)))
    return out.groupBy("case_id", *INDEX).agg(F.count("*").alias("n"))


def ensemble_average(preds: DataFrame, n_methods: int) -> DataFrame:
    """Per voxel the labels of all methods (case_id, method, i, j, k, label) over their number, and whether any has it."""
    return preds.groupBy("case_id", *INDEX).agg((F.sum("label") / n_methods).alias("mean"), F.max((F.col("label") > 0).cast("int")).alias("any"))


def mean_threshold_filter(voxels: DataFrame, label: str, over: float) -> DataFrame:
    """Cases whose mean label is over the threshold."""
    return voxels.groupBy("case_id").agg(F.avg(label).alias("mean")).where(F.col("mean") > over)


def header_survey(volumes: DataFrame) -> DataFrame:
    """Spacing and size of every volume (case_id, size, spacing), sorted."""
    return volumes.select("case_id", *[F.col("spacing")[a].alias(f"spacing_{c}") for a, c in enumerate("xyz")], *[F.col("size")[a].alias(f"size_{c}") for a, c in enumerate("xyz")]).orderBy("spacing_x", "spacing_y", "spacing_z", "case_id")


def resolution_report(volumes: DataFrame, points: DataFrame) -> DataFrame:
    """Per case: finest and coarsest spacing, radius quantiles, least radius over the coarsest spacing; under 1 is under-resolved."""
    spacing = volumes.select("case_id", F.array_min("spacing").alias("finest"), F.array_max("spacing").alias("coarsest"))
    shares = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    radii = joined(points.groupBy("case_id").agg(F.min("radius").alias("min_radius")), quantiles(points, ["case_id"], "radius", shares), ["case_id"], "left")
    ratio = F.col("min_radius") / F.col("coarsest")
    return spacing.join(radii, "case_id").select("case_id", "finest", "coarsest", *shares, ratio.alias("ratio"), (ratio < 1).alias("under_resolved"))


def finite_values(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, finite(c))
    return df
