"""Column expressions: names and labels, numbers, vectors, and coordinates of images and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Names and labels


def strip_ext(name) -> Column:
    """File name without its extension; .nii.gz and .tar.gz count as one, a trailing .seg goes too."""
    return F.regexp_replace(F.regexp_replace(col(name), r"(\.nii\.gz|\.tar\.gz|\.[^./]*)$", ""), r"\.seg$", "")


def stem(path) -> Column:
    """strip_ext of a path's last part."""
    return strip_ext(F.substring_index(col(path), "/", -1))


def parse_pair(name) -> Column:
    """struct(first, second) of 'A_vs_B', cut at the first _vs_; null if there is none."""
    parts = F.split(col(name), "_vs_", 2)
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("first"), parts[1].alias("second")))


def modality_bucket(modality) -> Column:
    """CT and CTA are CT, MR and CT_MR are MR, anything else is Other."""
    m = F.upper(F.trim(col(modality)))
    return F.when(m.isin("CT", "CTA"), "CT").when(m.isin("MR", "CT_MR"), "MR").otherwise("Other")


def catalog_modality(modality) -> Column:
    """As modality_bucket, but other texts stay and blanks are null."""
    m = F.trim(col(modality))
    return F.when(m == "", F.lit(None)).otherwise(F.when(modality_bucket(m) != "Other", modality_bucket(m)).otherwise(m))


def bucket_label(lo, hi) -> Column:
    """'[lo, hi)' with one digit; a null upper edge is inf."""
    upper = F.when(col(hi).isNull(), "inf").otherwise(F.format_string("%.1f", col(hi).cast("double")))
    return F.concat(F.lit("["), F.format_string("%.1f", col(lo).cast("double")), F.lit(", "), upper, F.lit(")"))


def format_mean_std(mean, std) -> Column:
    """'mean ± std': scientific under 0.01 or from 1000, else three digits; a null mean is '-'."""

    def one(c):
        size = F.abs(c)
        return F.when((size != 0) & ((size < 0.01) | (size >= 1000)), F.format_string("%.2e", c)).otherwise(F.format_string("%.3f", c))

    m, s = col(mean), col(std)
    return F.when(m.isNull(), "-").when(s.isNull(), one(m)).otherwise(F.concat(one(m), F.lit(" ± "), one(s)))


#: Methods that are shown under a name of their own.
METHOD_NAMES = {"global_pred": "EGNN (ours)", "mc": "Marching Cubes"}


def method_label(folder) -> Column:
    """The name that a method's folder is shown under: smoothing folders end in a pass band (04 is 0.4) and a count of rounds."""
    name = F.trim(col(folder).cast("string"))
    band, rounds = F.regexp_extract(name, r"(?i)taubin.*_(\d+)_(\d+)$", 1), F.regexp_extract(name, r"(?i)taubin.*_(\d+)_(\d+)$", 2)
    digits = F.regexp_replace(F.substring(band, 2, 100), "0+$", "")
    shown = F.when(F.length(band) == 1, band).when(band.startswith("0"), F.concat(F.lit("0."), F.when(digits == "", "0").otherwise(digits))).otherwise(band)
    smooth = F.when(band != "", F.concat(F.lit("Taubin "), shown, F.lit("/"), rounds)).otherwise("Taubin")
    label = F.when(F.lower(name).contains("taubin"), smooth).otherwise(name)
    for key, value in METHOD_NAMES.items():
        label = F.when(name == key, value).otherwise(label)
    return label


def format_p(p) -> Column:
    """A p-value with three digits, '<0.001' under that."""
    return F.when(col(p) < 0.001, "<0.001").otherwise(F.format_string("%.3f", col(p)))


def case_to_patient(case) -> Column:
    """The first run of four digits in a case name, else the name."""
    digits = F.regexp_extract(col(case), r"(\d{4})", 1)
    return F.when(digits != "", digits).otherwise(col(case))


def sample_to_case(name) -> Column:
    """The case of a sample called case_N_sub."""
    return F.regexp_extract(col(name), r"^(.*)_[0-9]+_[0-9]+$", 1)


def params_sha10(json_text) -> Column:
    """First ten hex digits of the SHA-1 of a JSON text whose keys are sorted."""
    return F.substring(F.sha1(col(json_text)), 1, 10)


def natural_key(name) -> Column:
    """Sort key under which digit runs compare as numbers and letters without case."""
    runs = F.regexp_extract_all(F.lower(col(name)), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 20, "0")).otherwise(r)), "")


# Numbers


def finite(c) -> Column:
    """The number, or null if it is NaN or infinite; texts that are no numbers are null too."""
    v = col(c).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def rint(c) -> Column:
    """Half-even rounding."""
    return F.rint(col(c))


def unit_hash(*keys) -> Column:
    """A number in [0, 1) from the md5 of the keys joined by _: its first 8 bytes modulo 10000, as a share."""
    text = F.concat_ws("_", *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 16), 16, 10).cast("decimal(20,0)") % 10000 / F.lit(10000.0)


def window_level(v, centre, width) -> Column:
    """Linear from 0 to 1 across the window; 0 at or below it, 1 above."""
    low = col(centre) - col(width) / 2
    return F.when(col(v) <= low, 0.0).when(col(v) > low + col(width), 1.0).otherwise((col(v) - low) / col(width))


# Vectors


def vec(*names) -> Vector:
    return tuple(col(n) for n in names)


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Vector) -> Vector:
    """Unit vector; null for the zero vector."""
    n = F.nullif(norm(a), F.lit(0.0))
    return tuple(p / n for p in a)


def angle_deg(a: Vector, b: Vector) -> Column:
    """Angle between unit vectors in degrees; their product is clipped to [-1, 1]."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))))


def distance2(a: Vector, b: Vector) -> Column:
    d = sub(a, b)
    return dot(d, d)


# Coordinates


def phys_to_index(p, origin, spacing) -> Column:
    """Nearest voxel index of a coordinate (half-even), for an image along the axes."""
    return F.rint((col(p) - col(origin)) / col(spacing)).cast("long")


def index_to_phys(i, origin, spacing) -> Column:
    return col(origin) + col(i) * col(spacing)


def to_unit_box(p, lo, hi) -> Column:
    return (col(p) - col(lo)) / (col(hi) - col(lo))


def from_unit_box(u, lo, hi) -> Column:
    return col(lo) + col(u) * (col(hi) - col(lo))


def pixel_flip(y, img_size: int) -> Column:
    """Unit height to a pixel row counted from the top, shifted by half."""
    return (1 - (col(y) + 0.5)) * img_size


def rotation(axis: Vector, angle: Column) -> tuple[Vector, Vector, Vector]:
    """Rows of Rodrigues' matrix for a unit axis and an angle in radians."""
    x, y, z = axis
    c, s = F.cos(angle), F.sin(angle)
    t = 1 - c
    return (t * x * x + c, t * x * y - s * z, t * x * z + s * y), (t * x * y + s * z, t * y * y + c, t * y * z - s * x), (t * x * z - s * y, t * y * z + s * x, t * z * z + c)


def rigid_rotate(p: Vector, axis: Vector, angle: Column, centre: Vector) -> Vector:
    """p turned about centre; unchanged if the angle is within a degree of 0 or 180."""
    d = sub(p, centre)
    degrees = F.abs(F.degrees(angle))
    still = (degrees < 1) | (F.abs(degrees - 180) < 1)
    return tuple(F.when(still, a).otherwise(o + dot(row, d)) for a, o, row in zip(p, centre, rotation(axis, angle)))


def affine(p: Vector, scale: float, pivot: Vector | None = None) -> Vector:
    """Scaled about the pivot (the origin if none)."""
    if pivot is None:
        return tuple(c * scale for c in p)
    return tuple(o + (c - o) * scale for c, o in zip(p, pivot))


def lps_to_ras(p: Vector) -> Vector:
    return -p[0], -p[1], p[2]


def snap_to_grid(p, res: int, lo, hi) -> Column:
    """Nearest of res + 1 grid coordinates between lo and hi (half-even)."""
    return col(lo) + F.rint(to_unit_box(p, lo, hi) * res) / res * (col(hi) - col(lo))


def corners(size: Column, spacing: Column, origin: Column, direction: Column) -> list[Vector]:
    """The eight corners of a volume from its header arrays (direction: nine numbers by row)."""
    found = []
    for bits in range(8):
        index = [(size[a] - 1) * ((bits >> a) & 1) * spacing[a] for a in range(3)]
        found.append(tuple(origin[a] + sum(direction[3 * a + b] * index[b] for b in range(3)) for a in range(3)))
    return found


def volume_bounds(size: Column, spacing: Column, origin: Column, direction: Column) -> Column:
    """struct(lo, hi): arrays of the least and greatest corner coordinates."""
    at = corners(size, spacing, origin, direction)
    return F.struct(F.array(*[F.least(*[c[a] for c in at]) for a in range(3)]).alias("lo"), F.array(*[F.greatest(*[c[a] for c in at]) for a in range(3)]).alias("hi"))


def bounds_equal(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    gaps = [F.abs(a[side][i] - b[side][i]) <= tolerance for side in ("lo", "hi") for i in range(3)]
    return gaps[0] & gaps[1] & gaps[2] & gaps[3] & gaps[4] & gaps[5]
