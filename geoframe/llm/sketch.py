"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions only.

A sketch keeps every distinct shingle hash that lies in the lowest FRACTION of all hashes. As the threshold is the same
for every document, sketches can be merged (union), and the share of a short document's sketch that a long one's holds
estimates containment however unequal they are. The smallest hash of all is kept apart: it compares texts of so few
shingles that none is under the threshold, and is no part of a sketch that is merged.

Words are what white space separates, letters lowered; a shingle is five words. Edge cases: a text of fewer words is one
shingle; a null or empty text, or one of white space alone, is the shingle of no words; rows that share a doc_id follow
each other in the order of a hash of their text, repeated rows too; a null doc_id comes first; a table of one document
has itself as next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoframe.plans.storage import stored

SHINGLE, FRACTION = 5, 8
#: Hashes are signed; those below this are the lowest 1 / FRACTION.
THRESHOLD = -(1 << 63) + (1 << 64) // FRACTION


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the sketch of the column text as the column name: hashes (those under the threshold, ascending, maybe none) and
    least, the smallest hash of all, which is kept apart."""
    words, hashes = f"__{name}_words", f"__{name}_hashes"
    shingle = lambda i: F.xxhash64(F.slice(F.col(words), i, SHINGLE))
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1)))
    return (
        df.withColumn(words, F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[ \t-\r]+"), ""))
        .withColumn(hashes, F.transform(places, shingle))
        .withColumn(name, F.struct(F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < THRESHOLD))).alias("hashes"), F.array_min(hashes).alias("least")))
        .drop(words, hashes)
    )


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents taken together: just that of the union of their shingles."""
    return F.struct(F.array_sort(F.array_union(a["hashes"], b["hashes"])).alias("hashes"), F.least(a["least"], b["least"]).alias("least"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the shingle sets behind two sketches, estimated; of two without hashes, whether their smallest are the same."""
    both = F.size(F.array_intersect(a["hashes"], b["hashes"]))
    either = F.size(a["hashes"]) + F.size(b["hashes"]) - both
    return F.when(either > 0, both / either).otherwise((a["least"] == b["least"]).cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Share of the first one's shingles that the second has, estimated: 1 if the second holds the first, however short that is.

    A first sketch without hashes tells only that its text is not held if the second one's smallest hash is larger than its own.
    """
    n = F.size(a["hashes"])
    return F.when(n > 0, F.size(F.array_intersect(a["hashes"], b["hashes"])) / n).otherwise((b["least"] <= a["least"]).cast("double"))


def as_text(sketch: Column) -> Column:
    """The sketch's hashes, 16 hex digits each; if there are none, "-" and the smallest hash."""
    digits = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.lower(F.when(F.size(sketch["hashes"]) > 0, F.array_join(F.transform(sketch["hashes"], digits), "")).otherwise(F.concat(F.lit("-"), digits(sketch["least"]))))


def with_range(docs: DataFrame) -> DataFrame:
    """docs (id, th, ..) with range, the number of the stretch of the order by (id, th) that a row is in.

    Stretches have about equally many rows. Only keys are sorted for that; rows find their stretch by the last keys of
    all, some per shuffle partition, in two steps of about the square root of their number.
    """
    n = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select("id", "th").repartitionByRange(n, "id", "th").withColumn("range", F.spark_partition_id())
    lasts = [r.last for r in ranged.groupBy("range").agg(F.max(F.struct("id", "th")).alias("last")).orderBy("range").collect()][:-1]
    side = max(1, round(len(lasts) ** 0.5))
    groups = [lasts[i : i + side] for i in range(0, len(lasts), side)]
    keys = lambda rows: [{"id": r.id, "th": r.th} for r in rows]
    kind = "array<struct<id:long,th:long>>"
    coarse, fine = F.from_json(F.lit(json.dumps(keys(g[-1] for g in groups))), kind), F.from_json(F.lit(json.dumps([keys(g) for g in groups])), f"array<{kind}>")
    before = lambda some: F.size(F.filter(some, lambda b: (b.id < F.col("id")) | ((b.id == F.col("id")) & (b.th < F.col("th")))))
    group = docs.withColumn("__group", before(coarse))
    inside = F.coalesce(before(F.get(fine, F.col("__group"))), F.lit(0))
    return group.withColumn("range", F.col("__group") * side + F.greatest(inside, F.lit(0))).drop("__group")


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Each text's sketch, that of its edited text (the last half replaced by the start of the next document), and their likeness."""
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    placed = with_range(named)
    # The first document of each range follows the last of the range before it; after the last range comes the first.
    firsts = stored(placed.groupBy("range").agg(F.min(F.struct("id", "th")).alias("k")).select("range", "k.id", "k.th"), "first-keys")
    over = Window.orderBy("range")
    followed = firsts.select("id", "th", F.coalesce(F.lag("range").over(over), F.max("range").over(Window.partitionBy())).alias("range"))
    heads = named.select("id", "th", "text").join(F.broadcast(followed), ["id", "th"]).dropDuplicates(["range"])  # a key per range
    heads = with_sketch(heads, "text", "first_sketch").select("range", F.col("text").alias("first_text"), "first_sketch")
    w = Window.partitionBy("range").orderBy("id", "th")
    sketched = with_sketch(placed.repartition("range"), "text", "sketch")
    ahead = sketched.select("*", F.lead("text").over(w).alias("next_text"), F.lead("sketch").over(w).alias("next_sketch"))
    whole = ahead.join(heads, "range").withColumn("next_text", F.coalesce("next_text", "first_text")).withColumn("next_sketch", F.coalesce("next_sketch", "first_sketch"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    sized = whole.withColumn("n_chars", F.length("text").cast("long")).withColumn("__half", half)
    edited = sized.withColumn("edited", F.concat(F.expr("left(text, int(n_chars) - __half)"), F.expr("left(next_text, __half)")))
    done = with_sketch(edited, "edited", "edited_sketch")
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_within"),
    )
