"""Roles of cases and samples: hashed, stratified, random and named splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoframe.functions.columns import unit_hash
from geoframe.plans.storage import stored


def hash_role(case, line, val_prop: float, testing: bool = False) -> Column:
    """val if the hash of case_line is under val_prop and the line isn't the first, else train; test in testing mode."""
    if testing:
        return F.lit("test")
    return F.when((unit_hash(case, line) < val_prop) & (F.col(line) != 0), "val").otherwise("train")


def place_of(tag: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{tag}_"), F.col(key).cast("string")))


def stratified_split(pool: DataFrame, stratum: str, key: str, share: float, tag: str = "42") -> DataFrame:
    """pool with role: in each stratum n * share rounded (half even) are test, at least one and not all; a single case is train."""
    w = Window.partitionBy(stratum)
    n_test = F.when(F.col("__n") == 1, 0).otherwise(F.greatest(F.lit(1), F.least(F.rint(F.col("__n") * share).cast("int"), F.col("__n") - 1)))
    ranked = pool.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(place_of(tag, key), key)))
    return ranked.withColumn("role", F.when(F.col("__r") <= n_test, "test").otherwise("train")).drop("__n", "__r")


def numbered(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """df with the row's number (from 0) in the given order: ranges are counted first, so no task has all rows."""
    ranged = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.withColumn("__inside", inside).join(F.broadcast(offsets), "__range").withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__before", "__inside")  # a row per range


def case_slice(cases: DataFrame, key: str, percent: float, start: int = 0, end: int | None = None, tag: str = "42") -> DataFrame:
    """Of the cases in hashed order the first int(percent * n), then rows start to end of those."""
    ranked = numbered(cases.withColumn("__place", place_of(tag, key)), "__place", key, name="__index")
    n = int(percent * ranked.count())
    return ranked.where((F.col("__index") >= start) & (F.col("__index") < (n if end is None else min(n, end)))).drop("__index", "__place")


def random_split(cases: DataFrame, key: str, train_share: float, tag: str = "42") -> DataFrame:
    """cases with role: the first int(n * train_share) in hashed order are train, the others test."""
    ranked = numbered(cases.withColumn("__place", place_of(tag, key)), "__place", key, name="__index")
    n = int(train_share * ranked.count())
    return ranked.withColumn("role", F.when(F.col("__index") < n, "train").otherwise("test")).drop("__index", "__place")


def apply_named_splits(cases: DataFrame, tests: DataFrame) -> DataFrame:
    """Per split name of tests (split_name, case_id) every case of its first dataset: test if listed, else train."""
    first = cases.groupBy("case_id").agg(F.min("dataset").alias("dataset"))
    names = F.broadcast(tests.select("split_name").distinct())  # a row per split name
    listed = tests.select("split_name", "case_id").distinct().withColumn("role", F.lit("test"))
    return first.join(names).join(listed, ["split_name", "case_id"], "left").select("split_name", "dataset", "case_id", F.coalesce("role", F.lit("train")).alias("role"))


def role_from_text(value, mapping: dict[str, str] | None = None) -> Column:
    """The mapped role of a text (as it is, or lowered), else train or test by its start, else null."""
    text, low = F.trim(F.col(value)), F.lower(F.trim(F.col(value)))
    by_start = F.when(low.startswith("train"), "train").when(low.startswith("test"), "test")
    if not mapping:
        return by_start
    given = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(given, text), F.try_element_at(given, low), by_start)


def radius_labels(samples: DataFrame, roles: DataFrame, role: str, tangent: bool = False) -> DataFrame:
    """NAME, RADIUS (or with tangent TANGENTX..Z too) and labels of the samples whose NAME has the role."""
    columns = ["NAME", "RADIUS", *(["TANGENTX", "TANGENTY", "TANGENTZ"] if tangent else ["NUM_OUTLETS"]), "BIFURCATION"]
    return samples.join(roles.where(F.col("role") == role).select("NAME"), "NAME", "left_semi").select(*columns)


def split_overlap(roles: DataFrame, key: str = "case_id") -> DataFrame:
    """Keys that are both train and test; a sound split has none."""
    return roles.where("role = 'train'").select(key).intersect(roles.where("role = 'test'").select(key))


def subset_check(part: DataFrame, whole: DataFrame, key: str = "case_id") -> DataFrame:
    """Keys of part that whole lacks; none if it is a subset."""
    return part.select(key).distinct().join(whole.select(key), key, "left_anti")


def aggregate_split(tests: list[DataFrame], pool: DataFrame, stratum: str, key: str, share: float) -> DataFrame:
    """key and role: all given tests, and a stratified split of the pool without what they use."""
    given = tests[0].select(key)
    for t in tests[1:]:
        given = given.union(t.select(key))
    given = given.distinct()
    rest = stratified_split(pool.join(given, key, "left_anti"), stratum, key, share)
    return given.withColumn("role", F.lit("test")).unionByName(rest.select(key, "role"))


def union_scores(tables: dict[str, DataFrame], tag: str = "method") -> DataFrame:
    """All tables under each other, with the name of each in the column tag."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
