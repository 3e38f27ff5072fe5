"""Catalogue of cases and their artifacts: presence, enrichment, cohorts, gaps and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoframe.functions.columns import modality_bucket

FOLDERS = ("images", "truths", "centerlines", "surfaces")


def query_cases(cases: DataFrame, splits: DataFrame | None = None, split: str | None = None, role: str | None = None, flags: dict[str, bool] | None = None, **wanted) -> DataFrame:
    """Cases for which every given list holds the column's value and every flag is as asked; an empty list is no filter.

    role counts only with split, which joins splits (split_name, dataset, case_id, role). Ordered by dataset and case.
    """
    for name, values in wanted.items():
        if values:
            cases = cases.where(F.col(name).isin(list(values) if not isinstance(values, str) else [values]))
    for name, value in (flags or {}).items():
        cases = cases.where(F.col(name) == F.lit(value))
    if split is not None:
        chosen = splits.where(F.col("split_name") == split)
        if role is not None:
            chosen = chosen.where(F.col("role") == role)
        cases = cases.join(chosen.select("dataset", "case_id"), ["dataset", "case_id"], "left_semi")
    return cases.orderBy("dataset", "case_id")


def query_cases_with_paths(cases: DataFrame) -> DataFrame:
    """The catalogue's paths under the names that samplers use."""
    names = {"case_id": "NAME", "image_path": "IMAGE", "truth_path": "SEGMENTATION", "centerline_path": "CENTERLINE", "surface_path": "SURFACE", "dataset": "DATASET"}
    return cases.select(*[F.col(a).alias(b) for a, b in names.items()])


def modality_filter(cases: DataFrame, modalities: list[str]) -> DataFrame:
    """Cases of the modalities; CT asks for CTA too."""
    return cases.where(F.col("modality").isin(sorted({m for x in modalities for m in ((x, "CTA") if x == "CT" else (x,))})))


def attribute_filter(cases: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Cases with one of the values of anatomy, disease or another attribute."""
    return cases.where(F.col(column).isin(values))


def presence(artifacts: DataFrame) -> DataFrame:
    """Per case of artifacts (folder, case_id) whether each folder has it."""
    flags = [F.max((F.col("folder") == f).cast("int")).cast("boolean").alias(f"has_{f}") for f in FOLDERS]
    return artifacts.where("case_id is not null").groupBy("case_id").agg(*flags)


def case_presence(artifacts: DataFrame) -> DataFrame:
    """presence() and each folder's path of artifacts (folder, case_id, path, rank): the path of the least rank."""
    paths = [F.min_by(F.when(F.col("folder") == f, F.col("path")), F.when(F.col("folder") == f, F.struct("rank", "path"))).alias(f"{f}_path") for f in FOLDERS]
    return artifacts.groupBy("case_id").agg(*paths).select("case_id", *[F.col(f"{f}_path").isNotNull().alias(f"has_{f}") for f in FOLDERS], *[f"{f}_path" for f in FOLDERS])


def enrich_cases(cases: DataFrame, sheet: DataFrame, table: DataFrame, defaults: DataFrame, columns: list[str]) -> DataFrame:
    """cases with the columns from table, else sheet (both by case_id), else defaults (by dataset)."""
    for prefix, other, key in (("t", table, "case_id"), ("s", sheet, "case_id"), ("d", defaults, "dataset")):
        cases = cases.join(other.select(key, *[F.col(c).alias(f"__{prefix}_{c}") for c in columns]), key, "left")
    chosen = [F.coalesce(*[F.nullif(F.trim(f"__{p}_{c}"), F.lit("")) for p in "tsd"]).alias(c) for c in columns]
    return cases.select(*[c for c in cases.columns if not c.startswith("__")], *chosen)


def merged_extras(sheet: Column, table: Column) -> Column:
    """One map of both; the table's value where both have a key."""
    kept = F.map_filter(sheet, lambda k, _: ~F.map_contains_key(table, k))
    return F.map_concat(kept, table)


def cohort_ready(artifacts: DataFrame, test: DataFrame, strict: bool = True) -> DataFrame:
    """case_id of centerlines (strict: those with an image too) that are not in test (case_id)."""
    lines = artifacts.where("folder = 'centerlines'").select("case_id").distinct()
    if strict:
        lines = lines.join(artifacts.where("folder = 'images'").select("case_id"), "case_id", "left_semi")
    return lines.join(test.select("case_id"), "case_id", "left_anti")


def exclude_cases(cases: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda left, o: left.join(o.select("case_id"), "case_id", "left_anti"), others, cases)


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of todo that the ledger done doesn't have under the same keys."""
    return todo.join(done.select(*keys), keys, "left_anti")


def complete_cases(done: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Cases of done (case_id, keys) that have every key combination of expected (relational division)."""
    wanted = expected.select(*keys).distinct()
    n = wanted.agg(F.count("*").alias("n_expected"))
    got = done.join(wanted, keys, "left_semi").select("case_id", *keys).distinct().groupBy("case_id").agg(F.count("*").alias("n"))
    return got.join(F.broadcast(n), F.col("n") == F.col("n_expected")).select("case_id")  # one row


def missing_in_folder(listed: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per listed case (case_id, aliases) and folder that lacks it: null found_as if no alias is there, else the least alias there."""
    ids = listed.select("case_id", F.explode(F.array_union(F.array("case_id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    there = artifacts.select("folder", F.col("case_id").cast("string").alias("name")).distinct()
    found = ids.join(there, "name").groupBy("case_id", "folder").agg(F.max((F.col("name") == F.col("case_id")).cast("int")).alias("own"), F.min("name").alias("found_as"))
    wanted = listed.select("case_id", F.explode(F.array(*[F.lit(f) for f in FOLDERS])).alias("folder"))
    return wanted.join(found, ["case_id", "folder"], "left").where("own is null or own = 0").select("case_id", "folder", "found_as")


def missing_in_csv(artifacts: DataFrame, listed: DataFrame) -> DataFrame:
    """Cases on disk that the list (case_id) lacks, with the sorted folders that have them."""
    return artifacts.join(listed.select("case_id"), "case_id", "left_anti").groupBy("case_id").agg(F.sort_array(F.collect_set("folder")).alias("folders"))


def name_consistency(artifacts: DataFrame) -> DataFrame:
    """Per folder: names, names common to all folders, names of others that it lacks."""
    flags = presence(artifacts)
    everywhere = reduce(Column.__and__, [F.col(f"has_{f}") for f in FOLDERS])
    sums = [F.count_if(f"has_{f}").alias(f"n_{f}") for f in FOLDERS] + [F.count("*").alias("n_all"), F.count_if(everywhere).alias("n_common")]
    row = flags.agg(*sums)
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("folder"), F.col(f"n_{f}").alias("n"), F.col("n_common"), (F.col("n_all") - F.col(f"n_{f}")).alias("n_missing")) for f in FOLDERS])).alias("r")).select("r.*")


def pair_by_stem(left: DataFrame, right: DataFrame, key: str = "stem") -> DataFrame:
    return left.join(right, key)


def unmatched_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that one side lacks, and which side has them."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").where("l is null or r is null").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def alias_split(listed: DataFrame) -> DataFrame:
    """Every id of listed (case_id, aliases, role) with its role."""
    return listed.select(F.explode(F.array_union(F.array("case_id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("id"), "role").distinct()


def role_conflicts(roles: DataFrame) -> DataFrame:
    """Ids of roles (id, role) with more than one role."""
    return roles.groupBy("id").agg(F.count_distinct("role").alias("n_roles")).where("n_roles > 1")


def cohort_from_config(cases: DataFrame, images: DataFrame, bad: DataFrame, test: DataFrame, mode: str = "train", **filters) -> DataFrame:
    """case_id of a mode: full is what the filters and images leave without bad ones; train is that without test; test is the test list."""
    if mode == "test":
        return test.select("case_id").distinct()
    chosen = query_cases(cases, **filters).select("case_id").join(images.select("case_id"), "case_id", "left_semi")
    chosen = exclude_cases(chosen, bad)
    return (exclude_cases(chosen, test) if mode == "train" else chosen).distinct()


def first_row_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both tables with one row per key, that of the highest version; new wins a tie. Aggregated, so hot keys meet in map tasks."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "__new"]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "__new")).alias("r")).select(*keys, "r.*")


def replace_split(old: DataFrame, new: DataFrame) -> DataFrame:
    """splits where the new rows stand for all old ones of their split and dataset."""
    keys = ["split_name", "dataset"]
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def gap_report(artifacts: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: cases in every folder, listed, listed and complete, missing (case, folder) pairs, on disk but not listed."""
    flags = presence(artifacts).withColumn("n_folders", sum(F.col(f"has_{f}").cast("int") for f in FOLDERS))
    both = flags.join(listed.select("case_id").distinct().withColumn("listed", F.lit(True)), "case_id", "full_outer").withColumn("listed", F.coalesce("listed", F.lit(False)))
    there = F.coalesce("n_folders", F.lit(0))
    return both.agg(
        F.count_if(there == len(FOLDERS)).alias("n_complete_on_disk"),
        F.count_if("listed").alias("n_listed"),
        F.count_if(F.col("listed") & (there == len(FOLDERS))).alias("n_listed_complete"),
        F.coalesce(F.sum(F.when(F.col("listed"), len(FOLDERS) - there)), F.lit(0)).cast("long").alias("n_missing_files"),
        F.count_if(~F.col("listed")).alias("n_not_listed"),
    )


def common_cases(artifacts: DataFrame, folders: tuple[str, ...] = FOLDERS) -> DataFrame:
    """Cases that every one of the folders has."""
    return artifacts.where(F.col("folder").isin(*folders)).groupBy("case_id").agg(F.count_distinct("folder").alias("n")).where(F.col("n") == len(folders)).select("case_id")


def fields_of_record(raw: DataFrame, column_map: dict[str, str]) -> DataFrame:
    """All-text rows mapped to catalogue fields (column_map: field -> column); blanks are null, other filled columns go to the map extra.

    case_id must be mapped and every mapped column must be there, or a ValueError names the columns that are.
    """
    missing = [c for c in column_map.values() if c not in raw.columns]
    if "case_id" not in column_map or missing:
        raise ValueError(f"case_id must be mapped and {missing} must be among {raw.columns}")
    clean = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in raw.columns}
    rest = [c for c in raw.columns if c not in column_map.values()]
    extra = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), clean[c])]), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    return raw.select(*[clean[c].alias(f) for f, c in column_map.items()], extra.alias("extra")).where("case_id is not null")


def split_group_report(cases: DataFrame) -> DataFrame:
    """Per anatomy and modality bucket a header row with n_train and n_test, then its cases (case_id, role), test before train."""
    bucketed = cases.withColumn("bucket", modality_bucket("modality"))
    counts = F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test")
    grouped = bucketed.groupingSets([["anatomy", "bucket"], ["anatomy", "bucket", "case_id", "role"]], "anatomy", "bucket", "case_id", "role").agg(*counts, F.grouping_id().alias("level"))
    return grouped.select(F.when(F.col("level") > 0, "group_header").otherwise("case").alias("row_type"), "anatomy", "bucket", "case_id", "role", *[F.when(F.col("level") > 0, F.col(c)).alias(c) for c in ("n_train", "n_test")])


def split_balance(cases: DataFrame) -> DataFrame:
    """Per anatomy, and for all (anatomy null): pool, test cases and their ratio."""
    sums = cases.rollup("anatomy").agg(F.count("*").alias("n_pool"), F.count_if(F.col("role") == "test").alias("n_test"))
    return sums.withColumn("ratio", F.try_divide(F.col("n_test").cast("double"), F.col("n_pool")))
