"""Sources and sinks: artifact listings, geometry tables, score files, category and metadata files, case lists, samples."""

from __future__ import annotations

import contextlib
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from geoframe.functions.columns import strip_ext
from geoframe.operators.catalog import FOLDERS, fields_of_record
from geoframe.operators.splits import numbered

#: Longer endings first, so that .nii.gz is not taken for .gz.
ENDINGS = (".nii.gz", ".tar.gz", ".nii", ".mha", ".nrrd", ".vti", ".vtp", ".vtk", ".stl", ".gz")


def artifact_rows(files: DataFrame) -> DataFrame:
    """folder, case_id, path, rank of files (path, length) in the artifact folders.

    Dot files are left out; the case is the name without its ending and a trailing .seg; rank is the ending's place in
    the list (a surface's .vtp before .stl); of a case's files in a folder the first by rank and path stays.
    """
    name, folder = F.substring_index("path", "/", -1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    rank = F.lit(len(ENDINGS))
    for i, e in reversed(list(enumerate(ENDINGS))):
        rank = F.when(F.lower(name).endswith(e), i).otherwise(rank)
    rows = files.select("path", name.alias("name"), folder.alias("folder"), rank.alias("rank")).where(F.col("folder").isin(*FOLDERS) & ~F.col("name").startswith("."))
    named = rows.withColumn("case_id", strip_ext("name"))
    return named.groupBy("folder", "case_id").agg(F.min(F.struct("rank", "path")).alias("f")).select("folder", "case_id", "f.path", "f.rank")


def scan_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """artifact_rows() of a folder; only names and lengths are read."""
    return artifact_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length"))


def scan_geometry(spark: SparkSession, root: str, cases: list[str] | None = None) -> dict[str, DataFrame]:
    """The point, line and mesh tables under root, each partitioned by case_id; only the given cases' partitions, without a look
    into the folders of others where their names are plain."""
    names = ("centerline_points", "vertices", "faces")
    if cases is None:
        return {t: spark.read.parquet(f"{root}/{t}") for t in names}
    return {t: _partitions(spark, f"{root}/{t}", cases).where(F.col("case_id").isin(cases)) for t in names}


def _partitions(spark: SparkSession, path: str, cases: list[str]) -> DataFrame:
    """The table at path, of the given cases at least."""
    if cases and all(re.fullmatch(r"[A-Za-z0-9_.-]+", c) for c in cases):
        with contextlib.suppress(AnalysisException):  # no such case
            return spark.read.option("basePath", path).parquet(f"{path}/case_id={{{','.join(cases)}}}")
    return spark.read.parquet(path)


def read_scores(spark: SparkSession, glob: str, schema: StructType | str, stem: str) -> DataFrame:
    """All <stem>_<method>.csv, with the method from the name, without MEAN and STD rows."""
    rows = spark.read.csv(glob, header=True, schema=schema).withColumn("method", F.regexp_extract(F.input_file_name(), rf"{stem}_([^/]*?)\.csv", 1))
    return rows.where(~F.upper("case_id").isin("MEAN", "STD"))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """category, category_order, case_id from {category: [cases]}; the order is the file's. One document."""
    text = spark.read.text(path, wholetext=True)
    names = F.json_object_keys("value")
    given = F.from_json("value", "map<string,array<string>>")
    rows = text.select(F.posexplode(names).alias("category_order", "category"), given.alias("m"))
    return rows.select("category", "category_order", F.explode(F.element_at("m", F.col("category"))).alias("case_id"))


def read_metadata(spark: SparkSession, path: str, column_map: dict[str, str]) -> DataFrame:
    """A CSV file's rows as catalogue fields; see fields_of_record()."""
    return fields_of_record(spark.read.csv(path, header=True), column_map)


def write_samples(samples: DataFrame, path: str) -> None:
    """One folder per modality and role; appended to what is there."""
    samples.write.partitionBy("modality", "role").mode("append").parquet(path)


def append_results(results: DataFrame, path: str) -> None:
    """Append; columns that are new are null in older rows when read with read_results()."""
    results.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def training_manifest(images: DataFrame, labels: DataFrame, prefix: str, start: int = 0) -> DataFrame:
    """name, image, label, train_image, train_label: pairs in order of name, numbered from start; images without label take no number."""
    pairs = numbered(images.join(labels, "name"), "name")
    at = (F.col("index") + start).cast("int")
    return pairs.select("name", "image", "label", F.format_string(f"{prefix}_%03d_0000", at).alias("train_image"), F.format_string(f"{prefix}_%03d", at).alias("train_label"))


def list_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A small list file's lines with their number."""
    lines = F.filter(F.split(F.rtrim("value"), r"\r?\n"), lambda x: x != "")
    return spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("line", name))


def zip_case_lists(spark: SparkSession, paths: dict[str, str], prefixes: dict[str, str] | None = None, **wanted) -> DataFrame:
    """Parallel list files put side by side by line number, with path prefixes, filtered; NAME is the image's stem."""
    out = None
    for name, path in paths.items():
        part = list_lines(spark, path, name)
        if prefixes and name in prefixes:
            part = part.withColumn(name, F.concat(F.lit(prefixes[name]), name))
        out = part if out is None else out.join(part, "line")
    for name, values in wanted.items():
        out = out.where(F.col(name).isin(values))
    return out.withColumn("NAME", strip_ext(F.substring_index(next(iter(paths)), "/", -1)))


def resolve_column(columns: list[str], names: list[str]) -> str | None:
    """The first column that is one of the names, exactly or without case."""
    low = {c.lower(): c for c in reversed(columns)}
    return next((c for n in names for c in (n if n in columns else low.get(n.lower()),) if c), None)


def load_case_csv(raw: DataFrame, id_column: str | None = None, alias_columns: list[str] = ()) -> DataFrame:
    """case_id, aliases and role of raw rows whose row_type is blank or case.

    The id is the given column, else legacy_name or name; role is the split column lowered, (none) if blank, (catalog)
    without that column. A file without an id column is an error.
    """
    name = resolve_column(raw.columns, [id_column] if id_column else ["legacy_name", "legacy name", "name"])
    if name is None:
        raise ValueError(f"no id column among {raw.columns}")
    kind, split = resolve_column(raw.columns, ["row_type"]), resolve_column(raw.columns, ["split"])
    rows = raw.where(F.coalesce(F.lower(F.trim(kind)), F.lit("")).isin("", "case")) if kind else raw
    role = F.coalesce(F.nullif(F.lower(F.trim(split)), F.lit("")), F.lit("(none)")) if split else F.lit("(catalog)")
    aliases = F.filter(F.array(*[F.nullif(F.trim(F.col(a)), F.lit("")) for a in alias_columns]), lambda a: a.isNotNull()) if alias_columns else F.array().cast("array<string>")
    return rows.select(F.nullif(F.trim(F.col(name)), F.lit("")).alias("case_id"), aliases.alias("aliases"), role.alias("role")).where("case_id is not null")


def write_case_lists(roles: DataFrame, path: str) -> None:
    """Sorted names of each role as text files, a folder per role; names without a role are left out."""
    named = roles.where("role is not null").select(F.col("case_id").cast("string").alias("value"), "role")
    named.repartitionByRange("role", "value").sortWithinPartitions("role", "value").write.partitionBy("role").text(path)
