"""Reports over sample rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_counts(rows: DataFrame) -> DataFrame:
    """Per case, and for all (case_id null): samples, those thrown out at a cap, errors."""
    return rows.rollup("case_id").agg(F.count("*").alias("n_samples"), F.count_if(F.col("status") == "cap").alias("n_caps"), F.count_if(F.col("status") == "error").alias("n_errors"))


def sample_stats_report(samples: DataFrame, columns: list[str] = ("GT_MEAN", "GT_STD", "IM_MEAN", "IM_STD", "RADIUS", "NUM_VOX")) -> DataFrame:
    """Means of the columns over all samples; what is no number is left out."""
    return samples.agg(*[F.avg(F.col(c).try_cast("double")).alias(c) for c in columns])


def fingerprint_summary(volumes: DataFrame, voxels: DataFrame, points: DataFrame) -> DataFrame:
    """One row over the dataset: distinct spacings and sizes, labels in use, cases with more than one label, mean points and lines."""
    headers = volumes.agg(F.count("*").alias("n_volumes"), F.count_distinct("spacing").alias("n_spacings"), F.count_distinct("size").alias("n_sizes"))
    labels = voxels.groupBy("case_id").agg(F.collect_set("label").alias("labels"))
    used = labels.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"), F.count_if(F.size("labels") > 2).alias("n_multi"))
    lines = points.groupBy("case_id").agg(F.count_distinct("point_id").alias("p"), F.count_distinct("line_id").alias("l")).agg(F.avg("p").alias("mean_points"), F.avg("l").alias("mean_lines"))
    return headers.join(used).join(lines)  # one row each
