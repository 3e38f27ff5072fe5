"""Orders over more rows than a task holds: rows are dealt to ranges of the order, ranges are summed up, and only then are rows
of a range ordered among themselves. A group, or a value, may have any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoframe.plans.storage import stored, stored_large


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df as a table with __range: no row of a lower range comes after one of a higher in the order; nulls first."""
    return stored_large(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")


def before_ranges(ranged: DataFrame, groups: list[str], weight: Column) -> DataFrame:
    """Per range and group that meet: __sum of weight, and __before, that of the group's earlier ranges. A group has a row a range."""
    earlier = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__range", *groups).agg(F.coalesce(F.sum(weight), F.lit(0)).alias("__sum"))
    return sums.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))


def joined(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """df joined with other's remaining columns where the keys are the same; nulls meet too."""
    renamed = other.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(renamed, same, how).drop(*[f"__k{i}" for i in range(len(keys))])


def group_total(df: DataFrame, groups: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """df with the sum of weight over the rows of its group before its own: a prefix sum in two levels.

    The order must tell the rows of a group apart if the result is to be the same in each run.
    """
    ranged = in_ranges(df.withColumn("__weight", weight), [*groups, *order])
    offsets = (stored_large if groups else stored)(before_ranges(ranged, groups, F.col("__weight")), "offsets")
    inside = Window.partitionBy("__range", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__inside", F.coalesce(F.sum("__weight").over(inside), F.lit(0)))
    return joined(summed, offsets, ["__range", *groups]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__weight", "__inside", "__sum", "__before")


def group_number(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """df with the row's number, from 0, in its group."""
    return group_total(df, groups, order, F.lit(1), name)


def counted_values(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Each value of a group once, with __n, how often it is there; null values are left out. A frequent value is one row then."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias(value)).agg(F.count("*").alias("__n"))


def value_ranks(df: DataFrame, groups: list[str], value: str, name: str = "rank", ties: str = "t") -> DataFrame:
    """Each value of a group once: its rank, from 1, the mean of their ranks for equal ones, and how often it is there (ties)."""
    ranked = group_total(counted_values(df, groups, value), groups, [value], F.col("__n"), "__lower")
    rank = F.col("__lower") + (F.col("__n") + 1) / 2
    return ranked.select(*groups, value, rank.alias(name), F.col("__n").alias(ties))


def average_ranks(df: DataFrame, groups: list[str], value: str, name: str = "rank", ties: str = "t") -> DataFrame:
    """df with the columns of value_ranks(); null for a null value."""
    return joined(df, value_ranks(df, groups, value, name, ties), [*groups, value], "left")


def quantiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the exact quantiles of a value, a column for each of the shares, linear between neighbours; nulls are left out.

    First the ranges are counted, which tells the ranges that hold the asked ranks; then only those are ordered. No task
    holds a group.
    """
    counts = counted_values(df.select(*groups, F.col(value).cast("double").alias("__value")), groups, "__value")
    ranged = in_ranges(counts, [*groups, "__value"])
    offsets = (stored_large if groups else stored)(before_ranges(ranged, groups, F.col("__n")), "offsets")
    # The two neighbours of each asked place, by their ranks from 0.
    whole = Window.partitionBy(*groups)
    sized = offsets.withColumn("__all", F.sum("__sum").over(whole))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("__name"), F.lit(float(s)).alias("__share")) for n, s in shares.items()]))
    placed = sized.withColumn("__asked", asked).withColumn("__at", F.col("__asked.__share") * (F.col("__all") - 1))
    ends = placed.withColumn("__rank", F.explode(F.array(F.floor("__at"), F.ceil("__at"))))
    here = ends.where((F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__sum")))
    here = stored_large(here.select("__range", *groups, "__before", "__sum", F.col("__asked.__name").alias("__name"), "__at", "__rank"), "asked-ranks")
    keys = ["__range", *groups]
    few = joined(ranged, here.select(*keys, "__before").distinct(), keys)
    inside = Window.partitionBy(*keys).orderBy("__value").rowsBetween(Window.unboundedPreceding, -1)
    ordered = few.withColumn("__lower", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0))).drop("__before")
    hits = joined(ordered, here.select(*keys, "__name", "__at", "__rank"), keys)
    hits = hits.where((F.col("__rank") >= F.col("__lower")) & (F.col("__rank") < F.col("__lower") + F.col("__n")))
    low, high = F.min("__value"), F.max("__value")
    each = hits.groupBy(*groups, "__name").agg((low + (high - low) * (F.first("__at") - F.floor(F.first("__at")))).alias("__q"))
    pick = [F.max(F.when(F.col("__name") == n, F.col("__q"))).alias(n) for n in shares]
    return each.groupBy(*groups).agg(*pick)
