"""Scores of cases and methods: summaries, comparisons, ranks and tests. Rows: case_id, method, value, ..."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoframe.functions.columns import finite, format_mean_std
from geoframe.operators.ranges import average_ranks, joined, quantiles, value_ranks
from geoframe.plans.storage import stored


def summarise(scores: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean and population deviation (null under two) of the finite values, and their number."""
    v = finite(value)
    return scores.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.when(F.count(v) >= 2, F.stddev_pop(v)).alias("std"))


def summarise_configs(scores: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Per configuration: mean, sample deviation and median of the finite values, cases, failed rows and their share."""
    v, failed = finite(value), F.count_if(F.col("status") != "ok")
    sums = scores.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count_distinct("case_id").alias("n_cases"), failed.alias("n_failed"), (failed / F.count("*")).alias("frac_failed"))
    medians = quantiles(scores.withColumn(value, v), by, value, {"median": 0.5})
    return joined(sums, medians, by, "left").select(*by, "mean", "std", "median", "n_cases", "n_failed", "frac_failed")


def with_category(scores: DataFrame, categories: DataFrame, drop: bool = False) -> DataFrame:
    """scores with the category of their case; those without get _uncategorized or go."""
    joined = scores.join(categories.select("case_id", "category"), "case_id", "inner" if drop else "left")
    return joined.withColumn("category", F.coalesce("category", F.lit("_uncategorized")))


def count_status(scores: DataFrame, by: list[str]) -> DataFrame:
    """Rows, distinct cases and diverged rows."""
    return scores.groupBy(*by).agg(F.count("*").alias("n_total"), F.count_distinct("case_id").alias("n_cases"), F.count_if(F.lower(F.trim("status")) == "diverged").alias("n_diverged"))


def failures_per_case(scores: DataFrame) -> DataFrame:
    return scores.where("status <> 'ok'").groupBy("case_id").agg(F.count("*").alias("n_failed")).orderBy(F.desc("n_failed"), "case_id")


def category_summary(scores: DataFrame, categories: DataFrame) -> DataFrame:
    """Per category and method: statistics without diverged rows, which are counted."""
    named = with_category(scores, categories)
    ok = named.withColumn("value", F.when(F.lower(F.trim("status")) != "diverged", F.col("value")))
    return summarise(ok, ["category", "method"]).join(count_status(named, ["category", "method"]), ["category", "method"])


def pairwise_methods(scores: DataFrame) -> DataFrame:
    """Per case every pair of methods a < b with both values and their difference."""
    a = scores.select("case_id", F.col("method").alias("method_a"), F.col("value").alias("value_a"))
    b = scores.select("case_id", F.col("method").alias("method_b"), F.col("value").alias("value_b"))
    return a.join(b, "case_id").where("method_a < method_b").withColumn("difference", F.col("value_a") - F.col("value_b"))


def baseline_delta(scores: DataFrame, keys: list[str], baseline: str, lower_is_better: bool = False) -> DataFrame:
    """Other methods' values less the baseline's mean on the keys, so that more is better; NaN without a baseline."""
    base = scores.where(F.col("method") == baseline).groupBy(*keys).agg(F.avg("value").alias("base"))
    sign = -1.0 if lower_is_better else 1.0
    return scores.where(F.col("method") != baseline).join(base, keys, "left").withColumn("delta", F.coalesce(sign * (F.col("value") - F.col("base")), F.lit(float("nan"))))


def bucket_means(rows: DataFrame, by: list[str], least: int = 5, value: str = "value") -> DataFrame:
    """Mean of the finite values per bucket, null if the bucket has fewer than `least` rows, and that number (empty values count)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.avg(finite(value))).alias("mean"))


def apart(edges: Column, least: float = 1e-9) -> Column:
    """Ascending numbers, each at least so much over the one before."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    more = lambda acc, x: F.when(F.size(acc) == 0, x).otherwise(F.greatest(x, last(acc) + least))
    return F.aggregate(edges, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(more(acc, x))))


def distinct_radii_pool(rows: DataFrame, value: str, k: int, by: list[str] = ()) -> DataFrame:
    """The k + 1 edges of k quantile bins, of all rows or of each group: bin, edge; each at least 1e-9 over the one before."""
    names = {f"__e{i}": i / k for i in range(k + 1)}
    edges = quantiles(rows, list(by), value, names).where("__e0 is not null")
    return edges.select(*by, F.posexplode(apart(F.array(*names))).alias("bin", "edge"))


def distribution_summary(rows: DataFrame, by: list[str], value: str = "value", least: int = 5) -> DataFrame:
    """Box-plot numbers: n, least, quartiles, greatest, and whether there are enough to show."""
    sums = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    out = joined(sums, quantiles(rows, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), by, "left")
    return out.select(*by, "n", "min", "q1", "median", "q3", "max", (F.col("n") >= least).alias("shown"))


def histogram(rows: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts in equal bins between the least and greatest value (the last bin is closed)."""
    ends = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    place = F.least(F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    return rows.join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))  # one row


def minmax_scale(rows: DataFrame, by: str, value: str, lower_is_better: bool = False) -> DataFrame:
    """Distance from the best value over the span, from 0 to 1; a span of none counts as 1."""
    w = Window.partitionBy(by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    span = F.when(hi == lo, 1.0).otherwise(hi - lo)
    gap = (F.col(value) - lo) if lower_is_better else (hi - F.col(value))
    return rows.withColumn("scaled", F.greatest(F.lit(0.0), F.least(F.lit(1.0), gap / span)))


def running_max(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    return rows.withColumn("running_max", F.max(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def fixed_order_sort(rows: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows in the listed order, unlisted after them by name; with place."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    place = F.when(at == 0, len(order) + 1).otherwise(at)
    return rows.withColumn("place", place).orderBy("place", column)


def best_configs(summary: DataFrame, k: int, by: str = "mean", tie: str = "method") -> DataFrame:
    return summary.orderBy(F.desc(by), tie).limit(k)


def best_method(means: DataFrame, by: list[str], direction: str = "higher") -> DataFrame:
    """Methods with the best mean of each group, ties kept; direction higher, lower or zero (closest to it)."""
    key = {"higher": -F.col("mean"), "lower": F.col("mean"), "zero": F.abs(F.col("mean"))}[direction]
    ranked = means.where("mean is not null and not isnan(mean)").withColumn("__r", F.rank().over(Window.partitionBy(*by).orderBy(key)))
    return ranked.where("__r = 1").drop("__r")


def point_differences(scores: DataFrame, group: str) -> DataFrame:
    """Per case and group the absolute differences of all pairs of values, then their mean."""
    return pairwise_methods(scores).join(scores.select("case_id", group).distinct(), "case_id").groupBy(group, "case_id").agg(F.avg(F.abs(F.col("difference"))).alias("mean_difference"))


def rank_avg(rows: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """Ranks within groups of any size, with ties at their mean."""
    return average_ranks(rows, by, value, name, "__t").drop("__t")


def paired_differences(scores: DataFrame) -> DataFrame:
    return pairwise_methods(scores).where("difference <> 0")


def wilcoxon(scores: DataFrame) -> DataFrame:
    """Per pair of methods: differences that aren't 0, sums of positive and negative signed ranks, z with tie correction, p."""
    pairs = paired_differences(scores).withColumn("size", F.abs("difference"))
    by = ["method_a", "method_b"]
    sums = average_ranks(pairs, by, "size").groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(F.col("difference") > 0, F.col("rank"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(F.col("difference") < 0, F.col("rank"))), F.lit(0.0)).alias("w_minus"),
        F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("ties"),
    )
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, F.sqrt(variance))
    return with_p(sums.withColumn("z", z), "z", "normal").drop("ties")


def pooled_ranks(rows: DataFrame, value: str) -> DataFrame:
    """(value, t, rank): each distinct value's number of rows and mean rank among all. Counts are summed, not rows ordered."""
    return value_ranks(rows, [], value)


def mann_whitney(rows: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """U of group a against b over pooled ranks, z with tie correction, p."""
    both = rows.where(F.col(group).isin(a, b))
    ranked = both.join(pooled_ranks(both, value), value)
    t = F.col("t").cast("double")
    sums = ranked.agg(F.count_if(F.col(group) == a).alias("n_a"), F.count_if(F.col(group) == b).alias("n_b"), F.sum(F.when(F.col(group) == a, F.col("rank"))).alias("r_a"), F.sum(t * t - 1).alias("ties"))
    u = F.col("r_a") - F.col("n_a") * (F.col("n_a") + 1) / 2
    n = (F.col("n_a") + F.col("n_b")).cast("double")
    variance = F.col("n_a").cast("double") * F.col("n_b") / 12 * (n + 1 - F.try_divide("ties", n * (n - 1)))
    z = F.try_divide(u - F.col("n_a") * F.col("n_b") / 2, F.sqrt(variance))
    return with_p(sums.withColumn("u", u).withColumn("z", z).drop("ties"), "z", "normal")


def kruskal_wallis(rows: DataFrame, group: str, value: str) -> DataFrame:
    """H over pooled ranks with tie correction, degrees of freedom and p."""
    ranks = stored(pooled_ranks(rows, value), "ranks")
    per = rows.join(ranks, value).groupBy(group).agg(F.count("*").alias("n"), F.sum("rank").alias("r"))
    total = per.agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), (F.count("*") - 1).alias("df"))
    t = F.col("t").cast("double")
    ties = ranks.agg(F.sum(t * t * t - t).alias("ties"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return with_p(total.join(F.broadcast(ties)).select("df", h.alias("h")), "h", "chi2", "df")  # one row


def friedman(scores: DataFrame) -> DataFrame:
    """Chi-square over ranks within cases that have every method, with tie correction, degrees of freedom and p."""
    methods = scores.select("method").distinct()
    k = methods.agg(F.count("*").alias("k"))
    full = scores.withColumn("m", F.count("*").over(Window.partitionBy("case_id"))).join(F.broadcast(k)).where("m = k")
    # A group is a case with a row per method, so a window is small here.
    case, tied = Window.partitionBy("case_id").orderBy("value"), Window.partitionBy("case_id", "value")
    counted = full.withColumn("t", F.count("*").over(tied).cast("double"))
    ranked = counted.withColumn("rank", F.rank().over(case) + (F.col("t") - 1) / 2)
    per = ranked.groupBy("method").agg(F.sum("rank").alias("r"), F.count("*").alias("n"), F.first("k").alias("k"), F.sum(F.col("t") * F.col("t") - 1).alias("ties"))
    kk, n = F.max("k").cast("double"), F.max("n").cast("double")
    chi = F.try_divide(12 / (n * kk * (kk + 1)) * F.sum(F.col("r") * F.col("r")) - 3 * n * (kk + 1), 1 - F.sum("ties") / (n * kk * (kk * kk - 1)))
    return with_p(per.agg(chi.alias("chi2"), (F.max("k") - 1).alias("df"), F.max("n").alias("n_cases")), "chi2", "chi2", "df")


def t_test_paired(scores: DataFrame) -> DataFrame:
    """Per pair of methods t of the differences, n and p."""
    d = F.col("difference").cast("double")
    out = pairwise_methods(scores).groupBy("method_a", "method_b").agg(F.count("*").alias("n"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("t")).withColumn("df", F.col("n") - 1)
    return with_p(out, "t", "t", "df")


def t_test_two_samples(scores: DataFrame) -> DataFrame:
    """Per pair of methods a < b Student's t of two samples of one variance, whatever their cases: n of each, t, df and p."""
    v = finite("value")
    per = scores.groupBy("method").agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s")).where("n > 0")
    side = lambda x: per.select(*[F.col(c).alias(f"{c}_{x}") for c in ("method", "n", "m", "s")])
    # A row a method: the pairs are few.
    both = side("a").join(side("b"), F.col("method_a") < F.col("method_b")).withColumn("df", F.col("n_a") + F.col("n_b") - 2)
    squares = lambda x: (F.col(f"n_{x}") - 1) * F.coalesce(f"s_{x}", F.lit(0.0))
    pooled = F.try_divide(squares("a") + squares("b"), F.col("df"))
    t = F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b"))))
    return with_p(both.withColumn("t", t).select("method_a", "method_b", "n_a", "n_b", "df", "t"), "t", "t", "df")


def omnibus(scores: DataFrame) -> DataFrame:
    """One test over all methods on the cases that have each: Friedman's, or Wilcoxon's for two methods: test, statistic, p; no row for one."""
    methods = scores.select("method").distinct().limit(3).count()
    if methods > 2:
        return friedman(scores).select(F.lit("friedman").alias("test"), F.col("chi2").alias("statistic"), "p")
    return wilcoxon(scores).select(F.lit("wilcoxon").alias("test"), F.col("z").alias("statistic"), "p")


def volume_bucket_means(rows: DataFrame, by: list[str], least: int = 5, jump: float = 0.2, cap: float = 0.1, outlier: float = 0.35) -> DataFrame:
    """Per bucket of segments (volume_gt, volume_pred, cap_area_gt, cap_area_pred, radius): n, both volumes summed, mean relative error.

    Segments without volume are left out, and those whose error is over jump where a cap is large (over cap of the sphere's
    surface): these were cut along the vessel. Errors from outlier on don't count in the mean. Under least segments all is null.
    """
    error = (F.col("volume_pred") - F.col("volume_gt")) / F.col("volume_gt")
    sphere = 4 * math.pi * F.col("radius") * F.col("radius")
    ratio = F.when(sphere > 1e-12, F.greatest("cap_area_gt", "cap_area_pred") / sphere).otherwise(0.0)
    kept = rows.where((F.col("volume_gt") > 1e-12) & (F.col("volume_pred") > 1e-12)).withColumn("__e", error).where(~((F.abs("__e") > jump) & (ratio > cap)))
    enough = lambda c: F.when(F.count("*") >= least, c)
    return kept.groupBy(*by).agg(F.count("*").alias("n"), enough(F.sum("volume_gt")).alias("volume_gt"), enough(F.sum("volume_pred")).alias("volume_pred"), enough(F.avg(F.when(F.abs("__e") < outlier, F.col("__e")))).alias("error_rel"))


def mcnemar(rows: DataFrame, a: str, b: str, threshold: float = 0.5) -> DataFrame:
    """Discordant counts of two outcomes at the threshold and the exact two-sided p."""
    x, y = F.col(a) > threshold, F.col(b) > threshold
    out = rows.agg(F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"))
    return with_p(out.withColumn("n", F.col("b") + F.col("c")).withColumn("least", F.least("b", "c")), "least", "binomial", "n")


def pairwise_tests(scores: DataFrame, factor: str = "pairs") -> DataFrame:
    """wilcoxon() with Bonferroni's correction by the number of pairs or of groups, at most 1."""
    tests = wilcoxon(scores)
    count = tests.agg(F.count("*").alias("m")) if factor == "pairs" else scores.agg(F.count_distinct("method").alias("m"))
    return tests.join(F.broadcast(count)).withColumn("p_corrected", F.least(F.lit(1.0), F.col("p") * F.col("m"))).drop("m")


def comparison_table(scores: DataFrame) -> DataFrame:
    """'mean ± std' of each method and, for each pair, the test's p."""
    s = summarise(scores, ["method"])
    shown = s.select("method", format_mean_std("mean", "std").alias("shown"))
    t = wilcoxon(scores).select("method_a", "method_b", "p")
    return t.join(shown.select(F.col("method").alias("method_a"), F.col("shown").alias("shown_a")), "method_a").join(shown.select(F.col("method").alias("method_b"), F.col("shown").alias("shown_b")), "method_b")


def unpivot_buckets(wide: DataFrame, ids: list[str], pattern: str = r"^(dice|volume_error)_radii_(.*?)(_rel)?$") -> DataFrame:
    """Metric columns whose name fits, as rows (bucket, value)."""
    import re

    found = [c for c in wide.columns if re.match(pattern, c)]
    return wide.unpivot(ids, found, "column", "value").withColumn("bucket", F.regexp_extract("column", pattern, 2))


# Tail probabilities: one row per test, so a small Python function over Arrow batches.


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def beta_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t by Simpson's rule over the angle."""
    if df <= 0:
        return float("nan")
    theta = math.atan(abs(t) / math.sqrt(df))
    n = 2000
    h = theta / n
    f = lambda u: math.cos(u) ** (df - 1)
    area = h / 3 * sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(i * h) for i in range(n + 1))
    scale = 2 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return max(0.0, 1 - scale * area)


def tail(kind: str, x: float | None, df: float | None) -> float | None:
    if x is None or x != x:
        return None
    if kind == "normal":
        return math.erfc(abs(x) / math.sqrt(2))
    if kind == "chi2":
        return upper_gamma(df / 2, x / 2)
    if kind == "t":
        return beta_tail(x, df)
    return least_binomial(int(df), int(x))


def least_binomial(n: int, k: int) -> float:
    """Twice the chance of at most k heads in n tosses, at most 1: terms from the k-th down, until they no longer count."""
    if 2 * k >= n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    total = 0.0
    while term > total * 1e-17 and k >= 0:
        total += term
        term *= k / (n - k + 1)
        k -= 1
    return min(1.0, 2 * total)


def with_p(df: DataFrame, statistic: str, kind: str, freedom: str | None = None) -> DataFrame:
    """df with p, the two-sided (chi2: upper) tail probability of its statistic."""

    @F.pandas_udf("double")
    def probability(x, d):
        import pandas as pd

        return pd.Series([tail(kind, None if a is None else float(a), None if b is None else float(b)) for a, b in zip(x, d)], dtype="float64")

    return df.withColumn("p", probability(F.col(statistic).cast("double"), (F.col(freedom) if freedom else F.lit(0)).cast("double")))
