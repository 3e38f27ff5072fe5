"""URL filter by empirical-Bayes host reputation.

Given rules come first: a rule is a host and the start of a path; it fits its host and all subdomains, and the longest
that fits decides. What no rule decides, the host's reputation does. Labelled page outcomes (good or not) are counted by
host, registered domain and suffix. Each level is a beta-binomial whose prior mean is the posterior mean of the level
above and whose strength is found from how much the groups of that level really differ (method of moments). A url is
blocked if the lower bound of its host's posterior (mean less Z standard deviations) is under LEAST.

Edge cases: a null url or one without "://" has empty host and path, which form a group of their own; a host of one
label is its own domain and suffix; labels that are null or belong to no page are not used, several of one page count as
good if one is; without any label the prior mean is 1/2 and its bound decides; repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoframe.plans.storage import stored

#: Standard deviations below the mean; the bound that a host must reach.
Z, LEAST = 1.645, 0.5
#: (verdict, rule); a rule is a host, then the start of a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host(pages: DataFrame) -> DataFrame:
    """pages with host and path of the column url."""
    url = F.coalesce("url", F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def by_rule(rules: list[tuple[str, str]], what: int) -> Column:
    """The longest fitting rule (what = 1) or its verdict (what = 0); null if none fits."""
    found = F.lit(None).cast("string")
    for row in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = row[1].partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        found = F.when(fits, row[what]).otherwise(found)
    return found


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain (the last two labels) and suffix (the last)."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def strength(groups: DataFrame) -> float:
    """Prior strength (a + b) of groups (n, k, mean), by moments: from the spread of k / n around mean beyond that of chance."""
    v = F.col("mean") * (1 - F.col("mean"))
    spread = F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("mean"), 2)))
    row = groups.agg(spread.alias("s"), F.sum(F.when(F.col("n") > 0, v)).alias("chance"), F.sum(F.when(F.col("n") > 0, v * (F.col("n") - 1))).alias("more")).first()
    if not row.more:
        return 2.0
    share = min(max((row.s - row.chance) / row.more, 0.001), 0.9)
    return 1 / share - 1


def shrunk(groups: DataFrame) -> DataFrame:
    """groups (n, k, mean: that of the level above) with their own posterior a and b."""
    m = F.lit(strength(groups))
    return groups.withColumn("a", F.col("k") + m * F.col("mean")).withColumn("b", F.col("n") - F.col("k") + m * (1 - F.col("mean")))


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Per host of pages (page_id, host): n labelled pages, k good ones, lower_bound of the posterior."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    marked = pages.select("page_id", "host").join(good, pages.page_id == good.doc_id, "left")
    domain, suffix = levels(F.col("host"))
    hosts = marked.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    hosts = stored(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("k")).first()
    overall = (total[1] + 1) / (total[0] + 2) if total[0] is not None else 0.5
    sums = F.sum("n").alias("n"), F.sum("k").alias("k")
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")
    suffixes = shrunk(hosts.groupBy("suffix").agg(*sums).withColumn("mean", F.lit(overall)))
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes.select("suffix", mean), "suffix")
    domains = stored(shrunk(stored(domains, "domains")).select("domain", mean), "domain-means")
    named = shrunk(stored(hosts.join(domains, "domain"), "host-priors"))
    a, b = F.col("a"), F.col("b")
    bound = a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return named.select("host", "n", "k", bound.alias("lower_bound"))


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Per page (page_id, url): page_id, host, path, rule, verdict."""
    named = with_host(pages.select("page_id", "url"))
    bounds = stored(reputations(named, labels).select("host", "lower_bound"), "host-bounds")
    reputation = F.when(F.col("lower_bound") >= LEAST, "allow").otherwise("block")
    return named.join(bounds, "host").select("page_id", "host", "path", by_rule(rules, 1).alias("rule"), F.coalesce(by_rule(rules, 0), reputation).alias("verdict"))


def oracle(rules: list[tuple[str, str]] = RULES) -> str:
    """The same over the tables pages and labels, as SQL."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fits.append((f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}')", rule, verdict))
    rule = "case " + " ".join(f"when {f} then '{r}'" for f, r, _ in fits) + " end"
    verdict = "case " + " ".join(f"when {f} then '{v}'" for f, _, v in fits) + f" when lower_bound >= {LEAST} then 'allow' else 'block' end"
    strong = "coalesce((select 1 / least(greatest((sum(case when n > 0 then n * pow(k / n - mean, 2) end) - sum(case when n > 0 then mean * (1 - mean) end)) / nullif(sum(case when n > 0 then mean * (1 - mean) * (n - 1) end), 0), 0.001::double), 0.9::double) - 1 from {0}), 2.0::double)"
    post = "select *, k + m * mean as a, n - k + m * (1 - mean) as b from (select *, {1} as m from {0})"
    return f"""
with named as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
good as (select doc_id, max(quality) as good from labels where doc_id is not null and quality is not null group by 1),
hosts as (select host, count(good)::double as n, coalesce(sum(good), 0)::double as k,
  array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain, string_split(host, '.')[-1] as suffix
  from named left join good on page_id = doc_id group by host),
s0 as (select suffix, sum(n) as n, sum(k) as k, (select (sum(k) + 1) / (sum(n) + 2) from hosts) as mean from hosts group by 1),
s1 as ({post.format("s0", strong.format("s0"))}),
d0 as (select domain, sum(h.n) as n, sum(h.k) as k, any_value(s1.a / (s1.a + s1.b)) as mean from hosts h join s1 using (suffix) group by 1),
d1 as ({post.format("d0", strong.format("d0"))}),
h0 as (select host, hosts.n, hosts.k, d1.a / (d1.a + d1.b) as mean from hosts join d1 using (domain)),
h1 as ({post.format("h0", strong.format("h0"))}),
bounds as (select host, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as lower_bound from h1)
select page_id, host, path, {rule} as rule, {verdict} as verdict from named join bounds using (host)"""
