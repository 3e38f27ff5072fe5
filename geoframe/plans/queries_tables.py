"""Catalogue, splits, reports and tests over scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoframe.functions import columns as C
from geoframe.operators import catalog, scores, splits
from geoframe.plans.registry import query, rounded
from geoframe.plans.views import ctes, view

CASES = ctes("v_case")
ART = ctes("v_artifact")
SCORE = ctes("v_score")
PRESENCE = ART + ", p as (select case_id, " + ", ".join(f"bool_or(folder = '{f}') as has_{f}" for f in catalog.FOLDERS) + " from v_artifact group by 1) "
HASH = "(('0x' || substr(md5({0}), 1, 16))::ubigint % 10000) / 10000.0::double"


@query(CASES + "select case_id, anatomy, dataset, modality from v_case where anatomy in ('BUILDING', 'MACHINERY') and modality = 'CT'")
def p1_query_cases(spark, d):
    return catalog.query_cases(view(spark, d, "v_case"), anatomy=["BUILDING", "MACHINERY"], modality="CT", dataset=[])


@query(CASES + "select case_id as \"NAME\", 'images/' || case_id as \"IMAGE\", 'truths/' || case_id as \"SEGMENTATION\", 'centerlines/' || case_id as \"CENTERLINE\", 'surfaces/' || case_id as \"SURFACE\", dataset as \"DATASET\" from v_case")
def p2_query_cases_with_paths(spark, d):
    named = view(spark, d, "v_case")
    for folder, name in (("images", "image"), ("truths", "truth"), ("centerlines", "centerline"), ("surfaces", "surface")):
        named = named.withColumn(f"{name}_path", F.concat(F.lit(f"{folder}/"), F.col("case_id").cast("string")))
    return catalog.query_cases_with_paths(named)


@query(CASES + "select case_id, modality from v_case where modality in ('CT', 'CTA')")
def p3_modality_filter(spark, d):
    return catalog.modality_filter(view(spark, d, "v_case"), ["CT"]).select("case_id", "modality")


BUCKET = "case when modality in ('CT', 'CTA') then 'CT' when modality in ('MR', 'CT_MR') then 'MR' else {0} end"


@query(CASES + f"select {BUCKET.format(repr('Other'))} as bucket, {BUCKET.format('modality')} as kept, count(*) as n from v_case group by 1, 2")
def p4_modality_bucket(spark, d):
    return view(spark, d, "v_case").groupBy(C.modality_bucket("modality").alias("bucket"), C.catalog_modality("modality").alias("kept")).agg(F.count("*").alias("n"))


@query(CASES + "select case_id, anatomy from v_case where anatomy in ('FURNITURE', 'HOUSEHOLD')")
def p5_attribute_filter(spark, d):
    return catalog.attribute_filter(view(spark, d, "v_case"), "anatomy", ["FURNITURE", "HOUSEHOLD"]).select("case_id", "anatomy")


@query(PRESENCE + "select * from p")
def j1_case_presence(spark, d):
    return catalog.presence(view(spark, d, "v_artifact"))


@query(
    "with c as (select c_custkey as case_id, n_name as dataset, c_nationkey from customer join nation on c_nationkey = n_nationkey), "
    "s as (select o_custkey as case_id, max(o_orderpriority) as anatomy from orders where o_custkey % 3 = 0 group by 1), "
    "t as (select o_custkey as case_id, max(o_orderstatus) as anatomy from orders where o_custkey % 5 = 0 group by 1) "
    "select c.case_id, c.dataset, coalesce(t.anatomy, s.anatomy, r_name) as anatomy from c left join t using (case_id) left join s using (case_id) left join (select n_name as dataset, r_name from nation join region on n_regionkey = r_regionkey) using (dataset)"
)
def j2_enrich_cases(spark, d):
    orders, nation, region = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "nation", "region"))
    by = lambda n, c: orders.where(F.col("o_custkey") % n == 0).groupBy(F.col("o_custkey").alias("case_id")).agg(F.max(c).alias("anatomy"))
    defaults = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("dataset"), F.col("r_name").alias("anatomy"))
    return catalog.enrich_cases(view(spark, d, "v_case").select("case_id", "dataset"), by(3, "o_orderpriority"), by(5, "o_orderstatus"), defaults, ["anatomy"])


@query(ART + "select distinct case_id from v_artifact where folder = 'centerlines' and case_id in (select case_id from v_artifact where folder = 'images') and case_id % 7 <> 0")
def j3_cohort_ready(spark, d):
    a = view(spark, d, "v_artifact")
    return catalog.cohort_ready(a, a.where("case_id % 7 = 0").select("case_id"))


@query(CASES + "select case_id from v_case where case_id not in (select o_custkey from orders where o_orderstatus = 'F')")
def j4_exclude_cases(spark, d):
    bad = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("case_id"))
    return catalog.exclude_cases(view(spark, d, "v_case").select("case_id"), bad)


@query(
    "with done as (select distinct o_custkey as case_id, o_orderpriority as settings from orders where o_orderstatus = 'O') "
    "select c_custkey as case_id, p as settings from customer, (select distinct o_orderpriority as p from orders) where not exists (select 1 from done where done.case_id = c_custkey and settings = p)"
)
def j5_resume(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    done = orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("settings"))
    settings = F.broadcast(orders.select(F.col("o_orderpriority").alias("settings")).distinct())  # a row per setting
    todo = view(spark, d, "v_case").select("case_id").join(settings)
    return catalog.resume(todo, done, ["case_id", "settings"])


@query("select o_custkey as case_id from orders where o_orderstatus = 'O' group by 1 having count(distinct o_orderpriority) = (select count(distinct o_orderpriority) from orders)")
def j5_complete_cases(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("case_id"), "o_orderpriority", "o_orderstatus")
    return catalog.complete_cases(rows.where("o_orderstatus = 'O'"), rows, ["o_orderpriority"])


@query(
    ART + ", l as (select c_custkey::varchar as case_id, (c_custkey + 1000000)::varchar as alias, (c_custkey + 5)::varchar as alias2 from customer), "
    "a as (select distinct folder, case_id::varchar as name from v_artifact), f as (select unnest(['images', 'truths', 'centerlines', 'surfaces']) as folder) "
    "select l.case_id, f.folder, (select min(name) from a where a.folder = f.folder and name in (alias, alias2)) as found_as from l, f where not exists (select 1 from a where a.folder = f.folder and name = l.case_id)"
)
def j6_missing_in_folder(spark, d):
    listed = view(spark, d, "v_case").select(F.col("case_id").cast("string").alias("case_id"), F.array((F.col("case_id") + 1000000).cast("string"), (F.col("case_id") + 5).cast("string")).alias("aliases"))
    return catalog.missing_in_folder(listed, view(spark, d, "v_artifact"))


@query(ctes("v_artifact", "v_case") + "select case_id, list_sort(list(distinct folder)) as folders from v_artifact where case_id not in (select case_id from v_case where modality <> 'US') group by 1")
def j7_missing_in_csv(spark, d):
    return catalog.missing_in_csv(view(spark, d, "v_artifact"), view(spark, d, "v_case").where("modality <> 'US'"))


@query(PRESENCE + ", t as (select count(*) as n_all, count_if(has_images and has_truths and has_centerlines and has_surfaces)::bigint as n_common, " + ", ".join(f"count_if(has_{f})::bigint as n_{f}" for f in catalog.FOLDERS) + " from p) " + " union all ".join(f"select '{f}' as folder, n_{f} as n, n_common, n_all - n_{f} as n_missing from t" for f in catalog.FOLDERS))
def j8_name_consistency(spark, d):
    return catalog.name_consistency(view(spark, d, "v_artifact"))


@query("select doc_id as stem, page_id, url from documents join pages on doc_id = page_id")
def j9_pair_by_stem(spark, d):
    docs, pages = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/pages.parquet")
    return catalog.pair_by_stem(docs.select(F.col("doc_id").alias("stem")), pages.select(F.col("page_id").alias("stem"), "page_id", "url"))


@query("select coalesce(l.k, r.k) as stem, case when l.k is null then 'right' else 'left' end as side from (select distinct doc_id as k from documents) l full join (select distinct page_id * 3 as k from pages) r on l.k = r.k where l.k is null or r.k is null")
def j10_unmatched_pairs(spark, d):
    docs, pages = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/pages.parquet")
    return catalog.unmatched_pairs(docs.select(F.col("doc_id").alias("stem")), pages.select((F.col("page_id") * 3).alias("stem")), "stem")


EDGES = [(0.0, 0.8), (1.0, 1.5), (1.5, 2.5), (2.5, None)]


@query(ctes("v_line") + "select lo, hi, count(*) as n from v_line join (values (0.0::double, 0.8::double), (1.0, 1.5), (1.5, 2.5), (2.5, null)) as e(lo, hi) on radius >= lo and (hi is null or radius < hi) group by 1, 2")
def j11_radius_bucket(spark, d):
    from geoframe.operators.spatial import radius_bucket

    return radius_bucket(view(spark, d, "v_line"), "radius", EDGES).groupBy("lo", "hi").agg(F.count("*").alias("n"))


@query(
    """with e as (select o_orderpriority, quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1]) as q from orders group by 1),
 i as (select o_orderpriority, b as bin, q[b + 1] as lo, case when b < 3 then q[b + 2] end as hi from e, range(4) t(b) where b <> 1)
 select o_orderpriority, bin, round(any_value(lo), 6) as lo, round(any_value(hi), 6) as hi, count(*) as n, round(sum(o_totalprice), 2) as total
 from orders join i using (o_orderpriority) where o_totalprice >= lo and (hi is null or o_totalprice < hi) group by 1, 2"""
)
def j11_own_edges(spark, d):
    from geoframe.operators.spatial import interval_join

    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderpriority", "o_totalprice")
    edges = scores.distinct_radii_pool(rows, "o_totalprice", 4, ["o_orderpriority"])
    after = edges.select("o_orderpriority", (F.col("bin") - 1).alias("bin"), F.col("edge").alias("hi"))
    # One bin is a hole, and the last has no end.
    intervals = edges.withColumnRenamed("edge", "lo").join(after, ["o_orderpriority", "bin"]).where("bin <> 1").withColumn("hi", F.when(F.col("bin") < 3, F.col("hi")))
    found = interval_join(rows, intervals, "o_totalprice", ["o_orderpriority"])
    sums = found.groupBy("o_orderpriority", "bin").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return rounded(rounded(sums.withColumn("bin", F.col("bin").cast("long")), "lo", "hi"), "total", digits=2)


@query(SCORE + "select a.case_id, a.method as method_a, a.value as value_a, b.method as method_b, b.value as value_b, a.value - b.value as difference from v_score a join v_score b on a.case_id = b.case_id and a.method < b.method")
def j14_pairwise_methods(spark, d):
    return scores.pairwise_methods(view(spark, d, "v_score"))


@query(SCORE + ", b as (select category, avg(value) as base from v_score where method = '1-URGENT' group by 1) select case_id, method, round(coalesce(value - base, 'nan'::double), 4) as delta from v_score left join b using (category) where method <> '1-URGENT'")
def j15_baseline_delta(spark, d):
    return rounded(scores.baseline_delta(view(spark, d, "v_score"), ["category"], "1-URGENT").select("case_id", "method", "delta"), "delta", digits=4)


@query("with l as (select c_custkey::varchar as case_id, (c_custkey + 37)::varchar as alias, case when c_custkey % 4 = 0 then 'test' else 'train' end as role from customer), r as (select case_id as id, role from l union select alias, role from l) select id, count(distinct role) as n_roles from r group by 1 having count(distinct role) > 1")
def j20_alias_split_conflicts(spark, d):
    listed = view(spark, d, "v_case").select(F.col("case_id").cast("string").alias("case_id"), F.array((F.col("case_id") + 37).cast("string")).alias("aliases"), F.when(F.col("case_id") % 4 == 0, "test").otherwise("train").alias("role"))
    return catalog.role_conflicts(catalog.alias_split(listed))


@query(CASES + "select distinct case_id from v_case where modality in ('CT', 'CTA') and case_id in (select doc_id from documents) and case_id not in (select doc_id from labels where quality = 0) and case_id % 9 <> 0")
def j21_cohort_from_config(spark, d):
    cases, docs, labels = view(spark, d, "v_case"), spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    one = lambda df, c: df.select(F.col(c).alias("case_id"))
    return catalog.cohort_from_config(cases, one(docs, "doc_id"), one(labels.where("quality = 0"), "doc_id"), cases.where("case_id % 9 = 0").select("case_id"), "train", modality=["CT", "CTA"])


@query(SCORE + "select method, count(value) as n, round(avg(value), 4) as mean, case when count(value) >= 2 then round(stddev_pop(value), 3) end as std from v_score group by 1")
def a1_summarise(spark, d):
    return rounded(rounded(scores.summarise(view(spark, d, "v_score"), ["method"]), "mean", digits=4), "std", digits=3)


@query(SCORE + "select method, round(avg(value), 4) as mean, round(stddev_samp(value), 3) as std, median(value) as median, count(distinct case_id) as n_cases, count_if(status <> 'ok')::bigint as n_failed, round(count_if(status <> 'ok') / count(*), 6) as frac_failed from v_score group by 1")
def a2_summarise_configs(spark, d):
    return rounded(rounded(rounded(scores.summarise_configs(view(spark, d, "v_score"), ["method"]), "mean", digits=4), "std", digits=3), "frac_failed")


CATEGORY = ctes("v_score", "v_category") + ", n as (select s.case_id, method, value, status, coalesce(c.category, '_uncategorized') as category from v_score s left join v_category c using (case_id)) "


@query(CATEGORY + "select category, count(*) as n_total, count(distinct case_id) as n_cases, count_if(status = 'diverged')::bigint as n_diverged from n group by 1")
def a3_count_status(spark, d):
    named = scores.with_category(view(spark, d, "v_score").drop("category"), view(spark, d, "v_category"))
    return scores.count_status(named, ["category"])


@query(SCORE + "select case_id, count(*) as n_failed from v_score where status <> 'ok' group by 1")
def a4_failures_per_case(spark, d):
    return scores.failures_per_case(view(spark, d, "v_score"))


@query(CATEGORY + "select category, method, count_if(status <> 'diverged')::bigint as n, round(avg(case when status <> 'diverged' then value end), 4) as mean, case when count_if(status <> 'diverged') >= 2 then round(stddev_pop(case when status <> 'diverged' then value end), 3) end as std, count(*) as n_total, count(distinct case_id) as n_cases, count_if(status = 'diverged')::bigint as n_diverged from n group by 1, 2")
def e13_category_summary(spark, d):
    return rounded(rounded(scores.category_summary(view(spark, d, "v_score").drop("category"), view(spark, d, "v_category")), "mean", digits=4), "std", digits=3)


ROLE = HASH.format("case_id::varchar || '_0'") + " < 0.2"
BUCKETED = CASES + f", b as (select *, {BUCKET.format(repr('Other'))} as bucket, case when case_id % 5 = 1 then 'test' else 'train' end as role from v_case) "


def _roled(spark, d):
    return view(spark, d, "v_case").withColumn("role", F.when(F.col("case_id") % 5 == 1, "test").otherwise("train"))


@query(BUCKETED + "select 'group_header' as row_type, anatomy, bucket, null::bigint as case_id, null::varchar as role, count_if(role = 'train')::bigint as n_train, count_if(role = 'test')::bigint as n_test from b group by anatomy, bucket union all select 'case', anatomy, bucket, case_id, role, null, null from b")
def a14_split_group_report(spark, d):
    return catalog.split_group_report(_roled(spark, d))


@query(BUCKETED + "select anatomy, count(*) as n_pool, count_if(role = 'test')::bigint as n_test, round(count_if(role = 'test') / count(*), 6) as ratio from b group by rollup (anatomy)")
def a15_split_balance(spark, d):
    return rounded(catalog.split_balance(_roled(spark, d)), "ratio")


@query(ctes("v_line") + ", b as (select case_id, floor(radius)::bigint as bin, radius from v_line) select case_id, bin, count(*) as n, case when count(*) >= 5 then round(avg(radius), 6) end as mean from b group by 1, 2")
def a16_bucket_means(spark, d):
    return rounded(scores.bucket_means(view(spark, d, "v_line").withColumn("bin", F.floor("radius")), ["case_id", "bin"], value="radius"), "mean")


@query("select unnest(range(5)) as bin, unnest(quantile_cont(o_totalprice, [0, 0.25, 0.5, 0.75, 1])) as edge from orders")
def a17_distinct_radii_pool(spark, d):
    return scores.distinct_radii_pool(spark.read.parquet(f"{d}/orders.parquet"), "o_totalprice", 4).withColumn("bin", F.col("bin").cast("long"))


@query("select o_orderpriority, count(o_totalprice) as n, min(o_totalprice) as min, round(quantile_cont(o_totalprice, 0.25), 6) as q1, round(quantile_cont(o_totalprice, 0.5), 6) as median, round(quantile_cont(o_totalprice, 0.75), 6) as q3, max(o_totalprice) as max, count(o_totalprice) >= 5 as shown from orders group by 1")
def a23_distribution_summary(spark, d):
    return rounded(scores.distribution_summary(spark.read.parquet(f"{d}/orders.parquet"), ["o_orderpriority"], "o_totalprice"), "q1", "median", "q3")


@query("select least(floor((l_quantity - lo) * 50 / (hi - lo)), 49)::bigint as bin, count(*) as n from lineitem, (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem) group by 1")
def a23_histogram(spark, d):
    return scores.histogram(spark.read.parquet(f"{d}/lineitem.parquet"), "l_quantity")


@query(PRESENCE + ", q as (select p.*, has_images::int + has_truths::int + has_centerlines::int + has_surfaces::int as nf from p), b as (select coalesce(nf, 0) as nf, c_custkey is not null as listed from q full join customer on case_id = c_custkey) select count_if(nf = 4)::bigint as n_complete_on_disk, count_if(listed)::bigint as n_listed, count_if(listed and nf = 4)::bigint as n_listed_complete, sum(case when listed then 4 - nf end)::bigint as n_missing_files, count_if(not listed)::bigint as n_not_listed from b")
def a24_gap_report(spark, d):
    return catalog.gap_report(view(spark, d, "v_artifact"), view(spark, d, "v_case"))


@query("select o_custkey as case_id, count(*) as n_samples, count_if(o_orderstatus = 'F')::bigint as n_caps, count_if(o_orderstatus = 'P')::bigint as n_errors from orders group by rollup (o_custkey)")
def a25_run_counts(spark, d):
    from geoframe.operators.report import run_counts

    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", "cap").when(F.col("o_orderstatus") == "P", "error").otherwise("ok").alias("status"))
    return run_counts(rows)


@query("select case_id, anatomy, n from (select c_custkey as case_id, c_mktsegment as anatomy, c_name as n, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as r from customer) where r = 1")
def w7_first_row_per(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("anatomy"), F.col("c_name").alias("n"), "c_nationkey", "c_acctbal")
    return catalog.first_row_per(rows, ["c_nationkey"], [F.desc("c_acctbal"), "case_id"]).select("case_id", "anatomy", "n")


@query("select o_custkey as case_id, arg_max(o_orderstatus, o_orderkey) as status, max(o_orderkey) as version from orders group by 1")
def w8_latest_wins(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("version"))
    return catalog.latest_wins(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ["case_id"], "version")


@query("with o as (select o_orderpriority as split_name, n_name as dataset, o_custkey as case_id, case when o_orderkey % 4 = 0 then 'test' else 'train' end as role, o_orderstatus from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey), n as (select * from o where o_orderstatus = 'P') select split_name, dataset, case_id, role from o where o_orderstatus = 'F' and not exists (select 1 from n where n.split_name = o.split_name and n.dataset = o.dataset) union all select split_name, dataset, case_id, role from n")
def w8_replace_split(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").join(view(spark, d, "v_case"), F.col("o_custkey") == F.col("case_id")).select(F.col("o_orderpriority").alias("split_name"), "dataset", "case_id", F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train").alias("role"), "o_orderstatus")
    return catalog.replace_split(rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), rows.where("o_orderstatus = 'P'").drop("o_orderstatus"))


@query(SCORE + "select case_id, method, rank() over w + (count(*) over (partition by method, value) - 1) / 2.0::double as rank from v_score window w as (partition by method order by value)")
def w9_rank_avg(spark, d):
    return scores.rank_avg(view(spark, d, "v_score"), ["method"], "value").select("case_id", "method", "rank")


@query(SCORE + "select case_id, method, round((max(value) over w - value) / (max(value) over w - min(value) over w), 6) as scaled from v_score window w as (partition by method)")
def w10_minmax_scale(spark, d):
    return rounded(scores.minmax_scale(view(spark, d, "v_score"), "method", "value").select("case_id", "method", "scaled"), "scaled")


@query(SCORE + "select case_id, method, max(value) over (partition by case_id order by method) as running_max from v_score")
def w11_running_max(spark, d):
    return scores.running_max(view(spark, d, "v_score"), "case_id", "method", "value").select("case_id", "method", "running_max")


@query("select c_name, regexp_replace(lower(c_name), '[0-9].*', '') || lpad(regexp_extract(c_name, '([0-9]+)', 1), 20, '0') as key from customer")
def t1_natural_sort(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_name", C.natural_key("c_name").alias("key")).orderBy("key")


@query("select c_custkey, c_mktsegment, case c_mktsegment when 'MACHINERY' then 1 when 'BUILDING' then 2 else 3 end::bigint as place from customer")
def t2_fixed_order_sort(spark, d):
    return scores.fixed_order_sort(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["MACHINERY", "BUILDING"])


@query(SCORE + "select case_id, round(avg(value), 4) as mean from v_score group by 1 order by 2 desc, 1 limit 10")
def t3_best_configs(spark, d):
    return scores.best_configs(rounded(scores.summarise(view(spark, d, "v_score"), ["case_id"]), "mean", digits=4), 10, tie="case_id").select("case_id", "mean")


@query("with r as (select c_custkey as case_id, row_number() over (order by md5('42_' || c_custkey), c_custkey) - 1 as i, count(*) over () as n from customer) select case_id from r where i >= 3 and i < floor(0.4 * n)")
def t4_case_slice(spark, d):
    return splits.case_slice(view(spark, d, "v_case").select("case_id"), "case_id", 0.4, start=3)


@query(SCORE + ", m as (select category, method, round(avg(value), 4) as mean from v_score group by 1, 2) select category, method, mean from (select *, rank() over (partition by category order by mean desc) as r from m) where r = 1")
def t6_best_method(spark, d):
    means = rounded(scores.summarise(view(spark, d, "v_score"), ["category", "method"]).select("category", "method", "mean"), "mean", digits=4)
    return scores.best_method(means, ["category"])


@query(ART + "select case_id from v_artifact group by 1 having count(distinct folder) = 4")
def u1_common_cases(spark, d):
    return catalog.common_cases(view(spark, d, "v_artifact"))


@query("select distinct o_custkey as case_id from orders where o_orderstatus = 'O' intersect select o_custkey from orders where o_orderstatus = 'F'")
def u2_split_overlap(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderstatus") == "O", "train").when(F.col("o_orderstatus") == "F", "test").alias("role"))
    return splits.split_overlap(rows)


@query("select distinct o_custkey as case_id from orders where o_orderkey % 2 = 0 and o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def u3_subset_check(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("case_id"), "o_orderkey", "o_orderstatus")
    return splits.subset_check(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderstatus = 'F'"))


STRATIFIED = "(select *, count(*) over (partition by anatomy) as n, row_number() over (partition by anatomy order by md5('42_' || case_id), case_id) as r from {0})"
TESTS = "case when r <= case when n = 1 then 0 else greatest(1, least(round_even({0} * n, 0)::bigint, n - 1)) end then 'test' else 'train' end as role"


@query(CASES + ", given as (select case_id from v_case where case_id % 11 = 0 union select case_id from v_case where case_id % 13 = 0), rest as (select * from v_case where case_id not in (select case_id from given)) select case_id, 'test' as role from given union all select case_id, " + TESTS.format("0.25") + " from " + STRATIFIED.format("rest"))
def u4_aggregate_split(spark, d):
    cases = view(spark, d, "v_case")
    return splits.aggregate_split([cases.where("case_id % 11 = 0"), cases.where("case_id % 13 = 0")], cases, "anatomy", "case_id", 0.25)


@query("select 'a' as method, o_custkey as case_id, o_totalprice as value from orders where o_orderstatus = 'F' union all select 'b', o_custkey, o_totalprice from orders where o_orderstatus = 'O'")
def u5_union_scores(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("case_id"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    return splits.union_scores({"a": rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), "b": rows.where("o_orderstatus = 'O'").drop("o_orderstatus")})


@query("select case_id, line_id, case when " + HASH.format("case_id::varchar || '_' || line_id::varchar") + " < 0.2 and line_id <> 0 then 'val' else 'train' end as role from (select distinct o_custkey as case_id, o_orderkey % 4 as line_id from orders)")
def d1_hash_role(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 4).alias("line_id")).distinct()
    return rows.withColumn("role", splits.hash_role("case_id", "line_id", 0.2))


@query(CASES + "select case_id, anatomy, " + TESTS.format("0.15") + " from " + STRATIFIED.format("v_case"))
def d2_stratified_split(spark, d):
    return splits.stratified_split(view(spark, d, "v_case").select("case_id", "anatomy"), "anatomy", "case_id", 0.15)


@query("with r as (select c_custkey as case_id, row_number() over (order by md5('42_' || c_custkey), c_custkey) - 1 as i, count(*) over () as n from customer) select case_id, case when i < floor(0.8 * n) then 'train' else 'test' end as role from r")
def d3_random_split(spark, d):
    return splits.random_split(view(spark, d, "v_case").select("case_id"), "case_id", 0.8)


@query(CASES + ", t as (select distinct o_orderpriority as split_name, o_custkey as case_id from orders where o_orderstatus = 'P') select s.split_name, dataset, c.case_id, case when t.case_id is null then 'train' else 'test' end as role from (select case_id, min(dataset) as dataset from v_case group by 1) c cross join (select distinct split_name from t) s left join t on t.split_name = s.split_name and t.case_id = c.case_id")
def d4_apply_named_splits(spark, d):
    tests = spark.read.parquet(f"{d}/orders.parquet").where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("split_name"), F.col("o_custkey").alias("case_id"))
    return splits.apply_named_splits(view(spark, d, "v_case"), tests)


@query("select o_orderkey, case o_orderstatus when 'O' then 'train' when 'F' then 'test' else case when o_orderkey % 2 = 0 then 'train' end end as role from orders")
def d5_role_from_text(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 2 == 0, "Training set").otherwise("?")).otherwise(F.col("o_orderstatus")).alias("text"))
    return rows.select("o_orderkey", splits.role_from_text("text", {"O": "train", "f": "test"}).alias("role"))


@query("select o_orderkey as \"NAME\", o_totalprice as \"RADIUS\", o_custkey as \"NUM_OUTLETS\", o_orderpriority as \"BIFURCATION\" from orders where o_orderstatus = 'F'")
def d6_radius_labels(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("NAME"), F.col("o_totalprice").alias("RADIUS"), F.col("o_custkey").alias("NUM_OUTLETS"), F.col("o_orderpriority").alias("BIFURCATION"), F.col("o_orderstatus").alias("role"))
    return splits.radius_labels(rows.drop("role"), rows.select("NAME", "role"), "F")


PAIRS = SCORE + ", d as (select a.method as method_a, b.method as method_b, a.value - b.value as difference, abs(a.value - b.value) as size from v_score a join v_score b on a.case_id = b.case_id and a.method < b.method where a.value <> b.value), r as (select *, rank() over (partition by method_a, method_b order by size) + (count(*) over (partition by method_a, method_b, size) - 1) / 2.0 as rank, count(*) over (partition by method_a, method_b, size) as t from d) "

def _simpson(term: str, upto: str) -> str:
    """SQL: the integral of term over u from 0 to upto, by Simpson's rule in 2000 steps."""
    return f"({upto}) / 6000 * list_sum([(case when k in (0, 2000) then 1 when k % 2 = 1 then 4 else 2 end) * ({term.replace('u', f'(({upto}) * k / 2000)')}) for k in range(0, 2001)])"


def _normal_p(z: str) -> str:
    return f"round(greatest(0, 1 - sqrt(2 / pi()) * {_simpson('exp(-u * u / 2)', f'abs({z})')}), 6) + 0.0"


def _t_p(t: str, df: str) -> str:
    return f"round(greatest(0, 1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {_simpson(f'pow(cos(u), {df} - 1)', f'atan(abs({t}) / sqrt({df}))')}), 6) + 0.0"


RANKED = "select method_a, method_b, count(*) as n, coalesce(sum(case when difference > 0 then rank end), 0)::double as w_plus, coalesce(sum(case when difference < 0 then rank end), 0)::double as w_minus, sum(t * t - 1)::double as ties from r group by 1, 2"
WILCOXON = PAIRS + f", w as ({RANKED}), z as (select *, (least(w_plus, w_minus) - n * (n + 1) / 4) / nullif(sqrt(n::double * (n + 1) * (2 * n + 1) / 24 - ties / 48), 0) as z from w), p as (select *, {_normal_p('z')} as p from z) "


@query(WILCOXON + "select method_a, method_b, n, w_plus, w_minus, round(z, 6) as z, p from p")
def e15_wilcoxon(spark, d):
    return rounded(scores.wilcoxon(view(spark, d, "v_score")), "z", "p")


TWO = SCORE.rstrip() + ", v_two as (select * from v_score where method in ('1-URGENT', '5-LOW')) "


@query((TWO + WILCOXON[len(SCORE) :].replace("v_score", "v_two")) + "select 'wilcoxon' as test, round(z, 6) as statistic, p from p")
def e16_omnibus_of_two(spark, d):
    return rounded(scores.omnibus(view(spark, d, "v_score").where("method in ('1-URGENT', '5-LOW')")), "statistic", "p")


@query(
    SCORE
    + ", m as (select method, count(value) as n, avg(value) as m, var_samp(value) as s from v_score group by 1), q as (select a.method as method_a, b.method as method_b, a.n as n_a, b.n as n_b, a.n + b.n - 2 as df, (a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2) * (1.0::double / a.n + 1.0::double / b.n)) as t from m a join m b on a.method < b.method)"
    + f"select method_a, method_b, n_a, n_b, df, round(t, 6) as t, {_t_p('t', 'df')} as p from q"
)
def e17_two_samples(spark, d):
    return rounded(scores.t_test_two_samples(view(spark, d, "v_score")), "t", "p")


SEGMENTS = """with s as (select l_linenumber as bucket, l_quantity::double as volume_gt, l_quantity * (0.7::double + (l_orderkey % 9) * 0.1::double) as volume_pred,
 (l_partkey % 7)::double as cap_area_gt, (l_suppkey % 5)::double as cap_area_pred, 1 + (l_partkey % 3) * 0.5::double as radius from lineitem) """


@query(
    SEGMENTS
    + """, e as (select *, (volume_pred - volume_gt) / volume_gt as e from s where volume_gt > 1e-12 and volume_pred > 1e-12),
 k as (select * from e where not (abs(e) > 0.2::double and greatest(cap_area_gt, cap_area_pred) / (4 * pi() * radius * radius) > 0.1::double))
 select bucket::bigint as bucket, count(*) as n, round(sum(volume_gt), 4) as volume_gt, round(sum(volume_pred), 4) as volume_pred, round(avg(e) filter (abs(e) < 0.35::double), 6) as error_rel from k group by 1"""
)
def a16_volume_buckets(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    share = F.lit(0.7) + (F.col("l_orderkey") % 9) * F.lit(0.1)
    segments = rows.select(
        F.col("l_linenumber").cast("long").alias("bucket"),
        F.col("l_quantity").cast("double").alias("volume_gt"),
        (F.col("l_quantity") * share).alias("volume_pred"),
        (F.col("l_partkey") % 7).cast("double").alias("cap_area_gt"),
        (F.col("l_suppkey") % 5).cast("double").alias("cap_area_pred"),
        (1 + (F.col("l_partkey") % 3) * 0.5).alias("radius"),
    )
    return rounded(rounded(scores.volume_bucket_means(segments, ["bucket"]), "volume_gt", "volume_pred", digits=4), "error_rel")


@query(SCORE + ", r as (select method, count(*) over (partition by value) as t, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 as rank from v_score where method in ('1-URGENT', '5-LOW')), s as (select count_if(method = '1-URGENT')::bigint as n_a, count_if(method = '5-LOW')::bigint as n_b, sum(case when method = '1-URGENT' then rank end)::double as r_a, sum(t * t - 1)::double as ties from r), u as (select *, r_a - n_a * (n_a + 1) / 2 as u, (n_a + n_b)::double as n from s), z as (select *, (u - n_a * n_b / 2) / sqrt(n_a::double * n_b / 12 * (n + 1 - ties / (n * (n - 1)))) as z from u) select n_a, n_b, r_a, u, round(z, 6) as z, " + _normal_p("z") + " as p from z")
def e16_mann_whitney(spark, d):
    return rounded(scores.mann_whitney(view(spark, d, "v_score"), "method", "value", "1-URGENT", "5-LOW"), "z", "p")


#: Of four degrees of freedom (five groups) the chi-square tail has a closed form.
@query("with r as (select o_orderpriority as g, rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0::double as rank from orders), p as (select g, count(*) as n, sum(rank) as r from r group by 1), t as (select sum(c::double * c * c - c) as ties from (select count(*) as c from orders group by o_totalprice)), h as (select (count(*) - 1)::bigint as df, (12 / (sum(n) * (sum(n) + 1.0::double)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - any_value(ties) / (sum(n)::double * sum(n) * sum(n) - sum(n))) as h from p, t) select df, round(h, 3) as h, round(case when df = 4 then exp(-h / 2) * (1 + h / 2) end, 4) as p from h")
def e16_kruskal_wallis(spark, d):
    return rounded(rounded(scores.kruskal_wallis(spark.read.parquet(f"{d}/orders.parquet"), "o_orderpriority", "o_totalprice"), "h", digits=3), "p", digits=4)


@query(SCORE + ", k as (select count(distinct method) as k from v_score), f as (select *, count(*) over (partition by case_id) as m from v_score), r as (select method, case_id, count(*) over (partition by case_id, value) as t, rank() over (partition by case_id order by value) + (count(*) over (partition by case_id, value) - 1) / 2.0::double as rank from f, k where m = k), p as (select method, sum(rank) as r, count(*) as n, sum(t * t - 1)::double as ties from r group by 1), c as (select (12 / (max(n)::double * max(k) * (max(k) + 1)) * sum(r * r) - 3 * max(n) * (max(k) + 1)) / (1 - sum(ties) / (max(n)::double * max(k) * (max(k) * max(k) - 1))) as chi2, (max(k) - 1)::bigint as df, max(n)::bigint as n_cases from p, k) select round(chi2, 6) as chi2, df, n_cases, round(case when df = 4 then exp(-chi2 / 2) * (1 + chi2 / 2) end, 6) as p from c")
def e16_friedman(spark, d):
    return rounded(scores.friedman(view(spark, d, "v_score")), "chi2", "p")


@query(SCORE + ", d as (select a.method as method_a, b.method as method_b, (a.value - b.value)::double as x from v_score a join v_score b on a.case_id = b.case_id and a.method < b.method), t as (select method_a, method_b, count(*) as n, avg(x) / (stddev_samp(x) / sqrt(count(*))) as t from d group by 1, 2) select method_a, method_b, n, n - 1 as df, round(t, 6) as t, " + _t_p("t", "(n - 1)") + " as p from t")
def e17_t_test(spark, d):
    return rounded(scores.t_test_paired(view(spark, d, "v_score")), "t", "p")


@query("with c as (select count_if(l_discount > 0.05 and not l_tax > 0.05)::bigint as b, count_if(not l_discount > 0.05 and l_tax > 0.05)::bigint as c from lineitem) select b, c, b + c as n, round(least(1, 2 * list_sum([exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)) for k in range(0, least(b, c) + 1)])), 6) as p from c")
def e18_mcnemar(spark, d):
    return rounded(scores.mcnemar(spark.read.parquet(f"{d}/lineitem.parquet"), "l_discount", "l_tax", 0.05).drop("least"), "p")


@query(WILCOXON + "select method_a, method_b, n, w_plus, w_minus, round(z, 6) as z, p, least(1, round(p * (select count(*) from p), 4)) as p_corrected from p")
def e19_pairwise_tests(spark, d):
    return rounded(rounded(scores.pairwise_tests(view(spark, d, "v_score")), "z", "p"), "p_corrected", digits=4)


_SHOWN = "case when {0} <> 0 and (abs({0}) < 0.01 or abs({0}) >= 1000) then printf('%.2e', {0}) else printf('%.3f', {0}) end"


@query(WILCOXON + f", s as (select method, avg(value) as m, case when count(value) >= 2 then stddev_pop(value) end as d from v_score group by 1), t as (select method, case when d is null then {_SHOWN.format('m')} else ({_SHOWN.format('m')}) || ' ± ' || ({_SHOWN.format('d')}) end as shown from s) select method_a, method_b, p, a.shown as shown_a, b.shown as shown_b from p join t a on a.method = method_a join t b on b.method = method_b")
def e23_comparison_table(spark, d):
    return rounded(scores.comparison_table(view(spark, d, "v_score")), "p")


@query("with f as (select p_partkey, p_size, p_partkey % 7 + 1 as n, p_partkey % 5 as k from part) select p_partkey, case k when 0 then 'Marching Cubes' when 1 then 'EGNN (ours)' when 2 then 'Taubin 0.' || n || '/' || p_size when 3 then 'Taubin ' || n || '/' || p_size else case when n < 4 then 'Taubin' else 'other_' || n end end as label from f")
def f3_method_label(spark, d):
    n, k, size = F.col("p_partkey") % 7 + 1, F.col("p_partkey") % 5, F.col("p_size")
    folder = F.when(k == 0, "mc").when(k == 1, "global_pred").when(k == 2, F.concat(F.lit("taubin_on_mc_0"), n, F.lit("_"), size)).when(k == 3, F.concat(F.lit("x_Taubin_"), n, F.lit("_"), size)).when(n < 4, " my_TAUBIN ").otherwise(F.concat(F.lit("other_"), n))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", C.method_label(folder).alias("label"))


@query(CATEGORY + "select category, method, count_if(status = 'diverged')::bigint as n_diverged from n group by 1, 2")
def e20_failure_panel(spark, d):
    named = scores.with_category(view(spark, d, "v_score").drop("category"), view(spark, d, "v_category"))
    return scores.count_status(named, ["category", "method"]).select("category", "method", "n_diverged")


@query(SCORE + ", d as (select a.category, a.case_id, abs(a.value - b.value) as x from v_score a join v_score b on a.case_id = b.case_id and a.method < b.method) select category, case_id, round(avg(x), 4) as mean_difference from d group by 1, 2")
def e14_point_differences(spark, d):
    return rounded(scores.point_differences(view(spark, d, "v_score"), "category"), "mean_difference", digits=4)


WIDE = "(select o_custkey as case_id, sum(case when o_orderstatus = 'F' then 1 end)::bigint as dice_radii_small, sum(case when o_orderstatus = 'O' then 1 end)::bigint as dice_radii_large from orders group by 1)"


@query(f"select case_id, 'dice_radii_small' as \"column\", dice_radii_small as value, 'small' as bucket from {WIDE} union all select case_id, 'dice_radii_large', dice_radii_large, 'large' from {WIDE}")
def e22_unpivot_buckets(spark, d):
    count = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, 1))
    wide = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("case_id")).agg(count("F").alias("dice_radii_small"), count("O").alias("dice_radii_large"), F.count("*").alias("other"))
    return scores.unpivot_buckets(wide, ["case_id"])


@query("select p_partkey, p_name, regexp_replace(p_brand, '#.*$', '') as brand, 'Brand' as first, regexp_extract(p_brand, '#(.*)$', 1) as second from part")
def f1_names(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", F.regexp_replace("p_brand", "#", "_vs_").alias("pair"), F.concat(F.lit("truths/x/"), F.regexp_replace("p_brand", "#.*", ".seg.nii.gz")).alias("path"))
    pair = C.parse_pair("pair")
    return rows.select("p_partkey", "p_name", C.stem("path").alias("brand"), pair["first"].alias("first"), pair["second"].alias("second"))


@query("select o_orderkey, '[' || printf('%.1f', (o_orderkey % 7)::double) || ', ' || case when o_orderkey % 3 = 0 then 'inf' else printf('%.1f', (o_orderkey % 11)::double) end || ')' as label from orders")
def f4_bucket_label(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 7).alias("lo"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 11).alias("hi"))
    return rows.select("o_orderkey", C.bucket_label("lo", "hi").alias("label"))


@query("select o_orderkey, case when o_orderkey % 1000 < 1 then '<0.001' else printf('%.3f', (o_orderkey % 1000) / 1000.0::double) end as shown from orders")
def f5_format_p(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", C.format_p(F.col("o_orderkey") % 1000 / 1000.0).alias("shown"))


@query("select c_name, case when regexp_extract(c_name, '([0-9]{4})', 1) <> '' then regexp_extract(c_name, '([0-9]{4})', 1) else c_name end as patient from customer")
def f6_case_to_patient(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_name", C.case_to_patient("c_name").alias("patient"))


@query("select event_id, substr(sha1(props), 1, 10) as sha10 from events")
def f7_params_sha10(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", C.params_sha10("props").alias("sha10"))


@query("select event_id, case when event_id % 5 = 0 then null else value end as value from events")
def f8_finite(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("value", F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 5 == 0, float("inf")).otherwise(F.col("value")))
    return rows.select("event_id", C.finite("value").alias("value"))


@query(ctes("v_line") + "select point_id, round(sqrt(x * x + y * y + z * z), 6) as norm, round(y * z - z * x, 6) as cx, ((round_even((x - 3) / 2, 0)))::bigint as i, round((x - 3) / 97, 6) as u from v_line")
def f9_f11_vectors(spark, d):
    rows = view(spark, d, "v_line")
    v = C.vec("x", "y", "z")
    w = (F.col("y"), F.col("x"), F.col("z"))
    return rounded(rows.select("point_id", C.norm(v).alias("norm"), C.cross(v, w)[0].alias("cx"), C.phys_to_index("x", F.lit(3.0), F.lit(2.0)).alias("i"), C.to_unit_box("x", F.lit(3.0), F.lit(100.0)).alias("u")), "norm", "cx", "u")


@query("select l_orderkey, l_linenumber, case when l_quantity <= 10 then 0.0::double when l_quantity > 30 then 1.0 else (l_quantity - 10) / 20 end as w from lineitem")
def f23_window_level(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", C.window_level("l_quantity", F.lit(20.0), F.lit(20.0)).alias("w"))


@query(ctes("v_line") + "select point_id, x * 2 as ax, round(-y, 6) + 0.0 as ry, round_even(x / 101 * 10, 0) / 10 * 101 as sx from v_line")
def f15_f19_points(spark, d):
    rows = view(spark, d, "v_line")
    v = C.vec("x", "y", "z")
    return rows.select("point_id", C.affine(v, 2.0)[0].alias("ax"), (C.lps_to_ras(v)[1] + F.lit(0.0)).alias("ry"), C.snap_to_grid("x", 10, F.lit(0.0), F.lit(101.0)).alias("sx"))


@query("select c_custkey, [-(c_custkey % 7 + 2) * 2.0::double, 0.0, 0.0] as lo, [0.0::double, (c_custkey % 5 + 2) * 3.0::double, 8.0] as hi from customer")
def f17_volume_bounds(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet")
    size = F.array(F.col("c_custkey") % 7 + 3, F.col("c_custkey") % 5 + 3, F.lit(9).cast("long"))
    bounds = C.volume_bounds(size, F.array(F.lit(2.0), F.lit(3.0), F.lit(1.0)), F.array(*[F.lit(0.0)] * 3), F.array(*[F.lit(float(v)) for v in (-1, 0, 0, 0, 1, 0, 0, 0, 1)]))
    tidy = lambda a: F.transform(a, lambda v: v + F.lit(0.0))
    return rows.select("c_custkey", tidy(bounds["lo"]).alias("lo"), tidy(bounds["hi"]).alias("hi"))
