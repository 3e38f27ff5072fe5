"""Sources, sinks and streams, over files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoframe.operators.catalog import fields_of_record
from geoframe.plans.registry import query
from geoframe.plans.storage import shared_folder, tasks_of
from geoframe.plans.views import POINTS, ctes, view
from geoframe.sources import tables as S
from geoframe.streaming import ingest


@query("with f as (select 'r/images/c' || doc_id || case doc_id % 3 when 0 then '.nii.gz' when 1 then '.mha' else '.seg.nii.gz' end as path, 'images' as folder, 'c' || doc_id as case_id, case doc_id % 3 when 1 then 3 else 0 end as rank from documents union all select 'r/surfaces/c' || doc_id || '.stl', 'surfaces', 'c' || doc_id, 8 from labels where doc_id % 2 = 0 union all select 'r/surfaces/c' || doc_id || '.vtp', 'surfaces', 'c' || doc_id, 6 from labels) select folder, case_id, arg_min(path, rank) as path, min(rank) as rank from f group by 1, 2")
def s1_scan_artifacts(spark, d):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    path = lambda df, folder, ending: df.select(F.concat(F.lit(f"r/{folder}/c"), F.col("doc_id").cast("string"), ending).alias("path"), F.lit(1).alias("length"))
    ending = F.when(F.col("doc_id") % 3 == 0, ".nii.gz").when(F.col("doc_id") % 3 == 1, ".mha").otherwise(".seg.nii.gz")
    files = path(docs, "images", ending).union(path(labels.where("doc_id % 2 = 0"), "surfaces", F.lit(".stl"))).union(path(labels, "surfaces", F.lit(".vtp"))).union(path(docs, "images/.hidden/x", F.lit(""))).union(path(docs, "images", F.lit("")).select(F.regexp_replace("path", "/c", "/.c"), "length"))
    return S.artifact_rows(files)


@query(ctes("v_line") + "select case_id, count(*) as n_points from v_line where case_id in (1, 3) group by 1")
def s2_scan_geometry(spark, d):
    root = shared_folder(spark, "geometry")
    for name, keep in (("v_line", "centerline_points"), ("v_vertex", "vertices"), ("v_face", "faces")):
        rows = view(spark, d, name).withColumnsRenamed({"mesh_id": "case_id"})
        # A case is one file: its lines are brought together, as meshes are. Tasks put files into place, not the driver.
        if name == "v_line":
            rows = rows.repartition(tasks_of(spark.read.parquet(f"{d}/events.parquet").count(), POINTS), "case_id")
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("case_id").parquet(f"{root}/{keep}")
    points = S.scan_geometry(spark, root, ["1", "3"])["centerline_points"]
    return points.groupBy(F.col("case_id").cast("long").alias("case_id")).agg(F.count("*").alias("n_points"))


@query(ctes("v_score") + "select case_id, value, regexp_replace(method, '.*-', '') as method from v_score where method in ('1-URGENT', '2-HIGH')")
def s3_read_scores(spark, d):
    root, scores = shared_folder(spark, "score-files"), view(spark, d, "v_score")
    for name in ("1-URGENT", "2-HIGH"):
        own = scores.where(F.col("method") == name).select("case_id", "value")
        own.union(own.agg(F.lit("MEAN"), F.max("value"))).write.csv(f"{root}/dice_{name.split('-')[1]}.csv", header=True)
    return S.read_scores(spark, f"{root}/dice_*.csv", "case_id string, value long", "dice")


@query(ctes("v_category") + "select category, (dense_rank() over (order by category) - 1)::int as category_order, case_id from v_category")
def s4_read_categories(spark, d):
    root = shared_folder(spark, "categories")
    listed = view(spark, d, "v_category").groupBy("category").agg(F.array_sort(F.collect_list("case_id")).alias("cases"))
    whole = listed.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "cases"))))).alias("value"))
    whole.write.text(root)
    return S.read_categories(spark, f"{root}/*.txt")


@query("select c_custkey::varchar as case_id, nullif(trim(case when c_custkey % 4 = 0 then ' ' else c_mktsegment end), '') as anatomy, case when c_custkey % 3 = 0 then 0 else 1 end + 1 as n_extra from customer")
def s5_read_metadata(spark, d):
    raw = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("Id"), F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_mktsegment")).alias("Anatomy"), F.col("c_name").alias("Name"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("x").alias("Note"))
    rows = fields_of_record(raw, {"case_id": "Id", "anatomy": "Anatomy"})
    return rows.select("case_id", "anatomy", F.size(F.map_keys("extra")).alias("n_extra"))


@query(ctes("v_case") + "select case_id, modality, case when case_id % 5 = 1 then 'test' else 'train' end as role from v_case")
def s6_write_samples(spark, d):
    root = shared_folder(spark, "samples")
    S.write_samples(view(spark, d, "v_case").select("case_id", "modality", F.when(F.col("case_id") % 5 == 1, "test").otherwise("train").alias("role")), root)
    return spark.read.parquet(root)


@query(ctes("v_score") + "select case_id, method, value, null::varchar as note from v_score where value % 2 = 0 union all select case_id, method, value, status from v_score where value % 2 <> 0")
def s7_append_results(spark, d):
    root, scores = shared_folder(spark, "results"), view(spark, d, "v_score")
    S.append_results(scores.where("value % 2 = 0").select("case_id", "method", "value"), root)
    S.append_results(scores.where("value % 2 <> 0").select("case_id", "method", "value", F.col("status").alias("note")), root)
    return S.read_results(spark, root)


@query("with p as (select 'c' || lpad(doc_id::varchar, 8, '0') as name, row_number() over (order by doc_id) - 1 + 5 as n from documents where doc_id in (select doc_id from labels)) select name, 'images/' || name as image, 'truths/' || name as label, 'vmr_' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end || '_0000' as train_image, 'vmr_' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end as train_label from p")
def s8_training_manifest(spark, d):
    name = F.concat(F.lit("c"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    one = lambda table, folder, c: spark.read.parquet(f"{d}/{table}.parquet").select(name.alias("name"), F.concat(F.lit(f"{folder}/"), name).alias(c))
    return S.training_manifest(one("documents", "images", "image"), one("labels", "truths", "label"), "vmr", 5)


@query("with r as (select (row_number() over (order by n_nationkey, c_custkey) - 1)::int as line, 'images/' || c_name || '.nii.gz' as image, c_mktsegment as kind, c_name as \"NAME\" from customer join nation on c_nationkey = n_nationkey) select * from r where kind in ('BUILDING')")
def s9_zip_case_lists(spark, d):
    root = shared_folder(spark, "lists")
    rows = spark.read.parquet(f"{d}/customer.parquet").orderBy("c_nationkey", "c_custkey")
    for name, c in (("image", F.concat("c_name", F.lit(".nii.gz"))), ("kind", F.col("c_mktsegment"))):
        # A list file is small by nature: one line a case.
        rows.select(c.alias("value")).coalesce(1).write.text(f"{root}/{name}")
    return S.zip_case_lists(spark, {"image": f"{root}/image/*.txt", "kind": f"{root}/kind/*.txt"}, {"image": "images/"}, kind=["BUILDING"])


@query("select c_custkey::varchar as case_id, [c_name] as aliases, case c_custkey % 3 when 0 then '(none)' when 1 then 'train' else 'test' end as role from customer where c_custkey % 7 <> 0")
def s10_load_case_csv(spark, d):
    k = F.col("c_custkey")
    raw = spark.read.parquet(f"{d}/customer.parquet").select(k.cast("string").alias("Name"), F.col("c_name").alias("alias"), F.when(k % 7 == 0, "group_header").when(k % 2 == 0, "case").otherwise("").alias("row_type"), F.when(k % 3 == 0, " ").when(k % 3 == 1, "Train").otherwise("TEST").alias("Split"))
    return S.load_case_csv(raw, alias_columns=["alias"])


@query("select c_custkey::varchar as value, case when c_custkey % 5 = 0 then 'test' else 'train' end as role from customer where c_custkey % 6 <> 0")
def s11_write_case_lists(spark, d):
    root = shared_folder(spark, "case-lists")
    k = F.col("case_id")
    S.write_case_lists(view(spark, d, "v_case").select("case_id", F.when(k % 6 == 0, None).when(k % 5 == 0, "test").otherwise("train").alias("role")), root)
    return spark.read.text(root)


@query("select o_custkey as case_id, arg_max(o_orderstatus, o_orderkey) as status, max(o_orderkey) as version from orders group by 1")
def r1_stream_catalog(spark, d):
    root = shared_folder(spark, "stream-catalog")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("case_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("version"))
    rows.repartition(4).write.parquet(f"{root}/in")
    files = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    table = ingest.BucketedTable(spark, f"{root}/table", ["case_id"], "version")
    ingest.stream_catalog(files, table, f"{root}/checkpoint").awaitTermination()
    return table.read(rows)


@query("select distinct user_id as case_id, event_type as settings_hash from events")
def r2_stream_scores(spark, d):
    root = shared_folder(spark, "stream-scores")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("settings_hash"), F.col("ts").cast("timestamp").alias("ts"))
    rows.repartition(4).write.parquet(f"{root}/in")
    files = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    ingest.stream_scores(files, f"{root}/out", f"{root}/checkpoint", "ts", ["case_id", "settings_hash"], "3650 days").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("case_id", "settings_hash")
