"""The tables of the data model, as views of the star-schema tables: for Spark and, as common table expressions, for SQL.

Cases are suppliers, customers or ten users each, so their number grows with the tables and their size doesn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.plans.storage import MOST

#: name -> (base tables, Spark SQL, DuckDB SQL; None if it is the same)
VIEWS: dict[str, tuple[str, str, str | None]] = {
    "v_line": (
        "events",
        """select {case} as case_id, {line} as line_id, event_id as point_id,
        cast(row_number() over (partition by {user} order by ts, event_id) - 1 as bigint) as seq,
        cast(event_id * 7 % 101 as double) as x, cast(event_id * 13 % 89 as double) as y, cast(event_id * 29 % 53 as double) as z,
        1 + (event_id % 5) * cast(0.5 as double) as radius, case when event_type = 'error' then 2 else -1 end as bifurc from events""",
        None,
    ),
    "v_vox": (
        "lineitem",
        """select l_suppkey as case_id, l_partkey % 12 as i, l_orderkey % 12 as j, cast(l_linenumber % 4 as bigint) as k,
        cast(sum(cast(l_quantity as bigint)) as bigint) as value, max(case when l_returnflag = 'R' then 1 else 0 end) as gt,
        max(case when l_linestatus = 'F' and l_quantity > 10 then 1 else 0 end) as pred from lineitem group by 1, 2, 3, 4""",
        None,
    ),
    "v_vertex": (
        "supplier",
        """select s_suppkey as mesh_id, cast(a * 16 + b as bigint) as vid, cast(a as double) as x, cast(b as double) as y,
        cast((a * 7 + b * 13 + s_suppkey * 3) % 5 as double) as z from supplier {grid16}""",
        None,
    ),
    "v_face": (
        "supplier",
        """select s_suppkey as mesh_id, cast(2 * (a * 15 + b) + s as bigint) as fid,
        cast(case when s = 0 then a * 16 + b else (a + 1) * 16 + b end as bigint) as v0,
        cast(case when s = 0 then (a + 1) * 16 + b else (a + 1) * 16 + b + 1 end as bigint) as v1,
        cast(a * 16 + b + 1 as bigint) as v2 from supplier {grid15}""",
        None,
    ),
    "v_point": (
        "embeddings",
        """select vec_id as point_id, label as grp, floor(cast({e0} as double) * 1000) as x, floor(cast({e1} as double) * 1000) as y,
        floor(cast({e2} as double) * 1000) as z from embeddings""",
        None,
    ),
    "v_score": (
        "orders",
        """select concat('c', o_custkey) as case_id, o_orderpriority as method, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as value,
        case when min(o_orderkey) % 7 = 0 then 'diverged' else 'ok' end as status, concat('g', o_custkey % 6) as category
        from orders group by o_custkey, o_orderpriority""",
        None,
    ),
    "v_category": ("orders", "select distinct concat('c', o_custkey) as case_id, concat('g', o_custkey % 6) as category from orders where o_custkey % 6 <> 5", None),
    "v_artifact": (
        "documents labels pages benchmark",
        """select 'images' as folder, doc_id as case_id from documents union all select 'truths', doc_id from labels
        union all select 'centerlines', page_id from pages union all select 'surfaces', item_id from benchmark""",
        None,
    ),
    "v_case": (
        "customer nation",
        """select c_custkey as case_id, c_mktsegment as anatomy, n_name as dataset,
        case c_custkey % 5 when 0 then 'CT' when 1 then 'CTA' when 2 then 'MR' when 3 then 'CT_MR' else 'US' end as modality
        from customer join nation on c_nationkey = n_nationkey""",
        None,
    ),
}

SPARK = {
    "case": "case_id",
    "line": "line_id",
    "user": "case_id, line_id",
    "grid16": "lateral view explode(sequence(0, 15)) as a lateral view explode(sequence(0, 15)) as b",
    "grid15": "lateral view explode(sequence(0, 14)) as a lateral view explode(sequence(0, 14)) as b lateral view explode(sequence(0, 1)) as s",
    "e0": "embedding[0]",
    "e1": "embedding[1]",
    "e2": "embedding[2]",
}
DUCKDB = {
    "case": "user_id // 10",
    "line": "user_id % 10",
    "user": "user_id",
    "grid16": ", range(16) as ta(a), range(16) as tb(b)",
    "grid15": ", range(15) as ta(a), range(15) as tb(b), range(2) as ts(s)",
    "e0": "embedding[1]",
    "e1": "embedding[2]",
    "e2": "embedding[3]",
}


#: Meshes that one task makes from its rows of supplier; rows of lineitem of which one task makes voxels; of events, lines.
MESHES, LINES, POINTS = 200, 500_000, 50_000
#: Views with more rows, or wider ones, than the files they come from suggest.
LARGE = ("v_line", "v_vox", "v_vertex", "v_face")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables in sf_dir.

    Meshes are dealt to tasks before their rows are made, as a small file is one task; so are the rows of voxels and whole
    lines, as a session's number of partitions doesn't grow with them. Joins with large views shuffle both
    sides: Spark would judge them by their files, and send them whole through the driver. What is dealt by meshes on both
    sides is joined where it is, by more keys than the mesh, too; the setting for that stays in the session.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    tables, text, _ = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()}
    if tables == "supplier":
        frames[tables] = frames[tables].repartition(frames[tables].count() // MESHES + 1, "s_suppkey")
    if name == "v_vox":
        place = [F.col("l_suppkey"), F.col("l_partkey") % 12, F.col("l_orderkey") % 12, (F.col("l_linenumber") % 4).cast("long")]
        used = frames[tables].select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
        frames[tables] = used.repartition(frames[tables].count() // LINES + 1, *place)
    if name == "v_line":
        # Windows over lines find their rows where they are.
        used = frames[tables].selectExpr("user_id div 10 as case_id", "user_id % 10 as line_id", "event_id", "ts", "event_type")
        frames[tables] = used.repartition(min(frames[tables].count() // POINTS + 1, MOST), "case_id", "line_id")
    for t in frames:
        text = _swap(text, t, "{" + t + "}")
    found = spark.sql(text.format(**SPARK, **{t: "{" + t + "}" for t in frames}), **frames)
    return found.hint("merge") if name in LARGE else found


def _swap(text: str, table: str, by: str) -> str:
    for word in ("from ", "join "):
        text = text.replace(word + table, word + by)
    return text


def ctes(*names: str) -> str:
    """`with` and the views' definitions for DuckDB."""
    return "with " + ", ".join(f"{n} as ({VIEWS[n][1].format(**DUCKDB)})" for n in names) + " "
