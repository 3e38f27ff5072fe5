"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a written table that one task takes into a join; most tasks, as up to so many shuffled parts are written without a sort
#: in memory, and a task may read millions of rows from files that compress well.
ROWS, MOST = 400_000, 200

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share.

    Only a local session may lack that setting, as in tests: it gets a temporary folder, which goes when Python ends.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
            atexit.register(shutil.rmtree, _local[context.applicationId], ignore_errors=True)
        root = _local[context.applicationId]
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: lineage ends here, lost executors lose nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_large(df: DataFrame, name: str) -> DataFrame:
    """stored() for a table that grows with the input. A join with it shuffles both sides: rows of a file that compresses well
    take many times its bytes, so its size would have Spark send them all through the driver."""
    return stored(df, name).hint("merge")


def tasks_of(count: int, rows: int | None = None) -> int:
    """Tasks to deal so many rows to, as a session's number of partitions doesn't grow with them."""
    return min(count // (rows or ROWS) + 1, MOST)


def tasks_for(table: DataFrame, rows: int | None = None) -> int:
    """tasks_of() the rows of a written table."""
    return tasks_of(table.count(), rows)
