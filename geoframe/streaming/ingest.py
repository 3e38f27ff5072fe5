"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoframe.operators.catalog import latest_wins


class BucketedTable:
    """A table of rows by key in a folder that all can reach, changed by upserts of batches.

    Rows are in buckets by a hash of their key. A batch rewrites only the buckets that it touches, as
    data/<batch>/bucket=<b>; manifest/<batch> lists for every bucket the batch that wrote it last. A batch whose manifest is
    there is done; one that is given again, after a failure, is computed from the manifest before it, so it ends the same.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], version: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.version, self.buckets = spark, path, keys, version, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folder(self, name: str):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def batches(self) -> list[int]:
        """The batches that are done, by the names in the manifest folder; no data file is listed."""
        files, folder = self._folder("manifest")
        if not files.exists(folder):
            return []
        done = (s.getPath() for s in files.listStatus(folder))
        return sorted(int(p.getName()) for p in done if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def manifest(self, batch: int) -> dict[int, int]:
        """Bucket to the batch that wrote it: a row a bucket at most."""
        return {r.bucket: r.batch for r in self.spark.read.parquet(f"{self.path}/manifest/{batch}").collect()}

    def rows(self, written: dict[int, int], like: DataFrame) -> DataFrame:
        """The rows of the buckets of a manifest, with bucket."""
        paths = [f"{self.path}/data/{batch}/bucket={bucket}" for bucket, batch in sorted(written.items())]
        if not paths:
            return like.limit(0).withColumn("bucket", F.lit(0))
        return self.spark.read.schema(like.schema).parquet(*paths).withColumn("bucket", self.bucket())

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Of each key the row with the greatest version stays, the batch's rows taken in."""
        earlier = [b for b in self.batches() if b < number]
        written = self.manifest(earlier[-1]) if earlier else {}
        placed = batch.withColumn("bucket", self.bucket())
        touched = [r.bucket for r in placed.select("bucket").distinct().collect()]
        old = self.rows({b: written[b] for b in touched if b in written}, batch)
        merged = latest_wins(old, placed, self.keys, self.version)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{number}")
        now = written | {b: number for b in touched}
        listed = self.spark.createDataFrame(sorted(now.items()), "bucket int, batch long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")

    def read(self, like: DataFrame) -> DataFrame:
        """The table after the last batch; like has its columns."""
        done = self.batches()
        return self.rows(self.manifest(done[-1]) if done else {}, like).drop("bucket")

    def vacuum(self, keep: int = 2) -> None:
        """Remove manifests but the last ones, and the data that none of these names."""
        done = self.batches()
        kept = done[-keep:]
        needed = {batch for b in kept for batch in self.manifest(b).values()}
        for name, stay in (("manifest", set(kept)), ("data", needed | set(kept))):
            files, folder = self._folder(name)
            for b in done:
                if b not in stay:
                    files.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, str(b)), True)


def stream_catalog(files: DataFrame, table: BucketedTable, checkpoint: str):
    """Start a stream that keeps the latest row of each key of files in the table."""
    return files.writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_scores(rows: DataFrame, path: str, checkpoint: str, time: str, keys: list[str], delay: str = "1 hour"):
    """Start a stream that appends the first row of each key, within the watermark, to the Parquet table at path."""
    fresh = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
