"""Upserts by buckets against a dict, what a batch writes, and repeated batches."""

from pathlib import Path

from geoframe.streaming.ingest import BucketedTable


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    schema = "k long, v string, version long"
    table = BucketedTable(spark, str(tmp_path / "t"), ["k"], "version", 16)
    batches = [[(i, "a", 1) for i in range(200)], [(3, "b", 2), (500, "b", 1)], [(3, "old", 1), (4, "c", 9), (4, "d", 10)]]
    want = {}
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        table.upsert(df, number)
        for k, v, version in rows:
            if version >= want.get(k, ("", -1))[1]:
                want[k] = v, version
        assert {r.k: (r.v, r.version) for r in table.read(df).collect()} == want
    assert len(list(Path(tmp_path / "t/data/1").glob("bucket=*"))) <= 2
    table.upsert(spark.createDataFrame(batches[2], schema), 2)
    table.vacuum(1)
    assert table.batches() == [2] and {r.k: (r.v, r.version) for r in table.read(spark.createDataFrame([], schema)).collect()} == want
    assert table.read(spark.createDataFrame([], schema)).columns == ["k", "v", "version"]
