"""Voxels are made by as many tasks as their rows ask for, whatever the session's number of partitions, and not dealt again."""

from geoframe.plans import views
from geoframe.plans.queries_grids import a19_ensemble_average

SMALL = "/root/testdata/sf0.001"


def test_voxels_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(views, "LINES", 500)
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    plan = a19_ensemble_average(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(sent) == 1 and f", {rows // 500 + 1})" in sent[0], sent
