"""The row of a score file's summary is an aggregate, so no task gets all scores."""

import geoframe.plans.queries_io as q


def test_s3_has_no_window_over_all(spark, monkeypatch):
    frame = type(spark.range(1))
    plans, union = [], frame.union
    monkeypatch.setattr(frame, "union", lambda a, b: (plans.append(b._jdf.queryExecution().optimizedPlan().toString()), union(a, b))[1])
    q.s3_read_scores(spark, "/root/testdata/sf0.001")
    assert plans and not [p for p in plans if "Window" in p]
