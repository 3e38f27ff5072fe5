"""No join of op13 broadcasts words, chunks or links, whose files are far smaller than their rows."""

from geoframe.plans import storage


def test_joins_shuffle_both_sides(spark, monkeypatch):
    import __spark_entry__

    plans, write = [], storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, folder: (plans.append(df), write(df, folder))[1])
    plans.append(__spark_entry__.queries()["op13_spelling_variants"](spark, "/root/testdata/sf0.001"))
    texts = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert sum("SortMergeJoin" in t for t in texts) >= 3
    assert not any("Broadcast" in t for t in texts)
