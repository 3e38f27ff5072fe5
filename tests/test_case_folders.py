"""Geometry by cases: one file a case, and only the folders of the asked cases are looked into."""

from pathlib import Path

from geoframe.plans import queries_io, storage
from geoframe.sources import tables

SMALL = "/root/testdata/sf0.001"


def test_only_asked_cases_are_read(spark, monkeypatch):
    roots, make = [], storage.shared_folder
    monkeypatch.setattr(queries_io, "shared_folder", lambda s, name: (roots.append(make(s, name)), roots[-1])[1])
    monkeypatch.setattr(queries_io, "POINTS", 100, raising=False)
    found = queries_io.s2_scan_geometry(spark, SMALL)
    root = Path(roots[0].removeprefix("file:"))
    for name in ("centerline_points", "vertices", "faces"):
        assert all(len(list(case.glob("part-*.parquet"))) == 1 for case in (root / name).glob("case_id=*"))
    counts = {r.case_id: r.n_points for r in found.collect()}
    whole = tables.scan_geometry(spark, roots[0])
    given = tables.scan_geometry(spark, roots[0], ["1", "3"])
    for name, df in given.items():
        folders = {Path(f).parent.name for f in whole[name].inputFiles()}
        assert {Path(f).parent.name for f in df.inputFiles()} == folders & {"case_id=1", "case_id=3"} < folders
        assert df.columns == whole[name].columns and sorted(df.collect()) == sorted(whole[name].where("case_id in (1, 3)").collect())
    assert counts == {r.case_id: r["count"] for r in given["centerline_points"].groupBy("case_id").count().collect()}
    assert tables.scan_geometry(spark, roots[0], ["999999"])["faces"].count() == 0
    assert tables.scan_geometry(spark, roots[0], ["1", " 1"])["faces"].count() == given["faces"].where("case_id = 1").count()
