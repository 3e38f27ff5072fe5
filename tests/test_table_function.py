"""Samples through a Python table function equal those of built-in functions; numbers follow the order of each case."""

import math

from geoframe.plans import queries_lines as q

SF = "/root/testdata/sf0.001"


def test_samples_of_the_table_function(spark):
    plain = {(r.case_id, r.line_id, r.seq, r.sub): r for r in q.k5_place_samples(spark, SF).collect()}
    got = q.x2_sample_udtf(spark, SF).collect()
    assert {(r.case_id, r.line_id, r.seq, r.sub) for r in got} == set(plain) and len(got) == len(plain) > 100
    for r in got:
        want = plain[r.case_id, r.line_id, r.seq, r.sub]
        for c in ("size_mult", "cx", "cy", "cz"):
            assert (r[c] is None) == (want[c] is None) and (r[c] is None or math.isclose(r[c], want[c], abs_tol=2e-6))
    by = {}
    for r in sorted(got, key=lambda r: (r.case_id, r.line_id, r.seq, r.sub)):
        by.setdefault(r.case_id, []).append(r.number)
    assert all(numbers == list(range(len(numbers))) for numbers in by.values())
