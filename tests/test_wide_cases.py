"""p6_points_in_box pairs the points of all users with the same last digit, not of ten neighbours, against plain loops."""

from collections import Counter

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_p6_pairs_across_users(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "ts", "event_id").collect()
    seen, points = Counter(), []
    for r in rows:
        points.append((r.user_id % 10, f"{r.user_id // 10}_{seen[r.user_id]}", r.event_id, [r.event_id * a % b for a, b in ((7, 101), (13, 89), (29, 53))]))
        seen[r.user_id] += 1
    want = sorted((c, e, box) for c, box, _, q in points for k, _, e, p in points if c == k and all(abs(u - v) <= 6 for u, v in zip(p, q)))
    got = sorted(tuple(r) for r in entry.queries()["p6_points_in_box"](spark, SF).select("case_id", "point_id", "box_id").collect())
    assert got == want and len({e for _, e, _ in got}) == len(rows)
