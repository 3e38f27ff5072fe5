"""The distance to a triangle is long: it is asked of what is left after the boxes, and computed in steps short enough to compile."""

import re

from geoframe.plans.queries_geometry import j13_nearest_on_surface


def test_joins_don_t_ask_the_long_distance(spark):
    plan = j13_nearest_on_surface(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    asked = [line for line in plan.splitlines() if re.search(r"\b(Join|Filter)\b", line)]
    assert asked and not [line for line in asked if "CASE WHEN" in line or "POWER" in line]
    assert max(line.count("CASE WHEN") for line in plan.splitlines()) == 1
