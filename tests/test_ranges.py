"""Orders by ranges against plain sorting: hot groups, ties, nulls."""

import math
import random

import numpy as np
import pytest

from geoframe.operators import ranges, scores, spatial


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    # A third of all rows in one group, a third of that with one value; a null group; null values.
    found = [(i, "hot" if i % 3 == 0 else None if i % 31 == 0 else f"g{i % 5}", None if i % 17 == 0 else 7.0 if i % 9 == 0 else rnd.uniform(-50, 50)) for i in range(900)]
    return found, spark.createDataFrame(found, "id long, g string, v double").repartition(5)


def groups_of(found):
    out = {}
    for i, g, v in found:
        out.setdefault(g, []).append((i, v))
    return out


def test_totals_and_numbers(rows):
    found, df = rows
    from pyspark.sql import functions as F

    got = {r.id: r.before for r in ranges.group_total(df, ["g"], ["id"], F.col("id") % 4, "before").collect()}
    numbers = {r.id: r.n for r in ranges.group_number(df, ["g"], ["id"], "n").collect()}
    for mine in groups_of(found).values():
        total = 0
        for n, (i, _) in enumerate(sorted(mine)):
            assert (got[i], numbers[i]) == (total, n)
            total += i % 4
    assert len(got) == 900


def test_ranks(rows):
    found, df = rows
    got = {r.id: (r["rank"], r.t) for r in ranges.average_ranks(df, ["g"], "v").collect()}
    for mine in groups_of(found).values():
        values = [v for _, v in mine if v is not None]
        for i, v in mine:
            want = (sum(w < v for w in values) + (values.count(v) + 1) / 2, values.count(v)) if v is not None else (None, None)
            assert got[i] == want


def test_quantiles(rows):
    found, df = rows
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.g: r for r in ranges.quantiles(df, ["g"], "v", shares).collect()}
    for g, mine in groups_of(found).items():
        for name, share in shares.items():
            assert math.isclose(got[g][name], np.quantile([v for _, v in mine if v is not None], share), abs_tol=1e-9)
    whole = ranges.quantiles(df, [], "v", {"m": 0.5}).first().m
    assert math.isclose(whole, np.median([v for _, _, v in found if v is not None]))
    assert ranges.quantiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_interval_join(spark, rows):
    found, df = rows
    edges = {g: [(-40.0, -10.0), (-10.0, 5.0), (7.0, 20.0), (30.0, None)] if g != "g1" else [(7.0, 7.5)] for g in groups_of(found)}
    intervals = spark.createDataFrame([(g, lo, hi, n) for g, some in edges.items() for n, (lo, hi) in enumerate(some)], "g string, lo double, hi double, bin int")
    got = sorted((r.id, r.bin) for r in spatial.interval_join(df, intervals, "v", ["g"]).collect())
    want = [(i, n) for i, g, v in found if v is not None for n, (lo, hi) in enumerate(edges[g]) if lo <= v and (hi is None or v < hi)]
    assert got == sorted(want)
    assert spatial.interval_join(df, intervals.limit(0), "v", ["g"]).count() == 0


def test_own_edges(rows):
    found, df = rows
    got = {}
    for r in scores.distinct_radii_pool(df, "v", 4, ["g"]).collect():
        got.setdefault(r.g, {})[r.bin] = r.edge
    for g, mine in groups_of(found).items():
        last = None
        for b, edge in enumerate(np.quantile([v for _, v in mine if v is not None], [0, 0.25, 0.5, 0.75, 1])):
            last = edge if last is None else max(edge, last + 1e-9)
            assert math.isclose(got[g][b], last, abs_tol=1e-9)
