"""Draws until every stratum is full, and cells that polylines touch."""

from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.operators import routes as rt
from cellweave.operators import sampling as sp


def _proposals(spark):
    """Stratum by draw; every 5th draw is ruled out early, every 7th late; stratum 2 is rare."""

    def propose(lo, hi):
        d = F.col("draw")
        stratum = F.when(d % 11 == 0, 2).when(d % 3 == 0, 1).otherwise(0)
        return spark.range(lo, hi).withColumnRenamed("id", "draw").select(
            "draw", F.when(d % 5 == 0, None).otherwise(stratum).alias("stratum"), F.when(d % 5 == 0, "no ground").alias("early"), F.when(d % 7 == 0, "too long").alias("late"))

    return propose


def _plain(quotas):
    left, out, reasons, d = list(quotas), [], {}, 0
    while any(left):
        s = 2 if d % 11 == 0 else 1 if d % 3 == 0 else 0
        if d % 5 == 0:
            why = "no ground"
        elif not left[s]:
            why = "stratum full"
        elif d % 7 == 0:
            why = "too long"
        else:
            why = "accepted"
            left[s] -= 1
            out.append((s, quotas[s] - left[s], d))
        reasons[why] = reasons.get(why, 0) + 1
        d += 1
    return sorted(out), reasons, d


@pytest.mark.parametrize("quotas, first", [([30, 25, 20], 16), ([30, 25, 20], 4096), ([5, 0, 3], 8)])
def test_quotas_fill_in_arrival_order(spark, quotas, first):
    found = sp.accept_until_full(_proposals(spark), "stratum", quotas, first)
    rows, reasons, draws = _plain(quotas)
    assert sorted((r.stratum, r.rank, r.draw) for r in found.rows.collect()) == rows
    assert {r.reason: r.n for r in found.reasons.collect()} == reasons
    assert found.draws == draws == sum(reasons.values())


def test_quotas_that_cannot_be_met_are_an_error(spark):
    with pytest.raises(ValueError, match="0 of 2"):
        sp.accept_until_full(_proposals(spark), "stratum", [1, 1, 1, 2], first=8, most_rounds=3)
    none = sp.accept_until_full(_proposals(spark), "stratum", [0, 0, 0])
    assert none.rows.count() == 0 and none.reasons.count() == 0 and none.draws == 0


def _touches(x1, y1, x2, y2, a, b, s):
    """Does the closed segment meet the half-open box [a, a + s) x [b, b + s)? Exact, over the piece of the line."""
    lo, hi, lo_open, hi_open = Fraction(0), Fraction(1), False, False
    for p, q, base in ((x1, x2, a), (y1, y2, b)):
        if p == q:
            if not base <= p < base + s:
                return False
            continue
        enter, leave = Fraction(base - p, q - p), Fraction(base + s - p, q - p)
        enter_open, leave_open = False, True
        if enter > leave:
            enter, leave, enter_open, leave_open = leave, enter, True, False
        if enter > lo or (enter == lo and enter_open):
            lo, lo_open = enter, enter_open
        if leave < hi or (leave == hi and leave_open):
            hi, hi_open = leave, leave_open
    return lo < hi or (lo == hi and not lo_open and not hi_open)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.integers(-9, 17)] * 4), min_size=40, max_size=60))
def test_touched_cells_equal_box_tests(spark, segs):
    rows = [(i, *[float(v) for v in seg]) for i, seg in enumerate(segs)]
    got = {(r.id, r.row, r.col) for r in rt.supercover(spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double"), ["id"], 4).collect()}
    want = {(i, r, c) for i, seg in enumerate(segs) for r in range(-4, 6) for c in range(-4, 6) if _touches(*seg, c * 4, r * 4, 4)}
    assert got == want


def test_points_nulls_and_long_segments(spark):
    rows = [(0, 4.0, 4.0, 4.0, 4.0), (1, None, 0.0, 1.0, 1.0), (2, float("nan"), 0.0, 1.0, 1.0), (3, 0.0, 0.5, 399999.5, 0.5), (4, 7.999, 0.0, 7.999, 12.0)]
    got = rt.supercover(spark.createDataFrame(rows, "id int, x1 double, y1 double, x2 double, y2 double"), ["id"], 4).groupBy("id").agg(F.count("*").alias("n"), F.max("row").alias("r")).collect()
    assert {r.id: (r.n, r.r) for r in got} == {0: (1, 1), 3: (100000, 0), 4: (4, 3)}
