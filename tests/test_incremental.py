import datetime as dt
import random

import pytest
from conftest import rows

from foldstone.operators.incremental import done_ranges, pending_marks

T0 = dt.datetime(2024, 1, 1)
at = lambda h: None if h is None else T0 + dt.timedelta(hours=h)
RUNS, FEED = "scope string, low bigint, high bigint, started_at timestamp_ntz, status string", "scope string, mark bigint, arrived_at timestamp_ntz, run_scope string"


def left(spark, runs, feed):
    ledger = done_ranges(spark.createDataFrame([(s, a, b, at(h), x) for s, a, b, h, x in runs], RUNS))
    return rows(pending_marks(spark.createDataFrame([(s, m, at(h), s) for s, m, h in feed], FEED), ledger))


def test_bounds_status_and_arrival(spark):
    runs = [("v", None, 5, 10, "succeeded"), ("v", 5, 9, 20, "failed"), ("v", 9, 12, 20, " Succeeded ")]
    feed = [("v", 0, 1), ("v", 5, 10), ("v", 5, 11), ("v", 4, 11), ("v", 6, 1), ("v", 9, 1), ("v", 10, 1), ("v", 12, 1), ("v", 13, 1), ("w", 1, 1)]
    assert left(spark, runs, feed) == [("v", 13), ("v", 4), ("v", 6), ("v", 9), ("w", 1)]


def test_nulls_and_empty_tables(spark):
    assert left(spark, [], [("v", 1, 1), ("v", 1, 2), (None, 1, 1), ("v", None, 1)]) == [("v", 1)]
    assert left(spark, [("v", None, 5, 9, "succeeded")], []) == []
    assert left(spark, [("v", None, None, 9, "succeeded"), ("v", None, 5, None, "succeeded"), ("v", 5, 5, 9, None)], [("v", 1, 1)]) == [("v", 1)]
    assert left(spark, [("v", None, 5, 9, "succeeded")], [("v", 1, None)]) == [("v", 1)]


@pytest.mark.parametrize("seed, many", [(0, 40), (1, 40), (2, 40), (3, 600)])
def test_equals_brute_force(spark, seed, many):
    r = random.Random(seed)
    scale = r.choice([1, 1000, 10**12])
    runs = []
    for _ in range(many):
        a = r.randrange(50) * scale
        runs.append((r.choice("vw"), r.choice([None, a]), a + r.randrange(1, 20) * scale, r.randrange(100), r.choice(["succeeded", "failed", "aborted"])))
    feed = [(r.choice("vwx"), r.randrange(80) * scale + r.randrange(2), r.randrange(100)) for _ in range(400)]
    ok = lambda s, m, h: any(x == "succeeded" and q == s and (a is None or a < m) and m <= b and g >= h for q, a, b, g, x in runs)
    want = {(s, m) for s, m, _ in feed} - {(s, m) for s, m, h in feed if ok(s, m, h)}
    assert left(spark, runs, feed) == sorted(want, key=repr)
