import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from foldstone.operators.references import RUN_WIDTH, contiguous_runs, numbered, orphans

P, R = "scope string, key bigint, since bigint", "scope string, key bigint, at bigint, id bigint"


def found(spark, parents, refs):
    return [r[-1] for r in rows(orphans(spark.createDataFrame(refs, R), spark.createDataFrame(parents, P)).select("id"))]


def test_runs_are_contiguous(spark):
    got = rows(contiguous_runs(spark.createDataFrame([("a", k, None) for k in (1, 2, 3, 3, 7, 8)], P)).select("run_start", "run_end"))
    assert got == [(1, 3), (7, 8)]


def test_missing_late_and_present(spark):
    parents = [("a", 1, 10), ("a", 2, None), ("b", 1, 0)]
    refs = [("a", 1, 10, 1), ("a", 1, 9, 2), ("a", 2, 0, 3), ("a", 3, 50, 4), ("b", 2, 5, 5), ("c", 1, 5, 6), ("a", 1, None, 7)]
    assert found(spark, parents, refs) == [2, 4, 5, 6]


def test_nulls_repeats_and_empty_tables(spark):
    refs = [(None, 1, 1, 1), ("a", None, 1, 2), ("a", 5, 1, 3), ("a", 5, 1, 4)]
    assert found(spark, [], refs) == [3, 4]
    assert found(spark, [("a", 5, None), (None, 1, None)], []) == []


def test_extra_columns_may_clash(spark):
    refs = spark.createDataFrame([("a", 9, 1, 1, "x", "y")], R + ", cut string, __run string")
    got = orphans(refs, spark.createDataFrame([("a", 1, 0)], P))
    assert got.select("id", "cut", "__run").collect()[0][:] == (1, "x", "y")


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    edge = [RUN_WIDTH * i + d for i in range(-1, 3) for d in (-2, -1, 0, 1)]
    parents = [(r.choice("ab"), r.choice(edge), r.choice([None, 3, 6])) for _ in range(25)]
    refs = [(r.choice("abc"), r.choice(edge), r.randrange(9), i) for i in range(300)]
    since = {}
    for s, k, t in parents:
        since[s, k] = min((x for x in (since.get((s, k)), t) if x is not None), default=None)
    want = [i for s, k, at, i in refs if (s, k) not in since or (since[s, k] is not None and since[s, k] > at)]
    assert sorted(found(spark, parents, refs)) == sorted(want)


def test_numbered_keeps_texts_apart(spark):
    texts = ["vol-1", "vol-01", "vol-001", "vol", "", "7", "07", "x" + "9" * 30, "vol-1x", "vol-"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    s, n = numbered(F.col("t"))
    assert df.select(s, n).distinct().count() == len(texts)
