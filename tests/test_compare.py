from conftest import rows

from foldstone.operators.compare import compare, difference_lines, latest_rows

S = "k string, v string, n bigint"


def lines(spark, left, right):
    c = compare(spark.createDataFrame(left, S), spark.createDataFrame(right, S), ["k"], ["v", "n"], ("a", "b"))
    return rows(difference_lines(c, ["k"]))


def test_missing_and_differing(spark):
    got = lines(spark, [("1", "x", 1), ("2", "x", 1), ("3", "x", 1)], [("2", "x", 2), ("3", "x", 1), ("4", "x", 1)])
    assert got == [("1", "missing_b"), ("2", "n"), ("4", "missing_a")]


def test_null_differs_from_a_value_but_not_from_null(spark):
    assert lines(spark, [("1", None, 1), ("2", None, None)], [("1", "x", 1), ("2", None, None)]) == [("1", "v")]


def test_null_keys_match(spark):
    assert lines(spark, [(None, "x", 1)], [(None, "y", 1)]) == [(None, "v")]


def test_both_fields_and_values(spark):
    c = compare(spark.createDataFrame([("1", "x", 1)], S), spark.createDataFrame([("1", None, 2)], S), ["k"], ["v", "n"])
    r = c.collect()[0]
    assert [tuple(d) for d in r["diffs"]] == [("v", "x", None), ("n", "1", "2")]


def test_empty_sides(spark):
    assert lines(spark, [], []) == []
    assert lines(spark, [], [("1", "x", 1)]) == [("1", "missing_a")]


def test_clashing_columns_and_long_values(spark):
    left = spark.createDataFrame([("1", "x" * 1_000_000, "no", "no")], "k string, v string, diffs string, status string")
    right = spark.createDataFrame([("1", "x" * 1_000_000, 1)], "k string, v string, diffs bigint")
    assert compare(left, right, ["k"], ["v"]).select("status").collect()[0][0] == "same"


def test_latest_rows_breaks_ties_by_the_next_order(spark):
    df = spark.createDataFrame([("1", "x", 1), ("1", "y", 2), ("1", "z", None)], S).selectExpr("*", "5 as t")
    assert rows(latest_rows(df, ["k"], ["t", "n"], ["v"])) == [("1", "y")]
