import random

import pytest
from conftest import rows

from foldstone.operators.changes import apply_changes

SCHEMA = "k string, n bigint, op string, a string, b string"


def fold(spark, changes, **kw):
    df = spark.createDataFrame(changes, SCHEMA)
    return rows(apply_changes(df, ["k"], "n", "op", ["a", "b"], **kw).select("k", "a", "b", "last_no"))


def test_put_replaces_all_fields(spark):
    assert fold(spark, [("x", 1, "put", "1", "1"), ("x", 2, "put", "2", None)]) == [("x", "2", None, 2)]


def test_patch_keeps_what_it_does_not_set(spark):
    got = fold(spark, [("x", 1, "put", "1", "1"), ("x", 2, "patch", None, "2")], patch_ops=["patch"])
    assert got == [("x", "1", "2", 2)]


def test_nothing_from_before_a_delete_survives(spark):
    got = fold(spark, [("x", 1, "put", "1", "1"), ("x", 2, "delete", None, None), ("x", 3, "patch", None, "3")], patch_ops=["patch"])
    assert got == [("x", None, "3", 3)]


def test_order_and_repetition_do_not_matter(spark):
    changes = [("x", 1, "put", "1", "1"), ("x", 2, "delete", None, None), ("y", 4, "put", "4", None), ("y", 3, "delete", None, None)]
    got = fold(spark, random.Random(1).sample(changes * 3, 12))
    assert got == [("y", "4", None, 4)]


def test_ties_unknown_operations_and_nulls(spark):
    changes = [("t", 1, "put", "1", None), ("t", 1, "delete", None, None), ("u", 1, "put", "1", None), ("u", 2, None, None, None), ("v", None, "put", "1", None), (None, 1, "put", "1", None), ("w", 1, "PUT?", None, None)]
    assert fold(spark, changes) == []  # a delete wins a tie; an unknown operation deletes; without place or key nothing counts


def test_a_patch_that_sets_nothing_changes_nothing(spark):
    changes = [("x", 1, "put", "1", None), ("x", 2, "patch", None, None), ("y", 1, "patch", None, None)]
    assert fold(spark, changes, patch_ops=["patch"]) == [("x", "1", None, 1)]


def test_repeated_deliveries_that_differ(spark):
    assert fold(spark, [("x", 1, "put", None, "1"), ("x", 1, "put", "1", None)]) == [("x", "1", "1", 1)]
    assert len({tuple(fold(spark, r)) for r in ([("x", 1, "put", a, "1") for a in order] for order in ("ab", "ba"))}) == 1


def test_without_fields_being_there_is_the_field(spark):
    df = spark.createDataFrame([("x", 1, "put", None, None), ("x", 2, "patch", None, None), ("y", 1, "put", "1", None), ("y", 2, "delete", None, None)], SCHEMA)
    assert rows(apply_changes(df, ["k"], "n", "op", patch_ops=["patch"])) == [("x", 2, 1)]


def test_empty_feed(spark):
    assert fold(spark, []) == []


def test_clashing_extra_columns(spark):
    df = spark.createDataFrame([("x", 1, "put", "1", "z", "q")], "k string, n bigint, op string, a string, last_no string, __set string")
    assert rows(apply_changes(df, ["k"], "n", "op", ["a"]).select("k", "a", "last_no")) == [("x", "1", 1)]


@pytest.mark.parametrize("seed", range(4))
def test_equals_replay(spark, seed):
    r = random.Random(seed)
    changes = [(r.choice("xyz"), n, r.choice(["put", "patch", "delete"]), r.choice([None, str(n)]), r.choice([None, str(n)])) for n in range(60)]
    state = {}
    for k, n, op, a, b in changes:
        if op == "delete":
            state.pop(k, None)
        elif op == "patch" and a is None and b is None:
            pass  # sets nothing, so changes nothing
        elif op == "put" or k not in state:
            state[k] = [a, b, n]
        else:
            state[k] = [a or state[k][0], b or state[k][1], n]
    r.shuffle(changes)
    assert fold(spark, changes, patch_ops=["patch"]) == sorted(((k, *v) for k, v in state.items()), key=repr)
