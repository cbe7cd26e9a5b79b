import datetime as dt

import pytest
from conftest import rows

from foldstone.operators import features
from foldstone.operators.features import column_names, event_features, feature_table

S = "actor string, event string, at timestamp_ntz, bytes bigint, target string, message string"
T = dt.datetime(2024, 1, 1)


def table(spark, entries, schema=S, **kw):
    df = spark.createDataFrame(entries, schema)
    return {r["actor"]: r.asDict() for r in feature_table(df, "actor", "event", "at", "bytes", ["target", "message"], **kw).collect()}


def test_counts_recency_and_totals(spark):
    got = table(spark, [("a", "put", T, 5, "k", "m"), ("a", "put", T, 5, "k", "m"), ("a", "put", T, 5, "k2", "m"), ("b", "get.x", T + dt.timedelta(hours=1), 7, None, None)], block_size=1)
    a, b = got["a"], got["b"]
    assert (a["entries"], a["n_put"], a["total_put"], a["recency_s_put"], a["n_get_x"], a["recency_s_get_x"]) == (2, 2, 10, 3600, 0, None)
    assert (b["n_get_x"], b["total_get_x"], b["recency_s_get_x"], b["n_put"]) == (1, 7, 0, 0)


def test_nulls_make_their_own_row_and_never_merge(spark):
    got = table(spark, [(None, "put", T, None, None, ""), (None, "put", T, None, "", None), (None, None, None, 3, None, None), ("", "put", T, 1, "x", "y")])
    r = got[None]
    assert len(got) == 1 and (r["entries"], r["n_put"], r["total_put"], r["n_unnamed"], r["recency_s_unnamed"]) == (4, 3, 1, 1, None)


def test_catalogue_as_of_and_others(spark):
    got = table(spark, [("a", "put", T, 5, "k", "m"), ("a", "odd", T, 5, "k", "m")], events=["put", "never"], as_of="2024-01-02 00:00:00")
    assert (got["a"]["entries"], got["a"]["n_put"], got["a"]["n_never"], got["a"]["recency_s_put"]) == (2, 1, 0, 86400) and "n_odd" not in got["a"]


def test_empty_log_and_clashing_columns(spark):
    assert table(spark, []) == {}
    got = table(spark, [("a", "put", T, 5, "k" * 300_000, "m", "x", 1)], S + ", entity string, n bigint")
    assert got["a"]["n_put"] == 1


def test_column_names_stay_apart():
    assert column_names(["a.b", "a_b", "A B", "", "é"]) == ["a_b", "a_b_2", "a_b_3", "unnamed", "unnamed_2"]


def test_more_event_types_than_a_row_has_room_for(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_EVENTS", 2)
    entries = spark.createDataFrame([("a", e, T, 1, "k", "m") for e in ("p", "q", "r", "r")] + [(None, "p", None, None, "k", "m")], S)
    with pytest.raises(ValueError):
        feature_table(entries, "actor", "event", "at", "bytes", ["target", "message"])
    long = event_features(entries, "actor", "event", "at", "bytes", ["target", "message"])
    assert rows(long) == [("a", "p", 1, 0, 1), ("a", "q", 1, 0, 1), ("a", "r", 1, 0, 1), (None, "p", 1, None, 0)]
    assert event_features(entries.limit(0), "actor", "event", "at", "bytes", ["target"]).count() == 0


def test_no_table_stays_in_the_catalogue(spark):
    before = spark.sql("show tables").count()
    assert table(spark, [("a", "put", T, 5, "k", "m")])["a"]["n_put"] == 1 and spark.sql("show tables").count() == before
