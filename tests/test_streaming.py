import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from foldstone.operators import metering
from foldstone.operators.fold import fold_state
from foldstone.session import scratch
from foldstone.streaming import feeds

LOG = "seq bigint, op string, key string, value string, ts_ms bigint, tenant string"


@pytest.fixture(scope="module")
def files(spark):
    path = scratch(spark, "stream-in")
    log = [(0, "put", "a", "1", 1000, "t"), (3, "delete", "b", None, 4000, "u"), (1, "put", "b", "2", 2000, "u"), (2, "put", "a", "3", 3999, "t"), (2, "put", "a", "3", 3999, "t")]
    for row in log:
        spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(path)
    return path


def test_state_from_many_late_and_repeated_batches(spark, files):
    got = feeds.live_state(feeds.file_stream(spark, files, LOG), "s1").select("key", "value", "seq")
    assert rows(got) == [("a", "3", 2)] == rows(fold_state(spark.read.parquet(files)).select("key", "value", "seq").distinct())


def test_events_are_filtered(spark, files):
    events = feeds.change_events(feeds.file_stream(spark, files, LOG), "a", "t")
    assert rows(feeds.run_append(events, "s2").distinct()) == [(0, "put", "a", "t", 1), (2, "put", "a", "t", 3)]


def test_fan_out_writes_the_same_everywhere(spark, files):
    a, b = feeds.fan_out(feeds.file_stream(spark, files, LOG), "s3", ["one", "two"])
    assert spark.read.parquet(a).count() == spark.read.parquet(b).count() == 5


def test_windows_and_repeats(spark):
    path = scratch(spark, "stream-events")
    t = dt.datetime(2024, 1, 1)
    events = [(t + dt.timedelta(minutes=m), e, i) for i, (m, e) in enumerate([(1, "x"), (2, "x"), (61, "x"), (62, "y"), (300, "x")])]
    for e in [*events, events[1]]:
        spark.createDataFrame([e], "ts timestamp_ntz, event_type string, event_id bigint").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: feeds.file_stream(spark, path, "ts timestamp_ntz, event_type string, event_id bigint", files=100)
    once = feeds.run_append(feeds.deduplicated(stream(), ["event_id"], "ts", "10 hours"), "w1")
    assert once.count() == 5
    closed = feeds.run_append(feeds.tumbling(stream(), "1 hour", "30 minutes"), "w2").select(F.hour("started"), "event_type", "n")
    assert rows(closed) == [(0, "x", 3), (1, "x", 1), (1, "y", 1)]


def append(spark, path, batches, schema):
    for rows_ in batches:  # a file a batch, in this order
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(path)
    return feeds.file_stream(spark, path, schema)


@pytest.mark.parametrize("every", [1, 2, 16])
def test_state_is_folded_as_it_grows(spark, monkeypatch, every):
    monkeypatch.setattr(feeds, "FOLD_EVERY", every)
    r = random.Random(every)
    log = [(n, r.choice(["put", "put", "delete"]), r.choice("abcd"), str(n), n, "t") for n in r.sample(range(60), 60)]
    batches = [log[i : i + 10] for i in range(0, 60, 10)]
    got = feeds.live_state(append(spark, scratch(spark, "grows"), batches, LOG), "s")
    assert rows(got.select("key", "seq")) == rows(fold_state(spark.createDataFrame(log, LOG)).select("key", "seq"))


def test_no_batch_gives_an_empty_state(spark):
    path = scratch(spark, "none")
    spark.createDataFrame([], LOG).write.parquet(path)
    assert feeds.live_state(feeds.file_stream(spark, path, LOG), "s").count() == 0


def test_limiter_over_many_files_out_of_order(spark):
    """Requests that come up to a minute late are judged by time, as the batch limiter does; the last file's lone request moves the watermark."""
    r = random.Random(2)
    requests = sorted((r.randrange(600) * 1_000_000, r.choice("ab")) for _ in range(150))
    requests = [(i, k, t) for i, (t, k) in enumerate(requests)]
    shifted = sorted(requests, key=lambda x: x[2] + r.randrange(50) * 1_000_000)
    schema = "event_id bigint, ip string, ts_us bigint"
    batches = [shifted[i : i + 15] for i in range(0, 150, 15)] + [[(999, "z", 10_000 * 1_000_000)]]
    got = feeds.run_append(feeds.stream_limiter(append(spark, scratch(spark, "late"), batches, schema), "ip", 3, 60_000_000, "1 minute"), "l")
    want = metering.sliding_limit(spark.createDataFrame(requests, schema), "ip", 3, 60_000_000)
    assert rows(got.where("event_id < 999")) == rows(want)


def test_windows_leave_late_events_out(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda *minutes: [(t + dt.timedelta(minutes=m), "x", m) for m in minutes]
    batches = [at(1, 2, 70), at(50), at(200), at(210), at(3), at(500)]  # 50 is late but within half an hour's watermark; 3 comes when hour 0 is closed
    stream = lambda: append(spark, scratch(spark, "windows"), batches, "ts timestamp_ntz, event_type string, event_id bigint")
    once = feeds.run_append(feeds.tumbling(stream(), "1 hour", "30 minutes"), "w3")
    assert rows(once.select(F.hour("started"), "n")) == [(0, 3), (1, 1), (3, 2)]
    wide = feeds.run_append(feeds.sliding(stream(), "2 hours", "1 hour", "30 minutes"), "w4").select(F.date_format("started", "dd-HH"), "n")
    assert rows(wide) == [("01-00", 4), ("01-01", 1), ("01-02", 2), ("01-03", 2), ("31-23", 3)]
    lone = feeds.run_append(feeds.sessions(stream(), "event_type", "1 hour", "30 minutes"), "w5").select(F.hour("started"), F.minute("started"), "n")
    assert rows(lone) == [(0, 1, 4), (3, 20, 2)]
