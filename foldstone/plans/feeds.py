"""Streaming queries and binary round trips, each with the oracle of its batch twin where there is one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.plans.store import ORACLES as STORE
from foldstone.plans.views import VIEWS, _SPARK, ctes
from foldstone.session import scratch
from foldstone.sources import formats
from foldstone.sources.tables import table
from foldstone.streaming import feeds


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A view over the events as a stream."""
    path = f"{d.rstrip('/')}/events.parquet"
    events = feeds.file_stream(spark, path, table(spark, d, "events").schema)
    return spark.sql(VIEWS[name].format(**_SPARK).replace("[events]", "{events}"), events=events)


def watch_events(spark, d):
    return feeds.run_append(feeds.change_events(_stream(spark, d, "kv_log")), "watch")


def watch_filtered(spark, d):
    return feeds.run_append(feeds.change_events(_stream(spark, d, "kv_log"), "user/00001", "tenant-1"), "watch-filtered")


def stream_state(spark, d):
    return feeds.live_state(_stream(spark, d, "kv_log"), "state").select("key", "value", "seq")


def stream_limiter(spark, d):
    requests = _stream(spark, d, "requests").select("event_id", "user_id", "ts_us")
    return feeds.run_append(feeds.stream_limiter(requests, "user_id", 3, 86_400_000_000), "limiter")


def stream_export(spark, d):
    return spark.read.text(feeds.run_lines(feeds.export_lines(_stream(spark, d, "kv_log")), "export")).select(F.col("value").alias("line"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return feeds.file_stream(spark, f"{d.rstrip('/')}/events.parquet", table(spark, d, "events").schema)


def stream_tumbling(spark, d):
    return feeds.run_append(feeds.tumbling(_events(spark, d), "1 hour", "10 minutes"), "tumbling").withColumn("started", F.col("started").cast("timestamp_ntz"))


def stream_sliding(spark, d):
    return feeds.run_append(feeds.sliding(_events(spark, d), "2 hours", "1 hour", "10 minutes"), "sliding").withColumn("started", F.col("started").cast("timestamp_ntz"))


def stream_sessions(spark, d):
    return feeds.run_append(feeds.sessions(_events(spark, d), "user_id", "2 hours", "10 minutes"), "sessions").withColumn("started", F.col("started").cast("timestamp_ntz"))


def _bytes_round(spark: SparkSession, rows: DataFrame, encode: Callable[[Iterator], bytes], name: str, fmt: str) -> DataFrame:
    """Write the rows with ``encode``, a file for each Arrow batch of a partition, then read the folder as ``fmt``."""
    formats.register(spark)
    path = scratch(spark, name)

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = formats.located(path)
        store.create_dir(folder, recursive=True)
        for n, frame in enumerate(frames):
            with store.open_output_stream(f"{folder}/part-{TaskContext.get().partitionId():05d}-{n:05d}") as f:  # a retry writes the same file
                f.write(encode(frame.itertuples(index=False)))
            yield pd.DataFrame({"n": [len(frame)]})

    rows.mapInPandas(save, "n bigint").agg(F.sum("n")).collect()
    return spark.read.format(fmt).load(path)


def fmt_wal(spark, d):
    """The whole log written as binary records and read back."""
    w = table(spark, d, "wal_entries").select(F.col("entry_id").alias("seq"), F.when(F.lower(F.trim("op")).isin("put", "1"), "put").otherwise("delete").alias("op"), "key", "value_bytes")
    got = _bytes_round(spark, w, lambda rows: b"".join(formats.wal_record(int(r.seq), r.op, r.key, bytes(r.value_bytes or b"")) for r in rows), "wal", "wal")
    return got.select("seq", "op", "key", F.lower(F.hex("value")).alias("value_hex"))


def fmt_segment(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("key"), F.col("text"))
    got = _bytes_round(spark, docs, lambda rows: b"".join(formats.blob_frame(r.key, (r.text or "").encode(), compress=True) for r in rows), "segment", "segment")
    return got.select("key", "size", "ok", F.decode("value", "UTF-8").alias("text"))


def fmt_index(spark, d):
    """Blob locations as index snapshots and back; a missing shard, size or digest is written as 0 or ''."""
    b = table(spark, d, "blob_locations")
    rows = b.select("key", F.coalesce("shard", F.lit(0)).alias("shard"), "blob_offset", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("blake3", F.lit("")).alias("hash"), F.coalesce("expires_at", F.lit(0)).alias("expires_at"))
    return _bytes_round(spark, rows, lambda rows: formats.index_snapshot((r.key, int(r.shard), int(r.blob_offset), int(r.size), r.hash, int(r.expires_at)) for r in rows), "index", "kvindex")


QUERIES = {"watch_events": watch_events, "watch_filtered": watch_filtered, "stream_state": stream_state, "stream_limiter": stream_limiter, "stream_export": stream_export, "stream_tumbling": stream_tumbling, "stream_sliding": stream_sliding, "stream_sessions": stream_sessions, "fmt_wal": fmt_wal, "fmt_segment": fmt_segment, "fmt_index": fmt_index}

# the watermark: ten minutes behind the last event, in whole milliseconds
_MARK = "with m as (select date_trunc('milliseconds', max(ts)) - interval 10 minutes as mark from events) "
_EVENTS = ctes("kv_log") + "select seq, op as event, key, tenant, ts_ms // 1000 as event_ts from kv_log"
ORACLES = {
    "watch_events": _EVENTS,
    "watch_filtered": _EVENTS + " where starts_with(key, 'user/00001') and tenant = 'tenant-1'",
    "stream_state": STORE["wal_fold_state"],
    "stream_limiter": STORE["sliding_limit"],
    "stream_export": ctes("kv_log") + """select '{"key":' || to_json(key) || ',"value":' || to_json(value) || '}' as line from kv_log where op = 'put'""",
    "stream_tumbling": _MARK + """, w as (select event_type, time_bucket(interval 1 hour, ts) as started from events)
select started, event_type, count(*) as n from w, m group by all having started + interval 1 hours <= any_value(mark)""",
    "stream_sliding": _MARK + """, w as (select event_type, unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) as started from events)
select started, event_type, count(*) as n from w, m group by all having started + interval 2 hours <= any_value(mark)""",
    "stream_sessions": _MARK + """, o as (select *, lag(ts) over (partition by user_id order by ts) as before from events),
s as (select *, sum(case when before is null or ts >= before + interval 2 hours then 1 else 0 end) over (partition by user_id order by ts) as session from o)
select user_id, min(ts) as started, count(*) as n from s, m group by user_id, session having max(ts) + interval 2 hours <= any_value(mark)""",
    "fmt_wal": "select entry_id as seq, case when lower(trim(op)) in ('put', '1') then 'put' else 'delete' end as op, key, case when lower(trim(op)) in ('put', '1') then lower(hex(coalesce(value_bytes, ''::blob))) end as value_hex from wal_entries",
    "fmt_index": "select key, coalesce(shard, 0) as shard, blob_offset, coalesce(size, 0) as size, coalesce(blake3, '') as hash, nullif(expires_at, 0) as expires_at from blob_locations",
    "fmt_segment": "select 'doc/' || doc_id as key, cast(strlen(text) as bigint) as size, true as ok, text from documents",
}
