"""The data-processing problems over the domain tables, and their oracle text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.functions import normalise as N
from foldstone.operators.changes import apply_changes
from foldstone.operators.compare import compare, difference_lines, latest_rows
from foldstone.operators.features import event_features, feature_cells, feature_table
from foldstone.operators.incremental import Ledger, done_ranges, pending_marks, run_transitions
from foldstone.operators.references import numbered, orphans
from foldstone.plans.views import NOW_MS
from foldstone.session import materialise, scratch
from foldstone.sources.tables import table

#: Bytes in an entry's meta: a whole number, quoted or not, at any depth, also in a text that was cut off after it.
BYTES = r'"bytes"\s*:\s*"?([0-9]+)"?\s*[,}]'


def audit_entries(spark: SparkSession, d: str) -> DataFrame:
    """Normalised audit entries; a time before 2000 or more than a day after receipt is impossible and NULL."""
    log = table(spark, d, "audit_log")
    possible = (F.col("logged_at") >= F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("logged_at") <= F.col("received_at") + F.expr("interval 1 day"))
    return log.select(
        N.word("actor").alias("actor"),
        N.word("event").alias("event"),
        F.when(possible, F.col("logged_at")).alias("at"),
        F.coalesce(F.regexp_extract("meta", BYTES, 1).try_cast("bigint"), F.lit(0)).alias("bytes"),
        N.decoded_key("target").alias("target"),
        "message",
        "meta",
        F.col("logged_at").cast("string").alias("raw_at"),
    )


def p1_features(spark: SparkSession, d: str) -> DataFrame:
    return feature_table(audit_entries(spark, d), "actor", "event", "at", "bytes", ["raw_at", "target", "message", "meta"])


def p1_events(spark: SparkSession, d: str) -> DataFrame:
    return event_features(audit_entries(spark, d), "actor", "event", "at", "bytes", ["raw_at", "target", "message", "meta"])


def p1_cells(spark: SparkSession, d: str) -> DataFrame:
    return feature_cells(p1_features(spark, d), "actor")


def p3_orphans(spark: SparkSession, d: str) -> DataFrame:
    meta, blobs, volumes = (table(spark, d, t) for t in ("key_metadata", "blob_locations", "volume_metadata"))
    registered = volumes.select(N.volume("volume_id").alias("volume_id"), "registered_at", "removed_at", "shards")
    latest = registered.where("volume_id is not null").groupBy("volume_id").agg(F.min("registered_at").alias("since"), F.max_by(F.struct("removed_at", "shards"), F.struct("registered_at", "removed_at")).alias("x"))
    live = latest.where("x.removed_at is null")
    scope, number = numbered(F.col("volume_id"))
    parents = live.select(F.concat(F.lit("volume "), scope).alias("scope"), number.alias("key"), "since")
    named = meta.select("meta_id", "updated_at", F.explode(F.array_distinct(F.transform("replicas", N.volume))).alias("volume_id"))
    refs = named.select(F.concat(F.lit("volume "), scope).alias("scope"), number.alias("key"), F.col("updated_at").alias("at"), F.lit("key_metadata").alias("src_table"), F.col("meta_id").alias("src_id"), F.col("volume_id").alias("ref_value"))
    shards = live.select(F.concat(F.lit("shard "), "volume_id").alias("scope"), F.explode("x.shards").alias("key"), F.lit(None).cast("bigint").alias("since"))
    located = blobs.select(
        F.concat(F.lit("shard "), F.coalesce(N.volume("volume_id"), F.lit(""))).alias("scope"), F.col("shard").alias("key"), F.col("written_at").alias("at"), F.lit("blob_locations").alias("src_table"), F.col("location_id").alias("src_id"), F.col("shard").cast("string").alias("ref_value")
    )
    found = orphans(refs.unionByName(located), parents.unionByName(shards))  # scopes of two kinds, one pass
    return found.select("src_table", N.month_of_millis("at").alias("period"), "src_id", "ref_value")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return p3_orphans(spark, d).groupBy("src_table", "period").agg(F.count("*").alias("orphans"), F.countDistinct("ref_value").alias("missing_values"))


def wal_feed(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "wal_entries")
    return w.select(N.volume("volume_id").alias("volume_id"), N.decoded_key("key").alias("key"), "sequence", N.log_op("op").alias("op"), "value_bytes", "tenant")


def change_feed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "key_changes")
    return c.select(F.lit("-").alias("volume_id"), N.decoded_key("key").alias("key"), "change_no", N.log_op("event").alias("event"), "tenant", "event_ts")


def _states(spark: SparkSession, d: str) -> DataFrame:
    """The present state of both feeds, each folded field by field; a put replaces all fields, so one that leaves the tenant open clears it."""
    keys = ["volume_id", "key"]
    wal = apply_changes(wal_feed(spark, d), keys, "sequence", "op", ["value_bytes", "tenant"])
    changes = apply_changes(change_feed(spark, d), keys, "change_no", "event", ["tenant", "event_ts"])
    return wal.select(F.lit("wal_entries").alias("feed"), "*").unionByName(changes.select(F.lit("key_changes").alias("feed"), "*"), allowMissingColumns=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select("feed", "volume_id", "key", "last_no")


def p4_state(spark: SparkSession, d: str) -> DataFrame:
    """The whole present state of both feeds with its fields."""
    return _states(spark, d).select("feed", "volume_id", "key", F.lower(F.hex("value_bytes")).alias("value_hex"), "tenant", "event_ts", "last_no")


def recorded_runs(spark: SparkSession, d: str) -> DataFrame:
    """The runs over both feeds with ``item``, the name under which the ledger keeps each."""
    wal, meta = table(spark, d, "wal_runs"), table(spark, d, "meta_runs")
    said = lambda df, feed, scope, field: df.select(F.lit(feed).alias("feed"), F.concat(F.lit(f"{feed}-"), F.col("run_id").cast("string")).alias("item"), scope.alias("scope"), F.col(f"from_{field}").alias("low"), F.col(f"to_{field}").alias("high"), "started_at", "finished_at", "status")
    return said(wal, "wal_entries", N.volume("volume_id"), "sequence").unionByName(said(meta, "key_metadata", F.lit(""), "updated_at"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The runs are replayed into a ledger; the ranges of its done items are handled, every other mark is pending."""
    wal, meta, runs = table(spark, d, "wal_entries"), table(spark, d, "key_metadata"), recorded_runs(spark, d)
    ledger = Ledger(spark, scratch(spark, "ledger"))
    ledger.record(run_transitions(runs))
    took = materialise(runs.join(ledger.states(NOW_MS).where("state = 'done'").select("item"), "item", "left_semi"), "runs")
    wal_done, meta_done = (done_ranges(took.where(F.col("feed") == feed)) for feed in ("wal_entries", "key_metadata"))
    volume = N.volume("volume_id")
    wal_left = pending_marks(wal.select(volume.alias("scope"), F.col("sequence").alias("mark"), "arrived_at", volume.alias("run_scope")), wal_done)
    meta_left = pending_marks(meta.select(N.decoded_key("key").alias("scope"), F.col("updated_at").alias("mark"), F.col("recorded_at").alias("arrived_at"), F.lit("").alias("run_scope")), meta_done)
    return wal_left.select(F.lit("wal_entries").alias("feed"), "scope", "mark").unionByName(meta_left.select(F.lit("key_metadata").alias("feed"), "scope", "mark"))


def catalogue_side(spark: SparkSession, d: str, lines: bool = True) -> DataFrame:
    """``key, volume_id, size, blake3``: a line for each distinct replica of each key whose latest version is active; without ``lines``, a row for each such key."""
    meta = table(spark, d, "key_metadata")
    versions = meta.select(N.decoded_key("key").alias("key"), "replicas", "size", N.digest("blake3").alias("blake3"), "updated_at", "recorded_at", "meta_id", N.word("state").alias("state"))
    newest = latest_rows(versions, ["key"], ["updated_at", "recorded_at", "meta_id"], ["replicas", "size", "blake3", "state"]).where("state = 'active'")
    if not lines:
        return newest.select("key", "replicas", "size", "blake3")
    return newest.select("key", F.explode(F.array_distinct(F.transform("replicas", N.volume))).alias("volume_id"), "size", "blake3").where("volume_id is not null")


def blob_side(spark: SparkSession, d: str) -> DataFrame:
    """``key, volume_id, size, blake3``: the latest blob of each key on each volume."""
    held = table(spark, d, "blob_locations").select(N.decoded_key("key").alias("key"), N.volume("volume_id").alias("volume_id"), "size", N.digest("blake3").alias("blake3"), "written_at", "location_id")
    return latest_rows(held, ["key", "volume_id"], ["written_at", "location_id"], ["size", "blake3"])


def p6_compared(spark: SparkSession, d: str) -> DataFrame:
    return compare(catalogue_side(spark, d), blob_side(spark, d), ["key", "volume_id"], ["blake3", "size"], ("meta", "blob"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return difference_lines(p6_compared(spark, d), ["key", "volume_id"])


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """Each differing field with both values."""
    return p6_compared(spark, d).select("key", "volume_id", F.inline("diffs"))


QUERIES = {
    "p1_features": p1_features,
    "p1_cells": p1_cells,
    "p1_events": p1_events,
    "p3_found": p3_orphans,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_state": p4_state,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_values": p6_values,
}

_VOL, _KEY = N.sql_word("volume_id"), N.sql_key("key")

_AUDIT = rf"""
with e as (
  select distinct {N.sql_word("actor")} as actor, {N.sql_word("event")} as event, logged_at, {N.sql_key("target")} as target, message, meta,
    logged_at >= timestamp '2000-01-01' and logged_at <= received_at + interval 1 day as possible
  from audit_log),
c as (
  select actor, event, case when possible then logged_at end as t, coalesce(try_cast(regexp_extract(meta, '{BYTES}', 1) as bigint), 0) as bytes from e),
a as (select max(t) as as_of from c)
"""

_ORPHANS = f"""
with v as (select distinct {_VOL} as volume_id, registered_at, removed_at, shards from volume_metadata),
r as (select *, row_number() over (partition by volume_id order by registered_at desc, removed_at desc nulls last) as rk, min(registered_at) over (partition by volume_id) as since from v),
live as (select * from r where rk = 1 and removed_at is null),
refs as (select meta_id, updated_at, unnest(list_distinct(list_transform(replicas, lambda x: lower(trim(x))))) as volume_id from key_metadata),
shards as (select distinct volume_id, unnest(shards) as shard from live),
found as (
  select 'key_metadata' as src_table, {N.sql_month("updated_at")} as period, meta_id as src_id, refs.volume_id as ref_value
  from refs left join live using (volume_id) where refs.volume_id is not null and (live.volume_id is null or live.since > updated_at)
  union all
  select 'blob_locations', {N.sql_month("written_at")}, location_id, cast(b.shard as varchar)
  from (select *, {_VOL} as v from blob_locations) b left join shards s on s.volume_id = b.v and s.shard = b.shard where b.shard is not null and s.shard is null)
"""

_COMPARED = f"""
with m as (select {_KEY} as key, replicas, size, {N.sql_digest("blake3")} as blake3, {N.sql_word("state")} as state,
    row_number() over (partition by {_KEY} order by updated_at desc nulls last, recorded_at desc nulls last, meta_id desc) as rk from key_metadata),
l as (select key, unnest(list_distinct(list_transform(replicas, lambda x: lower(trim(x))))) as volume_id, size, blake3 from m where rk = 1 and state = 'active'),
b as (select {_KEY} as key, {_VOL} as volume_id, size, {N.sql_digest("blake3")} as blake3,
    row_number() over (partition by {_KEY}, {_VOL} order by written_at desc nulls last, location_id desc) as rk from blob_locations),
r as (select * from b where rk = 1),
j as (select coalesce(l.key, r.key) as key, coalesce(l.volume_id, r.volume_id) as volume_id, l.key is not null as in_l, r.key is not null as in_r,
    l.size as ls, r.size as rs, l.blake3 as lb, r.blake3 as rb
  from (select * from l where volume_id is not null) l full join r on l.key = r.key and l.volume_id = r.volume_id)
"""

ORACLES = {
    "p1_cells": _AUDIT
    + """select actor, trim(regexp_replace(event, '[^0-9a-z]+', '_', 'g'), '_') as feature, count(*) as n, date_diff('second', max(t), any_value(as_of)) as recency_s, cast(sum(bytes) as bigint) as total
from c cross join a group by actor, event""",
    "p1_events": _AUDIT + """select actor, event, count(*) as n, date_diff('second', max(t), any_value(as_of)) as recency_s, cast(sum(bytes) as bigint) as total from c cross join a group by actor, event""",
    "p3_found": _ORPHANS + "select * from found",
    "p3_report": _ORPHANS + "select src_table, period, count(*) as orphans, count(distinct ref_value) as missing_values from found group by all",
    "p4_found": f"""
with w as (select {_VOL} as volume_id, {_KEY} as key, sequence as no, {N.sql_op("op")} as op from wal_entries),
c as (select '-' as volume_id, {_KEY} as key, change_no as no, {N.sql_op("event")} as op from key_changes),
f as (select 'wal_entries' as feed, * from w union all select 'key_changes', * from c),
r as (select *, row_number() over (partition by feed, volume_id, key order by no desc, (op = 'put')) as rk from f)
select feed, volume_id, key, no as last_no from r where rk = 1 and op = 'put'""",
    "p4_state": f"""
with w as (select {_VOL} as volume_id, {_KEY} as key, sequence as no, {N.sql_op("op")} as op, lower(hex(value_bytes)) as value_hex, tenant, cast(null as bigint) as event_ts from wal_entries),
c as (select '-' as volume_id, {_KEY} as key, change_no as no, {N.sql_op("event")} as op, cast(null as varchar) as value_hex, tenant, event_ts from key_changes),
f as (select 'wal_entries' as feed, * from w union all select 'key_changes', * from c),
r as (select *, rank() over (partition by feed, volume_id, key order by no desc) as rk from f)
select feed, volume_id, key, max(value_hex) as value_hex, max(tenant) as tenant, max(event_ts) as event_ts, max(no) as last_no from r where rk = 1 group by feed, volume_id, key having bool_and(op = 'put')""",
    "p5_found": f"""
with w as (select distinct {_VOL} as scope, sequence as mark, arrived_at as t from wal_entries),
m as (select distinct {_KEY} as scope, updated_at as mark, recorded_at as t from key_metadata),
wr as (select {_VOL} as scope, coalesce(from_sequence, -1) as lo, to_sequence as hi, started_at from wal_runs where status = 'succeeded'),
mr as (select coalesce(from_updated_at, -1) as lo, to_updated_at as hi, started_at from meta_runs where status = 'succeeded'),
wd as (select distinct w.scope, w.mark from w join wr on w.scope = wr.scope and mark > lo and mark <= hi and started_at >= t),
md as (select distinct m.scope, m.mark from m join mr on mark > lo and mark <= hi and started_at >= t)
select 'wal_entries' as feed, scope, mark from (select distinct scope, mark from w except select * from wd)
union all select 'key_metadata', scope, mark from (select distinct scope, mark from m except select * from md)""",
    "p6_found": _COMPARED
    + """select key, volume_id, 'missing_blob' as diff from j where in_l and not in_r
union all select key, volume_id, 'missing_meta' from j where in_r and not in_l
union all select key, volume_id, 'blake3' from j where in_l and in_r and lb is distinct from rb
union all select key, volume_id, 'size' from j where in_l and in_r and ls is distinct from rs""",
    "p6_values": _COMPARED
    + """select key, volume_id, 'blake3' as field, lb as left_value, rb as right_value from j where in_l and in_r and lb is distinct from rb
union all select key, volume_id, 'size', cast(ls as varchar), cast(rs as varchar) from j where in_l and in_r and ls is distinct from rs""",
}
