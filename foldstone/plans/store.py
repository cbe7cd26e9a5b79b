"""Queries of the log store's own operators over the views, and their oracle text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.functions import crypto, lz4
from foldstone.functions import scalars as S
from foldstone.operators import batch, fold, metering, reads
from foldstone.operators.changes import apply_changes
from foldstone.plans.problems import change_feed
from foldstone.plans.views import NOW_MS, ctes, view
from foldstone.session import scratch
from foldstone.sources.tables import table

SHARDS = 256
_KEY = bytes(range(32))

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


_LAST = ctes("kv_log") + ", r as (select *, row_number() over (partition by key order by seq desc) as rk from kv_log), w as (select * from r where rk = 1), s as (select * from w where op = 'put')\n"


@query("wal_fold_state", _LAST + "select key, value, seq from s")
def wal_fold_state(spark, d):
    return fold.fold_state(view(spark, d, "kv_log")).select("key", "value", "seq")


@query("wal_tombstones", _LAST + "select key, seq from w where op = 'delete'")
def wal_tombstones(spark, d):
    return fold.tombstones(view(spark, d, "kv_log"))


@query("snapshot_restore", _LAST + "select key, value, seq from s")
def snapshot_restore(spark, d):
    log = view(spark, d, "kv_log")
    high = (log.agg(F.max("seq")).first()[0] or 0) // 2
    snapshot = fold._last(log.where(F.col("seq") <= high))  # deletes stay, so that the tail is folded on top of them
    return fold.restore(snapshot, high, log).select("key", "value", "seq")


@query("next_seq", ctes("kv_log") + "select coalesce(max(seq) + 1, 0) as next_seq from kv_log")
def next_seq(spark, d):
    return fold.next_seq(view(spark, d, "kv_log"))


@query("max_struct", ctes("kv_docs") + "select size, key from kv_docs order by size desc, key desc limit 1")
def max_struct(spark, d):
    return fold.greatest(view(spark, d, "kv_docs"), "size", "key")


@query("scan_keys", ctes("kv_docs") + "select key from kv_docs")
def scan_keys(spark, d):
    return reads.scan_keys(view(spark, d, "kv_docs"))


@query("point_get", ctes("kv_docs") + "select key, size, hash from kv_docs where key = 'doc/00000042'")
def point_get(spark, d):
    return reads.point_get(view(spark, d, "kv_docs"), "doc/00000042").select("key", "size", "hash")


@query("exists_many", ctes("kv_docs") + ", a as (select concat('doc/', lpad(cast(event_id * 3 as varchar), 8, '0')) as key from events) select a.key, k.key is not null as found from a left join kv_docs k on a.key = k.key")
def exists_many(spark, d):
    asked = table(spark, d, "events").select(F.concat(F.lit("doc/"), F.lpad((F.col("event_id") * 3).cast("string"), 8, "0")).alias("key"))
    return reads.exists_many(asked, view(spark, d, "kv_docs"))


@query("negative_lookup", ctes("kv_docs") + ", a as (select unnest(['missing/0', 'missing/1', 'doc/00000007', 'doc/99999999', 'doc/00000042']) as key) select a.key, k.key is not null as found from a left join kv_docs k on a.key = k.key")
def negative_lookup(spark, d):
    """Keys asked of a stored generation with a Bloom filter on its keys: row groups that cannot hold them are not read."""
    path = scratch(spark, "generation")
    docs = view(spark, d, "kv_docs").select("key", "size")
    docs.repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)
    asked = ["missing/0", "missing/1", "doc/00000007", "doc/99999999", "doc/00000042"]
    held = spark.read.schema(docs.schema).parquet(path).where(F.col("key").isin(asked))
    return reads.exists_many(spark.createDataFrame([(k,) for k in asked], "key string"), held)


@query("range_keys", ctes("kv_docs") + "select key from kv_docs where key between 'doc/00000100' and 'doc/00000299'")
def range_keys(spark, d):
    return reads.range_keys(view(spark, d, "kv_docs"), "doc/00000100", "doc/00000299")


@query("prefix_scan", ctes("kv_docs") + "select key, size from kv_docs where starts_with(key, 'doc/000001')")
def prefix_scan(spark, d):
    return reads.prefix_scan(view(spark, d, "kv_docs"), "doc/000001").select("key", "size")


@query("search_value", ctes("kv_docs") + "select key from kv_docs where contains(value, 'kettle')")
def search_value(spark, d):
    return reads.search_value(view(spark, d, "kv_docs"), "kettle")


@query("search_count", ctes("kv_docs") + "select count(*) as total_matches from kv_docs where contains(value, 'the')")
def search_count(spark, d):
    return reads.search_value(view(spark, d, "kv_docs"), "the").agg(F.count("*").alias("total_matches"))


_ENTRIES = "with e as (select delivery_id, url_decode(key) as key, event as value from key_changes) "


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "key_changes").select("delivery_id", S.decode_key("key").alias("key"), F.col("event").alias("value"))


@query("import_upsert", _ENTRIES + "select key, arg_max(value, delivery_id) as value from e group by key")
def import_upsert(spark, d):
    return reads.import_entries(_entries(spark, d), "delivery_id")[0].select("key", "value")


@query("import_count", _ENTRIES + "select count(*) as imported from e")
def import_count(spark, d):
    return reads.import_entries(_entries(spark, d), "delivery_id")[1]


_OPS = ctes("kv_log") + """, ops as (select e.event_id as ord, case e.event_type when 'error' then 'delete' when 'view' then 'get' when 'signup' then 'scan' else 'put' end as op,
  concat('user/', lpad(cast(e.user_id as varchar), 6, '0')) as key, case when e.event_id % 7 = 0 then null else e.props end as value from events e)
"""


def _ops(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "get").when(F.col("event_type") == "signup", "scan").otherwise("put")
    return table(spark, d, "events").select(F.col("event_id").alias("ord"), op.alias("op"), F.concat(F.lit("user/"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), F.when(F.col("event_id") % 7 != 0, F.col("props")).alias("value"))


@query("batch_results", _OPS + """, p as (select *, max(case when op = 'delete' or (op = 'put' and value is not null) then ord end) over (partition by key order by ord rows between unbounded preceding and 1 preceding) as at from ops),
g as (select p.*, q.op as last_op, q.value as last_value from p left join ops q on p.at = q.ord),
r as (select ord, key, op, value, case when last_op = 'put' then last_value end as got from g)
select ord, key, case when op = 'get' then got end as value,
  case when op = 'put' and value is null then 'Missing value for put' when op = 'get' and got is null then 'Not found' when op not in ('put', 'get', 'delete') then 'Unknown op' end as error,
  not coalesce((op = 'put' and value is null) or (op = 'get' and got is null) or op not in ('put', 'get', 'delete'), false) as ok from r""")
def batch_results(spark, d):
    return batch.batch_results(_ops(spark, d))


_TXN = "case when op = 'put' and value is null then 'value required for put' when op not in ('put', 'delete') then 'unknown operation' end"


@query("txn_results", _OPS + f"select ord, key, {_TXN} is null as success, {_TXN} as error from ops")
def txn_results(spark, d):
    return batch.txn_results(_ops(spark, d))


@query("txn_totals", _OPS + f"select count(*) as total_operations, count(*) filter (where {_TXN} is null) as successful_operations from ops")
def txn_totals(spark, d):
    return batch.txn_totals(_ops(spark, d))


@query("import_json", _ENTRIES + "select key, value, count(*) as entries from e group by key, value")
def import_json(spark, d):
    """The change feed sent as import bodies of up to a hundred entries, stored as JSON lines and read back."""
    path = scratch(spark, "import")
    sent = _entries(spark, d).groupBy(F.floor(F.col("delivery_id") / 100).alias("body")).agg(F.sort_array(F.collect_list(F.struct("delivery_id", "key", "value"))).alias("e"))
    entries = F.transform("e", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    sent.select(F.to_json(F.struct(entries.alias("entries"))).alias("line")).write.text(path)
    return reads.read_import(spark, path).groupBy("key", "value").agg(F.count("*").alias("entries"))


@query("ttl_live", _LAST + f"select key, seq from s where expires_at is null or expires_at >= {NOW_MS}")
def ttl_live(spark, d):
    return fold.fold_state(view(spark, d, "kv_log")).where(fold.live(NOW_MS)).select("key", "seq")


@query("ttl_remaining", _LAST + f"select key, case when expires_at > {NOW_MS} then expires_at - {NOW_MS} end as remaining_ms from s where expires_at is not null")
def ttl_remaining(spark, d):
    return fold.ttl_remaining(fold.fold_state(view(spark, d, "kv_log")), NOW_MS)


@query("ttl_keys", _LAST + "select key, expires_at from s where expires_at is not null")
def ttl_keys(spark, d):
    return fold.fold_state(view(spark, d, "kv_log")).where("expires_at is not null").select("key", "expires_at")


@query("ttl_purge_count", _LAST + f"select count(*) filter (where expires_at < {NOW_MS}) as purged from s")
def ttl_purge_count(spark, d):
    return fold.purge(fold.fold_state(view(spark, d, "kv_log")), NOW_MS)[1]


@query("compact_live", _LAST + f"select key, value, seq, expires_at from s where expires_at is null or expires_at >= {NOW_MS}")
def compact_live(spark, d):
    return fold.compact(view(spark, d, "kv_log"), NOW_MS).select("key", "value", "seq", "expires_at")


@query("compact_report", _LAST + f""", b as (select count(*) as rows_before, coalesce(sum(strlen(coalesce(value, ''))), 0) as bytes_before from kv_log),
a as (select count(*) as rows_after, coalesce(sum(strlen(coalesce(value, ''))), 0) as bytes_after from s where expires_at is null or expires_at >= {NOW_MS})
select rows_before, cast(bytes_before as bigint) as bytes_before, rows_after, cast(bytes_after as bigint) as bytes_after, cast(bytes_before - bytes_after as bigint) as bytes_freed from a, b""")
def compact_report(spark, d):
    return fold.compact_report(view(spark, d, "kv_log"), NOW_MS, F.coalesce(F.octet_length("value").cast("bigint"), F.lit(0)))


@query("store_stats", _LAST + "select count(*) as keys, cast(sum(strlen(value)) as bigint) as bytes, count(expires_at) as with_ttl from s")
def store_stats(spark, d):
    return fold.fold_state(view(spark, d, "kv_log")).agg(F.count("*").alias("keys"), F.sum(F.octet_length("value")).alias("bytes"), F.count("expires_at").alias("with_ttl"))


@query("content_hash", ctes("kv_docs") + "select key, hash as digest from kv_docs")
def content_hash(spark, d):
    return view(spark, d, "kv_docs").select("key", S.content_hash("value").alias("digest"))


_LE = "concat(substr(h,15,2),substr(h,13,2),substr(h,11,2),substr(h,9,2),substr(h,7,2),substr(h,5,2),substr(h,3,2),substr(h,1,2))"


@query("shard_of_key", ctes("kv_docs") + f", k as (select key, sha256(key) as h from kv_docs) select key, cast(cast('0x' || {_LE} as ubigint) % {SHARDS} as bigint) as shard from k")
def shard_of_key(spark, d):
    return view(spark, d, "kv_docs").select("key", S.shard_of(S.content_hash("key"), SHARDS).alias("shard"))


@query("blob_prefix", ctes("kv_docs") + "select key, substr(hash, 1, 2) || '/' || substr(hash, 3, 2) as prefix from kv_docs")
def blob_prefix(spark, d):
    return view(spark, d, "kv_docs").select("key", S.blob_prefix(F.col("hash")).alias("prefix"))


@query("blob_chunks", ctes("kv_docs") + ", c as (select key, size, unnest(range(cast((size + 255) // 256 as bigint))) as chunk_no from kv_docs where size > 0) select key, cast(chunk_no as integer) as chunk_no, least(256, size - chunk_no * 256) as bytes from c")
def blob_chunks(spark, d):
    return reads.blob_chunks(view(spark, d, "kv_docs"), 256)


@query("segment_assign", ctes("kv_docs") + """, o as (select substr(hash, 1, 1) as writer, key, size, row_number() over (partition by substr(hash, 1, 1) order by key) as rn from kv_docs),
p as (select writer, key, size, rn, cast(0 as bigint) as segment, cast(0 as bigint) as blob_offset from o where rn = 1
  union all select o.writer, o.key, o.size, o.rn, case when p.blob_offset + p.size > 4096 then p.segment + 1 else p.segment end, case when p.blob_offset + p.size > 4096 then 0 else p.blob_offset + p.size end from p join o on o.writer = p.writer and o.rn = p.rn + 1)
select writer, key, segment, blob_offset from p""")
def segment_assign(spark, d):
    docs = view(spark, d, "kv_docs").withColumn("writer", F.substring("hash", 1, 1))
    return metering.segment_assign(docs, "writer", "key", "size", 4096)


@query("tenant_usage", ctes("tenant_ops") + "select tenant, cast(sum(delta_bytes) as bigint) as bytes, cast(sum(delta_objects) as bigint) as objects from tenant_ops group by tenant")
def tenant_usage(spark, d):
    return metering.tenant_usage(view(spark, d, "tenant_ops"))


@query("tenant_usage_clamped", ctes("tenant_ops") + """, o as (select *, row_number() over (partition by tenant order by seq) as rn from tenant_ops),
p as (select tenant, rn, greatest(0, delta_bytes) as bytes, greatest(0, delta_objects) as objects from o where rn = 1
  union all select o.tenant, o.rn, greatest(0, p.bytes + o.delta_bytes), greatest(0, p.objects + o.delta_objects) from p join o on o.tenant = p.tenant and o.rn = p.rn + 1)
select tenant, cast(arg_max(bytes, rn) as bigint) as bytes, cast(arg_max(objects, rn) as bigint) as objects from p group by tenant""")
def tenant_usage_clamped(spark, d):
    return metering.tenant_usage_clamped(view(spark, d, "tenant_ops"))


def _quota(used: str, limit: str, add: int) -> str:
    return ctes("tenant_ops", "quotas") + f""", u as (select tenant, cast(sum(delta_{used}) as bigint) as used from tenant_ops group by tenant)
select coalesce(tenant, tenant_id) as tenant, coalesce(used, 0) as used, coalesce({limit}, 1000000) as limit_value, case when not coalesce(enabled, true) then 'disabled' when coalesce({limit}, 1000000) = 0 or coalesce(used, 0) + {add} <= coalesce({limit}, 1000000) then 'allowed' else 'exceeded' end as result
from u full join quotas q on u.tenant = q.tenant_id"""


@query("quota_storage_check", _quota("bytes", "storage_limit", 4096))
def quota_storage_check(spark, d):
    return metering.quota_check(metering.tenant_usage(view(spark, d, "tenant_ops")), view(spark, d, "quotas"), "bytes", "storage_limit", 4096, 1_000_000)


@query("quota_object_check", _quota("objects", "object_limit", 1))
def quota_object_check(spark, d):
    return metering.quota_check(metering.tenant_usage(view(spark, d, "tenant_ops")), view(spark, d, "quotas"), "objects", "object_limit", 1, 1_000_000)


_BUCKET = ctes("requests") + """, o as (select event_id, user_id, ts_us, row_number() over (partition by user_id order by ts_us, event_id) as rn from requests),
p as (select event_id, user_id, ts_us, rn, true as allowed, cast(4.0 as double) as tokens from o where rn = 1
  union all select o.event_id, o.user_id, o.ts_us, o.rn, least(5.0, p.tokens + (o.ts_us - p.ts_us) / 1e6 * 0.00001) >= 1.0,
    least(5.0, p.tokens + (o.ts_us - p.ts_us) / 1e6 * 0.00001) - case when least(5.0, p.tokens + (o.ts_us - p.ts_us) / 1e6 * 0.00001) >= 1.0 then 1.0 else 0.0 end
  from p join o on o.user_id = p.user_id and o.rn = p.rn + 1)
"""


@query("token_bucket", _BUCKET + "select event_id, allowed, round(tokens, 6) as tokens from p")
def token_bucket(spark, d):
    return metering.token_bucket(view(spark, d, "requests"), "user_id", 5.0, 0.00001).select("event_id", "allowed", F.round("tokens", 6).alias("tokens"))


@query("token_bucket_headers", _BUCKET + "select event_id, cast(floor(tokens) as bigint) as remaining, case when allowed then 0 else cast(floor((1.0 - tokens) / 0.00001) as bigint) end as retry_after from p")
def token_bucket_headers(spark, d):
    b = metering.token_bucket(view(spark, d, "requests"), "user_id", 5.0, 0.00001)
    return b.select("event_id", F.floor("tokens").cast("bigint").alias("remaining"), F.floor("retry_after_s").cast("bigint").alias("retry_after"))


@query("sliding_limit", ctes("requests") + """, o as (select event_id, user_id, ts_us, row_number() over (partition by user_id order by ts_us, event_id) as rn from requests),
p as (select event_id, user_id, rn, true as allowed, [ts_us] as taken from o where rn = 1
  union all select o.event_id, o.user_id, o.rn, len(list_filter(p.taken, lambda x: x > o.ts_us - 86400000000)) < 3,
    case when len(list_filter(p.taken, lambda x: x > o.ts_us - 86400000000)) < 3 then list_append(list_filter(p.taken, lambda x: x > o.ts_us - 86400000000), o.ts_us) else list_filter(p.taken, lambda x: x > o.ts_us - 86400000000) end
  from p join o on o.user_id = p.user_id and o.rn = p.rn + 1)
select event_id, allowed from p""")
def sliding_limit(spark, d):
    return metering.sliding_limit(view(spark, d, "requests"), "user_id", 3, 86_400_000_000)


@query("bucket_gc", ctes("requests") + f"select user_id, max(ts_us) as last_us from requests where ts_us <= {NOW_MS * 1000} group by user_id having {NOW_MS * 1000} - max(ts_us) < 172800000000")
def bucket_gc(spark, d):
    return metering.bucket_gc(view(spark, d, "requests"), "user_id", NOW_MS * 1000, 172_800_000_000)


@query("endpoint_counters", ctes("requests") + "select path, grouping(path) = 1 as over_all, count(*) as total, count(*) filter (where success) as success, count(*) filter (where not success) as error from requests group by rollup (path)")
def endpoint_counters(spark, d):
    return metering.endpoint_counters(view(spark, d, "requests"))


@query("latency_histogram", ctes("requests") + f""", b as (select unnest({metering.BOUNDS}) as bound, unnest({[f"{x:g}" for x in metering.BOUNDS]}) as le)
select path, le, count(*) filter (where duration_ms <= bound) as n from requests cross join b group by path, le union all select path, '+Inf', count(*) from requests group by path""")
def latency_histogram(spark, d):
    return metering.latency_histogram(view(spark, d, "requests"))


@query("latency_sum_count", ctes("requests") + "select path, sum(cast(floor(duration_ms * 1000) as bigint)) / 1000.0 as sum_ms, count(*) as n from requests group by path")
def latency_sum_count(spark, d):
    return metering.latency_sum_count(view(spark, d, "requests"))


@query("gauge_last", ctes("requests") + "select user_id, arg_max(duration_ms, (ts_us, event_id)) as value from requests group by user_id")
def gauge_last(spark, d):
    return metering.gauge_last(view(spark, d, "requests"), "user_id")


@query("prom_lines", ctes("requests", "quotas", "tenant_ops") + f""", c as (select path, count(*) as t, count(*) filter (where success) as s, count(*) filter (where not success) as e, sum(cast(floor(duration_ms * 1000) as bigint)) // 1000 as ms from requests group by path),
b as (select unnest({metering.BOUNDS}) as bound, unnest({[f"{x:g}" for x in metering.BOUNDS]}) as le),
h as (select path, le, count(*) filter (where duration_ms <= bound) as n from requests cross join b group by path, le union all select path, '+Inf', count(*) from requests group by path),
u as (select tenant, cast(sum(delta_bytes) as bigint) as used from tenant_ops group by tenant)
select 'requests_total{{path="' || path || '"}} ' || t as line from c union all select 'requests_success{{path="' || path || '"}} ' || s from c union all select 'requests_error{{path="' || path || '"}} ' || e from c
union all select 'request_duration_ms_bucket{{path="' || path || '",le="' || le || '"}} ' || n from h
union all select 'request_duration_ms_sum{{path="' || path || '"}} ' || ms from c union all select 'request_duration_ms_count{{path="' || path || '"}} ' || t from c
union all select 'tenant_storage_bytes{{tenant="' || coalesce(tenant, tenant_id) || '"}} ' || coalesce(used, 0) from u full join quotas q on u.tenant = q.tenant_id
union all select 'tenant_storage_limit_bytes{{tenant="' || coalesce(tenant, tenant_id) || '"}} ' || coalesce(storage_limit, 1000000) from u full join quotas q on u.tenant = q.tenant_id""")
def prom_lines(spark, d):
    """Counters, histograms, and the quotas' gauges."""
    usage = metering.quota_check(metering.tenant_usage(view(spark, d, "tenant_ops")), view(spark, d, "quotas"), "bytes", "storage_limit", 0, 1_000_000)
    return metering.prom_lines(view(spark, d, "requests")).unionByName(metering.prom_gauges(usage, "tenant", {"tenant_storage_bytes": "used", "tenant_storage_limit_bytes": "limit_value"}))


@query("apikeys_list", ctes("api_keys") + "select id, name, tenant, role, created_at, expires_at, active from api_keys")
def apikeys_list(spark, d):
    return view(spark, d, "api_keys").drop("key_hash")


@query("apikey_status", ctes("api_keys") + f"select id, case when not active then 'disabled' when {NOW_MS} >= expires_at then 'expired' else 'valid' end as status from api_keys")
def apikey_status(spark, d):
    return view(spark, d, "api_keys").select("id", F.when(~F.col("active"), "disabled").when(F.lit(NOW_MS) >= F.col("expires_at"), "expired").otherwise("valid").alias("status"))


@query("key_valid", "select entry_id, octet_length(cast(encode(key) as blob)) between 1 and 1024 and not regexp_matches(key, '[\\x00-\\x1f\\x7f-\\x{9f}]') as valid from wal_entries")
def key_valid(spark, d):
    return table(spark, d, "wal_entries").select("entry_id", S.key_valid("key").alias("valid"))


@query("encode_key", """with c as (select entry_id, url_decode(key) as plain from wal_entries)
select entry_id, plain, array_to_string(list_transform(string_split(plain, ''), lambda x: case when regexp_matches(x, '[\\x00-\\x20\\x7f/%?#&]') or unicode(x) > 127 then regexp_replace(hex(encode(x)), '(..)', '%\\1', 'g') else x end), '') as encoded from c""")
def encode_key(spark, d):
    plain = S.decode_key("key")
    return table(spark, d, "wal_entries").select("entry_id", plain.alias("plain"), S.encode_key(plain).alias("encoded"))


@query("decode_key", "select entry_id, url_decode(key) as key from wal_entries")
def decode_key(spark, d):
    return table(spark, d, "wal_entries").select("entry_id", S.decode_key("key").alias("key"))


_DURATION = "case event_id % 6 when 0 then event_id || 'ms' when 1 then ' ' || event_id || 's ' when 2 then event_id || 'm' when 3 then event_id || 'h' when 4 then event_id || 'd' else event_id || ' weeks' end"


@query("parse_duration", "select event_id, case event_id % 6 when 0 then event_id when 1 then event_id * 1000 when 2 then event_id * 60000 when 3 then event_id * 3600000 when 4 then event_id * 86400000 end as ms from events")
def parse_duration(spark, d):
    return table(spark, d, "events").select("event_id", F.expr(_DURATION).alias("said")).select("event_id", S.parse_duration("said").alias("ms"))


@query("crc_roundtrip", ctes("kv_docs") + "select key, true as ok from kv_docs")
def crc_roundtrip(spark, d):
    """A frame with its checksum behind it is read back whole, and a changed frame is noticed."""
    data = F.col("value").cast("binary")
    framed = view(spark, d, "kv_docs").select("key", F.concat(data, F.unhex(F.lpad(F.hex(F.crc32(data)), 8, "0"))).alias("f"))
    body, mark = F.expr("substring(f, 1, octet_length(f) - 4)"), F.expr("substring(f, octet_length(f) - 3, 4)")
    same = F.lpad(F.hex(F.crc32(body)), 8, "0") == F.hex(mark)
    changed = F.lpad(F.hex(F.crc32(F.concat(body, F.lit(b"x")))), 8, "0") != F.hex(mark)
    return framed.select("key", (same & changed).alias("ok"))


@query("encrypt_roundtrip", ctes("kv_docs") + "select key, true as ok, size + 36 as bytes from kv_docs")
def encrypt_roundtrip(spark, d):
    sealed = view(spark, d, "kv_docs").select("key", "value", crypto.encrypted(F.col("value"), _KEY).alias("sealed"))
    return sealed.select("key", (crypto.decrypted(F.col("sealed"), _KEY) == F.col("value").cast("binary")).alias("ok"), F.octet_length("sealed").cast("bigint").alias("bytes"))


@query("encrypt_detect", ctes("kv_docs") + "select key, doc_id % 2 = 0 as detected, true as passes from kv_docs")
def encrypt_detect(spark, d):
    """Half the values are encrypted; plain ones pass through decryption."""
    mixed = view(spark, d, "kv_docs").select("key", "value", F.when(F.col("doc_id") % 2 == 0, crypto.encrypted(F.col("value"), _KEY)).otherwise(F.col("value").cast("binary")).alias("v"))
    return mixed.select("key", crypto.is_encrypted(F.col("v")).alias("detected"), (crypto.decrypted(F.col("v"), _KEY) == F.col("value").cast("binary")).alias("passes"))


@query("compress_decision", ctes("kv_docs") + "select key, value as text, true as smaller, case when size < 128 then false end as must from kv_docs")
def compress_decision(spark, d):
    """Each value as the store keeps it and read back: LZ4 only from 128 bytes on and only if that is smaller."""
    kept = view(spark, d, "kv_docs").select("key", "value", "size", lz4.stored(F.col("value")).alias("s"))
    smaller = F.when(F.col("s.compressed"), F.octet_length("s.data") < F.col("size")).otherwise(F.octet_length("s.data") == F.col("size"))
    return kept.select("key", F.decode(lz4.restored(F.col("s")), "UTF-8").alias("text"), smaller.alias("smaller"), F.when(F.col("size") < 128, F.col("s.compressed")).alias("must"))


@query("events_tumbling", "select time_bucket(interval 1 hour, ts) as started, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def events_tumbling(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("started"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("events_session", """with o as (select *, lag(ts) over (partition by user_id order by ts) as before from events),
s as (select *, sum(case when before is null or ts >= before + interval 2 hours then 1 else 0 end) over (partition by user_id order by ts) as session from o)
select user_id, min(ts) as started, count(*) as n from s group by user_id, session""")
def events_session(spark, d):
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@query("apikeys_state", """with c as (select change_no, lower(trim(event)) as op, url_decode(key) as key, tenant from key_changes),
g as (select key, max(change_no) filter (where op not in ('put', 'revoke')) as gone, max(change_no) filter (where op in ('put', 'revoke')) as last_no from c group by key),
l as (select c.*, last_no from c join g using (key) where op in ('put', 'revoke') and (gone is null or change_no > gone))
select key, not (arg_max(op, change_no) = 'revoke') as active, any_value(last_no) as last_no from l group by key""")
def apikeys_state(spark, d):
    """The lifecycle of keys: a put creates or renews, a revoke switches off, a delete removes."""
    c = change_feed(spark, d).withColumn("active", F.col("event") == "put")
    return apply_changes(c, ["key"], "change_no", "event", ["active"], replace_ops=["put"], patch_ops=["revoke"]).select("key", "active", "last_no")
