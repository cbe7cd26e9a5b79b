"""Queries over the cluster's own tables: volumes, placement, verification, repair, export; and their oracle text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.functions import normalise as N
from foldstone.functions import scalars as S
from foldstone.functions.blake3 import blake3
from foldstone.operators import integrity, placement, reads
from foldstone.operators.changes import apply_changes
from foldstone.plans.problems import blob_side, catalogue_side, wal_feed
from foldstone.plans.views import ctes, view
from foldstone.session import materialise, spread
from foldstone.sources.tables import table

RF = 3
SHARDS = 256
#: The present of the cluster's clocks: 2024-07-01 00:00:00 UTC.
BEAT_MS = 1719792000000

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


_COLUMNS = ["registered_at", "removed_at", "state", "address", "grpc_address", "total_keys", "total_bytes", "free_bytes", "last_heartbeat", "shards"]


def volumes(spark: SparkSession, d: str) -> DataFrame:
    """The latest registration of every volume that is not removed."""
    v = table(spark, d, "volume_metadata").select(N.volume("volume_id").alias("volume_id"), *(N.word(c).alias(c) if c == "state" else c for c in _COLUMNS)).where("volume_id is not null")
    latest = v.groupBy("volume_id").agg(F.max(F.struct(*_COLUMNS)).alias("x")).where("x.removed_at is null")
    return latest.select("volume_id", *(f"x.{c}" for c in _COLUMNS if c != "removed_at"))


_VOLUMES = f"""with recursive vm as (select {N.sql_word("volume_id")} as volume_id, registered_at, removed_at, {N.sql_word("state")} as state, address, grpc_address, total_keys, total_bytes, free_bytes, last_heartbeat, shards from volume_metadata where volume_id is not null),
vr as (select *, row_number() over (partition by volume_id order by {", ".join(f"{c} desc nulls last" for c in _COLUMNS)}) as vrk from vm),
volumes as (select * exclude (vrk, removed_at) from vr where vrk = 1 and removed_at is null)
"""
_LE = "concat(substr(h,15,2),substr(h,13,2),substr(h,11,2),substr(h,9,2),substr(h,7,2),substr(h,5,2),substr(h,3,2),substr(h,1,2))"


@query("scan_volumes", _VOLUMES + "select * exclude (shards), array_to_string(shards, ',') as shards from volumes")
def scan_volumes(spark, d):
    return volumes(spark, d).withColumn("shards", F.array_join(F.col("shards").cast("array<string>"), ","))


@query("volumes_healthy", _VOLUMES + "select volume_id from volumes where state = 'alive'")
def volumes_healthy(spark, d):
    return volumes(spark, d).where("state = 'alive'").select("volume_id")


@query("volumes_overloaded", _VOLUMES + "select volume_id, total_bytes from volumes where total_bytes > 10737418240")
def volumes_overloaded(spark, d):
    return volumes(spark, d).where(F.col("total_bytes") > 10 * 1024**3).select("volume_id", "total_bytes")


@query("cluster_totals", _VOLUMES + "select count(*) as volumes, count(*) filter (where state = 'alive') as healthy, cast(sum(total_keys) as bigint) as total_keys, cast(sum(total_bytes) as bigint) as total_bytes, cast(sum(free_bytes) as bigint) as free_bytes from volumes")
def cluster_totals(spark, d):
    return volumes(spark, d).agg(F.count("*").alias("volumes"), F.count_if(F.col("state") == "alive").alias("healthy"), *(F.sum(c).alias(c) for c in ("total_keys", "total_bytes", "free_bytes")))


_CATALOGUE = f"""km as (select {N.sql_key("key")} as key, replicas, size, {N.sql_digest("blake3")} as hash, {N.sql_word("state")} as kstate,
    row_number() over (partition by {N.sql_key("key")} order by updated_at desc nulls last, recorded_at desc nulls last, meta_id desc) as krk from key_metadata),
present as (select key, replicas, size, hash from km where krk = 1 and kstate = 'active'),
cl as (select key, unnest(list_distinct(list_transform(replicas, lambda x: lower(trim(x))))) as volume_id, size, hash from present),
catalog as (select * from cl where volume_id is not null),
bm as (select {N.sql_key("key")} as key, {N.sql_word("volume_id")} as volume_id, size, {N.sql_digest("blake3")} as hash,
    row_number() over (partition by {N.sql_key("key")}, {N.sql_word("volume_id")} order by written_at desc nulls last, location_id desc) as brk from blob_locations),
blobs as (select key, volume_id, size, hash from bm where brk = 1)
"""


@query("admin_status", _VOLUMES + f""", {_CATALOGUE} select count(*) as nb_volumes, count(*) filter (where state = 'alive') as alive, count(*) filter (where state = 'suspect') as suspect, count(*) filter (where state = 'dead') as dead,
count(*) filter (where state = 'draining') as draining, (select count(*) from present) as nb_objects, min(volume_id) filter (where state = 'alive') as first_alive from volumes""")
def admin_status(spark, d):
    """The status card: volumes by state and objects. The list of volumes itself is ``scan_volumes``."""
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("alive", "suspect", "dead", "draining")]
    card = volumes(spark, d).agg(F.count("*").alias("nb_volumes"), *states, F.min(F.when(F.col("state") == "alive", F.col("volume_id"))).alias("first_alive"), F.lit(1).alias("__one"))
    objects = catalogue_side(spark, d, lines=False).agg(F.count("*").alias("nb_objects"), F.lit(1).alias("__one"))
    return card.join(objects, "__one").drop("__one")


@query("cluster_ready", _VOLUMES + f"select count(*) filter (where state = 'alive') > 0 as ready, count(*) filter (where state = 'alive' and {BEAT_MS} - last_heartbeat <= 600000) as beating from volumes")
def cluster_ready(spark, d):
    alive = F.col("state") == "alive"
    return volumes(spark, d).agg((F.count_if(alive) > 0).alias("ready"), F.count_if(alive & (F.lit(BEAT_MS) - F.col("last_heartbeat") <= 600_000)).alias("beating"))


@query("stale_heartbeat", _VOLUMES + f"select volume_id, coalesce({BEAT_MS} - last_heartbeat > 600000, true) as stale from volumes")
def stale_heartbeat(spark, d):
    return volumes(spark, d).select("volume_id", F.coalesce(F.lit(BEAT_MS) - F.col("last_heartbeat") > 600_000, F.lit(True)).alias("stale"))


@query("format_bytes", _VOLUMES + """, u as (select volume_id, unnest([total_bytes, free_bytes // 1000, free_bytes // 1000000, total_bytes * 1000000]) as bytes from volumes)
select volume_id, bytes, case when bytes < 1024 then printf('%.2f B', bytes / 1.0) when bytes < 1048576 then printf('%.2f KB', bytes / 1024.0) when bytes < 1073741824 then printf('%.2f MB', bytes / 1048576.0)
  when bytes < 1099511627776 then printf('%.2f GB', bytes / 1073741824.0) when bytes < 1125899906842624 then printf('%.2f TB', bytes / 1099511627776.0) else printf('%.2f PB', bytes / 1125899906842624.0) end as shown from u""")
def format_bytes(spark, d):
    sizes = F.array("total_bytes", F.floor(F.col("free_bytes") / 1000).cast("bigint"), F.floor(F.col("free_bytes") / 1_000_000).cast("bigint"), F.col("total_bytes") * 1_000_000)
    return volumes(spark, d).select("volume_id", F.explode(sizes).alias("bytes")).select("volume_id", "bytes", S.format_bytes("bytes").alias("shown"))


_RANKED = _VOLUMES + f""", {_CATALOGUE}, w as (select k.key, k.size, v.volume_id, sha256(concat(k.key, v.volume_id)) as h from present k cross join volumes v where v.state = 'alive'),
ranked as (select *, row_number() over (partition by key order by {_LE} desc, volume_id) as rank from w)
"""


@query("hrw_replicas", _RANKED + f"select key, volume_id, rank from ranked where rank <= {RF}")
def hrw_replicas(spark, d):
    return placement.replicas(catalogue_side(spark, d, lines=False), placement.alive(volumes(spark, d)), RF)


@query("placement_status", _RANKED + f"select key, 'ok' as status, string_agg(volume_id, ',' order by rank) as volumes from ranked where rank <= {RF} group by key")
def placement_status(spark, d):
    return placement.placement_status(catalogue_side(spark, d, lines=False), placement.alive(volumes(spark, d)), RF)


@query("placement_insufficient", _VOLUMES + f", {_CATALOGUE} select key, 'insufficient_replicas' as status, '' as volumes from present")
def placement_insufficient(spark, d):
    """More replicas asked for than volumes are alive: every key says so, none is placed."""
    nodes = placement.alive(volumes(spark, d))
    return placement.placement_status(catalogue_side(spark, d, lines=False), nodes, len(nodes) + 1)


@query("volume_load", _RANKED + f"select volume_id, count(*) as keys, cast(coalesce(sum(size), 0) as bigint) as bytes from ranked where rank <= {RF} group by volume_id")
def volume_load(spark, d):
    keys = spread(catalogue_side(spark, d, lines=False).select("key", "size"))
    return placement.volume_load(keys.select("size", F.explode(placement.ranked(F.col("key"), placement.alive(volumes(spark, d)), RF)).alias("volume_id")))


_MAP = _VOLUMES + f""", w as (select s.shard, v.volume_id, v.state, sha256(concat('shard-', cast(s.shard as varchar), v.volume_id)) as h from (select unnest(range({SHARDS})) as shard) s cross join volumes v where v.state = 'alive'),
gone as (select min(volume_id) as volume_id from volumes where state = 'alive'),
m as (select shard, volume_id, row_number() over (partition by shard order by {_LE} desc, volume_id) as rank from w),
less as (select shard, volume_id, row_number() over (partition by shard order by {_LE} desc, volume_id) as rank from w where volume_id not in (select volume_id from gone)),
a as (select * from m where rank <= {RF}), b as (select * from less where rank <= {RF})
"""


@query("shard_map", _MAP + "select shard, volume_id, rank from a")
def shard_map(spark, d):
    return placement.shard_map(spark, SHARDS, placement.alive(volumes(spark, d)), RF)


@query("shard_nodes", _MAP + "select shard, string_agg(volume_id, ',' order by rank) as nodes from a group by shard")
def shard_nodes(spark, d):
    return placement.shard_nodes(shard_map(spark, d))


@query("shards_for_node", _MAP + "select volume_id, count(*) as shards, string_agg(cast(shard as varchar), ',' order by shard) as shard_list from a group by volume_id")
def shards_for_node(spark, d):
    return shard_map(spark, d).groupBy("volume_id").agg(F.count("*").alias("shards"), F.array_join(F.sort_array(F.collect_list("shard")), ",").alias("shard_list"))


@query("key_shard_nodes", _MAP + f""", {_CATALOGUE}, k as (select key, sha256(key) as h from present), n as (select shard, string_agg(volume_id, ',' order by rank) as nodes from a group by shard)
select key, shard, nodes from (select key, cast(cast('0x' || {_LE} as ubigint) % {SHARDS} as bigint) as shard from k) join n using (shard)""")
def key_shard_nodes(spark, d):
    """Where a key is: its shard, and the nodes that the shard map gives that shard."""
    keys = catalogue_side(spark, d, lines=False).select("key", S.shard_of(S.content_hash("key"), SHARDS).alias("shard"))
    return keys.join(F.broadcast(shard_nodes(spark, d)), "shard").select("key", "shard", "nodes")  # SHARDS rows


@query("rebalance_moves", _MAP + "select coalesce(a.shard, b.shard) as shard, coalesce(a.volume_id, b.volume_id) as volume_id, case when a.shard is null then 'add' else 'drop' end as change from a full join b on a.shard = b.shard and a.volume_id = b.volume_id where a.shard is null or b.shard is null")
def rebalance_moves(spark, d):
    """What moves if the first volume is lost."""
    nodes = placement.alive(volumes(spark, d))
    return placement.rebalance_moves(placement.shard_map(spark, SHARDS, nodes, RF), placement.shard_map(spark, SHARDS, nodes[1:], RF))


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What the catalogue expects and what the volumes hold, each written once."""
    expected = materialise(catalogue_side(spark, d).withColumnRenamed("blake3", "hash"), "catalogue")
    return expected, materialise(blob_side(spark, d).withColumnRenamed("blake3", "hash"), "blobs")


_CLASSES = _RANKED + f""", j as (select c.key, c.volume_id, c.size, c.hash, b.hash as held, b.key is not null as there from catalog c left join blobs b on c.key = b.key and c.volume_id = b.volume_id),
k as (select key, case when count(*) filter (where there and hash is distinct from held) > 0 then 'corrupted' when count(*) filter (where there) < {RF} then 'under_replicated' else 'healthy' end as class from j group by key),
o as (select b.key, b.volume_id from blobs b left join catalog c on c.key = b.key and c.volume_id = b.volume_id where c.key is null),
sound as (select j.key, j.volume_id from j join volumes v on v.volume_id = j.volume_id and v.state = 'alive' where there and hash is not distinct from held),
need as (select key, max(size) as size, {RF} - count(s.volume_id) as lost, min(s.volume_id) as source from (select distinct key, size from catalog) p left join sound s using (key) group by key),
free as (select r.key, r.volume_id, row_number() over (partition by r.key order by r.rank) as nth from ranked r left join sound s on s.key = r.key and s.volume_id = r.volume_id where s.key is null),
plan as (select n.key, f.volume_id as target, n.source, n.size from need n join free f on f.key = n.key and f.nth <= n.lost)
"""


@query("verify_report", _CLASSES + """select 'total_keys' as class, count(*) as n from k union all select 'healthy', count(*) filter (where class = 'healthy') from k union all select 'under_replicated', count(*) filter (where class = 'under_replicated') from k
union all select 'corrupted', count(*) filter (where class = 'corrupted') from k union all select 'orphaned', count(*) from o""")
def verify_report(spark, d):
    return integrity.verify_report(*sides(spark, d), RF)


@query("verify_keys", _CLASSES + "select key, class from k")
def verify_keys(spark, d):
    return integrity.verify_keys(*sides(spark, d), RF)


@query("orphans", _CLASSES + "select key, volume_id from o")
def orphans(spark, d):
    return integrity.orphan_blobs(*sides(spark, d))


@query("repair_plan", _CLASSES + "select key, target, source, size from plan")
def repair_plan(spark, d):
    return integrity.repair_plan(*sides(spark, d), placement.alive(volumes(spark, d)), RF)


@query("repair_report", _CLASSES + "select (select count(*) from catalog) as checked, count(*) as to_repair, count(*) filter (where source is null) as without_source, cast(coalesce(sum(size), 0) as bigint) as bytes_to_copy from plan")
def repair_report(spark, d):
    return integrity.repair_report(*sides(spark, d), placement.alive(volumes(spark, d)), RF)


@query("vote_tally", _VOLUMES + "select count(*) as voters, count(*) filter (where state = 'alive') as granted, count(*) filter (where state = 'alive') >= count(*) // 2 + 1 as won from volumes")
def vote_tally(spark, d):
    v = volumes(spark, d).agg(F.count("*").alias("voters"), F.count_if(F.col("state") == "alive").alias("granted"))
    return v.withColumn("won", F.col("granted") >= F.floor(F.col("voters") / 2) + 1)


@query("raft_commit_index", _VOLUMES + ", r as (select total_keys, row_number() over (order by total_keys desc nulls last) as rk, count(*) over () as n from volumes) select total_keys as commit_index from r where rk = n // 2 + 1")
def raft_commit_index(spark, d):
    """The greatest index that a majority of replicas has reached: the least of the majority that got farthest."""
    v = volumes(spark, d).select("total_keys")
    majority = v.count() // 2 + 1
    return v.orderBy(F.desc_nulls_last("total_keys")).limit(majority).agg(F.when(F.count("total_keys") == majority, F.min("total_keys")).alias("commit_index"))


@query("raft_append_check", f"""with w as (select distinct {N.sql_word("volume_id")} as volume_id, sequence from wal_entries where volume_id is not null and sequence is not null),
g as (select volume_id, sequence, lag(sequence) over (partition by volume_id order by sequence) as before from w),
c as (select volume_id, min(before) filter (where sequence > before + 1) as gap, max(sequence) as top from g group by volume_id)
select volume_id, sequence, sequence - 1 <= coalesce(gap, top) as accepted, case when sequence - 1 > coalesce(gap, top) then coalesce(gap, top) end as conflict_index from w join c using (volume_id)""")
def raft_append_check(spark, d):
    """Each entry of a volume's log as an append: refused where the entry before it lies beyond what the follower has without a gap, with that index."""
    w = table(spark, d, "wal_entries").select(N.volume("volume_id").alias("volume_id"), "sequence").where("volume_id is not null and sequence is not null").distinct()
    w = materialise(w, "sequences")
    follows = w.select("volume_id", (F.col("sequence") + 1).alias("sequence"))
    ends = follows.join(w, ["volume_id", "sequence"], "left_anti").groupBy("volume_id").agg((F.min("sequence") - 1).alias("reached"))  # the first entry that nothing follows
    beyond = F.col("sequence") - 1 > F.col("reached")
    return w.join(ends, "volume_id").select("volume_id", "sequence", (~beyond).alias("accepted"), F.when(beyond, F.col("reached")).alias("conflict_index"))


def log_values(spark: SparkSession, d: str) -> DataFrame:
    """``key, value``: what the logs hold of each key; of several volumes' puts, that of the highest sequence, then the last volume."""
    state = apply_changes(wal_feed(spark, d), ["volume_id", "key"], "sequence", "op", ["value_bytes"])
    return state.groupBy("key").agg(F.max_by("value_bytes", F.struct("last_no", "volume_id")).alias("value"))


_VALUES = f"""lw as (select {N.sql_word("volume_id")} as volume_id, {N.sql_key("key")} as key, sequence as no, {N.sql_op("op")} as op, value_bytes as value from wal_entries),
lr as (select *, row_number() over (partition by volume_id, key order by no desc, (op = 'put')) as lrk from lw),
vals as (select key, arg_max(coalesce(value, ''::blob), (no, volume_id)) as value from lr where lrk = 1 and op = 'put' group by key)
"""
# fixed values: the well-formed byte sequences of UTF-8 as pairs of hex digits, then the longest beginnings of such, then any byte
_WHOLE = "[0-7][0-9A-F]|(?:C[2-9A-F]|D[0-9A-F])[89AB][0-9A-F]|E0[AB][0-9A-F][89AB][0-9A-F]|E[1-9ABCEF](?:[89AB][0-9A-F]){2}|ED[89][0-9A-F][89AB][0-9A-F]|F0[9AB][0-9A-F](?:[89AB][0-9A-F]){2}|F[123](?:[89AB][0-9A-F]){3}|F48[0-9A-F](?:[89AB][0-9A-F]){2}"
_TORN = "F0[9AB][0-9A-F][89AB][0-9A-F]|F[123](?:[89AB][0-9A-F]){2}|F48[0-9A-F][89AB][0-9A-F]|F0[9AB][0-9A-F]|F[123][89AB][0-9A-F]|F48[0-9A-F]|E0[AB][0-9A-F]|E[1-9ABCEF][89AB][0-9A-F]|ED[89][0-9A-F]|[0-9A-F]{2}"
_LOSSY = f"decode(unhex(array_to_string(list_transform(regexp_extract_all(hex(value), '{_WHOLE}|{_TORN}'), lambda x: case when regexp_full_match(x, '{_WHOLE}') then x else 'EFBFBD' end), '')))"


@query("export_ndjson", _VOLUMES + f""", {_CATALOGUE}, {_VALUES}, e as (select key, {_LOSSY} as text from present join vals using (key))
select key, '{{"key":' || to_json(key) || ',"value":' || to_json(text) || '}}' as line from e""")
def export_ndjson(spark, d):
    """Every catalogued key that has a value, in the order of keys."""
    return reads.export_ndjson(catalogue_side(spark, d, lines=False), log_values(spark, d)).orderBy("key")


@query("catalog_value_diff", _VOLUMES + f""", {_CATALOGUE}, {_VALUES}
select count(*) filter (where a.key is not null and b.key is not null) as in_both, count(*) filter (where b.key is null) as catalog_only, count(*) filter (where a.key is null) as value_only from present a full join vals b on a.key = b.key""")
def catalog_value_diff(spark, d):
    return reads.catalog_value_diff(catalogue_side(spark, d, lines=False), log_values(spark, d))


_RANGE = ("doc/4", "doc/9")


@query("range_with_meta", _VOLUMES + f", {_CATALOGUE}, {_VALUES} select v.key, p.size, p.hash from vals v left join present p using (key) where v.key between '{_RANGE[0]}' and '{_RANGE[1]}'")
def range_with_meta(spark, d):
    meta = catalogue_side(spark, d, lines=False).select("key", "size", F.col("blake3").alias("hash"))
    return reads.range_with_meta(log_values(spark, d), meta, *_RANGE)


@query("range_with_values", _VOLUMES + f", {_CATALOGUE}, {_VALUES} select p.key, lower(hex(coalesce(v.value, ''::blob))) as value_hex from present p left join vals v using (key) where p.key between '{_RANGE[0]}' and '{_RANGE[1]}'")
def range_with_values(spark, d):
    """The catalogue's keys of a range with their values, empty bytes where there is none."""
    found = reads.range_with_values(catalogue_side(spark, d, lines=False), log_values(spark, d), *_RANGE)
    return found.select("key", F.lower(F.hex("value")).alias("value_hex"))


@query("range_page", _VOLUMES + f", {_CATALOGUE}, {_VALUES} select key from vals where key between '{_RANGE[0]}' and '{_RANGE[1]}' order by key limit 25 offset 10")
def range_page(spark, d):
    return reads.page(reads.range_keys(log_values(spark, d), *_RANGE), 25, 10)


@query("search_bytes", _VOLUMES + f", {_VALUES} select key from vals where contains(try(decode(value)), 'a')")
def search_bytes(spark, d):
    """A search through values of which some are no text: those are never found."""
    return reads.search_value(log_values(spark, d), "a")


@query("keys_of_tenant", f"""with w as (select {N.sql_word("volume_id")} as volume_id, {N.sql_key("key")} as key, sequence as no, {N.sql_op("op")} as op, tenant from wal_entries),
r as (select *, rank() over (partition by volume_id, key order by no desc) as rk from w), s as (select volume_id, key, max(tenant) as tenant from r where rk = 1 group by all having bool_and(op = 'put'))
select volume_id, key from s where tenant = 'tenant-02'""")
def keys_of_tenant(spark, d):
    state = apply_changes(wal_feed(spark, d), ["volume_id", "key"], "sequence", "op", ["tenant"])
    return reads.of_tenant(state, "tenant-02").select("volume_id", "key")


def objects(spark: SparkSession, d: str) -> DataFrame:
    """The log's entries on keys of the form bucket/name: ``bucket, object_key, seq, op, body``."""
    parts = [F.regexp_extract("key", "(?s)^([^/]+)/(.*)$", i) for i in (1, 2)]
    w = table(spark, d, "wal_entries").select(N.decoded_key("key").alias("key"), F.col("entry_id").alias("seq"), N.log_op("op").alias("op"), "value_bytes")
    return w.where(F.rlike("key", F.lit("(?s)^[^/]+/.*$"))).select(parts[0].alias("bucket"), parts[1].alias("object_key"), "seq", "op", F.coalesce("value_bytes", F.lit(b"")).alias("body"))


_OBJECTS = f"""with o as (select regexp_extract(key, '(?s)^([^/]+)/(.*)$', 1) as bucket, regexp_extract(key, '(?s)^([^/]+)/(.*)$', 2) as object_key, seq, op, coalesce(body, ''::blob) as body
  from (select url_decode(key) as key, entry_id as seq, {N.sql_op("op")} as op, value_bytes as body from wal_entries) where regexp_matches(key, '(?s)^[^/]+/.*$')),
x as (select url_decode(key) as key, arg_max(coalesce(expires_at, 0), (written_at, location_id)) as expires_at from blob_locations where written_at is not null group by 1)
"""


@query("object_put", _OBJECTS + """, r as (select *, row_number() over (partition by bucket, object_key order by seq desc) as rk from o where op = 'put')
select bucket, object_key, seq, cast(octet_length(body) as bigint) as body_bytes, nullif(expires_at, 0) as expires_at, 200 as status from r left join x on x.key = bucket || '/' || object_key where rk = 1""")
def object_put(spark, d):
    """The last put of each object, with the expiry that its newest blob was stored with (0: never)."""
    puts = objects(spark, d).where("op = 'put'").groupBy("bucket", "object_key").agg(F.max("seq").alias("seq"), F.max_by(F.octet_length("body").cast("bigint"), "seq").alias("body_bytes"))
    b = table(spark, d, "blob_locations").select(N.decoded_key("key").alias("key"), F.coalesce("expires_at", F.lit(0)).alias("expires_at"), "written_at", "location_id").where("written_at is not null")
    expiry = b.groupBy("key").agg(F.max_by("expires_at", F.struct("written_at", "location_id")).alias("expires_at"))
    joined = puts.withColumn("key", F.concat_ws("/", "bucket", "object_key")).join(expiry, "key", "left")
    return joined.select("bucket", "object_key", "seq", "body_bytes", F.nullif("expires_at", F.lit(0)).alias("expires_at"), F.lit(200).alias("status"))


@query("object_get", _OBJECTS + """, r as (select *, row_number() over (partition by bucket, object_key order by seq desc) as rk from o), a as (select distinct url_decode(key) as key from key_changes)
select a.key, case when r.op = 'put' then 200 else 404 end as status, case when r.op = 'put' then lower(hex(body)) end as body_hex from a left join r on a.key = bucket || '/' || object_key and rk = 1""")
def object_get(spark, d):
    """Each key of the change feed asked for: 200 and its body, or 404 where nothing is or the last operation deleted it."""
    last = objects(spark, d).groupBy("bucket", "object_key").agg(F.max_by(F.struct("op", "body"), "seq").alias("x")).where("x.op = 'put'")
    asked = table(spark, d, "key_changes").select(N.decoded_key("key").alias("key")).distinct()
    got = asked.join(last.select(F.concat_ws("/", "bucket", "object_key").alias("key"), "x.body"), "key", "left")
    return got.select("key", F.when(F.col("body").isNotNull(), 200).otherwise(404).alias("status"), F.lower(F.hex("body")).alias("body_hex"))


@query("audit_events", f"""select min(audit_id) as audit_id, logged_at, {N.sql_word("event")} as event, {N.sql_word("actor")} as actor, {N.sql_key("target")} as target, message, meta, count(*) as deliveries from audit_log group by 2, 3, 4, 5, 6, 7""")
def audit_events(spark, d):
    """Each audit entry once, however often it was delivered, with message and meta."""
    a = table(spark, d, "audit_log").select("audit_id", "logged_at", N.word("event").alias("event"), N.word("actor").alias("actor"), N.decoded_key("target").alias("target"), "message", "meta")
    return a.groupBy("logged_at", "event", "actor", "target", "message", "meta").agg(F.min("audit_id").alias("audit_id"), F.count("*").alias("deliveries"))


@query("content_blake3")
def content_blake3(spark, d):
    """The digest of every value of the log and the shard it names; no SQL engine here knows BLAKE3, so it is tested against the JVM's."""
    digest = blake3(F.coalesce("value_bytes", F.lit(b"")))
    return table(spark, d, "wal_entries").select("entry_id", digest.alias("digest")).select("entry_id", "digest", S.shard_of(F.col("digest"), SHARDS).alias("shard"))


@query("hrw_blake3")
def hrw_blake3(spark, d):
    """Placement by BLAKE3 weights."""
    return placement.replicas(catalogue_side(spark, d, lines=False), placement.alive(volumes(spark, d)), RF, "blake3")
