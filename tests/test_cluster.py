"""Volumes, repair, objects, imports and exports on small tables."""

import random
import time

import numpy as np
import pytest
from conftest import rows

from foldstone import config
from foldstone.functions import blake3, lz4
from foldstone.functions.blake3 import digest
from foldstone.operators import integrity, metering, placement, reads
from foldstone.plans import cluster
from foldstone.session import broadcast_if_small, qualified, scratch, spread
from foldstone.sources import formats
from foldstone.store import Store

VOLUME = "volume_id string, address string, grpc_address string, state string, shards array<bigint>, total_keys bigint, total_bytes bigint, free_bytes bigint, last_heartbeat bigint, registered_at bigint, removed_at bigint"
LOG = "entry_id bigint, volume_id string, sequence bigint, op string, key string, value_bytes binary, tenant string"


def test_volumes_are_the_latest_registrations(spark, tmp_path):
    reg = lambda v, at, gone=None, state="alive", beat=1: (v, None, None, state, [1], 1, 1, 1, beat, at, gone)
    data = [reg("v1", 1, 5), reg(" V1", 9, state=" Suspect"), reg("v2", 1), reg("v2", 1), reg("v3", 1), reg("v3", 2, 3), reg(None, 1), reg("v4", 1, beat=None)]
    spark.createDataFrame(data, VOLUME).write.parquet(f"{tmp_path}/volume_metadata.parquet")
    d = str(tmp_path)
    assert rows(cluster.volumes(spark, d).select("volume_id", "state")) == [("v1", "suspect"), ("v2", "alive"), ("v4", "alive")]
    assert rows(cluster.stale_heartbeat(spark, d)) == [("v1", True), ("v2", True), ("v4", True)]
    assert cluster.cluster_totals(spark, d).first()["volumes"] == 3 and cluster.vote_tally(spark, d).first()["won"]


def test_all_volumes_take_part(spark, tmp_path):
    spark.range(12_000).selectExpr("concat('vol-', id) as volume_id", "'a' as address", "'a' as grpc_address", "if(id < 900, 'alive', 'dead') as state", "array(id) as shards", "id as total_keys", "id as total_bytes", "id as free_bytes", "id as last_heartbeat", "id as registered_at", "cast(null as bigint) as removed_at").write.parquet(f"{tmp_path}/volume_metadata.parquet")
    assert cluster.cluster_totals(spark, str(tmp_path)).first()["volumes"] == 12_000
    assert cluster.raft_commit_index(spark, str(tmp_path)).first()[0] == 5999
    nodes = placement.alive(cluster.volumes(spark, str(tmp_path)))
    used = placement.replicas(spark.range(300).selectExpr("cast(id as string) as key"), nodes, 3).select("volume_id").distinct().count()
    assert len(nodes) == 900 and used > 500


CATALOG, BLOBS = "key string, volume_id string, size bigint, hash string", "key string, volume_id string, size bigint, hash string"


def test_repair_copies_to_other_living_volumes(spark):
    alive = ["a", "b", "c", "d"]
    catalog = spark.createDataFrame([("whole", v, 1, "h") for v in "abc"] + [("dead", v, 2, "h") for v in ("a", "b", "x")] + [("bad", v, 3, "h") for v in "abc"] + [("gone", "x", 4, "h")] + [("null", v, None, None) for v in "abc"], CATALOG)
    held = [("whole", v, 1, "h") for v in "abc"] + [("dead", v, 2, "h") for v in ("a", "b", "x")] + [("bad", "a", 3, "h"), ("bad", "b", 3, "h"), ("bad", "c", 3, "other")] + [("null", v, None, None) for v in "ab"] + [("stray", "a", 1, "h")]
    blobs = spark.createDataFrame(held, BLOBS)
    plan = rows(integrity.repair_plan(catalog, blobs, alive, 3))
    by = {k: [(t, s) for kk, t, s, _ in plan if kk == k] for k in ("whole", "dead", "bad", "gone", "null")}
    assert by["whole"] == [] and len(by["dead"]) == 1 and by["dead"][0][0] in "cd" and by["dead"][0][1] == "a"
    assert len(by["bad"]) == 1 and by["bad"][0][0] in "cd" and len(by["null"]) == 1 and by["null"][0][0] in "cd"
    assert len(by["gone"]) == 3 and {s for _, s in by["gone"]} == {None} and len({t for t, _ in by["gone"]}) == 3
    assert integrity.repair_report(catalog, blobs, alive, 3).first().asDict() == {"checked": 13, "to_repair": 6, "without_source": 3, "bytes_to_copy": 2 + 3 + 12}
    assert rows(integrity.repair_plan(catalog, blobs, ["a"], 3).where("key = 'gone'")) == [("gone", "a", None, 4)]  # fewer than it lacks
    assert rows(integrity.repair_plan(catalog.limit(0), blobs, alive, 3)) == [] and rows(integrity.orphan_blobs(catalog, blobs)) == [("stray", "a")]
    assert dict(rows(integrity.verify_keys(catalog, blobs, 3))) == {"whole": "healthy", "dead": "healthy", "bad": "corrupted", "gone": "under_replicated", "null": "under_replicated"}


def test_objects_are_decoded_before_they_are_cut(spark, tmp_path):
    data = [(1, "v", 1, "put", "b%2Fx%2fy", b"1", None), (2, "v", 2, " 1 ", "b/x/y", b"22", None), (3, "v", 3, "DEL", "b/z", None, None), (4, "v", 4, "put", "plain", b"4", None), (5, "v", 5, "put", "b/e", None, None), (6, "v", 6, "put", "b/n\nl", b"6", None)]
    spark.createDataFrame(data, LOG).write.parquet(f"{tmp_path}/wal_entries.parquet")
    spark.createDataFrame([("b/x%2Fy", 7, 1, 1), ("b/x/y", 0, 2, 2), ("b/e", 9, 1, 3)], "key string, expires_at bigint, written_at bigint, location_id bigint").write.parquet(f"{tmp_path}/blob_locations.parquet")
    spark.createDataFrame([(k,) for k in ("b/x/y", "b/z", "b%2Fe", "none/here")], "key string").write.parquet(f"{tmp_path}/key_changes.parquet")
    d = str(tmp_path)
    assert rows(cluster.object_put(spark, d)) == [("b", "e", 5, 0, 9, 200), ("b", "n\nl", 6, 1, None, 200), ("b", "x/y", 2, 2, None, 200)]
    assert rows(cluster.object_get(spark, d)) == [("b/e", 200, ""), ("b/x/y", 200, "3232"), ("b/z", 404, None), ("none/here", 404, None)]


def test_appends_after_a_gap_are_refused(spark, tmp_path):
    spark.createDataFrame([("a", n) for n in (3, 4, 5, 5, 8, 9)] + [("b", 0), (None, 1), ("b", None)], "volume_id string, sequence bigint").write.parquet(f"{tmp_path}/wal_entries.parquet")
    got = rows(cluster.raft_append_check(spark, str(tmp_path)))
    assert got == [("a", 3, True, None), ("a", 4, True, None), ("a", 5, True, None), ("a", 8, False, 5), ("a", 9, False, 5), ("b", 0, True, None)]


def test_import_bodies(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"entries":[{"key":"k","value":"1"},{"key":"q","value":""},{"key":"k","value":"é\\"2"}]}\nno json\n{"entries":[{"key":"x"}]}\n{"entries":[]}\n{}\n')
    got = reads.read_import(spark, str(tmp_path))
    assert rows(got.select("ord", "key", "value")) == [(0, "k", "1"), (1, "q", ""), (2, "k", 'é"2')]
    last, n = reads.import_entries(got, "ord")
    assert rows(last.select("key", "value")) == [("k", 'é"2'), ("q", "")] and n.first()[0] == 3


def test_exports_are_written_in_key_order(spark):
    state = spark.createDataFrame([(f"k{i:03d}", str(i).encode()) for i in random.Random(1).sample(range(300), 300)] + [("null", None)], "key string, value binary")
    path = scratch(spark, "export")
    reads.write_ndjson(reads.export_ndjson(state.select("key"), state), path)
    lines = [r[0] for r in spark.read.text(path).orderBy("_metadata.file_name").collect()]
    assert lines == sorted(lines) and len(lines) == 301 and '{"key":"null","value":""}' in lines


def test_pages_tenants_and_empty_values(spark):
    state = spark.createDataFrame([("a", b"1", "t"), ("b", None, None), ("c", b"3", "u")], "key string, value binary, tenant string")
    keys = spark.createDataFrame([("a",), ("b",), ("x",)], "key string")
    assert [tuple(r) for r in reads.page(reads.range_keys(state, "a", "z"), 1, 1).collect()] == [("b",)] and reads.page(reads.range_keys(state, "a", "z"), 5, 9).count() == 0
    assert reads.of_tenant(state, "t").count() == 1 and reads.of_tenant(state, None).count() == 3
    assert rows(reads.range_with_values(keys, state, "a", "x")) == [("a", b"1"), ("b", b""), ("x", b"")]


@pytest.mark.parametrize("value", [b"", b"short", b"a" * 127, b"a" * 128, bytes(range(256)), b"abc" * 5000])
def test_lz4_frames(value):
    packed = lz4.pack(value)
    assert (packed is None) == (len(value) < 128 or len(set(value)) == 256)
    assert packed is None or (lz4.unpack(packed, len(value)) == value and len(packed) < len(value))
    frame = formats.blob_frame("k", value, compress=True)
    assert list(formats.read_segment(frame)) == [("k", 0, len(value), value, True)]
    assert frame[:4] == (formats.LZ4_MAGIC if packed else formats.BLOB_MAGIC)


def test_broken_lz4_blocks(spark):
    packed = lz4.pack(b"a" * 1000)
    for broken, size in ((packed[:3], 1000), (packed, 999), (packed[:6], 1000)):
        with pytest.raises(ValueError):
            lz4.unpack(broken, size)
    df = spark.createDataFrame([(b"a" * 1000,), (b"",), (None,)], "v binary").select(lz4.stored(df_col("v")).alias("s"))
    assert [None if r[0] is None else bytes(r[0]) for r in df.select(lz4.restored(df_col("s"))).collect()] == [b"a" * 1000, b"", None]


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_metrics_of_null_and_odd_paths(spark):
    requests = spark.createDataFrame([(None, True, 2.0), ('a"b\\', False, 7.0), ('a"b\\', True, None)], "path string, success boolean, duration_ms double")
    assert rows(metering.endpoint_counters(requests)) == [('a"b\\', False, 2, 1, 1), (None, False, 1, 1, 0), (None, True, 3, 2, 1)]
    lines = [r[0] for r in metering.prom_lines(requests).collect()]
    assert 'requests_total{path=""} 1' in lines and 'requests_error{path="a\\"b\\\\"} 1' in lines and 'request_duration_ms_bucket{path="",le="5"} 1' in lines


def test_tenants_with_a_quota_but_no_usage(spark):
    usage = spark.createDataFrame([("a", 5), ("free", 5)], "tenant string, bytes bigint")
    quotas = spark.createDataFrame([("a", 6, True), ("idle", 1, True), ("off", 1, False)], "tenant_id string, storage_limit bigint, enabled boolean")
    assert rows(metering.quota_check(usage, quotas, "bytes", "storage_limit", 2, 100)) == [("a", 5, 6, "exceeded"), ("free", 5, 100, "allowed"), ("idle", 0, 1, "exceeded"), ("off", 0, 1, "disabled")]


def test_paths_without_a_scheme_get_that_of_the_file_system(spark, tmp_path):
    assert qualified(spark, f"{tmp_path}/") == f"file:{tmp_path}" and qualified(spark, f"file://{tmp_path}").startswith("file:/")
    store, path = formats.located(qualified(spark, str(tmp_path)))
    assert store.get_file_info(path).is_file is False and path == str(tmp_path)


def test_large_files_are_read_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "TASK_BYTES", 25)
    data = bytes(range(256)) * 2
    (tmp_path / "big").write_bytes(data)
    (tmp_path / "empty").write_bytes(b"")
    formats.register(spark)
    df = spark.read.format("chunks").option("width", "10").load(str(tmp_path))
    got = sorted((r["chunk_no"], bytes(r["chunk"])) for r in df.collect())
    assert b"".join(c for _, c in got) == data and [n for n, _ in got] == list(range(52)) and {len(c) for _, c in got[:-1]} == {10}


def test_files_are_read_record_by_record():
    import io

    class Slow(io.BytesIO):
        most = 0

        def read(self, n=-1):
            Slow.most = max(Slow.most, n)
            return super().read(n)

    data = b"".join(formats.wal_record(i, "put", f"k{i}", b"x" * 50) for i in range(100))
    assert [r[0] for r in formats.read_wal(Slow(data))] == list(range(100)) and Slow.most < 100


def test_settings(tmp_path):
    base = tmp_path / "store.toml"
    assert config.load(base, {}) == config.Settings()
    base.write_text('replicas = 2\nhold = "5m"\n')
    (tmp_path / "store.local.toml").write_text("replicas = 4\ncompress = true\n")
    assert config.load(base, {"FOLDSTONE_SHARDS": "16", "FOLDSTONE_OTHER": "x", "FOLDSTONE_COMPRESS": "0"}) == config.Settings(4, 16, compress=False, hold=300_000)
    for text in ("replicas = 0", "unknown = 1", 'hold = "soon"', 'replicas = "many"'):
        base.write_text(text)
        (tmp_path / "store.local.toml").unlink(missing_ok=True)
        with pytest.raises(ValueError):
            config.load(base, {})


def test_records_of_volumes_and_settings(spark):
    s = Store(spark, scratch(spark, "records"))
    s.put_record("volume", "v1", {"state": "alive", "keys": 3})
    s.put_record("config", "v1", {"state": "x"})
    s.put_record("volume", "v1", {"state": "dead", "keys": 4})
    assert s.get_record("volume", "v1") == {"state": "dead", "keys": 4} and s.get_record("volume", "v2") is None
    assert rows(s.records("volume", "state string, keys bigint")) == [("v1", "dead", 4)]


@pytest.mark.parametrize("limits", [{"rows": 1}, {"size": 1}])
def test_sides_beyond_either_limit_are_not_broadcast(spark, limits):
    shown = lambda df: df._jdf.queryExecution().analyzed().toString()
    small = spark.range(3)
    assert "ResolvedHint" in shown(broadcast_if_small(small, "side")) and "ResolvedHint" not in shown(broadcast_if_small(small, "side", **limits))


def test_too_many_volumes_are_an_error(spark, monkeypatch):
    volumes = spark.createDataFrame([("a", "alive"), ("b", "alive"), ("c", "alive"), ("d", "dead")], "volume_id string, state string")
    monkeypatch.setattr(placement, "MOST_VOLUMES", 3)
    assert placement.alive(volumes) == ["a", "b", "c"]
    monkeypatch.setattr(placement, "MOST_VOLUMES", 2)
    with pytest.raises(ValueError):
        placement.alive(volumes)


def test_spread_changes_no_row(spark):
    df = spark.range(100)
    assert spread(df, least=0).rdd.getNumPartitions() == df.rdd.getNumPartitions() and rows(spread(df, least=1 << 40)) == rows(df)


def test_blake3_ranks_are_their_own(spark):
    keys, nodes = spark.createDataFrame([("k1",), ("é",), ("",)], "key string"), ["a", "b", "c", "d"]
    weight = lambda k, v: int.from_bytes(bytes.fromhex(digest((k + v).encode()))[:8], "little")
    want = sorted((k, v, n) for k in ("k1", "é", "") for n, v in enumerate(sorted(nodes, key=lambda v: -weight(k, v))[:2], 1))
    assert sorted(map(tuple, placement.replicas(keys, nodes, 2, "blake3").collect())) == want


@pytest.mark.parametrize("at_once, weights", [(32_768, 1 << 20), (7, 5)])
def test_blake3_ranks_of_any_lengths(monkeypatch, at_once, weights):
    monkeypatch.setattr(blake3, "AT_ONCE", at_once)
    monkeypatch.setattr(placement, "WEIGHTS", weights)
    r = random.Random(2)
    keys = ["x" * n for n in (0, 1, 2, 3, 4, 5, 23, 26, 27, 54, 55, 60, 63, 64, 65, 128, 129, 1014, 1015, 1024, 2100)] + [f"doc/{r.random()}" for _ in range(20)] + ["é" * 31, None]
    nodes = [f"vol-{i:03d}" for i in range(20)] + ["", "é", "v" * 64, "w" * 200, "vol-7", "vol-003"]
    weights = iter(int.from_bytes(bytes.fromhex(x)[:8], "little") for x in blake3.digests([(k + v).encode() for k in keys if k is not None for v in nodes]))
    of = {k: {v: next(weights) for v in nodes} for k in keys if k is not None}
    for n in (1, 3, 30):
        want = [[nodes.index(v) for v in (nodes if k is None else sorted(nodes, key=lambda v: -of[k][v]))[:n]] for k in keys]  # noqa: B023
        got = placement._ranked_blake3(keys, [v.encode() for v in nodes], min(n, len(nodes)))
        assert [[nodes.index(nodes[i]) for i in x] for x in got.tolist()] == want


def test_blake3_weights_that_tie_in_their_upper_half():
    keys, named = [b"k1", b"k2"], [b"a", b"b", b"c", b"d"]
    weights = [[int.from_bytes(bytes.fromhex(digest(k + v))[:8], "little") for v in named] for k in keys]
    got = placement._heaviest(keys, named, np.full((2, 4), 7, dtype=np.uint32), 3)
    assert got.tolist() == [sorted(range(4), key=lambda i: -w[i])[:3] for w in weights]
    high = np.array([[1, 9, 9, 9], [5, 4, 5, 3]], dtype=np.uint32)
    want = [sorted(range(4), key=lambda i: (-int(h[i]), -w[i]))[:2] for h, w in zip(high, weights, strict=True)]
    assert placement._heaviest(keys, named, high, 2).tolist() == want


def test_blake3_placement_costs_about_what_sha256_does(spark):
    keys, nodes = spark.range(1000).selectExpr("concat('doc/', lpad(id, 10, '0'), '/v1.txt') as key"), [f"vol-{i:06d}" for i in range(2000)]

    def seconds(digest):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            placement.replicas(keys, nodes, 3, digest).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds("blake3") < 2 * seconds("sha256")


def test_placement_by_blake3_has_parts_for_every_core(spark):
    keys = spark.range(3).selectExpr("cast(id as string) as key")
    cores = spark.sparkContext.defaultParallelism
    assert spread(keys, least=0, parts=8).rdd.getNumPartitions() == 8 * cores and spread(keys, parts=8).rdd.getNumPartitions() == cores
