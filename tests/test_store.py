"""The log store: folds, snapshots, generations, formats and scalar functions."""

import random
import struct

import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from foldstone import cli
from foldstone.functions import blake3, crypto
from foldstone.functions import normalise as N
from foldstone.functions import scalars as S
from foldstone.operators import batch, fold, metering, placement, reads
from foldstone.session import scratch
from foldstone.sources import formats
from foldstone.store import LOG, Store

ROWS = [(0, "put", "key1", b"value1", None, None), (1, "put", "key2", b"value2", 50, None), (2, "delete", "key1", None, None, None)]


def log(spark, data=ROWS):
    return spark.createDataFrame(data, LOG)


def test_fold_and_empty_log(spark):
    assert rows(fold.fold_state(log(spark)).select("key", "seq")) == [("key2", 1)]
    assert rows(fold.fold_state(log(spark, []))) == [] and fold.next_seq(log(spark, [])).first()[0] == 0


def test_expiry_boundary(spark):
    state = fold.fold_state(log(spark))
    assert state.where(fold.live(50)).count() == 1 and state.where(fold.live(51)).count() == 0
    assert [fold.ttl_remaining(state, t).first()[1] for t in (49, 50)] == [1, None]
    assert fold.purge(state, 51)[1].first()[0] == 1


def test_store_survives_a_crash_before_the_swap(spark):
    s = Store(spark, scratch(spark, "store"))
    s.append(log(spark))
    s.write_generation(0)  # and no swap: as if it crashed
    assert rows(s.state().select("key")) == [("key2",)] and s._pointer() == (-1, -1)
    s.compact(0)
    s.append(spark.createDataFrame([(s.next_seq(), "put", "key1", b"again")], "seq bigint, op string, key string, value binary"))
    assert rows(s.state().select("key", "seq")) == [("key1", 3), ("key2", 1)]
    s.compact(51)  # key2 has expired
    assert rows(s.state().select("key")) == [("key1",)] and s.next_seq() == 4


def test_put_get_delete_and_time_to_live(spark):
    s = Store(spark, scratch(spark, "store3"))
    assert s.get("k") is None and s.delete("k") == 0 and s.put("k", b"1", 100, 50) == 1
    assert s.get("k", 150) == b"1" and s.get("k", 151) is None
    assert s.put("k", b"2") == 2 and s.put("q", b"") == 3 and s.get("k", 10**12) == b"2" and s.get("q") == b""
    s.compact(0)
    assert s.get("k") == b"2" and s.delete("k") == 4 and s.get("k") is None and s.next_seq() == 5


def test_the_log_is_trimmed_and_sequences_go_on(spark):
    s = Store(spark, scratch(spark, "store4"))
    s.append(log(spark))
    s.append(log(spark, [(3, "put", "key3", b"3", None, None)]))
    name = s.write_generation(0)
    s.append(log(spark, [(4, "put", "key4", b"4", None, None)]))
    s.swap(name)
    assert [n.split("-")[0] for n in s.trim()] == ["log/upto", "log/upto"] and s.log().count() == 1
    assert rows(s.state().select("key", "seq")) == [("key2", 1), ("key3", 3), ("key4", 4)] and s.next_seq() == 5
    s.compact(0)
    assert s.log().count() == 0 and s.next_seq() == 5 and s.state().count() == 3 and len([n for n in s._names(s.root) if n.startswith("gen-")]) == 1
    s.append(log(spark, []))  # nothing
    assert s.next_seq() == 5 and s.put("key4", b"new") == 5 and s.get("key4") == b"new" and s.get("key2") is not None


def test_an_append_that_failed_is_not_there(spark):
    s = Store(spark, scratch(spark, "store5"))
    spark.createDataFrame([(9, "put", "k", b"x", None, None)], LOG).write.parquet(f"{s.root}/aside/left")
    assert s.log().count() == 0 and s.next_seq() == 0


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda **_: spark)
    root = str(tmp_path / "s")
    run = lambda *a: cli.main([*a, "--now-ms", "1000"])
    assert run("put", root, "k", "é", "--ttl-ms", "5") == 0 and run("get", root, "k") == 0 and run("get", root, "none") == 1
    assert cli.main(["get", root, "k", "--now-ms", "1006"]) == 1 and run("delete", root, "k") == 0 and run("get", root, "k") == 1 and run("compact", root) == 0
    assert "é" in capsys.readouterr().out
    assert cli.main(["verify", DATA]) == 0 and "total_keys" in capsys.readouterr().out
    assert cli.main(["repair", DATA, "--out", str(tmp_path / "plan")]) == 0 and spark.read.parquet(str(tmp_path / "plan")).count() > 0
    assert cli.main(["list"]) == 0 and "p4_found" in capsys.readouterr().out


def test_delete_then_put_then_snapshot_keeps_the_key(spark):
    s = Store(spark, scratch(spark, "store2"))
    s.append(log(spark, [(0, "put", "k", b"1", None, None), (1, "delete", "k", None, None, None), (2, "put", "k", b"2", None, None)]))
    s.compact(0)
    assert rows(s.state().select("key", "seq")) == [("k", 2)]


def test_wal_stops_at_a_torn_tail():
    data = formats.wal_record(0, "put", "key1", b"value1") + formats.wal_record(1, "delete", "key1")
    assert list(formats.read_wal(data)) == [(0, "put", "key1", b"value1"), (1, "delete", "key1", None)]
    for cut in (1, 5, 20):
        assert len(list(formats.read_wal(data[:-cut]))) == 1
    assert list(formats.read_wal(data[:10] + b"X" + data[11:])) == [] and list(formats.read_wal(b"")) == []


def test_segment_lists_bad_frames():
    good = formats.blob_frame("k", b"v" * 10)
    bad = bytearray(formats.blob_frame("q", b"w"))
    bad[-1] ^= 1
    assert [(k, o, n, v, ok) for k, o, n, v, ok in formats.read_segment(good + bytes(bad) + b"junk")] == [("k", 0, 10, b"v" * 10, True), ("q", len(good), 1, None, False)]


def test_index_round_trip(spark, tmp_path):
    entries = [("key1", 0, 100, 1024, "ab" * 32, None), ("key2", 1, 200, 2048, "cd" * 32, 9999999999999)]
    (tmp_path / "index").write_bytes(formats.index_snapshot(entries))
    formats.register(spark)
    assert rows(spark.read.format("kvindex").load(str(tmp_path))) == entries
    with pytest.raises(ValueError):
        list(formats.read_index(b"KVINDEX9" + struct.pack("<Q", 0)))


def test_blake3_known_digests_and_the_jvm(spark):
    # fixed values: published digests
    assert blake3.digest(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    jvm = spark._jvm.org.apache.commons.codec.digest.Blake3
    for n in (1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 5000, 31745, 102400):
        data = bytes(i % 251 for i in range(n))
        assert blake3.digest(data) == bytes(jvm.hash(bytearray(data))).hex(), n
    many = [bytes(i % 251 for i in range(n)) for n in (0, 5000, 1, 1024, 1025, 0, 64, 3 * 1024, 7 * 1024 + 1, 31745)]
    assert blake3.digests(many) == [bytes(jvm.hash(bytearray(x))).hex() for x in many] and blake3.digests([]) == []
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(blake3.blake3("t")).collect()] == [blake3.digest(b"abc"), None]


@pytest.mark.parametrize(
    "raw, want",
    [("a%zz%2F+%C3%A9", "a%zz/+é"), ("25%_off", "25%_off"), ("%2525", "%25"), ("%", "%"), ("", ""), ("x%ff", "x%ff"), ("%EF%BF%BD", "�"), ("plain", "plain"), ("%2f%2F", "//")],
)
def test_decoded_key(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "k string").select(N.decoded_key("k")).first()[0] == want


def test_key_codec_round_trip(spark):
    keys = ["my/path/to/file.txt", "a b%c?d#e&f", "Ü/é🙂", "tab\there", "", "*~-_."]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", S.encode_key("k").alias("e"))
    assert all(r["e"].isascii() for r in df.collect())
    assert [r[0] for r in df.select(S.decode_key("e")).collect()] == keys
    assert df.first()["e"] == "my%2Fpath%2Fto%2Ffile.txt"


def test_normalised_words(spark):
    df = spark.createDataFrame([(" PUT\t", "BLAKE3:AB"), ("1", "ab"), ("del", None), (None, "")], "op string, h string")
    assert [tuple(r) for r in df.select(N.log_op("op"), N.digest("h")).collect()] == [("put", "ab"), ("put", "ab"), ("delete", None), (None, "")]


def test_durations_and_sizes(spark):
    df = spark.createDataFrame([(x,) for x in ["5ms", " 2h ", "+3s", "1w", "", "-1s", "1.5s", "99999999999999999d", None]], "d string")
    assert [r[0] for r in df.select(S.parse_duration("d")).collect()] == [5, 7_200_000, 3000, None, None, None, None, None, None]
    sizes = spark.createDataFrame([(n,) for n in [0, 1023, 1024, 1152, 1024**5, None]], "n bigint")
    assert [r[0] for r in sizes.select(S.format_bytes("n")).collect()] == ["0.00 B", "1023.00 B", "1.00 KB", "1.12 KB", "1.00 PB", None]


def test_encryption(spark):
    key = crypto.derive_key("A" * 44, "data")
    df = spark.createDataFrame([(b"secret",), (b"",), (None,)], "v binary").select("v", crypto.encrypted(F.col("v"), key).alias("e"))
    got = df.select("v", crypto.is_encrypted(F.col("e")), crypto.decrypted(F.col("e"), key), crypto.decrypted(F.col("e"), crypto.derive_key("A" * 44, "wal")), "e").collect()
    assert got[0][1] and bytes(got[0][2]) == b"secret" and got[0][3] == got[0][4] and bytes(got[1][2]) == b"" and got[2][2] is None
    with pytest.raises(ValueError):
        crypto.derive_key("AAAA", "data")


def test_placement(spark):
    nodes = [f"node{i}" for i in range(1, 6)]
    keys = spark.range(200).selectExpr("concat('key', id) as key")
    before, after = placement.replicas(keys, nodes, 3), placement.replicas(keys, nodes[:-1], 3)
    assert before.groupBy("key").count().where("count <> 3").count() == 0 and rows(before) == rows(placement.replicas(keys, nodes, 3))
    kept = before.where("volume_id <> 'node5'").join(after, ["key", "volume_id"], "left_anti")
    assert kept.count() == 0  # losing a node moves only its own replicas
    assert [r["status"] for r in placement.placement_status(keys.limit(1), nodes[:2], 3).collect()] == ["insufficient_replicas"]
    assert placement.placement_status(keys.limit(1), [], 3).first()["status"] == "no_healthy_volumes"


def test_batch_reads_its_own_writes(spark):
    ops = spark.createDataFrame([(1, "get", "a", None), (2, "put", "a", "1"), (3, "get", "a", None), (4, "delete", "a", None), (5, "get", "a", None), (6, "put", "a", None), (7, "nope", "a", None), (8, "get", "b", None), (9, None, "b", None)], "ord bigint, op string, key string, value string")
    base = spark.createDataFrame([("b", "old")], "key string, value string")
    got = {r["ord"]: (r["ok"], r["value"], r["error"]) for r in batch.batch_results(ops, base).collect()}
    assert got == {1: (False, None, "Not found"), 2: (True, None, None), 3: (True, "1", None), 4: (True, None, None), 5: (False, None, "Not found"), 6: (False, None, "Missing value for put"), 7: (False, None, "Unknown op"), 8: (True, "old", None), 9: (False, None, "Unknown op")}
    cut = {r["ord"]: (r["ok"], r["value"], r["error"]) for r in batch.batch_results(ops, base, width=1).collect()}
    assert cut == got
    assert batch.txn_log(ops, 100).count() == 2 and batch.txn_log(ops, 100, atomic=True).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_clamped_sum_over_many_stretches(spark, seed):
    r = random.Random(seed)
    ops = [(r.choice("ab"), i, r.choice([None, *range(-9, 9)])) for i in range(500)]
    want = dict.fromkeys({g for g, _, _ in ops}, 0)
    for g, _, d in ops:
        want[g] = max(0, want[g] + (d or 0))
    r.shuffle(ops)
    assert rows(metering.clamped_sum(spark.createDataFrame(ops, "g string, o bigint, d bigint"), "g", "o", "d", width=16)) == sorted(want.items())


def test_limits_isolate_keys(spark):
    req = spark.createDataFrame([(i, k, i * 1000) for k in "ab" for i in range(11)], "event_id bigint, ip string, ts_us bigint").withColumn("event_id", F.monotonically_increasing_id())
    joined = metering.token_bucket(req, "ip", 10.0, 0.001).join(req, "event_id")
    assert rows(joined.where("not allowed").groupBy("ip").count()) == [("a", 1), ("b", 1)]
    assert metering.sliding_limit(req, "ip", 3, 1_000_000).where("allowed").count() == 6


def bucket_brute(requests, burst, rate):
    state, out = {}, {}
    for i, k, t in sorted(requests, key=lambda x: (x[2], x[0])):
        tokens, last = state.get(k, (burst, t))
        tokens = min(burst, tokens + (t - last) / 1e6 * rate)
        out[i] = tokens >= 1
        state[k] = (tokens - out[i], t)
    return out


def sliding_brute(requests, limit, window):
    taken, out = {}, {}
    for i, k, t in sorted(requests, key=lambda x: (x[2], x[0])):
        now = [x for x in taken.get(k, []) if x > t - window]
        out[i] = len(now) < limit
        taken[k] = [*now, t] if out[i] else now
    return out


@pytest.mark.parametrize("pieces", [1, 64])
@pytest.mark.parametrize("seed", range(3))
def test_limits_equal_brute_force(spark, monkeypatch, seed, pieces):
    """Also where a hot key's time is cut into pieces that its stretches reach over."""
    monkeypatch.setattr(metering, "PIECES", pieces)
    r = random.Random(seed)
    requests = [(i, r.choice("aaab"), r.randrange(40_000) * 1000 * r.choice([1, 1, 7])) for i in range(400)]
    df = spark.createDataFrame(r.sample(requests, 400), "event_id bigint, ip string, ts_us bigint")
    assert dict(rows(metering.token_bucket(df, "ip", 3.0, 1.0).select("event_id", "allowed"))) == bucket_brute(requests, 3.0, 1.0)
    assert dict(rows(metering.sliding_limit(df, "ip", 3, 2_000_000))) == sliding_brute(requests, 3, 2_000_000)


def test_limiters_that_are_off_and_odd_requests(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, None, 1), (4, "a", None)], "event_id bigint, ip string, ts_us bigint")
    assert metering.token_bucket(df, "ip", 1.0, 0.1, enabled=False).where("allowed").count() == 4 and metering.sliding_limit(df, "ip", 1, 10, enabled=False).where("allowed").count() == 4
    assert rows(metering.sliding_limit(df, "ip", 1, 10)) == [(1, True), (2, False)] and metering.sliding_limit(df, "ip", 0, 10).where("allowed").count() == 0
    assert rows(metering.token_bucket(df.limit(0), "ip", 1.0, 0.1)) == []


@pytest.mark.parametrize("seed", range(3))
def test_segments_equal_brute_force(spark, seed):
    r = random.Random(seed)
    blobs = [(r.choice([None, "a", "b"]), i, f"k{i}", r.choice([None, 0, 1, 50, 99, 300])) for i in range(200)]
    want, state = [], {}
    for w, _, k, n in blobs:
        segment, offset = state.get(w, (0, 0))
        segment, offset = (segment + 1, 0) if offset > 100 else (segment, offset)
        want.append((w, k, segment, offset))
        state[w] = (segment, offset + (n or 0))
    got = metering.segment_assign(spark.createDataFrame(r.sample(blobs, 200), "w string, o bigint, key string, n bigint"), "w", "o", "n", 100)
    assert rows(got) == sorted(want, key=repr)


def test_reads(spark):
    state = spark.createDataFrame([("a", b"x"), ("ab", b"\xff\xfe"), ("b", "é".encode())], "key string, value binary")
    assert rows(reads.range_keys(state, "a", "ab")) == [("a",), ("ab",)] and rows(reads.range_keys(state, "b", "a")) == []
    assert rows(reads.search_value(state, "")) == [("a",), ("b",)] and reads.prefix_scan(state, "").count() == 3
    lines = dict(tuple(r) for r in reads.export_ndjson(state, state).collect())
    assert lines["a"] == '{"key":"a","value":"x"}' and "�" in lines["ab"]
    assert rows(reads.blob_chunks(state, 1).groupBy("key").count()) == [("a", 1), ("ab", 2), ("b", 2)]
