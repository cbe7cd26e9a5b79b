import random

import numpy as np
import pytest
from conftest import rows

from foldstone.llm.mph import SealedSet
from foldstone.llm.seen import KeyMemory, seen_before
from foldstone.session import scratch

S = "src string, scope string, key string, id bigint"


def halves(n, seed=0):
    r = np.random.default_rng(seed)
    return r.integers(0, 2**64, n, dtype=np.uint64), r.integers(0, 2**64, n, dtype=np.uint64)


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_slots_are_minimal_and_perfect(n):
    place, check = halves(n)
    sealed = SealedSet(place, check)
    assert sorted(sealed.slot(place)) == list(range(n)) and sealed.contains(place, check).all()


@pytest.mark.parametrize("bits, n", [(16, 0), (16, 3000), (8, 500), (24, 500)])
def test_a_sealed_set_is_read_back_as_it_was(bits, n):
    place, check = halves(n)
    sealed = SealedSet(place, check, bits)
    again = SealedSet.from_bytes(sealed.to_bytes())
    probes = (np.concatenate([x, y]) for x, y in zip((place, check), halves(20_000, 5), strict=True))
    p, c = probes
    assert (again.contains(p, c) == sealed.contains(p, c)).all() and (again.slot(place) == sealed.slot(place)).all()


def test_wrong_answers_are_as_rare_as_the_fingerprint_is_long():
    sealed, (place, check) = SealedSet(*halves(20_000), bits=8), halves(100_000, 1)
    assert 0 < sealed.contains(place, check).mean() < 2**-8
    assert SealedSet(*halves(20_000), bits=16).nbytes < 5 * 20_000


def brute(records):
    known, out = set(), []
    for src, scope, key, i in sorted((r for r in records if None not in r), key=lambda r: r[3]):
        if (src, scope, key) in known:
            out.append((src, i))
        known.add((src, scope, key))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [2, 16])
def test_rows_are_exact_whatever_the_fingerprint(spark, bits):
    r = random.Random(bits)
    records = [(r.choice("ab"), r.choice("xy"), r.choice(["hot", *map(str, range(900))]), i) for i in range(3000)]
    seen = seen_before(spark.createDataFrame(r.sample(records, 3000), S), batches=5, bits=bits)
    assert rows(seen.rows.select("src", "id")) == brute(records)
    told = seen.answers.groupBy().sum("probes", "yes", "wrong").first()
    assert (told["sum(wrong)"] > 0) == (bits == 2) and told["sum(yes)"] >= told["sum(wrong)"]


def test_nulls_repeats_long_keys_and_clashing_columns(spark):
    records = [("a", "x", None, 1), ("a", None, "k", 2), ("a", "x", "k" * 500_000, 3), ("a", "x", "k" * 500_000, 9), ("a", "x", "", 4), ("a", "x", "", 5), ("a", "x", "q", None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in records], S + ", batch int, match string")
    assert rows(seen_before(df).rows.select("src", "id")) == [("a", 5), ("a", 9)]


def test_empty(spark):
    seen = seen_before(spark.createDataFrame([], S))
    assert seen.rows.count() == 0 and seen.answers.count() == 0


def calls(spark, memory, records, edges):
    """Rows that separate calls, each over a range of ids, say were seen."""
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        out += rows(memory.take(spark.createDataFrame([r for r in records if lo <= r[3] < hi], S), batches=2).rows)
    return sorted(out, key=repr)


def made(seed, n=2000):
    r = random.Random(seed)
    return [(r.choice("ab"), r.choice("xy"), r.choice(["hot", *map(str, range(700))]), i) for i in range(n)]


@pytest.mark.parametrize("bits", [2, 16])
def test_later_calls_are_exact_too(spark, bits):
    records = made(bits)
    memory = KeyMemory(spark, scratch(spark, "memory"), 8, bits)
    assert calls(spark, memory, records, [0, 600, 1400, 2000]) == brute(records)


def test_a_new_call_reads_no_earlier_key(spark):
    """With the keys of earlier calls gone the fingerprints still answer."""
    records = made(7)
    memory = KeyMemory(spark, scratch(spark, "memory"), 8)
    calls(spark, memory, records, [0, 600, 1400])
    fs = memory._names and spark._jvm.org.apache.hadoop.fs.Path(memory.root).getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{memory.root}/keys"), True)
    late = KeyMemory(spark, memory.root, 99, keep=False)  # the number of parts is that of the folder
    assert late.parts == 8
    got = rows(late.take(spark.createDataFrame(records[1400:], S)).rows)
    want = [x for x in brute(records) if x[1] >= 1400]
    assert set(want) <= set(got) and len(got) - len(want) <= 2


def test_a_call_that_failed_is_taken_again(spark):
    records = made(9, 900)
    memory = KeyMemory(spark, scratch(spark, "memory"), 4)
    df = spark.createDataFrame(records, S)
    fs = spark._jvm.org.apache.hadoop.fs.Path(memory.root).getFileSystem(spark._jsc.hadoopConfiguration())
    memory.take(df.where("id < 500"))
    assert fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{memory.root}/done/call-0-1"), True)  # as if it broke off before its name was there
    assert rows(memory.take(df.where("id < 500")).rows.union(memory.take(df.where("id >= 500")).rows)) == brute(records)


def test_an_empty_call_between_others(spark):
    memory = KeyMemory(spark, scratch(spark, "memory"), 4)
    nothing, one, two = (spark.createDataFrame(x, S) for x in ([], [("a", "x", "k", 1)], [("a", "x", "k", 2)]))
    assert [rows(memory.take(x).rows) for x in (nothing, one, nothing, two)] == [[], [], [], [("a", 2)]]


def test_a_new_source_in_a_later_call(spark):
    memory = KeyMemory(spark, scratch(spark, "memory"), 4)
    assert rows(memory.take(spark.createDataFrame([("b", "x", "k", 1)], S)).rows) == []
    assert rows(memory.take(spark.createDataFrame([("a", "x", "k", 1), ("b", "x", "k", 2)], S)).rows) == [("b", 2)]
    with pytest.raises(ValueError):
        memory.take(spark.createDataFrame([], S), batches=65)
