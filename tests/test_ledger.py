import datetime as dt

import pytest
from conftest import DATA, rows

from foldstone.operators import incremental
from foldstone.operators.incremental import Ledger
from foldstone.plans.problems import p5_found
from foldstone.session import scratch

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def ledger(spark):
    return Ledger(spark, scratch(spark, "ledger"))


def test_leases_expire_and_stale_writers_are_refused(spark, ledger):
    ledger.add(["a", "b"], 0)
    ledger.add(["a"], 1)
    first = ledger.lease(10, 100, "one")[0]
    assert first.item == "a" and [x.item for x in ledger.lease(10, 100, "two", 5)] == ["b"]
    assert ledger.lease(50, 100, "three") == []  # both are leased
    assert rows(ledger.states(50)) == [("a", 1, "leased"), ("b", 1, "leased")]
    second = ledger.lease(111, 100, "four")[0]  # the first lease ran out
    assert (second.item, second.token) == ("a", 2)
    assert not ledger.commit(first, spark.range(1), 112)  # fenced
    assert ledger.commit(second, spark.range(3), 113)
    assert ledger.published("id bigint", 115).count() == 3
    assert rows(ledger.states(500)) == [("a", 2, "done"), ("b", 1, "pending")]


def test_repeated_commit_keeps_what_is_published(spark, ledger):
    ledger.add(["a"], 0)
    lease = ledger.lease(10, 100, "one")[0]
    assert ledger.commit(lease, spark.range(3), 20)
    assert not ledger.commit(lease, spark.range(9), 30)
    assert rows(ledger.published("id bigint", 40)) == [(i, "a", 1) for i in range(3)]
    assert ledger.lease(1000, 100, "two") == []


def test_a_writer_that_lost_its_lease_during_the_write(spark, ledger):
    ledger.add(["a"], 0)
    slow = ledger.lease(10, 100, "slow")[0]
    other = Ledger(spark, ledger.root)
    slow_rows = spark.range(7)
    write = slow_rows.write

    class Late:  # while the slow one writes, its lease runs out and another takes over and is done
        @property
        def write(self):
            quick = other.lease(200, 100, "quick")[0]
            assert other.commit(quick, spark.range(2), 210)
            return write

    assert not ledger.commit(slow, Late(), 220)
    assert ledger.published("id bigint", 230).count() == 2


def test_a_crash_during_the_write_is_absorbed_by_the_retry(spark, ledger):
    ledger.add(["a"], 0)
    lease = ledger.lease(10, 100, "one")[0]
    spark.range(5).write.parquet(lease.path)  # and no done: as if it crashed
    assert ledger.published("id bigint", 20).count() == 0
    assert ledger.commit(lease, spark.range(4), 30) and ledger.published("id bigint", 40).count() == 4


def test_a_torn_lease_blocks_nobody(spark, ledger):
    ledger.add(["a"], 0)
    tear = lambda name: ledger._fs.create(ledger._path(ledger._steps("a"), name), False).close()  # noqa: E731  created, and nothing written
    tear("000000001.leased")
    assert rows(ledger.states(10)) == [("a", 0, "pending")]
    lease = ledger.lease(10, 100, "two")[0]
    assert lease.token == 2
    tear("000000002.done")
    assert not ledger.commit(lease, spark.range(5), 20) and rows(ledger.states(20)) == [("a", 2, "leased")]
    again = ledger.lease(200, 100, "three")[0]
    assert again.token == 3 and ledger.commit(again, spark.range(1), 210) and ledger.published("id bigint", 220).count() == 1


def test_released_items_and_lost_races(spark, ledger):
    ledger.add(["a"], 0)
    lease = ledger.lease(10, 100, "one")[0]
    assert ledger.release(lease, 20) and not ledger.release(lease, 21)
    assert not ledger.commit(lease, spark.range(1), 22)
    assert not ledger._append("a", 1, "leased", 23, 99, "late")
    assert ledger.lease(30, 100, "two")[0].token == 2


def test_items_of_any_name(spark, ledger):
    names = ["a/b", "../up", "_hidden", ".dot", "100%", "x=y z+é"]
    ledger.add(names, 0)
    for lease in ledger.lease(10, 100, "one", 99):
        assert ledger.commit(lease, spark.range(1), 20)
    assert sorted(r["item"] for r in ledger.states(30).where("state = 'done'").collect()) == sorted(names)
    assert ledger.published("id bigint", 40).count() == len(names)


def test_runs_replayed(spark, ledger):
    runs = [("a", T0, T0, " Succeeded"), ("b", T0, T0, "failed"), ("c", T0, None, "ABORTED"), ("d", T0, None, None), ("e", None, None, "succeeded")]
    ledger.record(incremental.run_transitions(spark.createDataFrame(runs, "item string, started_at timestamp_ntz, finished_at timestamp_ntz, status string")))
    assert rows(ledger.states(1706745600000)) == [("a", 1, "done"), ("b", 1, "pending"), ("c", 1, "pending"), ("d", 1, "pending"), ("e", 1, "done")]


def test_p5_found_asks_the_ledger(spark, monkeypatch):
    want = p5_found(spark, DATA).count()
    monkeypatch.setattr(Ledger, "states", lambda self, now: spark.createDataFrame([], "item string, token bigint, state string"))
    assert p5_found(spark, DATA).count() > want  # nothing is done
