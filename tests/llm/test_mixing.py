import random
import time
from itertools import product

import pytest
from conftest import rows

from foldstone.llm import mixing
from foldstone.llm.mixing import count_tokens, mix, plan_mix

D, T = "doc_id bigint, text string, source string", "source string, target_share double, max_repeats bigint"


def test_plan_is_the_greatest_and_the_cheapest():
    held = {("a",): 40, ("b",): 20, ("a", "b"): 30}
    shares, repeats = {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}
    plan = plan_mix(held, shares, repeats)
    best = max(t for t in range(0, 400) if any(x + 40 >= t // 2 and 40 + 2 * 30 >= t // 2 for x in range(0, 31)))
    assert plan.quota == {"a": best // 2, "b": best // 2}
    assert all(n <= repeats[s] * held[p] for (p, s), n in plan.route.items())
    cost = lambda n, size: sum(max(0, n - k * size) for k in range(1, 9))
    # the cheapest split of what the shared texts give
    cheapest = min(cost(a1, 40) + cost(b1, 20) + cost(best // 2 - a1 + best // 2 - b1, 30) for a1, b1 in product(range(41), range(41)) if 0 <= best // 2 - a1 <= 30 and 0 <= best // 2 - b1 <= 60)
    assert plan.cost == cheapest


def cheapest(held, repeats, quota):
    """Least cost by brute force: every way to fill the quotas, token by token."""
    patterns, sources = list(held), list(quota)
    arcs = [(i, j) for j, s in enumerate(sources) for i, p in enumerate(patterns) if s in p]
    ways = {tuple([0] * len(patterns))}
    for j, s in enumerate(sources):
        mine = [i for i, jj in arcs if jj == j]
        splits = [x for x in product(*(range(min(quota[s], repeats[s] * held[patterns[i]]) + 1) for i in mine)) if sum(x) == quota[s]]
        ways = {tuple(w[i] + dict(zip(mine, x, strict=True)).get(i, 0) for i in range(len(patterns))) for w in ways for x in splits}
    cost = lambda w: sum(max(0, w[i] - k * held[p]) for i, p in enumerate(patterns) for k in range(1, 99))
    return min(map(cost, ways))


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_the_cheapest(seed):
    r = random.Random(seed)
    held = {p: r.randrange(1, 5) for p in r.sample([("a",), ("b",), ("c",), ("a", "b"), ("b", "c"), ("a", "b", "c")], 4)}
    repeats = {s: r.randrange(1, 4) for s in "abc"}
    shares = {s: r.randrange(1, 4) / 6 for s in "abc"}
    plan = plan_mix(held, shares, repeats)
    got = {s: sum(n for (_, x), n in plan.route.items() if x == s) for s in plan.quota}
    assert got == plan.quota and all(0 < n <= repeats[s] * held[p] for (p, s), n in plan.route.items())
    assert plan.cost == cheapest(held, repeats, plan.quota)
    # no greater total fits: one more, shared out, is beyond what some source may use
    weight = sum(shares[s] for s in plan.quota)
    most = {s: repeats[s] * sum(n for p, n in held.items() if s in p) for s in plan.quota}
    assert any(int((plan.total + 1) * shares[s] / weight) >= most[s] for s in plan.quota)


def test_many_patterns_in_seconds():
    r = random.Random(5)
    sources = [f"s{i:02d}" for i in range(50)]
    held = {}
    while len(held) < 5000:
        held[tuple(sorted(r.sample(sources, r.randrange(1, 9))))] = r.randrange(1, 10**9)
    shares = {s: r.random() for s in sources}
    began = time.process_time()
    plan = plan_mix(held, {s: x / sum(shares.values()) for s, x in shares.items()}, {s: r.randrange(1, 9) for s in sources})
    assert time.process_time() - began < 30
    assert {s: sum(n for (_, x), n in plan.route.items() if x == s) for s in plan.quota} == plan.quota


def test_a_source_without_texts_gets_nothing_and_the_rest_share_its_weight():
    plan = plan_mix({("a",): 10, ("b",): 10}, {"a": 0.3, "b": 0.3, "c": 0.4}, {"a": 1, "b": 1, "c": 9})
    assert plan.total == 20 and plan.quota == {"a": 10, "b": 10}
    assert plan_mix({}, {"a": 1.0}, {"a": 1}).total == 0


def test_shares_caps_and_copies(spark):
    docs = [(i, f"text number {i} of source a, quite plain", " A " if i % 3 else "a") for i in range(400)]
    docs += [(1000 + i, f"short {i}", "b") for i in range(60)]
    docs += [(2000 + i, f"text number {i} of source a, quite plain", "a") for i in range(50)]  # copies
    docs += [(3000, None, "a"), (3001, "", "b"), (3002, "no target", "z"), (3003, "no source", None)]
    targets = spark.createDataFrame([("a", 0.8, 1), ("B", 0.15, 3), ("none", 0.05, 2)], T)
    m = mix(spark.createDataFrame(docs, D), targets)
    share = {r["source"]: r for r in m.shares.collect()}
    assert share["none"]["actual_share"] == 0 and abs(share["a"]["actual_share"] - 0.8 / 0.95) < 0.02 and share["b"]["most_uses"] <= 3 and share["a"]["most_uses"] == 1
    chosen = m.chosen.collect()
    assert len({(r["source"], r["doc_id"]) for r in chosen}) == len(chosen)
    assert not {r["doc_id"] for r in chosen} & {*range(2000, 2050), 3000, 3001, 3002, 3003}
    assert rows(m.chosen) == rows(mix(spark.createDataFrame(docs, D), targets).chosen)


def test_texts_of_two_sources_are_routed(spark):
    docs = [(i, f"shared text {i}", s) for i in range(40) for s in "ab"] + [(100 + i, f"own text {i}", "a") for i in range(40)]
    docs = [(n, t, s) for n, (_, t, s) in enumerate(docs)]
    m = mix(spark.createDataFrame(docs, D), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], T))
    by = {s: {docs[r["doc_id"]][1] for r in m.chosen.where(f"source = '{s}'").collect()} for s in "ab"}
    assert len(by["b"]) == 40 and not any(t.startswith("shared") for t in by["a"])
    assert all(docs[r["doc_id"]][2] == r["source"] for r in m.chosen.collect())


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text", "a", "x", 1)], D + ", pattern string, bucket int")
    assert mix(docs.limit(0), spark.createDataFrame([("a", 1.0, 1)], T)).chosen.count() == 0
    assert mix(docs, spark.createDataFrame([], T)).chosen.count() == 0
    assert rows(mix(docs, spark.createDataFrame([("a", 1.0, 1)], T)).chosen.select("doc_id", "uses")) == [(1, 1)]


@pytest.mark.parametrize("text, n", [(None, 0), ("", 0), ("hello world", 2), ("<|endoftext|>", 7)])
def test_tokens(spark, text, n):
    assert count_tokens(spark.createDataFrame([(text,)], "t string"), "t", "n").first()["n"] == n


def test_very_long_texts(spark):
    assert count_tokens(spark.createDataFrame([("ab " * 300_000,), ("x" * 200_000,)], "t string"), "t", "n").agg({"n": "min"}).first()[0] > 1000


@pytest.mark.parametrize("limit", ["MOST_TARGETS", "MOST_PATTERNS"])
def test_too_many_targets_or_patterns_are_an_error(spark, monkeypatch, limit):
    docs = spark.createDataFrame([(1, "one text", "a"), (2, "two texts", "b")], D)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], T)
    monkeypatch.setattr(mixing, limit, 2)
    assert mix(docs, targets).chosen.count() == 2
    monkeypatch.setattr(mixing, limit, 1)
    with pytest.raises(ValueError):
        mix(docs, targets)


def test_the_tokenizer_is_a_setting(spark):
    spark.conf.set("foldstone.tokenizer", "/none/such")
    try:
        with pytest.raises(Exception, match="such"):
            mix(spark.createDataFrame([(1, "one text", "a")], D), spark.createDataFrame([("a", 1.0, 1)], T))
    finally:
        spark.conf.unset("foldstone.tokenizer")
