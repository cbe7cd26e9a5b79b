"""Mixing sources to target weights: a min-cost flow over membership patterns, then a seeded selection."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldstone.functions.normalise import word
from foldstone.session import broadcast_if_small, materialise, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct sets of sources that hold one text; at most 2**targets exist, far fewer occur.
MOST_PATTERNS = 100_000
#: Targets of one mix.
MOST_TARGETS = 1_000
#: Documents that one prefix-sum bucket holds, about.
BUCKET = 5_000


def count_tokens(docs: DataFrame, text: str, out: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Add ``out``: the tokens of ``text`` under a public byte-level vocabulary; NULL counts 0. Whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import public_tokenizers
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("counting", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t)) if (t := x.as_py()) else 0 for x in batch.column(text)]
            yield batch.append_column(out, pa.array(sizes, pa.int64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


class Routing:
    """Min-cost flow from texts to sources: pattern -> source arcs with room, quotas of sources, and a convex cost of using a pattern.

    The n-th use of a pattern's texts costs n - 1. Costs stand on the way into a pattern alone, and a shortest augmenting path enters
    only one, so successive shortest paths fall into rounds of plain maximum flow: in round n each pattern lends its texts n
    times, and what earlier rounds sent is rerouted, never taken back. The search runs over sources, of which there are few: a step from one
    source to another moves what any of their shared patterns can move, in one vector operation over the arcs.
    """

    def __init__(self, held: np.ndarray, arc_pattern: np.ndarray, arc_source: np.ndarray, room: np.ndarray, quota: np.ndarray):
        self.held, self.p, self.s, self.room = held, arc_pattern, arc_source, room
        self.sent = np.zeros(len(room), dtype=np.int64)
        self.open = quota.astype(np.int64).copy()
        self.spare = np.zeros(len(held), dtype=np.int64)
        self.of = [np.flatnonzero(arc_source == i) for i in range(len(quota))]
        served = np.bincount(arc_pattern, minlength=len(held))
        self.of = [arcs[np.argsort(served[arc_pattern[arcs]], kind="stable")] for arcs in self.of]  # texts that few can use go first

    def _fill(self, rooms: np.ndarray, amount: int) -> np.ndarray:
        """``amount`` laid into ``rooms`` in order."""
        before = np.cumsum(rooms) - rooms
        return np.clip(amount - before, 0, rooms)

    def _enter(self, s: int, amount: int) -> int:
        """Send from spare texts straight to ``s``."""
        arcs = self.of[s]
        moved = self._fill(np.minimum(self.spare[self.p[arcs]], self.room[arcs] - self.sent[arcs]), amount)
        self.sent[arcs] += moved
        self.spare[self.p[arcs]] -= moved
        return int(moved.sum())

    def _lent(self, s: int) -> np.ndarray:
        """What ``s`` takes of each pattern."""
        out = np.zeros(len(self.held), dtype=np.int64)
        out[self.p[self.of[s]]] = self.sent[self.of[s]]
        return out

    def _shift(self, a: int, b: int, amount: int) -> None:
        """Hand ``amount`` from ``a`` to ``b`` within patterns that both may use."""
        arcs = self.of[b]
        moved = self._fill(np.minimum(self._lent(a)[self.p[arcs]], self.room[arcs] - self.sent[arcs]), amount)
        self.sent[arcs] += moved
        back = np.zeros(len(self.held), dtype=np.int64)
        back[self.p[arcs]] = moved
        self.sent[self.of[a]] -= back[self.p[self.of[a]]]

    def _path(self) -> tuple[list[int], int] | None:
        """Sources from one that spare texts reach to one whose quota is open, and how much can go that way."""
        free = np.minimum(self.spare[self.p], self.room - self.sent)
        into = np.bincount(self.s, weights=free, minlength=len(self.open)).astype(np.int64)
        amount = {int(i): int(into[i]) for i in np.flatnonzero(into)}
        via: dict[int, int | None] = dict.fromkeys(amount)
        queue = deque(amount)
        while queue:
            a = queue.popleft()
            if self.open[a] > 0:
                path, at = [a], a
                while via[at] is not None:
                    at = via[at]
                    path.append(at)
                return path[::-1], min(amount[a], int(self.open[a]))
            lent = self._lent(a)
            step = np.bincount(self.s, weights=np.minimum(lent[self.p], self.room - self.sent), minlength=len(self.open)).astype(np.int64)
            for b in map(int, np.flatnonzero(step)):
                if b not in via:
                    via[b], amount[b] = a, min(amount[a], int(step[b]))
                    queue.append(b)
        return None

    def run(self) -> bool:
        """Route until every quota is full; False if the arcs have no room for them."""
        for _ in range(int((self.room.sum() // max(1, self.held.min(initial=1))) + 1) if len(self.held) else 0):
            if not self.open.any():
                break
            self.spare = self.spare + self.held
            for s in np.flatnonzero(self.open):
                self.open[s] -= self._enter(int(s), int(self.open[s]))
            while self.open.any() and (found := self._path()):
                path, amount = found
                for a, b in reversed(list(zip(path, path[1:], strict=False))):
                    self._shift(a, b, amount)
                self._enter(path[0], amount)
                self.open[path[-1]] -= amount
            full = np.bincount(self.s, weights=self.room - self.sent, minlength=len(self.open)) == 0
            if full[self.open > 0].any():
                break
        return not self.open.any()

    def cost(self) -> int:
        used = np.bincount(self.p, weights=self.sent, minlength=len(self.held)).astype(np.int64)
        rounds, rest = np.divmod(used, np.maximum(1, self.held))
        return int((self.held * (rounds * (rounds - 1) // 2) + rest * rounds).sum())


@dataclass(frozen=True)
class Plan:
    """``total`` tokens; ``quota`` by source; ``route`` by (pattern, source); ``cost`` in repeated tokens, weighted."""

    total: int
    quota: dict[str, int]
    route: dict[tuple[tuple[str, ...], str], int]
    cost: int


def plan_mix(held: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> Plan:
    """Quotas and routes for the greatest feasible total, or for ``total`` if that is less.

    ``held``: distinct tokens by the set of sources that hold them. A source without any tokens can give
    none; the others' shares are scaled up to sum to 1. The n-th use of a text costs n - 1, so repetition is
    spread before it is deepened; no source uses a text more than its ``repeats``.
    """
    able = sorted({s for p in held for s in p if held[p] > 0 and repeats.get(s, 0) > 0 and shares.get(s, 0) > 0})
    weight = sum(shares[s] for s in able)
    number = {s: i for i, s in enumerate(able)}
    patterns = [p for p in sorted(held) if held[p] > 0 and any(s in number for s in p)]
    arcs = [(i, number[s], repeats[s] * held[p]) for i, p in enumerate(patterns) for s in p if s in number]
    p, s, room = (np.array([a[k] for a in arcs], dtype=np.int64) for k in range(3))
    most = np.zeros(len(able), dtype=np.int64)
    np.add.at(most, s, room)
    # a pattern lends its texts to each source as often as that may use them, whoever else does: only the sources' own rooms bound the total
    best = min((int(most[number[x]] * weight / shares[x]) for x in able), default=0)
    best = best if total is None else min(best, total)
    quota = {x: min(int(best * shares[x] / weight), int(most[number[x]])) for x in able}
    flow = Routing(np.array([held[x] for x in patterns], dtype=np.int64), p, s, room, np.array([quota[x] for x in able], dtype=np.int64))
    if not flow.run():
        raise AssertionError("quotas within every source's room were not routed")
    route = {(patterns[p[e]], able[s[e]]): int(flow.sent[e]) for e in np.flatnonzero(flow.sent)}
    return Plan(best, quota, route, flow.cost())


@dataclass(frozen=True)
class Mix:
    """``chosen``: source, doc_id, tokens, uses; ``shares``: a row a target; ``plan``: what was asked of each pattern."""

    chosen: DataFrame
    shares: DataFrame
    plan: Plan


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, total: int | None = None, tokenizer: str | None = None) -> Mix:
    """Choose documents so that each source holds its share of the tokens.

    ``docs``: ``doc_id, text, source``; ``targets``: ``source, target_share, max_repeats``. Sources compare
    trimmed and without case. Texts that are letter by letter equal are one text, held by all sources in
    which it stands: they are the overlap that the flow routes, and copies cannot get round ``max_repeats``.
    Documents without text or tokens, and those of sources without a target, are never chosen. A target
    without documents reaches a share of 0, the rest share its weight. Empty tables give no choice and zero shares.

    Only the tokens per membership pattern reach the driver. Which texts a source takes is decided by a
    seeded order: a text's place is its prefix sum of tokens in that order, computed in buckets of bounded
    size, and a source takes the texts that begin in its stretch, as often as the stretch wraps round.
    A source so misses its quota by at most two texts for each pattern.

    ``tokenizer`` is the vocabulary's path on every executor, by default that of the session's ``foldstone.tokenizer``, else TOKENIZER.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or spark.conf.get("foldstone.tokenizer", TOKENIZER)
    wanted = targets.select(word("source").alias("source"), "target_share", F.col("max_repeats").cast("bigint").alias("max_repeats")).where("source is not null")
    goals = {r["source"]: r for r in wanted.limit(MOST_TARGETS + 1).collect()}
    if len(goals) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    aimed = docs.select("doc_id", "text", word("source").alias("source")).where(F.col("source").isin(*goals) if goals else F.lit(False))
    sized = count_tokens(spread(aimed), "text", "tokens", tokenizer)
    held = sized.where("tokens > 0").groupBy(F.unhex(F.sha2("text", 256)).alias("same"), "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    units = held.groupBy("same").agg(F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("copies"), F.max("tokens").alias("tokens"))
    units = units.select(F.concat_ws("\t", F.transform("copies", lambda c: c["source"])).alias("pattern"), "copies", "tokens", F.xxhash64("same", F.lit(seed)).alias("at"), F.hex("same").alias("same"))
    units = materialise(units, "units")

    summed = units.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(summed) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources hold texts")
    sizes = {tuple(r["pattern"].split("\t")): r["tokens"] for r in summed}
    plan = plan_mix(sizes, {s: float(r["target_share"] or 0) for s, r in goals.items()}, {s: int(r["max_repeats"] or 0) for s, r in goals.items()}, total)

    stretches, begun = [], dict.fromkeys(sizes, 0)
    for (p, s), n in sorted(plan.route.items()):
        stretches.append(("\t".join(p), s, begun[p], n, sizes[p]))
        begun[p] += n
    routes = spark.createDataFrame(stretches, "pattern string, source string, begin bigint, length bigint, round bigint")

    buckets = max(16, sum(r["n"] for r in summed) // BUCKET)
    placed = units.withColumn("bucket", F.pmod(F.shiftright("at", 20), F.lit(buckets)))
    sums = placed.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("pattern", "bucket", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.sum("tokens").over(Window.partitionBy("pattern", "bucket").orderBy("at", "same").rowsBetween(Window.unboundedPreceding, -1))
    lined = placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, ["pattern", "bucket"]).withColumn("pos", F.col("start") + F.col("inside"))
    turns = lambda edge: F.floor((edge - 1 - F.col("pos")) / F.col("round"))
    uses = (turns(F.col("begin") + F.col("length")) - turns(F.col("begin"))).cast("bigint")
    taken = lined.join(broadcast_if_small(routes, "routes"), "pattern").withColumn("uses", uses).where("uses > 0")
    copy = F.filter("copies", lambda c: c["source"] == F.col("source"))[0]
    chosen = materialise(taken.select("source", copy["doc_id"].alias("doc_id"), "tokens", "uses"), "chosen")

    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("actual_tokens"), F.max("uses").alias("most_uses"), F.count("*").alias("documents"))
    quota = spark.createDataFrame(list(plan.quota.items()) or [("", 0)], "source string, quota_tokens bigint")
    whole = F.sum(F.coalesce("actual_tokens", F.lit(0))).over(Window.partitionBy())  # over the targets alone
    shares = wanted.dropDuplicates(["source"]).join(quota, "source", "left").join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("quota_tokens", F.lit(0)).alias("quota_tokens"), F.coalesce("actual_tokens", F.lit(0)).alias("actual_tokens"),
        F.when(whole > 0, F.coalesce("actual_tokens", F.lit(0)) / whole).otherwise(0.0).alias("actual_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("documents", F.lit(0)).alias("documents"),
    )
    return Mix(chosen, shares, plan)
