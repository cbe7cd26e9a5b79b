"""Usage, metrics and ordered folds that hold no group in memory."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Resetting gaps that one piece of a key's time may hold.
PIECES = 64

# fixed values: the upper bounds of the latency buckets in milliseconds
BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0]


def tenant_usage(ops: DataFrame) -> DataFrame:
    """``tenant, bytes, objects`` as plain sums."""
    return ops.groupBy("tenant").agg(F.sum("delta_bytes").alias("bytes"), F.sum("delta_objects").alias("objects"))


def clamped_sum(ops: DataFrame, group: str, order: str, delta: str, width: int = 65_536) -> DataFrame:
    """``group``, ``total``: the running sum in ``order`` that never goes below 0.

    Such a sum ends at S - min(0, least prefix sum). Sum and least prefix compose, so the orders are cut into
    stretches of ``width``, each reduced by itself, and only the stretches' two numbers are put in line: a
    group that holds a third of all rows is spread over tasks. ``order`` is unique within a group. NULL deltas count 0.
    """
    cut = F.floor(F.col(order) / F.lit(width))
    placed = ops.select(F.col(group).alias("g"), cut.alias("cut"), F.col(order).alias("o"), F.coalesce(delta, F.lit(0)).alias("d"))
    within = Window.partitionBy("g", "cut").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    runs = placed.withColumn("p", F.sum("d").over(within)).groupBy("g", "cut").agg(F.sum("d").alias("s"), F.min("p").alias("low"))
    line = Window.partitionBy("g").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    whole = runs.withColumn("before", F.coalesce(F.sum("s").over(line), F.lit(0)))
    ends = whole.groupBy("g").agg(F.sum("s").alias("s"), F.min(F.col("before") + F.col("low")).alias("low"))
    return ends.select(F.col("g").alias(group), (F.col("s") - F.least(F.lit(0), "low")).cast("bigint").alias("total"))


def tenant_usage_clamped(ops: DataFrame) -> DataFrame:
    """``tenant, bytes, objects``, each clamped at 0 after every operation."""
    sums = [clamped_sum(ops, "tenant", "seq", f"delta_{x}").withColumnRenamed("total", x) for x in ("bytes", "objects")]
    return sums[0].join(sums[1], "tenant")


def _stretches(requests: DataFrame, reset: int) -> DataFrame:
    """``event_id, k, t`` and ``stretch``, the time at which the stretch began: stretches lie between gaps of ``reset`` or more, after which no state remains.

    Times are cut into pieces. Within a piece a window finds where stretches begin; of each piece its first and last time and its last beginning are put in
    line, which says what its first request goes on with. So a hot key is spread over its pieces, and rows move once.
    """
    order = Window.partitionBy("k", "cut").orderBy("t", "event_id")
    cut = requests.withColumn("cut", F.floor(F.col("t") / F.lit(PIECES * reset)))
    begun = cut.withColumn("begin", F.when(F.col("t") - F.lag("t").over(order) >= F.lit(reset), F.col("t")))
    near = begun.withColumn("near", F.last("begin", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    line = Window.partitionBy("k").orderBy("cut")
    pieces = near.groupBy("k", "cut").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max("begin").alias("inner"))
    before = F.lag("last").over(line)
    opened = pieces.withColumn("own", F.when(before.isNull() | (F.col("first") - before >= F.lit(reset)), F.col("first")))
    earlier = F.last(F.coalesce("inner", "own"), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    opened = opened.select("k", "cut", F.coalesce("own", earlier).alias("open"))
    return near.join(opened, ["k", "cut"]).select("event_id", "k", "t", F.coalesce("near", "open").alias("stretch"))


def _edges(*columns: np.ndarray) -> list[tuple[int, int]]:
    """The runs of equal neighbours."""
    n = len(columns[0])
    change = np.zeros(max(0, n - 1), dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    at = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return [(a, b) for a, b in zip(at, at[1:], strict=False) if a < b]


def _in_order(requests: DataFrame, key: str, at: str, reset: int, fresh, fold, names: list[str], schema: str) -> DataFrame:
    """Run ``fold(state, times)`` over each stretch in time order, stream-wise: it gives the columns and changes ``state``, which ``fresh()`` makes.

    Requests without key or time are of no stretch and left out.
    """
    width = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = requests.select("event_id", F.col(key).alias("k"), F.col(at).alias("t")).where("k is not null and t is not null")
    ordered = _stretches(placed, reset).withColumn("k", F.xxhash64("k")).repartition(width, "k", "stretch").sortWithinPartitions("k", "stretch", "t", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, s, t = (batch.column(c).to_numpy() for c in ("k", "stretch", "t"))
            parts = []
            for a, b in _edges(k, s):
                if (k[a], s[a]) != now:
                    now, state = (k[a], s[a]), fresh()
                parts.append(fold(state, t[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), *(pa.array(np.concatenate(c)) for c in zip(*parts, strict=True))], ["event_id", *names])

    return ordered.mapInArrow(run, schema)


def token_bucket(requests: DataFrame, key: str, burst: float, rate: float, enabled: bool = True) -> DataFrame:
    """``event_id, allowed, tokens, retry_after_s`` for a bucket of ``burst`` tokens a key, refilled at ``rate`` a second.

    A bucket starts full; a request takes a token or is refused and takes none. ``requests``: ``event_id`` (unique,
    breaks ties), ``ts_us``, ``key``. After a gap that refills the whole bucket nothing of the past matters:
    keys are cut there, and a stretch is folded as a stream with two numbers of state. A limiter that is not
    ``enabled`` allows everything and keeps its bucket full.
    """
    if not enabled:
        return requests.select("event_id", F.lit(True).alias("allowed"), F.lit(float(burst)).alias("tokens"), F.lit(0.0).alias("retry_after_s"))

    def fold(state: dict, times: np.ndarray) -> tuple[np.ndarray, ...]:
        tokens, last, left, passed = state["tokens"], state["last"], [], []
        for t in times.tolist():
            tokens = tokens if last is None else min(burst, tokens + (t - last) / 1e6 * rate)
            last = t
            passed.append(tokens >= 1.0)
            tokens = tokens - 1.0 if passed[-1] else tokens
            left.append(tokens)
        state["tokens"], state["last"] = tokens, last
        allowed, kept = np.array(passed), np.array(left)
        return allowed, kept, np.where(allowed, 0.0, (1.0 - kept) / rate)

    return _in_order(requests, key, "ts_us", int(burst / rate * 1e6) + 1, lambda: {"tokens": burst, "last": None}, fold, ["allowed", "tokens", "retry_after_s"], "event_id bigint, allowed boolean, tokens double, retry_after_s double")


def sliding_limit(requests: DataFrame, key: str, limit: int, window_us: int, enabled: bool = True) -> DataFrame:
    """``event_id, allowed``: at most ``limit`` allowed requests of a key in any ``window_us``; refused ones do not count.

    State is the last ``limit`` allowed times; a gap of the whole window clears it, and keys are cut there. The next request that may
    pass is found by bisection, so refused ones cost nothing. A limiter that is not ``enabled`` allows everything, one with a ``limit`` of 0 nothing.
    """
    if not enabled or limit <= 0:
        return requests.select("event_id", F.lit(not enabled).alias("allowed"))

    def fold(taken: deque, times: np.ndarray) -> tuple[np.ndarray]:
        allowed, at, listed = np.zeros(len(times), bool), 0, times.tolist()
        while True:
            if len(taken) == limit:
                at = bisect_left(listed, taken[0] + window_us, at)
            if at >= len(listed):
                return (allowed,)
            allowed[at] = True
            taken.append(listed[at])
            at += 1

    return _in_order(requests, key, "ts_us", window_us, lambda: deque(maxlen=limit), fold, ["allowed"], "event_id bigint, allowed boolean")


def bucket_gc(requests: DataFrame, key: str, now_us: int, window_us: int) -> DataFrame:
    """``key, last_us`` of keys seen within the window before ``now_us``."""
    return requests.where(F.col("ts_us") <= F.lit(now_us)).groupBy(key).agg(F.max("ts_us").alias("last_us")).where(F.lit(now_us) - F.col("last_us") < F.lit(window_us))


def segment_assign(blobs: DataFrame, writer: str, order: str, size: str, limit: int) -> DataFrame:
    """``key, segment, offset``: where each of a writer's blobs lands in its own sequence of segments.

    A segment is closed when its offset is already beyond ``limit`` before a write, so its last blob may
    reach over. Where a blob lands depends on all before it: each writer's blobs are read once in order, as a
    stream with two numbers of state; writers are independent.
    """
    width = int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = blobs.select(F.col(writer).alias("w"), F.col(order).alias("o"), "key", F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("bigint").alias("n")).repartition(width, "w").sortWithinPartitions("w", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, segment, offset = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("w").dictionary_encode()
            ids, sizes = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
            seg, off = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for a, b in _edges(ids):
                writer = (codes.dictionary[int(ids[a])].as_py() if ids[a] >= 0 else None,)
                if writer != now:
                    now, segment, offset = writer, 0, 0
                ahead = np.concatenate([[0], np.cumsum(sizes[a:b])])  # bytes before each blob, and behind the last
                at = 0
                while at < b - a:  # a turn a segment
                    end = int(np.searchsorted(ahead[:-1], limit - offset + ahead[at], side="right"))
                    if end <= at:
                        segment, offset = segment + 1, 0
                        continue
                    seg[a + at : a + end], off[a + at : a + end] = segment, offset + ahead[at:end] - ahead[at]
                    offset, at = offset + int(ahead[end] - ahead[at]), end
            yield pa.RecordBatch.from_arrays([batch.column("w"), batch.column("key"), pa.array(seg), pa.array(off)], ["writer", "key", "segment", "blob_offset"])

    return placed.mapInArrow(run, "writer string, key string, segment bigint, blob_offset bigint")


def endpoint_counters(requests: DataFrame) -> DataFrame:
    """``path, over_all, total, success, error`` by path and over all; a NULL path is one of its own, and over all only where ``over_all`` says so."""
    return requests.rollup("path").agg((F.grouping("path") == 1).alias("over_all"), F.count("*").alias("total"), F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("error"))


def latency_histogram(requests: DataFrame, bounds: list[float] = BOUNDS) -> DataFrame:
    """``path, le, n``: cumulative counts by upper bound, the last one ``+Inf``; NaN is above every bound, NULL is not counted.

    One count by bucket, then a running sum over at most ``len(bounds) + 1`` rows a path: no row is compared
    with bounds it does not fall in.
    """
    v = F.col("duration_ms")
    at = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        at = F.when(v <= F.lit(bounds[i]), F.lit(i)).otherwise(at)
    counted = requests.where(v.isNotNull()).groupBy("path", at.alias("b")).agg(F.count("*").alias("n"))
    filled = counted.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    upto = [F.aggregate(F.sequence(F.lit(0), F.lit(i)), F.lit(0).cast("bigint"), lambda acc, j: acc + F.coalesce(F.element_at("m", j), F.lit(0))) for i in range(len(bounds) + 1)]
    names = [*(f"{b:g}" for b in bounds), "+Inf"]
    return filled.select("path", F.inline(F.array(*(F.struct(F.lit(n).alias("le"), u.alias("n")) for n, u in zip(names, upto, strict=True)))))


def latency_sum_count(requests: DataFrame) -> DataFrame:
    """``path, sum_ms, n``; each value counts in whole thousandths."""
    return requests.where("duration_ms is not null").groupBy("path").agg((F.sum(F.floor(F.col("duration_ms") * 1000).cast("bigint")) / F.lit(1000.0)).alias("sum_ms"), F.count("*").alias("n"))


def gauge_last(requests: DataFrame, key: str) -> DataFrame:
    """``key, value``: the last value set, by time then id."""
    return requests.groupBy(key).agg(F.max_by("duration_ms", F.struct("ts_us", "event_id")).alias("value"))


def _line(name: str, labels: dict[str, Column], value: Column) -> Column:
    """One line of text exposition; in a label's value backslash, quote and line end are escaped."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    shown = F.concat_ws(",", *(F.concat(F.lit(f'{k}="'), escaped(c), F.lit('"')) for k, c in labels.items()))
    return F.concat(F.lit(f"{name}{{"), shown, F.lit("} "), value.cast("string"))


def prom_lines(requests: DataFrame) -> DataFrame:
    """``line``: counters and latency histograms by path as text exposition; a NULL path is shown as an empty one."""
    path = F.coalesce("path", F.lit(""))
    counters = F.array(*(_line(f"requests_{c}", {"path": path}, F.col(c)) for c in ("total", "success", "error")))
    lines = endpoint_counters(requests).where("not over_all").select(F.explode(counters).alias("line"))
    buckets = latency_histogram(requests).select(_line("request_duration_ms_bucket", {"path": path, "le": F.col("le")}, F.col("n")).alias("line"))
    sums = F.array(_line("request_duration_ms_sum", {"path": path}, F.floor("sum_ms")), _line("request_duration_ms_count", {"path": path}, F.col("n")))
    return lines.unionByName(buckets).unionByName(latency_sum_count(requests).select(F.explode(sums).alias("line")))


def prom_gauges(rows: DataFrame, label: str, gauges: dict[str, str]) -> DataFrame:
    """``line``: a gauge for each row and each of ``gauges`` (name: column), labelled by the column ``label``; NULL values have no line."""
    lines = F.array_compact(F.array(*(_line(name, {label: F.coalesce(label, F.lit(""))}, F.col(c)) for name, c in gauges.items())))
    return rows.select(F.explode(lines).alias("line"))


def quota_check(usage: DataFrame, quotas: DataFrame, used: str, limit: str, add: int, default_limit: int) -> DataFrame:
    """``tenant, used, limit_value, result``: allowed, exceeded or disabled, were ``add`` more used.

    A limit of 0 is none, a tenant without a quota has ``default_limit``, one without usage has used 0.
    """
    q = quotas.select(F.col("tenant_id").alias("tenant"), F.col(limit).alias("__limit"), "enabled")
    u = usage.select("tenant", F.col(used).alias("used")).join(q, "tenant", "full").withColumn("used", F.coalesce("used", F.lit(0)))
    bound = F.coalesce("__limit", F.lit(default_limit))
    result = F.when(~F.coalesce("enabled", F.lit(True)), "disabled").when((bound == 0) | (F.col("used") + F.lit(add) <= bound), "allowed").otherwise("exceeded")
    return u.select("tenant", "used", bound.alias("limit_value"), result.alias("result"))
