"""Change feeds, live state and limiters as Structured Streaming, run until what is there has been read.

Sinks are files in the shared folder, with their checkpoints beside them: a restart goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.session import scratch


def file_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; of a single file, its folder with that name alone."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    return reader.parquet(path)


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Append the stream's rows to files until the source is read, and read them back."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def run_lines(lines: DataFrame, name: str) -> str:
    """Append a stream of single texts to text files, a line each, until the source is read; their folder."""
    out = scratch(lines.sparkSession, name)
    lines.writeStream.format("text").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{out}/rows"


def export_lines(log: DataFrame) -> DataFrame:
    """``line``: a JSON object for each put of a streamed log, values that are no UTF-8 mended."""
    text = F.make_valid_utf8(F.coalesce(F.col("value").cast("string"), F.lit("")))
    return log.where("op = 'put'").select(F.to_json(F.struct("key", text.alias("value"))).alias("line"))


def change_events(log: DataFrame, prefix: str = "", tenant: str | None = None) -> DataFrame:
    """Every mutation as ``seq, event, key, tenant, event_ts`` in seconds, of one key prefix and tenant if given."""
    kept = log.where(F.startswith("key", F.lit(prefix))) if prefix else log
    kept = kept.where(F.col("tenant") == F.lit(tenant)) if tenant is not None else kept
    return kept.select("seq", F.col("op").alias("event"), "key", "tenant", F.floor(F.col("ts_ms") / 1000).cast("bigint").alias("event_ts"))


#: Batches whose folds are put together into one.
FOLD_EVERY = 16


def live_state(log: DataFrame, name: str) -> DataFrame:
    """The fold of a streamed log: each batch is reduced and appended once, the newest row of a key stands.

    Batches may come late or twice: a batch writes to a path of its own number, and sequences decide. Every FOLD_EVERY-th
    batch folds what came since the last such fold into it, so a reader meets one fold and fewer than FOLD_EVERY batches, however long the stream has run.
    """
    spark, out = log.sparkSession, scratch(log.sparkSession, name)
    rest = [c for c in log.columns if c != "key"]
    newest = lambda df: df.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("key", "r.*")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark._jsc.hadoopConfiguration())

    def parts(below: int) -> list[str]:
        """The latest complete fold below a batch, and the batches after it."""
        folds = [n for n in range(FOLD_EVERY - 1, below, FOLD_EVERY) if fs.exists(path(f"{out}/fold/{n}/_SUCCESS"))]
        start = folds[-1] + 1 if folds else 0
        return [f"{out}/fold/{n}" for n in folds[-1:]] + [f"{out}/rows/{n}" for n in range(start, below) if fs.exists(path(f"{out}/rows/{n}/_SUCCESS"))]

    def reduce(batch: DataFrame, number: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{out}/rows/{number}")
        if number % FOLD_EVERY == FOLD_EVERY - 1:
            newest(spark.read.schema(log.schema).parquet(*parts(number), f"{out}/rows/{number}")).write.mode("overwrite").parquet(f"{out}/fold/{number}")
        last.append(number)

    last: list[int] = []
    log.writeStream.foreachBatch(reduce).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = parts(max(last, default=-1) + 1)
    rows = spark.read.schema(log.schema).parquet(*found) if found else spark.createDataFrame([], log.schema)
    return newest(rows).where("op = 'put'")


def stream_limiter(requests: DataFrame, key: str, limit: int, window_us: int, late: str = "0 seconds") -> DataFrame:
    """``event_id, allowed``: the sliding limit of a stream, with the answers of its batch twin whatever the batches.

    A request waits until the watermark, ``late`` behind the latest one, has passed it, so a key's requests are judged by time,
    also where files bring them out of order; what comes later still is left out. State is at most ``limit`` allowed times and the requests that
    wait; once both are over, a timeout removes it.
    """

    def fold(_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        taken, waiting = ([], [])
        if state.exists:
            times, due, ids = state.get
            taken, waiting = list(times), list(zip(due, ids, strict=True))
        if not state.hasTimedOut:
            for f in frames:
                waiting += zip(f["ts_us"].tolist(), f["event_id"].tolist(), strict=True)
        now = state.getCurrentWatermarkMs()
        ready, allowed = sorted(x for x in waiting if x[0] // 1000 <= now), []
        waiting = [x for x in waiting if x[0] // 1000 > now]
        for t, _id in ready:
            allowed.append(len(taken) < limit or taken[0] <= t - window_us)
            if allowed[-1]:
                taken = [*taken, t][-limit:]
        taken = [x for x in taken if x > now * 1000 - window_us]
        if taken or waiting:
            state.update((taken, [t for t, _id in waiting], [i for _t, i in waiting]))
            state.setTimeoutTimestamp(max(now + 1, min(t for t, _id in waiting) // 1000 if waiting else (taken[-1] + window_us) // 1000))
        else:
            state.remove()
        yield pd.DataFrame({"event_id": [i for _t, i in ready], "allowed": allowed}).astype({"event_id": "int64", "allowed": "bool"})

    timed = requests.withColumn("__at", F.timestamp_micros("ts_us")).withWatermark("__at", late)
    return timed.groupBy(key).applyInPandasWithState(fold, "event_id bigint, allowed boolean", "taken array<bigint>, due array<bigint>, ids array<bigint>", "append", "EventTimeTimeout")


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """``started, event_type, n`` of a stream by windows; a window is given out once the watermark has passed it, and what comes later is left out."""
    return _timed(events, late).groupBy(F.window("t", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "event_type", "n")


def sliding(events: DataFrame, width: str, step: str, late: str) -> DataFrame:
    """The same by windows that overlap, a new one every ``step``."""
    return _timed(events, late).groupBy(F.window("t", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "event_type", "n")


def sessions(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """``key, started, n``: sessions that end after ``gap`` without an event, given out once the watermark has passed their end."""
    return _timed(events, late).groupBy(key, F.session_window("t", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), "n")


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Repeated deliveries dropped, as long as they come within ``late`` of one another in event time."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def fan_out(stream: DataFrame, name: str, sinks: list[str]) -> list[str]:
    """Append each batch to several places; a batch that is retried overwrites what it had written."""
    out = scratch(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for sink in sinks:
            kept.write.mode("overwrite").parquet(f"{out}/{sink}/batch={number}")
        kept.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return [f"{out}/{sink}" for sink in sinks]
