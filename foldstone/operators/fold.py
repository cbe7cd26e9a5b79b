"""The mutation log folded into state, with snapshots, tombstones and time to live.

A log has ``seq`` (unique), ``op`` (put or delete), ``key``, ``value`` and may have ``expires_at``, ``tenant``
and more. Rows without ``seq`` or ``key`` have no place in a log and are left out. Empty logs fold to empty
states. All columns of the winning row stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _last(log: DataFrame) -> DataFrame:
    rest = [c for c in log.columns if c != "key"]
    placed = log.where(F.col("key").isNotNull() & F.col("seq").isNotNull())
    return placed.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("__row")).select("key", *(F.col(f"__row.{c}").alias(c) for c in rest))


def fold_state(log: DataFrame) -> DataFrame:
    """The row of the last put of each key whose last operation is a put. Map-side reduced, so hot keys do not skew."""
    return _last(log).where("op = 'put'")


def tombstones(log: DataFrame) -> DataFrame:
    """``key, seq`` of keys whose last operation is a delete."""
    return _last(log).where("op = 'delete'").select("key", "seq")


def restore(snapshot: DataFrame, high: int, log: DataFrame) -> DataFrame:
    """State from a snapshot of all operations up to ``high`` and the log's tail beyond it; equals the full fold."""
    return fold_state(snapshot.unionByName(log.where(F.col("seq") > F.lit(high)), allowMissingColumns=True))


def next_seq(log: DataFrame) -> DataFrame:
    """One row: one more than the greatest sequence, 0 for an empty log."""
    return log.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("next_seq"))


def greatest(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the greatest by ``columns`` in turn; NULLs for an empty table."""
    return df.agg(F.max(F.struct(*columns)).alias("__m")).select("__m.*")


def live(now_ms: int) -> Column:
    """Not expired: an entry lives through the millisecond it expires at; without expiry, for ever."""
    return F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now_ms))


def ttl_remaining(state: DataFrame, now_ms: int) -> DataFrame:
    """``key, remaining_ms`` for entries with an expiry, NULL from the millisecond they expire at."""
    left = F.when(F.col("expires_at") > F.lit(now_ms), F.col("expires_at") - F.lit(now_ms))
    return state.where("expires_at is not null").select("key", left.alias("remaining_ms"))


def purge(state: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The entries that stay, and one row with how many go."""
    gone = F.count_if(~live(now_ms)).alias("purged")
    return state.where(live(now_ms)), state.agg(gone)


def compact(log: DataFrame, now_ms: int) -> DataFrame:
    """What a compaction keeps: last puts that live, with their expiry."""
    return fold_state(log).where(live(now_ms))


def compact_report(log: DataFrame, now_ms: int, size: Column) -> DataFrame:
    """One row: log rows and bytes before, rows and bytes kept, bytes freed."""
    before = log.agg(F.count("*").alias("rows_before"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_before"))
    after = compact(log, now_ms).agg(F.count("*").alias("rows_after"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_after"))
    one = F.lit(1).alias("__one")
    both = before.select("*", one).join(after.select("*", one), "__one").drop("__one")  # two single rows
    return both.withColumn("bytes_freed", F.col("bytes_before") - F.col("bytes_after"))
