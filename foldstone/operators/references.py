"""References to records that do not exist: runs of parent keys, matched as of the preceding run start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldstone.session import broadcast_if_small

#: Parent keys are cut at multiples of this, so that no run, window or attribute array grows beyond it.
RUN_WIDTH = 1024


def numbered(c: Column) -> tuple[Column, Column]:
    """Split a textual key into (scope, integer): the stem with the digits' count, and up to 18 final digits.

    The split can be undone, so two texts are equal if and only if both parts are. A text without final
    digits is its own scope with the integer 0.
    """
    digits = F.regexp_extract(c, "([0-9]{1,18})$", 1)
    stem = F.substring(c, F.lit(1), F.length(c) - F.length(digits))
    scope = F.concat(stem, F.lit("#"), F.length(digits).cast("string"))
    return scope, F.coalesce(digits.try_cast("bigint"), F.lit(0))


def _cut(key: Column) -> Column:
    return F.floor(key / F.lit(RUN_WIDTH)).cast("bigint")


def contiguous_runs(parents: DataFrame) -> DataFrame:
    """Compress parents (``scope``, ``key`` bigint, ``since`` bigint or NULL) into runs.

    Gives ``scope, cut, run_start, run_end, since`` with one ``since`` per key of the run in key order.
    Repeated parents count once, with the earliest ``since``; a NULL ``scope`` or ``key`` is no parent.
    """
    unique = parents.where(F.col("scope").isNotNull() & F.col("key").isNotNull()).groupBy("scope", _cut(F.col("key")).alias("cut"), "key").agg(F.min("since").alias("since"))
    island = F.col("key") - F.row_number().over(Window.partitionBy("scope", "cut").orderBy("key"))
    return (
        unique.withColumn("__island", island)
        .groupBy("scope", "cut", "__island")
        .agg(F.min("key").alias("run_start"), F.max("key").alias("run_end"), F.array_sort(F.collect_list(F.struct("key", "since"))).alias("__members"))
        .select("scope", "cut", "run_start", "run_end", F.transform("__members", lambda m: m["since"]).alias("since"))
    )


def match_runs(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """As-of match of distinct references (``scope``, ``key``, further columns) to the preceding run start.

    Adds ``present`` (the key lies within that run) and ``since`` of the matched parent. Runs are cut at
    multiples of RUN_WIDTH, so a window never holds more than 2 * RUN_WIDTH rows, however hot its scope.
    """
    extra = [c for c in refs.columns if c not in ("scope", "key")]
    run = F.struct("run_end", "run_start", "since")
    starts = runs.select("scope", "cut", F.col("run_start").alias("key"), F.lit(0).alias("__kind"), run.alias("__run"), *(F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in extra))
    asked = refs.select("scope", _cut(F.col("key")).alias("cut"), "key", F.lit(1).alias("__kind"), F.lit(None).cast(starts.schema["__run"].dataType).alias("__run"), *extra)
    before = Window.partitionBy("scope", "cut").orderBy("key", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(asked).withColumn("__at", F.last("__run", ignorenulls=True).over(before)).where("__kind = 1")
    present = F.coalesce(F.col("key") <= F.col("__at.run_end"), F.lit(False))
    offset = (F.col("key") - F.col("__at.run_start")).cast("int")
    return found.select("scope", "key", *extra, present.alias("present"), F.when(present, F.get(F.col("__at.since"), offset)).alias("since"))


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``refs`` whose parent is missing, or came later than the reference.

    ``refs``: ``scope, key, at`` and further columns, which are kept; ``parents``: ``scope, key, since``. A
    reference is an orphan if no parent has its scope and key, or if ``since`` is after ``at`` (a NULL on
    either side of that comparison proves nothing). References with a NULL scope or key refer to nothing.
    Every row is judged, repeated rows too.

    References are reduced to distinct (scope, key) with their earliest ``at`` before any shuffle, so one
    parent that a third of all rows name costs one row; what may be an orphan is then looked up from the
    rows, by broadcast if its written size allows it, else by a shuffle join that splits on skew.
    """
    named = refs.where(F.col("scope").isNotNull() & F.col("key").isNotNull())
    distinct = named.groupBy("scope", "key").agg(F.min("at").alias("first_at"))
    judged = match_runs(distinct, contiguous_runs(parents))
    suspects = judged.where(~F.col("present") | (F.col("since") > F.col("first_at"))).select("scope", "key", "present", "since")
    hit = broadcast_if_small(suspects, "suspects")
    return named.join(hit, ["scope", "key"]).where(~F.col("present") | (F.col("since") > F.col("at"))).drop("present", "since")
