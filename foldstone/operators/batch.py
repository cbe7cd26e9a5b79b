"""Ordered batches and transactions of put, get and delete, a result for each operation.

Operations have ``ord`` (unique), ``op``, ``key`` and ``value``. A batch reads its own writes: an operation sees
the last put or delete of its key before it in the batch, else the base state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def batch_results(ops: DataFrame, base: DataFrame | None = None, width: int = 65_536) -> DataFrame:
    """``ord, key, ok, value, error`` of each operation.

    Errors: a put without value, a get that finds nothing, an unknown operation. Deleting an absent key
    succeeds. An empty batch gives no rows. Ordinals are cut into stretches of ``width``: the look-back runs within a stretch, and
    each stretch takes over the last effect of those before it, so one hot key is spread over tasks.
    """
    effect = F.when((F.col("op") == "put") & F.col("value").isNotNull(), F.struct(F.col("value").alias("v"))).when(F.col("op") == "delete", F.struct(F.lit(None).cast("string").alias("v")))
    cut = ops.select("ord", "op", "key", "value", F.floor(F.col("ord") / F.lit(width)).alias("__cut")).withColumn("__effect", effect)
    ends = cut.where("__effect is not null").groupBy("key", "__cut").agg(F.max_by("__effect", "ord").alias("__end"))
    takes = cut.select("key", "__cut").distinct().join(ends, ["key", "__cut"], "left")
    earlier = Window.partitionBy("key").orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    takes = takes.select("key", "__cut", F.last("__end", ignorenulls=True).over(earlier).alias("__carried")).where("__carried is not null")
    before = Window.partitionBy("key", "__cut").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = cut.withColumn("__near", F.last("__effect", ignorenulls=True).over(before)).join(takes, ["key", "__cut"], "left")
    seen = seen.withColumn("__seen", F.coalesce("__near", "__carried"))
    if base is not None:
        seen = seen.join(base.select("key", F.col("value").alias("__base")), "key", "left")
    else:
        seen = seen.withColumn("__base", F.lit(None).cast("string"))
    got = F.when(F.col("__seen").isNotNull(), F.col("__seen.v")).otherwise(F.col("__base"))
    # fixed values: the texts of errors
    error = (
        F.when((F.col("op") == "put") & F.col("value").isNull(), "Missing value for put")
        .when((F.col("op") == "get") & got.isNull(), "Not found")
        .when(~F.coalesce(F.col("op").isin("put", "get", "delete"), F.lit(False)), "Unknown op")
    )
    return seen.select("ord", "key", error.isNull().alias("ok"), F.when(F.col("op") == "get", got).alias("value"), error.alias("error"))


def txn_results(ops: DataFrame) -> DataFrame:
    """``ord, key, success, error``: each operation by itself, as a transaction reports it."""
    error = F.when((F.col("op") == "put") & F.col("value").isNull(), "value required for put").when(~F.coalesce(F.col("op").isin("put", "delete"), F.lit(False)), "unknown operation")
    return ops.select("ord", "key", error.isNull().alias("success"), error.alias("error"))


def txn_totals(ops: DataFrame) -> DataFrame:
    """One row: operations and how many succeeded."""
    return txn_results(ops).agg(F.count("*").alias("total_operations"), F.count_if("success").alias("successful_operations"))


def txn_log(ops: DataFrame, first_seq: int, atomic: bool = False) -> DataFrame:
    """The log rows that a transaction appends; with ``atomic``, none unless every operation succeeded."""
    judged = ops.join(txn_results(ops).select("ord", "success"), "ord")
    kept = judged.where("success")
    if atomic:
        failed = txn_results(ops).agg(F.count_if(~F.col("success")).alias("n")).first()["n"]
        kept = kept.where(F.lit(failed == 0))
    return kept.select((F.col("ord") + F.lit(first_seq)).alias("seq"), "op", "key", "value")
