"""Verify what volumes hold against the catalogue, and plan the repair.

``catalog``: ``key, volume_id, size, hash``, a row for each expected replica. ``blobs``: the same for what is held.
Both sides are unique on (key, volume_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldstone.operators.placement import ranked
from foldstone.session import spread


def _held(catalog: DataFrame, blobs: DataFrame) -> DataFrame:
    held = blobs.select("key", "volume_id", F.col("hash").alias("held_hash"), F.lit(True).alias("held"))
    return catalog.join(held, ["key", "volume_id"], "left")


def verify_keys(catalog: DataFrame, blobs: DataFrame, replicas: int) -> DataFrame:
    """``key, class``: corrupted if a held replica's hash differs, else under_replicated if fewer than ``replicas`` are held, else healthy."""
    keyed = _held(catalog, blobs).groupBy("key").agg(F.count_if(F.col("held") & ~F.col("hash").eqNullSafe(F.col("held_hash"))).alias("bad"), F.count("held").alias("n"))
    return keyed.select("key", F.when(F.col("bad") > 0, "corrupted").when(F.col("n") < replicas, "under_replicated").otherwise("healthy").alias("class"))


def orphan_blobs(catalog: DataFrame, blobs: DataFrame) -> DataFrame:
    """Held blobs that no catalogue row expects on that volume."""
    return blobs.join(catalog.select("key", "volume_id"), ["key", "volume_id"], "left_anti").select("key", "volume_id")


def verify_report(catalog: DataFrame, blobs: DataFrame, replicas: int) -> DataFrame:
    """``class, n`` for total_keys, healthy, under_replicated, corrupted and orphaned; the middle three sum to the first."""
    classes = verify_keys(catalog, blobs, replicas)
    counts = classes.agg(F.count("*").alias("total_keys"), *(F.count_if(F.col("class") == c).alias(c) for c in ("healthy", "under_replicated", "corrupted")))
    lines = counts.selectExpr("stack(4, 'total_keys', total_keys, 'healthy', healthy, 'under_replicated', under_replicated, 'corrupted', corrupted) as (class, n)")
    return lines.unionByName(orphan_blobs(catalog, blobs).agg(F.count("*").alias("n")).select(F.lit("orphaned").alias("class"), "n"))


def repair_plan(catalog: DataFrame, blobs: DataFrame, alive: list[str], replicas: int) -> DataFrame:
    """``key, target, source, size``: the copies that give every key ``replicas`` sound ones again.

    A replica is sound if it is held with the catalogue's hash on a volume that is alive. The targets are the volumes of greatest
    weight for the key among those ``alive`` that hold no sound one (a corrupted blob is written over); a key may get fewer than it lacks
    if too few volumes are alive. The source is the first sound holder, NULL if none is left.
    """
    sound = F.col("held") & F.col("hash").eqNullSafe(F.col("held_hash")) & F.col("volume_id").isin(alive)
    holders = F.collect_set(F.when(sound, F.col("volume_id")))  # at most the key's replicas
    keyed = _held(catalog, blobs).groupBy("key").agg(holders.alias("holders"), F.max("size").alias("size")).where(F.size("holders") < replicas)
    ranks = ranked(F.col("key"), alive, 2 * replicas - 1)  # so many hold enough that are free
    free = F.slice(F.filter(ranks, lambda v: ~F.array_contains("holders", v)), F.lit(1), F.lit(replicas) - F.size("holders"))
    return spread(keyed).select("key", F.explode(free).alias("target"), F.array_min("holders").alias("source"), "size")


def repair_report(catalog: DataFrame, blobs: DataFrame, alive: list[str], replicas: int) -> DataFrame:
    """One row: replicas checked, copies to make, those without a source, and bytes to copy."""
    plan = repair_plan(catalog, blobs, alive, replicas).agg(F.count("*").alias("to_repair"), F.count_if(F.col("source").isNull()).alias("without_source"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_to_copy"))
    checked = catalog.agg(F.count("*").alias("checked"))
    one = F.lit(1).alias("__one")
    return checked.select("*", one).join(plan.select("*", one), "__one").drop("__one")
