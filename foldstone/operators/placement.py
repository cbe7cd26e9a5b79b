"""Rendezvous placement of keys on volumes, shard maps, and what moves when volumes change."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.functions.blake3 import Endings, digests
from foldstone.session import spread

#: Volumes that one placement ranks; each key is hashed once with each of them.
MOST_VOLUMES = 10_000
#: Weights that are held at once while keys are ranked by BLAKE3.
WEIGHTS = 1 << 20


def alive(volumes: DataFrame) -> list[str]:
    """The ids of volumes that may take writes, in order. ValueError beyond MOST_VOLUMES."""
    ids = [r["volume_id"] for r in volumes.where("state = 'alive'").select("volume_id").distinct().orderBy("volume_id").limit(MOST_VOLUMES + 1).collect()]
    if len(ids) > MOST_VOLUMES:
        raise ValueError(f"more than {MOST_VOLUMES} volumes")
    return ids


def _heaviest(keys: list[bytes], named: list[bytes], high: np.ndarray, n: int) -> np.ndarray:
    """The places of the ``n`` greatest weights of each key, heaviest first, of the weights' upper halves ``high``. Lower halves are worked out where upper ones tie."""
    floor = np.partition(high, -n, axis=1)[:, -n]
    row, at = np.nonzero(high >= floor[:, None])
    upper, lower = ~high[row, at], np.zeros(len(row), dtype=np.uint64)
    order = np.lexsort((upper, row))
    same = (row[order][1:] == row[order][:-1]) & (upper[order][1:] == upper[order][:-1])
    if same.any():
        tied = order[np.append(same, False) | np.append(False, same)]
        lower[tied] = ~np.frombuffer(bytes.fromhex("".join(x[:16] for x in digests([keys[i] + named[j] for i, j in zip(row[tied], at[tied], strict=True)]))), "<u8")
        order = np.lexsort((lower, upper, row))
    return at[order][np.searchsorted(row[order], np.arange(len(keys)))[:, None] + np.arange(n)]


def _ranked_blake3(keys: list[str | None], named: list[bytes], n: int) -> np.ndarray:
    """Places in ``named``, (keys, n). Keys of one length are ranked together."""
    out = np.tile(np.arange(n), (len(keys), 1))
    heads = [None if k is None else k.encode() for k in keys]
    lengths = np.array([-1 if h is None else len(h) for h in heads], dtype=np.int64)
    endings, many = Endings(named), max(1, WEIGHTS // len(named))
    for size in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == size)
        for i in range(0, len(at), many):
            part = at[i : i + many]
            own = [heads[j] for j in part]
            out[part] = _heaviest(own, named, endings.high(own), n)
    return out


def ranked(key: Column, nodes: list[str], n: int, digest: str = "sha256") -> Column:
    """The ``n`` nodes of greatest weight for ``key``, heaviest first; ties keep the nodes' order.

    The weight is the little-endian number in the first 8 bytes of SHA-256(key, node), or of BLAKE3 with ``digest="blake3"``. The nodes come with the
    function instead of by a join: no pairs leave a row, nothing is shuffled. A NULL key has no weights.
    """
    if not nodes:
        return F.array().cast("array<string>")
    named = [v.encode() for v in nodes]

    def run(keys: pa.Array) -> pa.Array:
        if digest == "blake3":
            most = min(n, len(nodes))
            places = _ranked_blake3(keys.to_pylist(), named, most)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * most, pa.int32()), pa.array(nodes, pa.string()).take(pa.array(places.ravel())))
        out = []
        for k in keys.to_pylist():
            if k is None:
                out.append(nodes[:n])
                continue
            head = k.encode()
            weights = np.frombuffer(b"".join(sha256(head + v).digest()[:8] for v in named), "<u8")
            out.append([nodes[i] for i in np.argsort(~weights, kind="stable")[:n]])
        return pa.array(out, pa.list_(pa.string()))

    run.__annotations__ = {"keys": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(key)


def replicas(keys: DataFrame, nodes: list[str], n: int, digest: str = "sha256") -> DataFrame:
    """``key, volume_id, rank``: up to ``n`` rows a key, rank from 1."""
    rows = spread(keys.select("key"), parts=8 if digest == "blake3" else 0)  # a row costs as much as there are nodes, however few its bytes
    return rows.select("key", F.posexplode(ranked(F.col("key"), nodes, n, digest)).alias("rank", "volume_id")).select("key", "volume_id", (F.col("rank") + 1).cast("bigint").alias("rank"))


def placement_status(keys: DataFrame, nodes: list[str], n: int) -> DataFrame:
    """``key, status, volumes``: ok, no_healthy_volumes, or insufficient_replicas where fewer than ``n`` are alive."""
    status = F.lit("no_healthy_volumes" if not nodes else "insufficient_replicas" if len(nodes) < n else "ok")
    chosen = F.array_join(ranked(F.col("key"), nodes, n), ",") if len(nodes) >= n else F.lit("")
    return spread(keys.select("key")).select("key", status.alias("status"), chosen.alias("volumes"))


def shard_map(spark: SparkSession, shards: int, nodes: list[str], n: int) -> DataFrame:
    """``shard, volume_id, rank`` for shards 0 .. shards - 1."""
    named = spark.range(shards).select(F.col("id").alias("shard"), F.concat(F.lit("shard-"), F.col("id").cast("string")).alias("key"))
    return named.select("shard", F.posexplode(ranked(F.col("key"), nodes, n)).alias("rank", "volume_id")).select("shard", "volume_id", (F.col("rank") + 1).cast("bigint").alias("rank"))


def shard_nodes(placed: DataFrame) -> DataFrame:
    """``shard, nodes``: a shard's volumes by rank, joined by commas."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "volume_id"))), lambda x: x["volume_id"])
    return placed.groupBy("shard").agg(F.array_join(ordered, ",").alias("nodes"))


def rebalance_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """``shard, volume_id, change``: replicas that a new shard map adds or drops."""
    a = before.select("shard", "volume_id", F.lit(-1).alias("d"))
    b = after.select("shard", "volume_id", F.lit(1).alias("d"))
    net = a.unionByName(b).groupBy("shard", "volume_id").agg(F.sum("d").alias("d")).where("d <> 0")
    return net.select("shard", "volume_id", F.when(F.col("d") > 0, "add").otherwise("drop").alias("change"))


def volume_load(placed: DataFrame) -> DataFrame:
    """``volume_id, keys, bytes`` of placed replicas with their ``size``."""
    return placed.groupBy("volume_id").agg(F.count("*").alias("keys"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
