"""Point, range, prefix and substring reads, scans, exports and imports over a state table.

All are filters and joins that Catalyst pushes to the scan; results of a missing key are what SQL gives: no row,
or NULL in an outer join. NULL keys are never found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_keys(state: DataFrame) -> DataFrame:
    """All keys in byte order."""
    return state.select("key").orderBy("key")


def point_get(state: DataFrame, key: str) -> DataFrame:
    """The entry of ``key``, or no row."""
    return state.where(F.col("key") == F.lit(key))


def exists_many(keys: DataFrame, state: DataFrame) -> DataFrame:
    """``key, found`` for each asked key, once per asked row."""
    there = state.select(F.col("key").alias("__key")).distinct()
    return keys.select("key").join(there, F.col("key") == F.col("__key"), "left").select("key", F.col("__key").isNotNull().alias("found"))


def range_keys(state: DataFrame, start: str, end: str) -> DataFrame:
    """Keys from ``start`` to ``end``, both included, in byte order; none if ``start`` is greater."""
    return state.where(F.col("key").between(start, end)).select("key").orderBy("key")


def range_with_meta(state: DataFrame, meta: DataFrame, start: str, end: str) -> DataFrame:
    """The range's keys with their metadata columns, NULL where a key has none."""
    return state.where(F.col("key").between(start, end)).select("key").join(meta.where(F.col("key").between(start, end)), "key", "left")


def range_with_values(catalog: DataFrame, state: DataFrame, start: str, end: str) -> DataFrame:
    """``key, value`` of the catalogue's keys in the range, empty bytes where the state has none."""
    values = state.where(F.col("key").between(start, end)).select("key", F.col("value").cast("binary").alias("value"))
    return catalog.where(F.col("key").between(start, end)).select("key").join(values, "key", "left").select("key", F.coalesce("value", F.lit(b"")).alias("value"))


def page(ordered: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows of a range, search or export from the ``offset``-th on, in its order."""
    return ordered.offset(offset).limit(limit)


def of_tenant(state: DataFrame, tenant: str | None) -> DataFrame:
    """The entries of a tenant; without one, all."""
    return state if tenant is None else state.where(F.col("tenant") == F.lit(tenant))


def prefix_scan(state: DataFrame, prefix: str) -> DataFrame:
    """Entries whose key starts with ``prefix``; the empty prefix is a full scan."""
    return state.where(F.startswith("key", F.lit(prefix)))


def search_value(state: DataFrame, needle: str) -> DataFrame:
    """Keys whose value is valid UTF-8 and contains ``needle``, by letter case; the empty needle is in every such value."""
    value = F.col("value").cast("string")
    return state.where(F.is_valid_utf8(value) & F.contains(value, F.lit(needle))).select("key")


def export_ndjson(catalog: DataFrame, state: DataFrame) -> DataFrame:
    """``key, line``: one JSON object for each key that is both catalogued and has a value, bad UTF-8 replaced."""
    both = catalog.select("key").distinct().join(state.select("key", "value"), "key")
    text = F.make_valid_utf8(F.coalesce(F.col("value").cast("string"), F.lit("")))
    return both.select("key", F.to_json(F.struct("key", text.alias("value"))).alias("line"))


def write_ndjson(lines: DataFrame, path: str) -> None:
    """The lines of an export as text files, in the order of keys from file to file and within each."""
    lines.repartitionByRange("key").sortWithinPartitions("key").select("line").write.text(path)


def read_import(spark: SparkSession, path: str) -> DataFrame:
    """``source, ord, key, value`` of import bodies ``{"entries": [{"key": ..., "value": ...}]}``, one JSON document a line.

    An entry without key or value is part of no valid body: such bodies and lines that are no JSON give no entries.
    """
    bodies = spark.read.text(path).select(F.col("_metadata.file_name").alias("source"), F.from_json("value", "entries array<struct<key string, value string>>").alias("body"))
    whole = bodies.where(F.col("body.entries").isNotNull() & ~F.exists("body.entries", lambda e: e.isNull() | e["key"].isNull() | e["value"].isNull()))
    return whole.select("source", F.posexplode("body.entries").alias("ord", "e")).select("source", "ord", "e.key", "e.value")


def import_entries(entries: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """The last entry of each key by ``order``, and one row with the number of entries read, duplicates included."""
    rest = [c for c in entries.columns if c != "key"]
    last = entries.groupBy("key").agg(F.max_by(F.struct(*rest), order).alias("__row")).select("key", *(F.col(f"__row.{c}").alias(c) for c in rest))
    return last, entries.agg(F.count("*").alias("imported"))


def catalog_value_diff(catalog: DataFrame, state: DataFrame) -> DataFrame:
    """One row: distinct keys in both, only catalogued, only with a value."""
    sides = catalog.select("key", F.lit(1).alias("c"), F.lit(0).alias("v")).unionByName(state.select("key", F.lit(0).alias("c"), F.lit(1).alias("v")))
    keyed = sides.groupBy("key").agg(F.max("c").alias("c"), F.max("v").alias("v"))
    return keyed.agg(F.count_if(F.expr("c = 1 and v = 1")).alias("in_both"), F.count_if(F.expr("v = 0")).alias("catalog_only"), F.count_if(F.expr("c = 0")).alias("value_only"))


def blob_chunks(state: DataFrame, width: int) -> DataFrame:
    """``key, chunk_no, bytes``: each value cut into pieces of ``width`` bytes; an empty value has none."""
    data = F.col("value").cast("binary")
    pieces = F.floor((F.octet_length(data) + F.lit(width - 1)) / F.lit(width)).cast("int")
    cut = state.where(F.octet_length(data) > 0).select("key", data.alias("__data"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("chunk_no"))
    return cut.select("key", "chunk_no", F.substring("__data", F.col("chunk_no") * F.lit(width) + 1, F.lit(width)).alias("chunk")).select("key", "chunk_no", F.octet_length("chunk").cast("bigint").alias("bytes"))
