"""One wide feature row per entity from an event log."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.session import scratch

#: Columns a wide row may have; a log with more event types needs a catalogue of those wanted.
MAX_EVENTS = 4000


def content_digest(columns: Sequence[str]) -> Column:
    """128 bits over the columns' text, lengths included, so that neither NULL and '' nor neighbours mix."""
    parts = [F.coalesce(F.concat(F.length(F.col(c)).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat(*parts) if parts else F.lit("")))


def column_names(events: Sequence[str]) -> list[str]:
    """A column name per event type, distinct also where only punctuation differs."""
    names: list[str] = []
    for e in events:
        base = re.sub(r"[^0-9a-z]+", "_", e.lower()).strip("_") or "unnamed"
        name, n = base, 2
        while name in names:
            name, n = f"{base}_{n}", n + 1
        names.append(name)
    return names


def event_cells(log: DataFrame, entity: str, event: str, at: str, total: str, content: Sequence[str]) -> DataFrame:
    """``entity, event, n, last_at, total`` per entity and event, each entry once.

    Entries that agree in entity, event, ``at``, ``total`` and the text columns ``content`` are deliveries of
    one. The shuffle carries a digest in place of those texts. A hot entity's entries are spread by their
    whole content, then summed on the map side. A NULL event counts as the event ''.
    """
    entries = log.select(
        F.coalesce(F.col(entity), F.lit("")).alias("entity"), F.coalesce(F.col(event), F.lit("")).alias("event"), F.col(at).alias("at"), F.col(total).alias("total"), content_digest(content).alias("__digest")
    ).distinct()
    return entries.groupBy("entity", "event").agg(F.count("*").alias("n"), F.max("at").alias("last_at"), F.sum("total").alias("total"))


def feature_table(
    log: DataFrame,
    entity: str,
    event: str,
    at: str,
    total: str,
    content: Sequence[str],
    as_of: str | None = None,
    events: Sequence[str] | None = None,
    block_size: int = 32,
) -> DataFrame:
    """One row per entity: ``entity``, ``entries, last_at, total`` over all events, and for each event type
    ``n_<event>`` (0 where never seen), ``recency_s_<event>`` (seconds from the last entry to ``as_of``, NULL
    where never seen) and ``total_<event>`` (0 where never seen).

    ``as_of`` is a UTC timestamp text; by default it is the latest ``at`` of the log. ``events`` fixes the
    catalogue, else it is every event type that occurs, at most MAX_EVENTS (ValueError beyond, as no row is
    dropped in silence); events outside a given catalogue still count in the overall columns. A NULL ``at``
    counts, but gives no recency. Entries with a NULL or blank entity make one row whose entity is NULL, so
    that the table's sums are those of the log. An empty log gives an empty table. Other columns are ignored.

    Event types are cut into blocks. The cells (at most entities x events, far fewer than entries) are
    written once, bucketed by entity and sorted by block: each block's aggregation, the complete entity
    table and all joins between them then run inside a bucket, without another exchange, and a block reads its own row groups. The
    table's name leaves the catalogue at once; its files go with the session.

    More event types than a row has room for have an exact way as well: ``event_features`` gives the same in long form.
    """
    spark = log.sparkSession
    cells = event_cells(log, entity, event, at, total, content)
    path, name = scratch(spark, "cells"), f"foldstone_cells_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = path + "-raw"
    cells.write.parquet(raw)
    cells = spark.read.parquet(raw)
    if events is None:
        events = sorted(r["event"] for r in cells.select("event").distinct().limit(MAX_EVENTS + 1).collect())
    if len(events) > MAX_EVENTS:
        raise ValueError(f"more than {MAX_EVENTS} event types: name those wanted in events=")
    cells = cells.withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))

    blocks = [list(events[i : i + block_size]) for i in range(0, len(events), block_size)]
    places = [(e, b, p) for b, block in enumerate(blocks) for p, e in enumerate(block)]
    catalogue = spark.createDataFrame(places, "event string, block int, place int")
    placed = cells.join(F.broadcast(catalogue), "event", "left").withColumn("block", F.coalesce("block", F.lit(-1)))
    placed.repartition(buckets, "entity").write.bucketBy(buckets, "entity").sortBy("block", "entity").option("path", path).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"drop table {name}")  # external: the files stay, and the plan knows them by now

    out = stored.groupBy("entity").agg(F.sum("n").alias("entries"), F.max("last_at").alias("last_at"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    for b in range(len(blocks)):
        cell = F.struct("place", F.struct("n", "last_at", "total"))  # at most block_size of them an entity
        wide = stored.where(F.col("block") == b).groupBy("entity").agg(F.map_from_entries(F.collect_list(cell)).alias(f"__block_{b}"))
        out = out.join(wide, "entity", "left")

    # As text: hundreds of columns built call by call would cost the driver more than the whole job.
    stamp = as_of or str(cells.agg(F.max("last_at").cast("string")).first()[0] or "1970-01-01")
    shown = [f"case when entity <> '' then entity end as `{entity}`", "entries", "last_at", "total"]
    for (_, b, p), c in zip(places, column_names(events), strict=True):
        of = f"element_at(__block_{b}, {p})"
        shown += [
            f"coalesce({of}.n, 0L) as `n_{c}`",
            f"timestampdiff(second, {of}.last_at, timestamp_ntz'{stamp}') as `recency_s_{c}`",
            f"coalesce({of}.total, 0L) as `total_{c}`",
        ]
    return out.selectExpr(*shown)


def event_features(log: DataFrame, entity: str, event: str, at: str, total: str, content: Sequence[str], as_of: str | None = None) -> DataFrame:
    """``entity, event, n, recency_s, total``: what ``feature_table`` has in its columns, a row for each event type an entity has, of any number of types.

    Entities are told by the column ``entity``; NULL and blank ones are one, whose entity is NULL.
    """
    cells = event_cells(log, entity, event, at, total, content).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))
    if as_of is None:
        last = log.agg(F.max(F.col(at).cast("timestamp_ntz")).cast("string")).first()[0]
    stamp = as_of or str(last or "1970-01-01")
    recency = F.expr(f"timestampdiff(second, last_at, timestamp_ntz'{stamp}')")
    return cells.select(F.when(F.col("entity") != "", F.col("entity")).alias(entity), F.col("event").alias(event), "n", recency.alias("recency_s"), F.coalesce("total", F.lit(0)).alias("total"))


def feature_cells(wide: DataFrame, entity: str) -> DataFrame:
    """The wide table in long form again: ``entity, feature, n, recency_s, total`` for features that occur."""
    features = [c[2:] for c in wide.columns if c.startswith("n_")]
    cells = ", ".join(f"named_struct('feature', '{f}', 'n', `n_{f}`, 'recency_s', `recency_s_{f}`, 'total', `total_{f}`)" for f in features)
    empty = "cast(array() as array<struct<feature string, n bigint, recency_s bigint, total bigint>>)"
    return wide.selectExpr(f"`{entity}`", f"inline({f'filter(array({cells}), x -> x.n > 0)' if features else empty})")
