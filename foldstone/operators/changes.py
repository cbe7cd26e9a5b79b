"""Rebuild current state from a change feed: column-wise last writer wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_changes(
    feed: DataFrame,
    keys: Sequence[str],
    order: str,
    op: str,
    fields: Sequence[str] = (),
    replace_ops: Sequence[str] = ("put",),
    patch_ops: Sequence[str] = (),
) -> DataFrame:
    """Fold ``feed`` into one row per living key: ``keys``, the ``fields``, ``last_no`` and ``born_no``.

    A change in ``replace_ops`` sets every field (also to NULL), one in ``patch_ops`` sets the fields that
    are not NULL, any other operation (unknown or NULL ones too) deletes. Each field is the ``max_by`` over
    the changes that set it, kept only where that change lies after the latest delete and not before the
    latest replacement. As the latest setter decides, one aggregation answers it: no second pass, no join,
    and a key that holds a third of the feed is reduced before the shuffle.

    A key lives if one of its fields was set after its latest delete; ``last_no`` is the latest change that set one of the
    fields, so the one that made the present state. A patch that sets nothing changes nothing. Without ``fields`` the
    being there of the key is its only field, which every replacement and patch sets. ``born_no`` is the latest
    replacement since the last delete, NULL if the key only ever was patched.

    Repeated deliveries change nothing, arrival order never matters. At equal ``order`` a delete wins, then
    any value before NULL, and of two values always the same one. A change without ``order`` or without a full key has no place and is left out. An
    empty feed gives no rows. Further columns of the feed are ignored.
    """
    replaces, patches = F.col(op).isin(*replace_ops), F.col(op).isin(*patch_ops) if patch_ops else F.lit(False)
    alive = F.coalesce(replaces | patches, F.lit(False))
    no = F.col(order)

    def latest(when: Column) -> Column:
        return F.max(F.when(F.coalesce(when, F.lit(False)), no))

    def setter(field: str) -> Column:
        """The number and value of the latest change that set ``field``; at equal numbers a value goes before NULL, and a hash of fixed size tells values apart."""
        sets = F.coalesce(replaces | (patches & F.col(field).isNotNull()), F.lit(False))
        return F.max_by(F.when(sets, F.struct(no.alias("no"), F.col(field).alias("v"))), F.when(sets, F.struct(no, F.col(field).isNotNull(), F.xxhash64(field))))

    placed = feed.where(F.col(order).isNotNull())
    for k in keys:
        placed = placed.where(F.col(k).isNotNull())
    aggregates = [latest(~alive).alias("__gone"), latest(replaces).alias("__replaced"), *(setter(f).alias(f"__of_{f}") for f in fields)]
    if not fields:
        aggregates.append(latest(alive).alias("__set"))
    folded = placed.groupBy(*keys).agg(*aggregates)

    numbers = [F.col(f"__of_{f}.no") for f in fields] or [F.col("__set")]
    made = F.greatest(*numbers) if len(numbers) > 1 else numbers[0]
    living = folded.withColumn("__made", made).where("__made is not null and (__gone is null or __made > __gone)")
    barrier = F.greatest("__gone", "__replaced")

    def kept(field: str) -> Column:
        of = F.col(f"__of_{field}")
        return F.when(barrier.isNull() | (of["no"] >= barrier), of["v"]).alias(field)

    born = F.when(F.col("__gone").isNull() | (F.col("__replaced") > F.col("__gone")), F.col("__replaced"))
    return living.select(*keys, *(kept(f) for f in fields), F.col("__made").alias("last_no"), born.alias("born_no"))
