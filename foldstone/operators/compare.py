"""Differences between two copies of the same data, field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by ``order`` (NULLs least); partially aggregated before the shuffle."""
    picked = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("__row")).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in columns))


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Null-safe full outer join on ``keys``: one row per key with ``status`` and ``diffs``.

    ``status`` is ``missing_<right>``, ``missing_<left>``, ``differs`` or ``same``; ``diffs`` is an array of
    (field, left value, right value), values as text, of the fields that are not null-safe equal (NULL differs
    from any value, not from NULL). Both sides must be normalised and unique on ``keys``. NULL keys match
    NULL keys. Two empty sides give no rows. Columns beyond ``keys`` and ``fields`` are ignored, and may clash.

    NULL-safe matching stays an equi-join: Spark turns ``<=>`` into a hash key, so nothing is broadcast or
    nested; the two aggregations that make the sides unique already are partitioned on the same keys.
    """
    l = left.select(*(F.col(k).alias(f"__l_{k}") for k in keys), F.struct(*fields).alias("__l"), F.lit(True).alias("__in_l"))
    r = right.select(*(F.col(k).alias(f"__r_{k}") for k in keys), F.struct(*fields).alias("__r"), F.lit(True).alias("__in_r"))
    on = [F.col(f"__l_{k}").eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    joined = l.join(r, on, "full_outer")

    def diff(field: str) -> Column:
        a, b = F.col(f"__l.{field}"), F.col(f"__r.{field}")
        return F.when(~a.eqNullSafe(b), F.struct(F.lit(field).alias("field"), a.cast("string").alias("left_value"), b.cast("string").alias("right_value")))

    both = F.col("__in_l").isNotNull() & F.col("__in_r").isNotNull()
    diffs = F.when(both, F.array_compact(F.array(*(diff(f) for f in fields)))).otherwise(F.array_compact(F.array(*(F.when(F.lit(False), diff(f)) for f in fields))))
    out = joined.select(*(F.when(F.col("__in_l").isNotNull(), F.col(f"__l_{k}")).otherwise(F.col(f"__r_{k}")).alias(k) for k in keys), "__in_l", "__in_r", diffs.alias("diffs"))
    status = (
        F.when(F.col("__in_r").isNull(), f"missing_{names[1]}")
        .when(F.col("__in_l").isNull(), f"missing_{names[0]}")
        .when(F.size("diffs") > 0, "differs")
        .otherwise("same")
    )
    return out.select(*keys, status.alias("status"), "diffs")


def difference_lines(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One line per key missing on a side and per differing field: ``keys``, ``diff``."""
    lines = F.when(F.col("status") == "differs", F.transform("diffs", lambda d: d["field"])).otherwise(F.array("status"))
    return compared.where(F.col("status") != "same").select(*keys, F.explode(lines).alias("diff"))
