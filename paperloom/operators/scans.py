"""Running sums, numbers and predecessors within keys, for keys that may hold any share of the rows.

Rows are cut into ranges by key and order, so that a large key is many ranges. A range sums what it has of each key; what its key has in earlier ranges is
added to the sums within the range. Only keys that go on from an earlier range need that, at most one for each range, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.storage import checkpoint

_RANGE, _BEFORE = "_range", "_before"


def ranges(rows: DataFrame, key: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """rows, stored in ranges of (key, order), with the number of their range. Rows that are equal in both share a range."""
    by = [*key, *order]
    cut = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    return checkpoint(cut).withColumn(_RANGE, F.spark_partition_id())


def _joined(rows: DataFrame, sums: DataFrame, key: list[str]) -> DataFrame:
    """rows with what ``sums`` (key, range, before) say; there is at most one row for each range in it, so it is broadcast."""
    sums = sums.select(F.col(_RANGE).alias("_r"), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(key)], _BEFORE)
    same = F.col(_RANGE) == F.col("_r")
    for n, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return rows.join(F.broadcast(sums), same, "left").drop("_r", *[f"_k{n}" for n in range(len(key))])


def running_sum(ranged: DataFrame, key: list[str], order: list[str], value: Column, out: str, inclusive: bool = True) -> DataFrame:
    """``ranges`` with ``out``: the sum of ``value`` over the rows of the key up to this one; ``order`` must be unique within a key."""
    sums = ranged.groupBy(*key, _RANGE).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*key).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = checkpoint(sums.withColumn(_BEFORE, F.sum("_sum").over(earlier)).filter(F.col(_BEFORE).isNotNull()))
    within = Window.partitionBy(*key, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = _joined(ranged.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0))), sums, key)
    return rows.withColumn(out, F.col(out) + F.coalesce(_BEFORE, F.lit(0))).drop(_BEFORE)


def numbered(ranged: DataFrame, key: list[str], order: list[str], out: str) -> DataFrame:
    """``ranges`` with the number of each row within its key, from 1 on."""
    return running_sum(ranged, key, order, F.lit(1).cast("long"), out)


def previous(ranged: DataFrame, key: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``ranges`` with ``out``: the value of the key's row before this one, null for the first."""
    last = ranged.groupBy(*key, _RANGE).agg(F.max(F.struct(*order, F.col(value).alias("_v")))["_v"].alias("_v"))
    earlier = Window.partitionBy(*key).orderBy(_RANGE)
    last = last.withColumn(_BEFORE, F.lag(F.struct("_v")).over(earlier)).filter(F.col(_BEFORE).isNotNull())
    within = Window.partitionBy(*key, _RANGE).orderBy(*order)
    rows = ranged.withColumn("_lag", F.lag(F.struct(F.col(value).alias("_v"))).over(within))
    return _joined(rows, checkpoint(last), key).withColumn(out, F.coalesce("_lag", _BEFORE)["_v"]).drop("_lag", _BEFORE)


def plain(ranged: DataFrame) -> DataFrame:
    """The rows without their ranges."""
    return ranged.drop(_RANGE)
