"""Joins of snapshots, objects, pointers and inventories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.merge import merged_text

from . import scans as R


def compare_snapshots(left: DataFrame, right: DataFrame, path: str, value: str, allowed: DataFrame | None = None) -> DataFrame:
    """(path, before, after, change) of every path that differs between two snapshots; both sides meet in one aggregation.

    A path is in a snapshot once, so rows are dealt out by path before they are grouped; null is a value like any other. ``value`` may be a struct, of mode and content, say. ``allowed`` has paths that may differ.
    """
    rows = left.select(path, F.lit(True).alias("_old"), F.col(value).alias("_v")).unionAll(right.select(path, F.lit(False), F.col(value)))
    one = lambda old: F.max(F.when(F.col("_old") == old, F.struct("_v")))
    rows = rows.repartition(path).groupBy(path).agg(one(True).alias("_b"), one(False).alias("_a")).filter(~F.col("_b").eqNullSafe(F.col("_a")))
    if allowed is not None:
        rows = rows.join(allowed.select(path).distinct(), path, "left_anti")
    what = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted").otherwise("changed")
    return rows.select(path, F.col("_b._v").alias("before"), F.col("_a._v").alias("after"), what.alias("change"))


def inventory_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two inventories has, repeats counted: one aggregation over both sides."""
    columns = before.columns
    both = before.withColumn("_n", F.lit(1)).unionAll(after.select(*columns).withColumn("_n", F.lit(-1)))
    rows = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    rows = rows.withColumn("side", F.when(F.col("_n") > 0, "before").otherwise("after"))
    return rows.withColumn("_x", F.explode(F.sequence(F.lit(1), F.abs("_n")))).select(*columns, "side")


def inventory_report(diff: DataFrame, order: list[str], most: int = 20) -> DataFrame:
    """(side, rows, and the columns of ``order``) of an ``inventory_diff``: how many rows a side has alone, and the first ``most`` of them."""
    counts = diff.groupBy("side").agg(F.count("*").alias("rows"))
    first = [diff.filter(F.col("side") == s).select("side", *order).orderBy(*order).limit(most) for s in ("before", "after")]
    return first[0].unionAll(first[1]).join(F.broadcast(counts), "side")  # a row for each side


def cas_check(pointers: DataFrame, objects: DataFrame) -> DataFrame:
    """Pointers (path, oid, size) without an object, or with one of another size."""
    rows = pointers.join(objects.select("oid", F.col("size").alias("have")), "oid", "left")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("have") != F.col("size"), "wrong-size")
    return rows.withColumn("problem", problem).filter("problem is not null").select("path", "oid", "problem")


def carry_pointers(base: DataFrame, changed: DataFrame, parsed: DataFrame, path: str) -> DataFrame:
    """The pointer map of the next snapshot: what did not change, and what the changed paths hold now."""
    return base.join(changed.select(path).distinct(), path, "left_anti").unionByName(parsed)


def evictable(objects: DataFrame, ledger: DataFrame, backups: DataFrame, dirty: DataFrame) -> DataFrame:
    """Why each object (oid, seen) may not go, or ``evict``: the server has it, a later backup exists, it is not dirty."""
    newest = backups.agg(F.max("at").alias("backup"))
    rows = objects.join(ledger.select("oid").distinct().withColumn("on_server", F.lit(True)), "oid", "left")
    rows = rows.join(dirty.select("oid").distinct().withColumn("is_dirty", F.lit(True)), "oid", "left").crossJoin(F.broadcast(newest))
    why = F.when(F.col("is_dirty"), "dirty").when(F.col("on_server").isNull(), "not-on-server").when(F.coalesce(F.col("backup") <= F.col("seen"), F.lit(True)), "no-backup-since").otherwise("evict")
    return rows.select("oid", why.alias("decision"))


def evict_until(objects: DataFrame, key: str, order: list[str], size: str, limit: int) -> DataFrame:
    """Per key, the objects to evict, oldest first, until what is left is within ``limit``; order must be unique within a key."""
    totals = objects.groupBy(F.col(key).alias("_key")).agg(F.sum(size).alias("_total")).filter(F.col("_total") > limit)
    rows = R.plain(R.running_sum(R.ranges(objects, [key], order), [key], order, F.col(size), "_gone", inclusive=False))
    rows = rows.join(totals, F.col(key).eqNullSafe(F.col("_key")))
    return rows.filter(F.col("_total") - F.col("_gone") > limit).drop("_gone", "_total", "_key")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, path: str, value: str) -> DataFrame:
    """What a merge does with each path that a side changed; null is a value like any other. A path is in a side once, so rows are dealt out first."""
    part = lambda df, n: df.select(path, F.lit(n).alias("_n"), F.col(value).alias("_v"))
    one = lambda n: F.max(F.when(F.col("_n") == n, F.struct("_v")))
    rows = part(base, 0).unionAll(part(ours, 1)).unionAll(part(theirs, 2)).repartition(path).groupBy(path).agg(one(0).alias("b"), one(1).alias("o"), one(2).alias("t"))
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    what = (
        F.when(same("o", "t"), F.when(same("b", "o"), "unchanged").otherwise("same"))
        .when(same("b", "o"), "theirs")
        .when(same("b", "t"), "ours")
        .when(F.col("o").isNull() | F.col("t").isNull(), "delete-modify")
        .otherwise("conflict")
    )
    return rows.select(path, what.alias("action")).filter("action <> 'unchanged'")


def sidecar_status(sources: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Whether the derived text of each source is there and up to date."""
    rows = sources.select("path", F.col("sha").alias("now")).join(sidecars.select("path", F.col("sha").alias("then")), "path", "full_outer")
    what = F.when(F.col("now").isNull(), "orphan").when(F.col("then").isNull(), "missing").when(F.col("now") == F.col("then"), "skipped").otherwise("hash-changed")
    return rows.select("path", what.alias("status"))


def seeded_sample(rows: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """T5: n rows by a seeded hash; the same ones whenever the keys are the same."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), *key).limit(n)


def cap(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """Flags the rows within the cap of each key; the others stay as explicit overflow. Order must be unique within a key."""
    found = R.plain(R.numbered(R.ranges(rows, [key], order), [key], order, "_n"))
    return found.withColumn("within", F.col("_n") <= most).drop("_n")


def union_merge(rows: DataFrame, base: str, ours: str, theirs: str, out: str) -> DataFrame:
    """Rows with ``out``, the three-way merge of texts, line by line, in which both sides' lines stay where both changed the same place.

    What only one side changed, deletions included, is taken from it; of what both changed, lines in common come once and others in the order
    ours, theirs. A null text counts as empty. A text is one file, so one row by nature.
    """

    @F.pandas_udf("string")
    def of(b: pd.Series, o: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([merged_text(x or "", y or "", z or "") for x, y, z in zip(b, o, t, strict=True)], dtype=object)

    return rows.withColumn(out, of(base, ours, theirs))
