"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, free_name, sized

#: A source's seeded order is cut into so many buckets, and the bucket on its edge again, LEVELS times in all.
FAN, LEVELS = 1024, 3


def water_fill(sizes: DataFrame, epochs: float = 3.0) -> DataFrame:
    """Adds ``target`` to (source_size, weight): shares of the total by weight, at most ``epochs`` sizes each.

    Each round clamps the sources whose share passes their cap and deals what is left to the others by weight;
    a round moves two sums to the driver and the loop ends when none is clamped anew. Sizes of 0 get target 0.
    """
    sizes = sizes.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        clamped = F.col("cap") <= F.col("weight") * F.lit(level)
        full, weight = sizes.agg(F.sum(F.when(clamped, F.col("cap")).otherwise(0.0)), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight")))).first()
        higher = (total - full) / weight if weight else 0.0
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return sizes.withColumn("target", F.least("cap", F.col("weight") * F.lit(level))).drop("cap")


def word_count(text: Column) -> Column:
    """The words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_ranks(sizes: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of each ``s`` from 0 by code point, null last; numbered by ranges, so no task has them all."""
    at = checkpoint(sizes.repartitionByRange("s").withColumn("_part", F.spark_partition_id()))
    parts = at.groupBy("_part").agg(F.count("*").alias("_n"), F.max(F.col("s").isNull().cast("int")).alias("_null"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    whole = Window.partitionBy()
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_all"), F.max("_null").over(whole).alias("_any"))
    rows = at.join(F.broadcast(parts), "_part")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(F.col("s").asc_nulls_first())) - 1
    rank = F.when(F.col("s").isNull(), F.col("_all") - 1).otherwise(rank - F.col("_any"))
    return rows.withColumn("rank", rank).drop("_part", "_before", "_all", "_any")


def _bucket(at: Column, level: int) -> Column:
    """The bucket of a place in the seeded order; each level cuts one bucket of the level above into FAN."""
    return F.floor(F.pmod(at, F.lit(2**31)) / F.lit(2.0**31 / FAN**level)).cast("long")


def mix_plan(slim: DataFrame, weights: tuple[float, ...], epochs: float) -> DataFrame:
    """A row per source: its size, target, whole repetitions, and where the fractional one ends. ``slim`` has s, id, size and at."""
    sizes = checkpoint(slim.groupBy("s").agg(F.sum("size").alias("source_size")))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sizes = source_ranks(sizes).withColumn("weight", F.element_at(cycle, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    plan = water_fill(checkpoint(sizes.drop("rank")), epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = checkpoint(plan.withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size")))
    # The words before each bucket of the seeded order come from sums that are made before anything moves.
    left, edge = slim, plan.select(F.col("s").alias("es"), F.col("rest").alias("need"))
    for level in range(1, LEVELS + 1):
        here = F.col("s").eqNullSafe(F.col("es"))
        if level > 1:
            here &= _bucket(F.col("at"), level - 1) == F.col("edge")
        left = left.join(sized(edge), here).select("s", "id", "size", "at", "need")
        sums = left.groupBy("s", _bucket(F.col("at"), level).alias("bucket")).agg(F.sum("size").alias("here"), F.first("need").alias("need"))
        upto = F.sum("here").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        over = sums.withColumn("upto", upto).filter("upto > need").groupBy("s").agg(F.min(F.struct("bucket", "upto", "here", "need")).alias("x"))
        edge = checkpoint(over.select(F.col("s").alias("es"), F.col("x.bucket").alias("edge"), (F.col("x.need") - F.col("x.upto") + F.col("x.here")).alias("need")))
        left = left.drop("need")
    # Only what is left of the bucket on a source's edge is ordered row by row; rows equal in every respect stand together.
    left = left.join(sized(edge), F.col("s").eqNullSafe(F.col("es")) & (_bucket(F.col("at"), LEVELS) == F.col("edge")))
    rows = left.groupBy("s", "at", "id").agg(F.sum("size").alias("here"), F.count("*").alias("equal"), F.first("need").alias("need"))
    upto = F.sum("here").over(Window.partitionBy("s").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = rows.withColumn("upto", upto).filter("upto > need").groupBy("s").agg(F.min(F.struct("at", "id", "upto", "here", "equal", "need")).alias("x"))
    missing = F.round((F.col("x.need") - F.col("x.upto") + F.col("x.here")) / F.col("x.equal")).cast("long")
    last = last.select(F.col("s").alias("ls"), _bucket(F.col("x.at"), LEVELS).alias("edge"), F.struct("x.at", "x.id").alias("edge_at"), missing.alias("missing"))
    plan = plan.join(last, F.col("s").eqNullSafe(F.col("ls")), "left")
    return checkpoint(plan.select("s", "source_size", "target", "whole", "edge", "edge_at", "missing"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    epochs: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
    out: str = "mix",
) -> DataFrame:
    """Adds ``out`` to ``docs``: struct<size, source_size, target, repeats, taken>, sizes in words.

    Sources are ordered by code point, null last as a source of its own, and get the weights in turn. A source
    whose target is k + f of its size takes every document k times (repeats), and once more those that come first in a
    seeded order of the source until f of its words are reached; of the document on that edge, only as many words
    as are missing. So taken adds up to the rounded target, and no document passes ``epochs`` times its size.

    The seeded order is a hash of id and text, so reruns and other partitionings agree. Repeated rows stand at the
    same place; on the edge, they share its words evenly. Null and empty texts have size 0 and take 0, a null id is an id like
    others, whole texts count. An empty table gives an empty result. The columns of ``docs`` stay; if one is called ``out``,
    the new one gets an underscore more.
    """
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(source_col).alias("s"),
        F.col(id_col).alias("id"),
        word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("at"),
    )
    plan = mix_plan(checkpoint(rows.select("s", "id", "size", "at")), weights, epochs)
    found = rows.join(sized(plan.withColumnRenamed("s", "ps")), F.col("s").eqNullSafe(F.col("ps")))
    here, at = _bucket(F.col("at"), LEVELS), F.struct("at", "id")
    extra = (
        F.when(F.col("edge").isNull() | (here < F.col("edge")), F.col("size"))
        .when(here > F.col("edge"), F.lit(0))
        .when(at < F.col("edge_at"), F.col("size"))
        .when(at == F.col("edge_at"), F.least("size", "missing"))
        .otherwise(F.lit(0))
    )
    taken = (F.col("whole") * F.col("size") + extra).cast("long")
    mix = F.struct("size", "source_size", "target", F.col("whole").alias("repeats"), taken.alias("taken"))
    return found.select("row.*", mix.alias(free_name(docs, out)))
