"""What several operators share: checkpoints, words, held-out rows and connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.storage import checkpoint, loop_checkpoint

__all__ = ["bounded_sample", "checkpoint", "connected_components", "free_name", "held_out", "loop_checkpoint", "lower_ascii", "sized", "table", "words"]

#: ASCII white space, as a Java regular expression.
WHITE = r"[\x20\x09-\x0D]+"
#: A word is a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null, empty or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda x: x != "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def free_name(df: DataFrame, *names: str) -> str | list[str]:
    """Each name, with as many underscores appended as make it differ from the columns of df, regardless of case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found if len(found) > 1 else found[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents that no model learns from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def bounded_sample(df: DataFrame, key: list[str], most: int, seed: int) -> DataFrame:
    """About ``most`` rows (all, if there are no more), chosen by a seeded hash of ``key``.

    A row's fate depends only on its key and the row count, so reruns agree, and nothing is sorted or moved.
    """
    total = df.count()
    if total <= most:
        return df
    share = int(most / total * 2**31)
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), F.lit(2**31)) < share)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", store: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """(node, root) for every node that a link joins to another; root is the component's smallest node.

    Each round hooks every node to its smallest neighbour, follows the chains this makes to their roots, and rewrites the
    links between those roots, so the graph shrinks at least by half. Minima are taken by partial aggregation, and
    the joins are plain equi-joins of stored tables, whose hot keys Spark splits.
    Null ends and links of a node to itself are ignored; without links the result is empty. ``store`` keeps the tables of a round.
    """
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a is not null and b is not null and a <> b")
    edges = store(edges.distinct())
    total = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        parent = store(parent)
        while True:  # every chain of parents is halved until all nodes know their root
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            higher = store(parent.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            parent = higher.select("node", "root")
            if higher.filter("moved").isEmpty():
                break
        if total is None:
            total = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            total = total.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            total = store(total)
        ends = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        edges = edges.join(ends, "a").select("b", "ra")
        ends = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(ends, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = store(edges.distinct())
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    return total


def sized(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, marked for a broadcast if its count proves it to have ``most`` rows or fewer; else left to a shuffle.

    For stored tables of a few numbers or short strings a row, as it counts them first.
    """
    return F.broadcast(df) if df.count() <= most else df
