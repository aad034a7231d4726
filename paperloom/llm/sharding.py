"""Sharding by a minimax contiguous partition: the smallest capacity for which the groups, in a fixed order, fit into the shards.

Groups of equal texts are kept together; their order is that of their hash. The capacity is found by binary search, each try by one greedy
pass over the sums of pieces, which are ranges of hashes. Spark sums the pieces; those in which a cut can fall are split until the
capacity is exact, so the driver holds a bounded number of sums and never the groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, free_name, sized

#: Ranges of hashes that are summed first.
FIRST_BITS = 12
#: New pieces that a round of splitting makes at most, and groups that are fetched one by one.
MOST_PIECES = 1 << 16


@dataclass
class ShardPlan:
    """Hashes of groups with a shard of their own, first of all; then the smallest hash of each further shard but the first (none: empty)."""

    alone: list[int]
    bounds: list[int | None]
    capacity: int

    def shard(self, h: Column) -> Column:
        """The shard of a text by its hash."""
        own = F.lit(len(self.alone))
        for b in self.bounds:
            own = own + (F.when(h >= b, 1).otherwise(0) if b is not None else F.lit(0))
        for k, x in enumerate(self.alone):
            own = F.when(h == x, k).otherwise(own)
        return own.cast("int")


class Pieces:
    """Ranges of hashes in order: all hashes x with x >> shift equal to prefix; the size, number and largest size of their groups."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows.assign(start=[int(p) << int(s) for p, s in zip(rows["prefix"], rows["shift"], strict=True)]).sort_values("start", ignore_index=True)
        self.size, self.top = (self.rows[c].to_numpy(np.int64) for c in ("size", "top"))
        self.ends = np.concatenate([[0], np.cumsum(self.size)])

    def fill(self, capacity: int, shards: int, loose: bool) -> list[int]:
        """Where shards end that are filled one after the other. Shards end where pieces do or, if ``loose``, anywhere in a piece
        but inside its largest group, wherever that lies: ends can't come later than these.
        """
        at, found = 0, []
        for _ in range(shards):
            k = int(np.searchsorted(self.ends, at + capacity, "right")) - 1
            end = int(self.ends[k])
            if loose and k < len(self.size):
                rest, size, top = at + capacity - end, int(self.size[k]), int(self.top[k])
                end += size - top if size - top < rest < top else rest
            at = max(at, end)
            found.append(at)
        return found

    def least_capacity(self, shards: int, loose: bool) -> int:
        """The smallest capacity with which the shards take everything."""
        total = int(self.ends[-1])
        low, high = max(-(-total // shards), int(self.top.max(initial=0))), max(total, 1)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fill(mid, shards, loose)[-1] == total else (mid + 1, high)
        return low

    def unsure(self, low: int, high: int, shards: int) -> np.ndarray:
        """Which pieces of several groups a cut can fall into, for capacities from low to high."""
        found = np.zeros(len(self.size), bool)
        for a, b in zip(self.fill(low, shards, False), self.fill(high, shards, True), strict=True):
            found |= (self.ends[:-1] < b) & (self.ends[1:] > a)
        return found & (self.rows["count"].to_numpy() > 1)

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Ends of all shards but the last, as numbers of pieces: each as near to an equal share of the rest as the capacity allows."""
        total = int(self.ends[-1])
        least = [len(self.size)]  # the earliest end of each shard for which the capacity suffices for those after it
        for _ in range(shards - 1):
            least.insert(0, int(np.searchsorted(self.ends, self.ends[least[0]] - capacity, "left")))
        at, found = 0, []
        for k in range(shards - 1):
            most = int(np.searchsorted(self.ends, self.ends[at] + capacity, "right")) - 1
            share = self.ends[at] + (total - self.ends[at]) / (shards - k)
            near = int(np.searchsorted(self.ends, share, "left"))
            if near > 0 and share - self.ends[near - 1] < self.ends[min(near, len(self.size))] - share:
                near -= 1
            at = min(max(near, least[k], at), most)
            found.append(at)
        return found


def _summed(groups: DataFrame, shift: int) -> pd.DataFrame:
    prefix = F.shiftright("h", shift).alias("prefix")
    found = groups.groupBy(prefix).agg(F.sum("size").alias("size"), F.count("*").alias("count"), F.max("size").alias("top")).toPandas()
    return found.astype({"prefix": "int64", "size": "int64", "count": "int64", "top": "int64"}).assign(shift=shift)


def _split(groups: DataFrame, opened: pd.DataFrame, most: int) -> pd.DataFrame:
    """The pieces that ``opened`` ones fall into: single groups if there are few enough, else ranges of fewer bits."""
    bits = max(1, (most // len(opened)).bit_length() - 1)
    found = []
    for shift, part in opened.groupby("shift"):
        some = groups.sparkSession.createDataFrame(part[["prefix"]])
        here = groups.withColumn("prefix", F.shiftright("h", int(shift))).join(F.broadcast(some), "prefix").select("h", "size")  # at most ``most`` rows
        found.append(_summed(here, 0 if opened["count"].sum() <= most else max(0, int(shift) - bits)))
    return pd.concat(found, ignore_index=True)


def plan_shards(groups: DataFrame, shards: int, most: int = MOST_PIECES) -> ShardPlan:
    """Cuts rows (h, size), one for each group and stored, into shards.

    A group that is as large as an equal share of what is left gets a shard of its own: no capacity can be smaller, and nothing is put beside
    it. The others are cut by the smallest capacity. With few groups, some shards may stay empty.
    """
    total = groups.agg(F.sum("size")).first()[0] or 0
    alone, rest, left = [], total, shards
    for r in groups.orderBy(F.desc("size"), "h").limit(shards - 1).collect():
        if left > 1 and r["size"] * left >= rest:
            alone.append(r["h"])
            rest, left = rest - r["size"], left - 1
    groups = groups.filter(~F.col("h").isin(alone)) if alone else groups
    pieces = Pieces(_summed(groups, 64 - FIRST_BITS))
    while True:
        low, high = pieces.least_capacity(left, loose=True), pieces.least_capacity(left, loose=False)
        unsure = pieces.unsure(low, high, left)
        if low == high or not unsure.any():
            break
        finer = _split(groups, pieces.rows[unsure], most)
        pieces = Pieces(pd.concat([pieces.rows[~unsure].drop(columns="start"), finer], ignore_index=True))
    starts = pieces.rows["start"].tolist()
    return ShardPlan(alone, [starts[k] if k < len(starts) else None for k in pieces.cuts(high, left)], high)


def shard_documents(docs: DataFrame, shards: int = 8, text_col: str = "text", keep: list[str] | None = None, most: int = MOST_PIECES) -> DataFrame:
    """The columns ``keep`` of docs (None: all) with ``placed``: struct<size, text_crc32, shard, slot>.

    size is the text's bytes in UTF-8 and one more, text_crc32 their checksum; a null text counts as one without bytes. Rows of equal text get the
    same shard; a shard's rows have the slots from 0 on, without a gap, in the order of the stored rows. Shards are as near to equal in bytes as whole
    groups of equal texts allow, so one that holds a group larger than an equal share is larger, whatever the method. Rows, repeated ones included, stay
    as they are, an empty table stays empty, and if a column is called ``placed``, the new one gets an underscore more.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    keep = docs.columns if keep is None else keep
    out, size, crc, h, part, own, slot, before = free_name(docs, "placed", "size", "crc", "h", "part", "own", "slot", "before")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, (F.octet_length(text) + 1).cast("long").alias(size), F.crc32(text.cast("binary")).alias(crc), F.xxhash64(text).alias(h))
    rows = checkpoint(rows)
    plan = plan_shards(checkpoint(rows.groupBy(F.col(h).alias("h")).agg(F.sum(size).alias("size"))), shards, most)
    # Rows are numbered within their stored partition, which no shard, however large, exceeds.
    rows = rows.withColumns({own: plan.shard(F.col(h)), part: F.spark_partition_id(), slot: F.monotonically_increasing_id()})
    counts = checkpoint(rows.groupBy(part, own).agg(F.count("*").alias("n")))
    earlier = Window.partitionBy(own).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = checkpoint(counts.select(part, own, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before)))
    number = F.row_number().over(Window.partitionBy(part, own).orderBy(slot)) - 1
    rows = rows.withColumn(slot, number).join(sized(counts), [part, own])
    placed = F.struct(F.col(size).alias("size"), F.col(crc).alias("text_crc32"), F.col(own).alias("shard"), (F.col(before) + F.col(slot)).alias("slot"))
    return rows.select(*keep, placed.alias(out))


def write_shards(placed: DataFrame, path: str, files: int = 1, column: str = "placed") -> None:
    """Writes the rows as Parquet, a folder for each shard, with the rows of a file in the order of their slots.

    ``files`` is about how many files a shard gets; its rows are dealt to them by ranges of slots, so no task writes a whole large shard.
    """
    rows = placed.select("*", F.col(f"{column}.shard").alias("shard"), F.col(f"{column}.slot").alias("slot"))
    shards = rows.agg(F.max("shard")).first()[0]
    if shards is None:
        return
    rows = rows.repartitionByRange((shards + 1) * files, "shard", "slot").sortWithinPartitions("shard", "slot")
    rows.drop("slot").write.partitionBy("shard").mode("overwrite").parquet(path)
