"""Benchmark decontamination by SimHash windows of the items' sizes. DataFrame functions only.

A window is as many words of a document as an item has. Windows and items of a size meet if any block of their
fingerprints agrees: with one block more than the radius, every pair within it does. Pairs that meet are verified by
their exact weighted shingle similarity. Windows that share no shingle with an item of their size have a similarity of
0, so only those are fingerprinted that start where shared shingles start, or align one with its place in an item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lower_ascii, sized, words

#: Bits in which fingerprints may differ, and blocks of 3 bits, of which then at least one agrees. At a similarity of 0.8
#: fingerprints of 64 bits differ by 9.7 bits on average and by more than 20 once in 10,000 pairs.
RADIUS, BLOCKS = 20, 21


def _shingles(w: Column, size: int) -> Column:
    """The hash of each run of ``size`` words; of fewer words, the whole sequence's."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
    return F.when(F.size(w) > 0, F.transform(starts, lambda k: F.xxhash64(F.slice(w, k, size)))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(hashes: Column) -> Column:
    """SimHash of 64 bits: a bit is set if more than half of the hashes have it set."""
    masks = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    half = F.size(hashes) / 2
    count = lambda m: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.when(h.bitwiseAND(m) != 0, 1).otherwise(0))
    return F.aggregate(masks, F.lit(0).cast("long"), lambda acc, m: acc.bitwiseOR(F.when(count(m) > half, m).otherwise(F.lit(0).cast("long"))))


def similarity(x: Column, y: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingle hashes, a shingle's weight being its count."""
    times = lambda a, h: F.size(F.filter(a, lambda z: z == h))
    both = F.aggregate(F.array_distinct(y), F.lit(0), lambda n, h: n + F.least(times(x, h), times(y, h)))
    return both / (F.size(x) + F.size(y) - both)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """(doc, item_id, start_word, n_words, similarity) of the most similar window of each document and item.

    doc is struct<id, text>, the id and the text's hash, so that texts which share an id are told apart; equal rows
    count as one. Words are compared without case (A-Z). ``start_word`` counts from 0; of equal windows among those that
    are compared, the first. Texts that are null or without words match nothing; a document shorter than an item has one window,
    all of it. Items of fewer words than ``size`` match windows with the same words. Null ids are kept as null. Whole texts
    count, however long; empty tables give an empty result; further columns of either table are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words(lower_ascii(F.col(item_text_col))).alias("iw")).filter(F.size("iw") > 0)
    items = items.withColumn("n", F.size("iw")).withColumn("ih", _shingles(F.col("iw"), size)).dropDuplicates(["item_id", "iw"])
    items = checkpoint(items.select("item_id", "n", "ih", fingerprint(F.col("ih")).alias("ifp")).withColumn("no", F.monotonically_increasing_id()))
    short = [r["n"] for r in items.filter(F.col("n") < size).select("n").distinct().collect()]
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text")).alias("doc"), F.col(text_col).alias("text"))
    split = words(lower_ascii(F.col("text"))).alias("w")
    places = checkpoint(items.select("n", F.posexplode("ih").alias("ik", "h")).distinct())
    windows = None
    for length in [*short, size]:
        some = places.filter(F.col("n") == length if length < size else F.col("n") >= size)
        starts = checkpoint(_starts(rows.select("doc", split), sized(some), length))
        found = rows.join(sized(starts), "doc").select("doc", "n", "starts", split).select("doc", "n", "w", F.explode("starts").alias("start"))
        found = found.select("doc", "start", "n", _shingles(F.slice("w", F.col("start") + 1, F.col("n")), length).alias("wh"))
        windows = found if windows is None else windows.union(found)
    windows = checkpoint(windows.withColumn("fp", fingerprint(F.col("wh"))).withColumn("at", F.monotonically_increasing_id()))
    blocks = lambda fp: F.array(*[F.expr(f"shiftrightunsigned({fp}, {3 * k}) & 7") for k in range(BLOCKS)])
    left = windows.select("at", "n", "fp", F.posexplode(blocks("fp")).alias("block", "bits"))
    right = sized(checkpoint(items.select("no", "n", "ifp", F.posexplode(blocks("ifp")).alias("block", "bits"))), 200_000)
    met = left.join(right, ["n", "block", "bits"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select("at", "no").distinct()
    met = met.join(windows.select("at", "doc", "start", "wh"), "at").join(sized(items.select("no", "item_id", "n", "ih"), 20_000), "no")
    met = met.withColumn("similarity", similarity(F.col("wh"), F.col("ih"))).filter(F.col("similarity") >= threshold)
    best = met.groupBy("doc", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("less"), "start", "n")).alias("x"))
    return best.select("doc", "item_id", F.col("x.start").alias("start_word"), F.col("x.n").alias("n_words"), (-F.col("x.less")).alias("similarity"))


def _starts(rows: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(doc, n, starts): where windows of n words are laid.

    A window can be moved to the right until it starts with a shared shingle, without losing any, and back to the first
    shingle of that run, which gains on the left what it loses on the right; so the starts of runs suffice. Alignments
    are for texts that repeat a shingle more often than the item.
    """
    # The words are left behind before shingles are laid out as rows; the outer form, as the plain one repeats the shingling in a filter.
    hits = rows.select("doc", F.size("w").alias("total"), _shingles(F.col("w"), length).alias("dh"))
    hits = hits.select("doc", "total", F.posexplode_outer("dh").alias("dk", "h")).join(places, "h")
    inside = lambda x: F.greatest(F.least(x, F.col("total") - F.col("n")), F.lit(0))
    hits = hits.groupBy("doc", "n", "total").agg(F.array_sort(F.collect_set("dk")).alias("dk"), F.collect_set(inside(F.col("dk") - F.col("ik"))).alias("aligned"))
    runs = F.filter("dk", lambda x, k: ~F.get("dk", k - 1).eqNullSafe(x - 1))
    return hits.select("doc", "n", F.array_distinct(F.concat("aligned", F.transform(runs, inside))).alias("starts"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which ``find_leaks`` finds nothing, as they are.

    A row goes by its id and text, so of rows that share an id only those with the leak go, and repeated rows go or stay
    together. Rows with a null or empty text stay, and so does every row if the benchmark is empty.
    """
    gone = checkpoint(find_leaks(docs, benchmark, id_col, text_col, **options).select("doc").distinct())
    gone = gone.select(F.col("doc.id").alias("_id"), F.col("doc.text").alias("_hash"))
    here = docs[id_col].eqNullSafe(gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_hash"])
    return docs.join(sized(gone, 300_000), here, "left_anti")
