"""Near-deduplication: groups of near SimHash fingerprints, and near copies by their exact similarity.

Two fingerprints of 64 bits within two bits share at least one value within one bit of both; so every fingerprint emits
the values within one bit of it, and those within two bits meet on a common value. A group of equal fingerprints sends
one leader, so a value gathers at most 65 rows, whatever the number of copies.

Near copies start from these groups: each text is compared to the leader of its group by its exact similarity. No ball of two bits reaches every pair
of a similarity of 0.8, so an exact way by shingles finds the links that are left: see ``near_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, checkpoint, connected_components, loop_checkpoint, sized

_ODD = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Another 64 bits from each hash and its number; k = 0 keeps the hash itself."""
    with np.errstate(over="ignore"):
        z = h + k.astype(np.uint64) * np.uint64(_ODD)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.where(k == 0, h, z ^ (z >> np.uint64(31)))


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, A-Z in lower case, repeats included."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)], np.uint64)
    runs = zip(*(found[k:] for k in range(size)), strict=False)
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(run), 42) for run in runs), np.uint64, len(found) - size + 1)


def sketch_of(text: str | None, size: int) -> list[int]:
    """One signed 64-bit word; a bit is set if more than half of the shingles have it set."""
    h = shingle_hashes(text or "", size)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        part = h[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return [int(np.packbits(counts * 2 > len(h)).view(">i8")[0])]


def sketch(text: Column, size: int = 5) -> Column:
    """The sketch of each text as array<bigint>; null and empty texts have all bits zero."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([sketch_of(x, size) for x in texts])

    return of(text)


def simhash_near_dups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    bits: int = 64,
    tables: int = 1,
    distance: int = 2,
    store: Callable[[DataFrame], DataFrame] = checkpoint,
) -> DataFrame:
    """(id, sketch, component_id) for every row of ``docs``: component_id is the smallest id of its group.

    The links are exactly the pairs of fingerprints within ``distance`` bits, which can be two at most. Only one table of
    64 bits is exact, so no other is taken.

    Null and empty texts have a sketch of zeros and so form one group. Repeated rows stay repeated. Rows with a
    null id get the group's smallest id, or null if no row of the group has one. Further columns are ignored. ``store`` keeps tables between the steps.
    """
    if (bits, tables) != (64, 1) or not 0 <= distance <= 2:
        raise ValueError("links are exact only with one table of 64 bits and a distance of 2 or less")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = store(rows.select("id", sketch(F.col("text"), size).alias("sketch")))
    same = rows.groupBy("sketch").agg(F.min("id").alias("id"))
    node = store(same.withColumn("node", F.monotonically_increasing_id()))  # small numbers, stored once
    links = _links(node.select("node", "sketch"), distance, store)
    roots = connected_components(links, store=store)
    ids = node.join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    least = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    found = store(node.select("node", "sketch").join(ids.select("node", "root"), "node").join(least, "root").select("sketch", "component_id"))
    return rows.join(found, "sketch").select("id", "sketch", "component_id")


def _links(node: DataFrame, distance: int, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) between nodes, by way of leaders. Rows that move hold a key and a node; sketches join the few pairs that meet."""
    masks = F.array(*[F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)]])
    ball = node.select("node", F.explode(F.transform(masks, lambda m: F.col("sketch")[0].bitwiseXOR(m))).alias("value"))
    first = Window.partitionBy("value").orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = ball.withColumn("a", F.first("node").over(first)).filter("a <> node").select("a", F.col("node").alias("b"))
    met = store(met.distinct())
    met = met.join(node.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(node.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    return met.filter(F.expr("bit_count(x[0] ^ y[0])") <= distance).select("a", "b")


def shingle_tokens(text: str | None, size: int) -> np.ndarray:
    """The shingles as a set: of a shingle that occurs m times, its hash and m - 1 more. A text without words has one token, 0.

    Tokens are 48 bits of the hashes, as these rows are most of what moves: two texts of 1,000 shingles share one by chance once in
    200 million pairs, and a token that meets by chance only adds a pair to verify.
    """
    h = np.sort(shingle_hashes(text or "", size))
    if not len(h):
        return np.zeros(1, np.int64)
    at = np.arange(len(h))
    k = at - np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]], at, 0))
    return (_mixed(h, k) >> np.uint64(16)).view(np.int64)


def _tokens(rows: DataFrame, size: int) -> DataFrame:
    """(node, n, token) of rows (node, text): n tokens of each text. A few texts at a time, to keep the workers small.

    A task takes a node once, however many copies of its text it reads.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = [k for k, node in enumerate(batch.column(0).to_pylist()) if node not in seen and not seen.add(node)]
            batch = batch.take(pa.array(new, pa.int64()))
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [shingle_tokens(x, size) for x in part.column(1).to_pylist()]
                n = np.array([len(x) for x in found], np.int32)
                node = np.repeat(np.array(part.column(0).to_pylist(), np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.repeat(n, n)), pa.array(np.concatenate(found))], ["node", "n", "token"])

    return rows.mapInArrow(of, "node long, n int, token long")


def _least_shared(similarity: float) -> Column:
    """Tokens that a text of n tokens must share with any text of at least this similarity."""
    return F.ceil(F.col("n") * similarity - 1e-9)


#: Texts of the sample in which frequent tokens are looked for, how many of these a frequent token is in, and how many tokens are counted in this way.
SAMPLE, FREQUENT, MOST_FREQUENT = 20_000, 100, 100_000


def _frequent_counts(texts: DataFrame, size: int, frequent: np.ndarray) -> DataFrame:
    """(token, df_, least_, most_) of the given tokens, sorted: how many rows have them, and the smallest and largest node. A task sums up what it reads."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, least, most = np.zeros(len(frequent), np.int64), np.full(len(frequent), 2**63 - 1), np.full(len(frequent), -(2**63))
        seen: set[int] = set()
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                tokens = shingle_tokens(text.as_py(), size)
                at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                at = at[frequent[at] == tokens]
                n[at] += 1
                least[at], most[at] = np.minimum(least[at], node), np.maximum(most[at], node)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (frequent, n, least, most)], ["token", "n", "a", "b"])

    rows = texts.mapInArrow(of, "token long, n long, a long, b long")
    return rows.groupBy("token").agg(F.sum("n").alias("df_"), F.min("a").alias("least_"), F.max("b").alias("most_"))


def _candidates(docs: DataFrame, text_col: str, size: int, similarity: float) -> DataFrame:
    """(node, n, tokens) of the texts that share enough tokens with others: n counts all, tokens holds the shared ones, the rarest first.

    A token's rows are counted where they meet, in one shuffle; those of the tokens that are frequent in a sample of texts are counted by partial
    sums before and then dealt out, so that no task gets them. Both counts are exact, whatever the sample.
    """
    texts = docs.select(F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text"))
    some = _tokens(bounded_sample(texts, ["node"], SAMPLE, 1), size).groupBy("token").agg(F.count("*").alias("k")).filter(F.col("k") >= FREQUENT)
    frequent = np.sort(np.array([r["token"] for r in some.orderBy(F.desc("k"), "token").limit(MOST_FREQUENT).collect()], np.int64))
    rows, known = _tokens(texts, size).withColumn("part", F.lit(0)), len(frequent) > 0
    if known:
        counts = checkpoint(_frequent_counts(texts, size, frequent))
        rows = rows.join(sized(counts, MOST_FREQUENT), "token", "left").withColumn("part", F.when(F.col("df_").isNotNull(), F.pmod("node", F.lit(4096))).otherwise(0))
    by = Window.partitionBy("token", "part")
    for name, met in (("df", F.count("*")), ("least", F.min("node")), ("most", F.max("node"))):
        rows = rows.withColumn(name, F.coalesce(f"{name}_", met.over(by)) if known else met.over(by))
    rows = rows.filter("least <> most").groupBy("node").agg(F.first("n").alias("n"), F.collect_set(F.struct("df", "token")).alias("tokens"))
    rows = rows.filter(F.size("tokens") >= _least_shared(similarity))
    return rows.select("node", "n", F.array_sort("tokens")["token"].alias("tokens"))


def _alike(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is ``similarity`` or more.

    Merge joins, as tokens of copies look small when compressed, and Spark would send them to the driver for a broadcast.
    """
    x = texts.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("tokens").alias("x"))
    y = texts.select(F.col("node").alias("b"), "n", F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").filter(both >= (F.col("m") + F.col("n") - both) * similarity - 1e-9).select("a", "b")


def near_copies(docs: DataFrame, text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, root) of every text with a near copy; node is xxhash64 of the text, root the smallest of its group.

    Texts are linked if the weighted Jaccard similarity of their shingles, a shingle's weight being its count, is
    ``similarity`` or more. The first token, in order of rarity, that two such texts share is among the rarest
    n - ceil(similarity * n) + 1 of each, and even the rarest n - ceil(2 similarity / (1 + similarity) * n) + 1 of the one with fewer
    tokens (prefix filter, which loses nothing): there they meet, if what is left of both suffices. Texts without words are
    alike. Before that, each text is compared to the leader of its SimHash group, and to one of the texts with the same most frequent token, and of those
    with the same one in the middle, which joins the bulk of large groups by a row a text. Where a token still has many groups, leaders are compared to the rest first, until these have
    joined; then all pairs of different groups are.
    """
    texts = checkpoint(_candidates(docs, text_col, size, similarity))
    named = docs.select(F.xxhash64(text_col).alias("node"), F.col(text_col).alias("text"))
    groups = simhash_near_dups(named, "node", "text", size, store=loop_checkpoint).select(F.col("id").alias("node"), F.col("component_id").alias("token"))
    links = _first_links(texts, groups.distinct(), similarity)
    prefix = F.size("tokens") - _least_shared(similarity) + 1
    met = texts.select("node", "n", F.size("tokens").alias("size"), F.posexplode(F.slice("tokens", F.lit(1), prefix.cast("int"))).alias("k", "token"))
    small = F.col("k") <= F.col("size") - _least_shared(2 * similarity / (1 + similarity))
    met = met.select("token", "node", F.col("node").alias("root"), "n", (F.col("size") - F.col("k")).alias("rest"), small.alias("small"))
    left, share = checkpoint(_merged(checkpoint(met), links)), similarity / (1 + similarity)
    best, turn, stale = math.inf, 0, 0
    while True:
        left, cross = _apart(left)
        if not cross:
            break
        stale = 0 if cross < best / 2 else stale + 1
        last = cross <= (16 if stale else 4) * left.count() or stale == 3  # leaders that join no more groups: these texts are unlike
        pairs = loop_checkpoint((_across(left, share) if last else _led(left, turn, share)).distinct())
        found = _alike(pairs, texts, similarity)
        links = loop_checkpoint(links.union(found))
        if last:
            break
        left = _merged(left, links)
        best, turn = min(best, cross), turn + 1
    return connected_components(links, store=loop_checkpoint)


def _first_links(texts: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(a, b), stored: texts that are alike, by one comparison of each text for its SimHash group (node, token) and for two of its tokens, the most
    frequent one and the one in the middle."""
    places = F.array_distinct(F.array(F.size("tokens"), F.floor(F.size("tokens") / 2 + 1).cast("int")))
    rows = texts.select("node", F.explode(F.transform(places, lambda k: F.element_at("tokens", k))).alias("token"))
    grouped = groups.join(texts.select("node").hint("merge"), "node").select("node", "token", F.lit(True).alias("sketched"))
    rows = loop_checkpoint(rows.withColumn("sketched", F.lit(False)).unionByName(grouped))
    lead = rows.groupBy("sketched", "token").agg(F.min("node").alias("a"))
    pairs = rows.join(lead.hint("merge"), ["sketched", "token"]).filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    return loop_checkpoint(_alike(loop_checkpoint(pairs), texts, similarity))


def _apart(left: DataFrame) -> tuple[DataFrame, int]:
    """The rows of tokens in which some text meets a smaller one of another group, and the number of such pairs."""
    sizes = left.groupBy("token", "root").agg(F.count("*").alias("k"), F.count_if("small").alias("m"))
    sizes = sizes.groupBy("token").agg((F.sum("k") * F.sum("m") - F.sum(F.col("k") * F.col("m"))).alias("pairs")).filter("pairs > 0")
    sizes = loop_checkpoint(sizes)
    cross = sizes.agg(F.sum("pairs")).first()[0]
    return loop_checkpoint(left.join(sizes.select("token").hint("merge"), "token")), int(cross or 0)


def _enough(rest: str, n: str, other_rest: str, other_n: str, share: float) -> Column:
    """Whether two texts that share this token first can share enough of them."""
    return F.least(rest, other_rest) >= (F.col(n) + F.col(other_n)) * share - 1e-9


def _merged(left: DataFrame, links: DataFrame) -> DataFrame:
    """left with groups joined along the links: each root is hung under the smallest one that a link leads to, and chains are cut twice.

    Longer chains are joined in later turns; groups only spare comparisons, and the components are found at the end.
    """
    of = left.select("node", "root").distinct()
    columns = left.columns
    ends = links.join(of.toDF("a", "ra"), "a").join(of.toDF("b", "rb"), "b").filter("ra <> rb")
    hung = loop_checkpoint(ends.groupBy(F.greatest("ra", "rb").alias("root")).agg(F.min(F.least("ra", "rb")).alias("up")))
    for _ in range(2):
        hung = hung.join(hung.toDF("up", "above"), "up", "left").select("root", F.coalesce("above", "up").alias("up"))
    return left.join(hung, "root", "left").withColumn("root", F.coalesce("up", "root")).select(*columns)


def _led(left: DataFrame, turn: int, share: float) -> DataFrame:
    """(a, b): the pairs of a token's leader, one of its smaller texts and another one each turn, and its texts of other groups."""
    first = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root", "n", "rest"))
    lead = left.filter("small").groupBy("token").agg(first.alias("x"))
    lead = lead.select("token", F.col("x.root").alias("of"), F.col("x.node").alias("a"), F.col("x.n").alias("m"), F.col("x.rest").alias("r"))
    return left.join(lead.hint("merge"), "token").filter((F.col("root") != F.col("of")) & _enough("rest", "n", "r", "m", share)).select("a", F.col("node").alias("b"))


def _across(left: DataFrame, share: float) -> DataFrame:
    """(a, b): all pairs of a token's smaller texts with texts of other groups; a group is never joined to itself.

    Groups meet first, and only those of which some texts can share enough.
    """
    of = lambda rows, g: rows.groupBy("token", F.col("root").alias(g)).agg(F.max("rest").alias(f"{g}_rest"), F.min("n").alias(f"{g}_n"))
    both = of(left.filter("small"), "r").join(of(left, "s"), "token").filter((F.col("r") != F.col("s")) & _enough("r_rest", "r_n", "s_rest", "s_n", share))
    x = left.filter("small").select("token", F.col("root").alias("r"), F.col("node").alias("x"), F.col("n").alias("xn"), F.col("rest").alias("xr"))
    y = left.select("token", F.col("root").alias("s"), F.col("node").alias("y"), F.col("n").alias("yn"), F.col("rest").alias("yr"))
    rows = both.select("token", "r", "s").join(x.hint("merge"), ["token", "r"]).join(y.hint("merge"), ["token", "s"]).filter(_enough("xr", "xn", "yr", "yn", share))
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group of near copies; of rows with equal id, each stays.

    A group whose ids are all null stays whole. A row goes by its id and its text, so rows that share an id, or have
    none, and hold other texts aren't touched. Texts are known by a hash of 64 bits; where a second hash tells that texts share it, their rows stay.
    """
    groups = near_copies(docs, text_col, **options)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("node"), F.xxhash64(F.lit(1), text_col).alias("other"))
    rows = checkpoint(rows.join(groups, "node", "left").select("id", "node", "other", F.coalesce("root", "node").alias("root")))
    shared = rows.groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y")).filter("x <> y").select("node")
    rows = rows.join(sized(checkpoint(shared)), "node", "left_anti")
    least = rows.groupBy("root").agg(F.min("id").alias("least"))
    others = rows.join(least, "root").filter("least is not null and not (id <=> least)")
    gone = checkpoint(others.select(F.col("id").alias("_gone"), F.col("node").alias("_hash")).distinct())
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & (F.xxhash64(docs[text_col]) == gone["_hash"]), "left_anti")
