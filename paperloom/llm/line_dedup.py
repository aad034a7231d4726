"""Line deduplication over whole corpora by a deletion-neighbourhood join. DataFrame functions only.

A line is its sequence of words. Lines within an edit of one word (one replaced, added or missing) of an earlier
line count as repeats of it. Every line that can have such a neighbour emits a hashed key for each word left out: with
the place of the gap for replaced words, and as a bag of words, beside the whole line's bag, for added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WORD, checkpoint, free_name, sized, words


def _key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text"))


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, line, raw) of every line that has ``min_words`` words or more."""
    # The outer form, as the plain one splits the text once more in a filter.
    rows = docs.select("doc", F.posexplode_outer(F.split(F.col("text"), "\n")).alias("line", "raw"))
    return rows.filter(_long(F.col("raw"), min_words))


def _long(line: Column, min_words: int) -> Column:
    """Whether a line has so many words; the match ends with the last word that is needed."""
    if min_words < 1:
        return line.isNotNull()
    return line.rlike(rf"(?:{WORD}{WHITE}){{{min_words - 1}}}[^\x20\x09-\x0D]")


def _worded(lines: DataFrame) -> DataFrame:
    return lines.withColumn("words", words(F.col("raw"))).withColumn("w", F.size("words"))


def _halves() -> Column:
    """Keys that two lines within one word of each other must share: a half that the edit leaves alone.

    For a length n, of the shorter line, either the first n // 2 words agree, or the last n - n // 2 words; a line of w
    words can be the shorter one of two (n = w) or the longer one (n = w - 1).
    """
    keys = []
    for n in (F.col("w"), F.col("w") - 1):
        half = F.floor(n / 2).cast("int")
        keys.append(F.xxhash64(F.lit(0), n, F.slice("words", F.lit(1), half)))
        keys.append(F.xxhash64(F.lit(1), n, F.slice("words", F.col("w") - (n - half) + 1, n - half)))
    return F.array(*keys)


def near_pairs(lines: DataFrame) -> DataFrame:
    """(later, earlier) ids of lines within one word, of (id, words, w) with unique ids; ids are ordered.

    Of the lines that differ in the same place, each pairs with the earliest; of a line and those with a word more,
    the line pairs with each. So a line has an earlier neighbour exactly if it is ``later`` in some pair.
    """
    at = lambda f: F.transform(F.col("words"), f)
    xor = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))
    rows = lines.withColumn("placed", at(lambda x, k: F.xxhash64(F.lit(2), x, k))).withColumn("bag", at(lambda x: F.xxhash64(F.lit(3), x)))
    rows = rows.withColumn("all_placed", xor(F.col("placed"))).withColumn("all_bag", xor(F.col("bag")))
    rows = checkpoint(rows.select("id", "words", "w", "placed", "bag", "all_placed", "all_bag"))
    gap = rows.select("id", "w", "all_placed", F.posexplode("placed").alias("k", "h"))
    gap = gap.select("id", F.xxhash64(F.lit(4), "w", "k", F.col("all_placed").bitwiseXOR(F.col("h"))).alias("key"))
    first = gap.groupBy("key").agg(F.min("id").alias("earlier"), F.count("*").alias("n")).filter("n > 1").select("key", "earlier")
    replaced = gap.join(first, "key").filter("id > earlier").select(F.col("id").alias("later"), "earlier").distinct()
    less = rows.select("id", (F.col("w") - 1).alias("w"), "all_bag", F.explode("bag").alias("h"))
    less = less.select(F.col("id").alias("long"), F.xxhash64("w", F.col("all_bag").bitwiseXOR(F.col("h"))).alias("key"))
    whole = rows.select(F.col("id").alias("short"), F.xxhash64("w", "all_bag").alias("key"))
    added = less.join(whole, "key").select(F.greatest("long", "short").alias("later"), F.least("long", "short").alias("earlier")).distinct()
    pairs = checkpoint(replaced.union(added).distinct())
    text = rows.select("id", "words")
    pairs = pairs.join(text.withColumnsRenamed({"id": "later", "words": "x"}), "later").join(text.withColumnsRenamed({"id": "earlier", "words": "y"}), "earlier")
    return pairs.filter(within_one(F.col("x"), F.col("y"))).select("later", "earlier")


def within_one(x: Column, y: Column) -> Column:
    """Whether an edit of one word, or none, turns one array into the other."""
    unlike = F.filter(F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b)), lambda d: d)
    start = F.coalesce(F.array_position(F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b)), True), F.lit(0)).cast("int")
    start = F.greatest(start, F.lit(1))
    longer = F.when(F.size(x) > F.size(y), x).otherwise(y)
    shorter = F.when(F.size(x) > F.size(y), y).otherwise(x)
    rest = lambda a, k: F.slice(a, k, F.greatest(F.size(a) - k + 1, F.lit(0)))
    same = F.size(x) == F.size(y)
    return F.when(same, F.size(unlike) <= 1).when(F.size(longer) - F.size(shorter) == 1, rest(longer, start + 1) == rest(shorter, start))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 6, exact_words: int | None = None) -> DataFrame:
    """Every row of ``docs`` with repeated lines taken out of its text, and with _lines and _kept, their counts.

    Documents are ordered by id, nulls last, and by a hash of the text where ids are equal; lines by their place. The edit
    bound grows with the line, one word from ``min_words`` words on: a line of ``min_words``
    words or more is dropped if it equals an earlier line of the corpus, or differs from the first occurrence of an earlier line by one word. A shorter line
    of ``exact_words`` words or more (1: every line that isn't blank; left out: none) is dropped if it equals an earlier one. Other
    lines stay. White space within and around a kept line stays as it is.

    Rows equal in id and text count as one document and get the same result. A null text stays null, an empty one
    empty, both with one line or none: _lines is 0 for null and 1 for empty. An empty table gives an empty result, whole
    texts count. The other columns of ``docs`` stay as they are; where one is called _lines or _kept, the new one gets an underscore more.
    """
    keyed = docs.select(F.col(id_col), F.col(text_col)).select(_key(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    least = min_words if exact_words is None else min(max(exact_words, 1), min_words)
    lines = _lines(keyed, least)
    place = F.struct("doc", "line").alias("id")
    halves = F.when(F.col("w") >= min_words, _halves()).otherwise(F.array().cast("array<bigint>"))
    seen = _worded(lines).select(F.xxhash64(F.lit(5), "words").alias("h"), F.xxhash64(F.lit(6), "words").alias("g"), place, halves.alias("halves"))
    firsts = checkpoint(seen.groupBy("h", "g").agg(F.min(F.struct("id", "halves")).alias("x")).select("h", "g", "x.id", "x.halves"))
    halves = firsts.select("h", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    chosen = halves.join(shared, "half").select("h").distinct()
    chosen = checkpoint(firsts.join(chosen, "h").select("id.doc", "id.line"))
    told = sized(chosen.withColumnsRenamed({"doc": "d", "line": "l"}), 300_000)
    near = lines.join(told, (F.col("doc") == F.col("d")) & (F.col("line") == F.col("l")))
    near = _worded(near.select(place, "raw").dropDuplicates(["id"])).drop("raw")
    later = near_pairs(near).select(F.col("later").alias("id")).distinct()
    kept = firsts.select("id").join(checkpoint(later), "id", "left_anti")
    kept = checkpoint(kept.groupBy("id.doc").agg(F.collect_list("id.line").alias("_at")))
    doc, of, at, split, stay, n_lines, n_kept = free_name(docs, "_doc", "_of", "_at", "_split", "_stay", "_lines", "_kept")
    rows = docs.withColumn(doc, _key(id_col, text_col))
    rows = rows.join(kept.withColumnsRenamed({"doc": of, "_at": at}), F.col(doc) == F.col(of), "left")
    rows = rows.withColumn(split, F.split(F.col(text_col), "\n"))
    # Places of lines that stay: those that are kept, and those that are never looked at. Sorted and read off, so long texts take linear time.
    places = F.sequence(F.lit(0), F.size(split) - 1)
    short = F.filter(places, lambda k: ~_long(F.element_at(split, k + 1), least))
    stays = F.array_sort(F.concat(F.coalesce(at, F.array().cast("array<int>")), short))
    rows = rows.withColumn(stay, F.when(F.col(split).isNotNull(), F.transform(stays, lambda k: F.element_at(split, k + 1))))
    rows = rows.withColumn(n_lines, F.coalesce(F.array_size(split), F.lit(0))).withColumn(n_kept, F.coalesce(F.array_size(stay), F.lit(0)))
    rows = rows.withColumn(text_col, F.array_join(stay, "\n"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], n_lines, n_kept)
