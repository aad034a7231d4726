"""Changes to a tree: what they touch, which rules they break, and what has to be made anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as X


def changed_paths(staged: DataFrame, unstaged: DataFrame, untracked: DataFrame) -> DataFrame:
    """(store, path, topology) of every path changed in any way; topology if it was added or deleted somewhere.

    The inputs have (store, path, status), status being A, D, M or ?.
    """
    rows = staged.unionByName(unstaged).unionByName(untracked)
    return rows.groupBy("store", "path").agg(F.bool_or(F.col("status").isin("A", "D", "?")).alias("topology"))


def enrich_need(pages: DataFrame, body_hash: str, fields: list[str]) -> DataFrame:
    """(store, path, reason, fields) of the pages with a field to fill.

    A field with a stamp (``<field>_stamp``) is up to date if the stamp is the body's hash, else hash-stale. Without
    one, a value is a person's and stays, and no value is missing. A page's reason is missing if any field's is.
    """
    blank = lambda c: X.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    why = lambda f: F.when(~blank(f"{f}_stamp"), F.when(X.trim(F.col(f"{f}_stamp")) != F.col(body_hash), "hash-stale")).when(blank(f), "missing")
    rows = pages.withColumn("_why", F.array_compact(F.array(*[F.when(why(f).isNotNull(), F.struct(F.lit(f).alias("f"), why(f).alias("why"))) for f in fields])))
    reason = F.when(F.exists("_why", lambda x: x["why"] == "missing"), "missing").otherwise("hash-stale")
    return rows.filter(F.size("_why") > 0).select("store", "path", reason.alias("reason"), F.array_join(F.transform("_why", lambda x: x["f"]), ",").alias("fields"))


def attribute_project(slugs: DataFrame, id_col: str, slug: str, projects: DataFrame) -> DataFrame:
    """The longest project (column ``project``) that starts a slug at a hyphen; null if none does.

    A slug emits its prefixes and meets projects by equality, so that neither side need be small.
    """
    parts = F.split(F.col(slug), "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
    rows = slugs.select(id_col, F.explode_outer(prefixes).alias("project")).join(projects.select("project").distinct().withColumn("_known", F.lit(True)), "project", "left")
    return rows.groupBy(id_col).agg(F.max_by(F.when(F.col("_known"), F.col("project")), F.when(F.col("_known"), F.length("project"))).alias("project"))


def shortest_unique_prefix(names: DataFrame, name: str, least: int) -> DataFrame:
    """(name, prefix): the shortest prefix of ``least`` characters or more that no other name has; null if none.

    Every name emits its prefixes and they are counted, so that common beginnings are summed up before they move.
    """
    rows = names.select(F.col(name).alias("n")).filter("n is not null").distinct()
    lengths = F.sequence(F.lit(least), F.greatest(F.length("n"), F.lit(least)))
    cut = rows.select("n", F.explode(F.transform(F.filter(lengths, lambda k: k <= F.length("n")), lambda k: F.substring(F.col("n"), F.lit(1), k))).alias("p"))
    lone = cut.groupBy("p").agg(F.count("*").alias("k"), F.min("n").alias("n")).filter("k = 1")
    best = lone.groupBy("n").agg(F.min_by("p", F.length("p")).alias("prefix"))
    return rows.join(best, "n", "left").select(F.col("n").alias(name), "prefix")


def get_pages(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(store, wanted, path): the file a short name means: itself, with .md, or the folder's index; null if there is none.

    A name may be store:path, which looks into that store.
    """
    form = r"\A([a-z][a-z0-9]*(?:-[a-z0-9]+)*):(.+)\z"
    other = F.col("wanted").rlike(form)
    rows = wanted.select("store", "wanted", F.when(other, F.regexp_extract("wanted", form, 1)).otherwise(F.col("store")).alias("_in"), F.when(other, F.regexp_extract("wanted", form, 2)).otherwise(F.col("wanted")).alias("_name"))
    ways = F.array(F.col("_name"), F.concat("_name", F.lit(".md")), F.concat("_name", F.lit("/README.md")))
    rows = rows.select("store", "wanted", "_in", F.posexplode(ways).alias("rank", "path"))
    rows = rows.join(files.select(F.col("store").alias("_in"), "path").distinct().withColumn("_there", F.lit(True)), ["_in", "path"], "left")
    return rows.groupBy("store", "wanted").agg(F.min_by(F.when(F.col("_there"), F.col("path")), F.when(F.col("_there"), F.col("rank"))).alias("path"))


def with_pointer_flag(got: DataFrame, pages: DataFrame) -> DataFrame:
    """The found (store, path) with content and whether that is a large-file pointer."""
    rows = got.join(pages.select("store", "path", "content"), ["store", "path"], "left")
    return rows.withColumn("is_pointer", X.parse_pointer(F.col("content")).isNotNull())


def strip_candidates(history: DataFrame, final: DataFrame) -> DataFrame:
    """(blob, both_kinds) of the blobs at large-file paths that the final map lacks; a blob at both kinds of paths is flagged.

    ``history`` has (blob, large), a row for each path that ever held the blob.
    """
    kinds = history.groupBy("blob").agg(F.bool_or("large").alias("_large"), F.bool_or(~F.col("large")).alias("both_kinds"))
    return kinds.filter("_large").join(final.select("blob").distinct(), "blob", "left_anti").select("blob", "both_kinds")


def drift_counts(expected: DataFrame, actual: DataFrame, key: list[str], value: str) -> DataFrame:
    """How many of the expected rows are created, changed or unchanged, and whether a check passes."""
    rows = expected.select(*key, F.col(value).alias("_e")).join(actual.select(*key, F.col(value).alias("_a"), F.lit(True).alias("_there")), key, "left")
    new, same = F.col("_there").isNull(), F.col("_there") & F.col("_e").eqNullSafe(F.col("_a"))
    out = rows.agg(F.count("*").alias("total"), F.count_if(new).alias("created"), F.count_if(same).alias("unchanged"))
    out = out.withColumn("changed", F.col("total") - F.col("created") - F.col("unchanged"))
    return out.withColumn("clean", F.col("total") == F.col("unchanged"))


def differing_rows(expected: DataFrame, actual: DataFrame, key: list[str], value: str) -> DataFrame:
    """K1: the rows to write, with a flag for new ones; rows that are there already are not written again."""
    rows = expected.join(actual.select(*key, F.col(value).alias("_a"), F.lit(True).alias("_there")), key, "left")
    rows = rows.filter(F.col("_there").isNull() | ~F.col(value).eqNullSafe(F.col("_a")))
    return rows.withColumn("created", F.col("_there").isNull()).drop("_a", "_there")


#: The largest plain file that passes, and the largest without a warning, in bytes.
PLAIN_CAP, PLAIN_WARNING = 32 * 2**20, 10 * 2**20


def judge_changes(changes: DataFrame, junk: Column, freezes: DataFrame | None = None, freeze_id: str = "") -> DataFrame:
    """(store, commit, path, rule, level) of every rule that a change breaks.

    ``changes`` has (store, commit, path, size, large); ``junk`` tells names that nobody wants; ``freezes`` are the few
    current freezes (store, id), a null store meaning all, of which ``freeze_id`` is let through. They go to the changes, as there are few stores and many changes.
    """
    plain = ~F.coalesce("large", F.lit(False))
    level = lambda rule, name: F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("level"))
    found = [
        F.when(plain & (F.col("size") > PLAIN_CAP), level("plain-size", "violation")).when(plain & (F.col("size") > PLAIN_WARNING), level("plain-size", "warning")),
        F.when(junk, level("junk-name", "violation")),
    ]
    rows = changes
    if freezes is not None:
        frozen = freezes.filter(F.col("id") != freeze_id).select("store").distinct().withColumn("_frozen", F.lit(True))
        everywhere = frozen.filter("store is null").agg((F.count("*") > 0).alias("_all"))
        rows = rows.join(F.broadcast(frozen), "store", "left").crossJoin(F.broadcast(everywhere))
        found.append(F.when(F.col("_all") | F.coalesce("_frozen", F.lit(False)), level("freeze", "violation")))
    rows = rows.select("store", "commit", "path", F.explode_outer(F.array_compact(F.array(*found))).alias("x")).filter("x is not null")
    return rows.select("store", "commit", "path", "x.rule", "x.level")


def change_summary(judged: DataFrame) -> DataFrame:
    """Broken rules by rule and level, with the number of commits."""
    return judged.groupBy("rule", "level").agg(F.count("*").alias("paths"), F.count_distinct("commit").alias("commits"))


def retention_plan(snapshots: DataFrame, tagged: Column, at: str, clock_started: int | None, retention_days: int, now: int) -> DataFrame:
    """Tagged snapshots with ``state`` and whether to ``forget`` each. Times are in seconds.

    Without a clock nothing goes; before the deadline all is kept; then those from before the clock's start go.
    """
    rows = snapshots.filter(tagged)
    if clock_started is None:
        return rows.withColumns({"state": F.lit("clock-not-started"), "forget": F.lit(False)})
    if now < clock_started + retention_days * 86_400:
        return rows.withColumns({"state": F.lit("keeping"), "forget": F.lit(False)})
    forget = F.coalesce(F.col(at) < clock_started, F.lit(False))
    left = rows.agg((F.count_if(forget) > 0).alias("_left"))
    rows = rows.withColumn("forget", forget).crossJoin(F.broadcast(left))
    return rows.withColumn("state", F.when(F.col("_left"), "expired").otherwise("deleted")).drop("_left")


def final_map(files: DataFrame, cache: DataFrame, key: list[str], content: str) -> DataFrame:
    """Every file with its oid and blob name: the cache's where ``key`` (path, size, time, inode) is as it was, else the hashes of
    its content."""
    rows = files.join(cache.select(*key, F.col("oid").alias("_oid"), F.col("blob").alias("_blob") if "blob" in cache.columns else F.lit(None).cast("string").alias("_blob")).distinct(), key, "left")
    data = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    rows = rows.withColumn("hashed", F.col("_oid").isNull()).withColumn("oid", F.coalesce("_oid", F.sha2(data, 256)))
    return rows.withColumn("blob", F.coalesce("_blob", X.blob_sha1(data))).drop("_oid", "_blob")


def unique_totals(mapped: DataFrame, size: str) -> DataFrame:
    """(files, objects, bytes) of a final map; an object counts once, however many files hold it."""
    once = mapped.groupBy("oid").agg(F.count("*").alias("_n"), F.max(size).alias("_s"))
    return once.agg(F.sum("_n").alias("files"), F.count("*").alias("objects"), F.sum("_s").alias("bytes"))


def write_if_changed(spark: SparkSession, expected: DataFrame, folder: str, key: list[str], value: str, check: bool = False) -> DataFrame:
    """K1: writes the rows of ``expected`` whose value differs from what ``folder`` holds, and reports (key..., created) of each.

    What is there is the last write of each key; a write appends a new part, so a run that fails leaves the old state, and
    one that finds no difference writes nothing. With ``check`` nothing is written.
    """
    schema = expected.select(*key, value).withColumn("_at", F.lit(0).cast("long")).schema
    there = spark.read.schema(schema).option("mode", "PERMISSIVE").parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], schema)
    last = there.groupBy(*key).agg(F.max_by(value, "_at").alias(value), F.max("_at").alias("_at"))
    turn = last.agg(F.max("_at")).first()[0]
    rows = differing_rows(expected.select(*key, value), last, key, value)
    if not check:
        rows.select(*key, value, F.lit((turn or 0) + 1).cast("long").alias("_at")).write.mode("append").parquet(folder)
        written = spark.read.schema(schema).parquet(folder).filter(F.col("_at") == (turn or 0) + 1)
        return written.join(last.select(*key, F.lit(True).alias("_old")), key, "left").select(*key, F.col("_old").isNull().alias("created"))
    return rows.select(*key, "created")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def alarm_counts(changes: DataFrame, key: str, since: str, now: int, age: int) -> DataFrame:
    """Per key, the changes older than ``age`` seconds that are still open, and since when."""
    old = F.col(since) <= now - age
    rows = changes.groupBy(key).agg(F.count("*").alias("open"), F.count_if(old).alias("overdue"), F.min(since).alias("oldest"))
    return rows.withColumn("alarm", F.col("overdue") > 0)
