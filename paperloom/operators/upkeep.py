"""Backups, drills, checks of rewritten histories, alarms over scans, and when a routine may retire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import paths as Q

from . import scans
from .snapshots import cas_check, compare_snapshots, union_merge

HOUR, DAY = 3_600, 86_400


def commit_origin(commits: DataFrame, states: DataFrame) -> DataFrame:
    """(commit, message, from_server): the oldest state that holds each commit, and whether a fetch wrote it.

    ``states`` has (commit, ord, message), a row for each commit that a state holds; larger ord are older. A commit that no
    state holds is this clone's own.
    """
    oldest = states.groupBy("commit").agg(F.max_by("message", "ord").alias("message"))
    rows = commits.select("commit").distinct().join(oldest, "commit", "left")
    return rows.withColumn("from_server", F.col("message").isNotNull() & (F.col("message") != "update by push"))


def sampled(rows: DataFrame, key: list[str], group: list[str], most: int, seed: int) -> DataFrame:
    """T5: up to ``most`` rows of each group by a seeded hash, the same ones whenever the keys are. Ranked within buckets of
    the hash first, so that no task ranks a whole group."""
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in key])
    rows = rows.withColumn("_h", h).withColumn("_b", F.pmod("_h", F.lit(256)))
    few = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", *key))).filter(F.col("_r") <= most)
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_h", *key))).filter(F.col("_r") <= most)
    return few.drop("_h", "_b", "_r")


def restore_drill(restored: DataFrame, live: DataFrame, floor: int, most: int, seed: int) -> DataFrame:
    """(snapshot, required, available, sampled, matched, result) of comparing hashes of a sample with what is live.

    ``restored`` has (snapshot, path, sha), ``live`` (path, sha). A drill fails on a sample below its floor, on fewer files than
    are live, or on any other hash.
    """
    total = live.agg(F.count("*").alias("live"))
    counts = restored.groupBy("snapshot").agg(F.count("*").alias("available"))
    picked = sampled(restored, ["path"], ["snapshot"], most, seed).join(live.select("path", F.col("sha").alias("_sha")), "path", "left")
    same = picked.groupBy("snapshot").agg(F.count("*").alias("sampled"), F.count_if(F.col("sha") == F.col("_sha")).alias("matched"))
    rows = counts.join(same, "snapshot", "left").crossJoin(F.broadcast(total))
    rows = rows.withColumn("required", F.least(F.lit(floor).cast("long"), "live"))
    good = (F.col("sampled") >= F.col("required")) & (F.col("matched") == F.col("sampled")) & (F.col("available") >= F.col("live"))
    return rows.select("snapshot", "required", "available", "sampled", "matched", F.when(good, "ok").otherwise("failed").alias("result"))


def verify_rewrite(before: DataFrame, after: DataFrame, pointers: DataFrame, objects: DataFrame, known: DataFrame) -> DataFrame:
    """(check, path) of everything that a rewrite got wrong: other trees, missing or wrong objects, names outside the final map.

    ``before`` and ``after`` have (path, blob) by composed path, ``pointers`` (path, oid, size), ``objects`` (oid, size), ``known`` (oid).
    """
    trees = compare_snapshots(before, after, "path", "blob").select(F.concat(F.lit("tree-"), "change").alias("check"), "path")
    cas = cas_check(pointers, objects).select(F.concat(F.lit("object-"), "problem").alias("check"), "path")
    outside = pointers.join(known.select("oid").distinct(), "oid", "left_anti").select(F.lit("oid-outside-map").alias("check"), "path")
    return trees.union(cas).union(outside)


def sampled_commits(commits: DataFrame, odd: DataFrame, ends: int = 50, most: int = 200, seed: int = 1) -> DataFrame:
    """(store, commit, place) of the commits (store, commit, ord) to verify: the first and last ``ends`` by order, ``most`` at random of
    those between, and all of ``odd`` (store, commit); orders are unique within a store, and places count from 1.
    """
    ranged = scans.ranges(commits.select("store", "commit", "ord"), ["store"], ["ord"])
    rows = scans.plain(scans.numbered(ranged, ["store"], ["ord"], "place")).join(commits.groupBy("store").agg(F.count("*").alias("n")), "store")
    edge = (F.col("place") <= ends) | (F.col("place") > F.col("n") - ends)
    # The seeded choice ranks a few times as many as it needs, so no store is ranked whole.
    share = F.pmod(F.xxhash64(F.lit(seed), "store", "commit"), F.lit(1 << 30)) / F.lit(1 << 30)
    few = rows.filter(~edge).withColumn("_h", share).filter(F.col("_h") * (F.col("n") - 2 * ends) < 4 * most + 100)
    by = Window.partitionBy("store").orderBy("_h", "commit")
    picked = few.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= most).select("store", "commit", "place")
    return rows.filter(edge).select("store", "commit", "place").union(picked).union(rows.join(odd, ["store", "commit"], "left_semi").select("store", "commit", "place")).distinct()


def history_faults(picked: DataFrame, renamed: DataFrame, before: DataFrame, after: DataFrame, allowed: DataFrame) -> DataFrame:
    """(check, store, commit, path) of what a rewrite got wrong in the commits ``picked`` (store, commit), by their old names.

    ``renamed`` has (store, commit, new), ``before`` and ``after`` are trees (store, commit, path, mode, blob), of old and new names, and
    ``allowed`` the paths (store, path) that may differ. Commits without a new name, or with several, are faults; only trees of picked commits are read.
    """
    names = renamed.groupBy("store", "commit").agg(F.min("new").alias("new"), F.count("*").alias("names"))
    rows = picked.select("store", "commit").distinct().join(names, ["store", "commit"], "left")
    row = lambda df, check, path: df.select(F.lit(check).alias("check"), "store", "commit", path.alias("path"))
    none = F.lit(None).cast("string")
    pairs = rows.filter("new is not null")
    side = lambda df: df.select(F.struct("store", "commit", "path").alias("at"), F.struct("mode", "blob").alias("what"))
    old = before.join(pairs.select("store", "commit"), ["store", "commit"], "left_semi")
    new = after.withColumnRenamed("commit", "new").join(pairs.select("store", "commit", "new"), ["store", "new"])
    found = compare_snapshots(side(old), side(new), "at", "what").select(F.concat(F.lit("tree-"), "change").alias("check"), "at.*")
    found = found.join(allowed.select("store", "path").distinct(), ["store", "path"], "left_anti").select("check", "store", "commit", "path")
    return found.union(row(rows.filter("new is null"), "commit-unnamed", none)).union(row(rows.filter("names > 1"), "commit-ambiguous", none))


def content_faults(pointers: DataFrame, objects: DataFrame) -> DataFrame:
    """(check, path) of pointers (path, oid, size) whose object (oid, content) is missing or, hashed anew, another one."""
    rows = pointers.join(objects.select("oid", F.sha2("content", 256).alias("sha"), F.octet_length("content").alias("bytes")), "oid", "left")
    what = F.when(F.col("sha").isNull(), "object-missing").when(F.col("sha") != F.col("oid"), "object-hash").when(F.col("bytes") != F.col("size"), "object-size")
    return rows.select(what.alias("check"), "path").filter("check is not null")


def ignored_outside(files: DataFrame, key: str, most_bytes: int) -> DataFrame:
    """Per store the ignored files (path, size) outside reject places; active if one is of a large kind, or from ``most_bytes`` on."""
    large = Q.is_large_path(F.col("path"))
    rows = files.groupBy(key).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(large).alias("large"))
    return rows.withColumn("active", (F.col("large") > 0) | (F.col("bytes") >= most_bytes))


def reject_residue(files: DataFrame, key: str, now: int, most_bytes: int, age: int) -> DataFrame:
    """Per store the files (size, changed in seconds) left in reject places; active from ``most_bytes`` on, or once the oldest is of that age."""
    rows = files.groupBy(key).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("changed").alias("oldest"))
    return rows.withColumn("active", (F.col("bytes") >= most_bytes) | (now - F.col("oldest") >= age))


def clean_days(samples: DataFrame, key: str, end: int, days: int = 3) -> DataFrame:
    """(key, missing, first_gap, dirty, backup_days, ahead, clean) of the hours before ``end`` (seconds).

    ``samples`` has (key, ts, kind, uncollected, large_outside, ahead). Clean: a sample in every hour, none with uncollected
    changes or large files outside, a backup every day, none with commits that weren't pushed. A key without a gap stays in.
    """
    start, hours = end - days * DAY, days * DAY // HOUR
    inside = samples.filter((F.col("ts") > start) & (F.col("ts") <= end))
    hour, day = F.floor((F.col("ts") - start - 1) / HOUR), F.floor((F.col("ts") - start - 1) / DAY)
    dirty = (F.col("uncollected") != 0) | (F.col("large_outside") != 0)
    backup = F.col("kind") == "backup"
    # An hour or a day is one bit, so a key's samples fold into a few numbers.
    seen = inside.groupBy(key, hour.alias("hour")).agg(F.count_if(dirty).alias("dirty"), F.max(F.when(backup, day)).alias("day"), F.count_if(backup & (F.col("ahead") != 0)).alias("ahead"))
    rows = seen.groupBy(key).agg(F.collect_set("hour").alias("_hours"), F.sum("dirty").alias("dirty"), F.count_distinct("day").alias("backup_days"), F.sum("ahead").alias("ahead"))
    rows = samples.select(key).distinct().join(rows, key, "left")
    want = F.sequence(F.lit(0).cast("long"), F.lit(hours - 1).cast("long"))
    gaps = F.array_except(want, F.coalesce("_hours", F.array().cast("array<bigint>")))
    rows = rows.withColumn("_gaps", gaps)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("dirty", "backup_days", "ahead")}
    rows = rows.withColumns(zero).select(key, F.size("_gaps").cast("long").alias("missing"), F.array_min("_gaps").alias("first_gap"), "dirty", "backup_days", "ahead")
    return rows.withColumn("clean", (F.col("missing") == 0) & (F.col("dirty") == 0) & (F.col("backup_days") >= days) & (F.col("ahead") == 0))


def backup_judgement(runs: DataFrame, drills: DataFrame, key: str, last: int = 3) -> DataFrame:
    """(key, ok) from the ``last`` runs (key, at, result, snapshot), all ok, and the newest drill (key, at, result, snapshot), ok and of one of them."""
    newest = Window.partitionBy(key).orderBy(F.desc("at"))
    recent = runs.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= last)
    state = recent.groupBy(key).agg((F.count("*") == last).alias("_full"), F.bool_and(F.col("result") == "ok").alias("_good"), F.collect_set("snapshot").alias("_snaps"))
    drill = drills.groupBy(key).agg(F.max(F.struct("at", "result", "snapshot")).alias("_d"))
    rows = state.join(drill, key, "left")
    return rows.select(key, F.coalesce(F.col("_full") & F.col("_good") & (F.col("_d.result") == "ok") & F.array_contains("_snaps", F.col("_d.snapshot")), F.lit(False)).alias("ok"))


def retirement(keys: DataFrame, key: str, conditions: dict[str, DataFrame], state: DataFrame, reenable_after: int = 6 * HOUR) -> DataFrame:
    """B11, ST10: (key, action, failed): keep-running, retire, stay-retired or reenable.

    ``conditions`` are tables (key, ok); a key without a row fails. ``state`` has (key, enabled, retired, red): whether the
    routine runs, whether it was retired, and for how many seconds its alarm has been red.
    """
    rows = keys.select(key).distinct()
    for name, table in conditions.items():
        rows = rows.join(table.select(key, F.col("ok").alias(f"_{name}")), key, "left")
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(f"_{name}", F.lit(False)), F.lit(name)) for name in conditions]))
    rows = rows.withColumn("failed", F.array_join(failed, ",")).join(state, key, "left")
    off = F.coalesce(F.col("retired") & ~F.col("enabled"), F.lit(False))
    action = (
        F.when(off & (F.col("red") >= reenable_after), "reenable").when(off, "stay-retired").when((F.col("failed") == "") & F.coalesce("enabled", F.lit(False)), "retire").otherwise("keep-running")
    )
    return rows.select(key, action.alias("action"), "failed")


def merge_actions(base: DataFrame, ours: DataFrame, theirs: DataFrame, derived: Column, union: Column, region: str) -> DataFrame:
    """(path, class, kept, copied, content): what a merge does with paths (path, content) that both sides changed.

    union paths merge their lines; derived ones, and index pages of which only the generated region changed on our side, take
    theirs; others take theirs and keep a copy of ours; where one side deleted, the other's change stays. content is what the path holds then.
    """
    rows = base.select("path", F.col("content").alias("b")).join(ours.select("path", F.col("content").alias("o")), "path", "full_outer").join(theirs.select("path", F.col("content").alias("t")), "path", "full_outer")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    rows = rows.filter(~same("o", "t") & ~same("b", "o") & ~same("b", "t"))
    bare = lambda x: F.regexp_replace(x, rf"(?s)(<!-- {region}:start -->).*?(<!-- {region}:end -->)", "$1$2")
    only_region = F.col("path").rlike(r"(?i)(?:\A|/)README\.md\z") & F.col("b").isNotNull() & (bare(F.col("b")) == bare(F.col("o")))
    both = F.col("o").isNotNull() & F.col("t").isNotNull()
    kind = F.when(union & both, "union").when(derived, "derived").when(both & only_region, "derived").when(both, "general").otherwise("delete-modify")
    rows = rows.withColumn("class", kind)
    kept = F.when(F.col("class") == "union", "both").when(F.col("class").isin("derived", "general"), "remote").when(F.col("o").isNotNull(), "local").otherwise("remote")
    rows = rows.withColumn("kept", kept)
    merged = union_merge(rows.filter("class = 'union'"), "b", "o", "t", "content")
    others = rows.filter("class <> 'union'").withColumn("content", F.when(F.col("kept") == "local", F.col("o")).otherwise(F.col("t")))
    return merged.unionByName(others).select("path", "class", "kept", (F.col("class") == "general").alias("copied"), "content")


def dependent_indexes(changed: DataFrame, links: DataFrame) -> DataFrame:
    """(store, path) of index pages whose lines link to a path that came or went; ``links`` are (store, path, resolved)."""
    gone = changed.filter("topology").select("store", F.col("path").alias("resolved")).distinct()
    return links.join(gone, ["store", "resolved"], "left_semi").select("store", "path").distinct()


def phase_totals(phases: DataFrame, key: str, cold: Column) -> DataFrame:
    """(key, seconds, cold, warm): how long a run's phases (start, stop) took, in all, cold and warm."""
    took = F.col("stop") - F.col("start")
    return phases.groupBy(key).agg(F.sum(took).alias("seconds"), F.sum(F.when(cold, took).otherwise(0)).alias("cold"), F.sum(F.when(cold, 0).otherwise(took)).alias("warm"))


def top_directory(events: DataFrame, key: str, directory: Column, size: str, seconds: str, bucket: int) -> DataFrame:
    """(key, bucket, dir, bytes): the folder with most bytes in each bucket of time; of equal ones the first by name."""
    at = (F.floor(F.col(seconds) / bucket) * bucket).cast("long")
    sums = events.groupBy(key, at.alias("bucket"), directory.alias("dir")).agg(F.sum(size).alias("bytes"))
    best = F.min(F.struct((-F.col("bytes")).alias("less"), "dir")).alias("x")
    return sums.groupBy(key, "bucket").agg(best).select(key, "bucket", F.col("x.dir").alias("dir"), (-F.col("x.less")).alias("bytes"))


def two_level_totals(files: DataFrame, key: list[str], size: str) -> DataFrame:
    """A4: (key..., dir, files, bytes, place) by the first two folders of a path, ordered by bytes, files and name."""
    parts = F.split("path", "/")
    directory = F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), F.size(parts) - 1)), "/")
    rows = files.groupBy(*key, directory.alias("dir")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("bytes"), F.desc("files"), "dir")).cast("long"))
