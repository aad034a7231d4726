"""Windows and aggregates over events, samples, logs and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans as S


def consecutive_ok(runs: DataFrame, key: str, order: list[str], ok: Column, last: int = 30) -> DataFrame:
    """The trailing run of successes per key among its ``last`` latest rows; order must be unique within a key."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    rows = runs.select(key, *order, ok.alias("ok")).withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= last)
    failed = F.sum((~F.col("ok")).cast("int")).over(newest)
    return rows.withColumn("failed", failed).groupBy(key).agg(F.sum((F.col("failed") == 0).cast("long")).alias("streak"))


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    first = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def tail(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each key, 1 being the latest."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("back", F.row_number().over(newest).cast("long")).filter(F.col("back") <= n)


def fold_by_id(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Per id the last non-null value of every field, and where the id was first seen.

    Maxima of structs by order need no sort of a key's rows, so an id with many lines does no harm.
    """
    at = F.struct(*order)
    last = [F.max(F.when(F.col(f).isNotNull(), F.struct(at.alias("at"), F.col(f).alias("v"))))["v"].alias(f) for f in fields]
    return log.groupBy(key).agg(F.min(order[0]).alias("first_seen"), *last)


def fold_json(lines: DataFrame, line: str, order: list[str], id_field: str = "id") -> DataFrame:
    """W2, ST9: (id, first_seen, fields): JSON objects, one a line, folded by id: of each field the last value, whatever its name.

    fields maps names to values as JSON text. A field that a later line leaves out keeps its value; one that it sets to null is null. Lines that aren't
    objects, and those whose id is missing, null, empty, zero or false, are left out. first_seen is ``order`` of the id's first line; orders must be unique.
    Fields are folded one by one, by partial sums, before an id's are put together, so an id with many lines is no large group.
    """
    rows = lines.select(F.struct(*order).alias("at"), F.try_parse_json(line).alias("v")).filter(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    said = F.to_json(F.try_variant_get("v", f"$.{id_field}", "variant"))
    rows = rows.withColumn("id", F.try_variant_get("v", f"$.{id_field}", "string")).filter(~said.isin("null", '""', "0", "false"))
    parts = rows.sparkSession.tvf.variant_explode(F.col("v").outer())
    fields = rows.lateralJoin(parts).select("id", "at", "key", F.to_json("value").alias("value"))
    last = fields.groupBy("id", "key").agg(F.max(F.struct("at", "value"))["value"].alias("value"))
    entry = F.array_sort(F.collect_list(F.struct("key", "value")))
    first = rows.groupBy("id").agg(F.min("at").alias("first_seen"))
    return first.join(last.groupBy("id").agg(F.map_from_entries(entry).alias("fields")), "id")


def open_conflicts(folded: DataFrame, at: str = "first_seen") -> DataFrame:
    """ST9: the conflicts of ``fold_json`` whose status is open, in the order in which they were first seen."""
    return folded.filter(F.try_element_at("fields", F.lit("status")) == '"open"').orderBy(at, "id")


def assign_seq(events: DataFrame, key: str, order: list[str], last_seen: DataFrame) -> DataFrame:
    """Numbers that go on after the last one each key has; ``last_seen`` is (key, seq), and order must be unique within a key."""
    rows = S.plain(S.numbered(S.ranges(events, [key], order), [key], order, "_n"))
    return rows.join(last_seen, key, "left").withColumn("seq", F.coalesce("seq", F.lit(0)) + F.col("_n")).drop("_n")


def hour_coverage(samples: DataFrame, key: str, seconds: str, start: int, hours: int) -> DataFrame:
    """(key, missing, first_gap): the hours after ``start`` in which a key has no sample."""
    inside = samples.filter((F.col(seconds) > start) & (F.col(seconds) <= start + hours * 3600))
    have = inside.select(key, F.floor((F.col(seconds) - start - 1) / 3600).cast("long").alias("hour")).distinct()
    want = samples.select(key).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hours - 1).cast("long"))))
    gaps = want.join(have, [key, "hour"], "left_anti").groupBy(key).agg(F.count("*").alias("missing"), F.min("hour").alias("first_gap"))
    return gaps


def rolling_growth(events: DataFrame, key: str, seconds: str, size: str, bucket: int = 600, span: int = 86_400) -> DataFrame:
    """Per bucket, files and bytes of the trailing span; what is a whole span old no longer counts."""
    at = (F.floor(F.col(seconds) / bucket) * bucket).cast("long")
    sums = events.groupBy(key, at.alias("bucket")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    trailing = Window.partitionBy(key).orderBy("bucket").rangeBetween(-(span - 1), 0)
    return sums.select(key, "bucket", F.sum("files").over(trailing).alias("files_24h"), F.sum("bytes").over(trailing).alias("bytes_24h"))


def alarm_onset(samples: DataFrame, key: str, order: list[str], active: Column, at: str) -> DataFrame:
    """Every active run of a key's samples: its first and last time and its length; order must be unique within a key."""
    rows = S.ranges(samples.withColumn("active", F.coalesce(active, F.lit(False))), [key], order)
    rows = S.previous(rows, [key], order, "active", "before").withColumn("change", (~F.col("active").eqNullSafe(F.col("before"))).cast("long"))
    rows = S.running_sum(rows, [key], order, F.col("change"), "island").filter("active")
    return rows.groupBy(key, "island").agg(F.min(at).alias("since"), F.max(at).alias("until"), F.count("*").alias("samples")).drop("island")


def rate_cap(calls: DataFrame, key: str, seconds: str, per_tick: int, per_hour: int) -> DataFrame:
    """At each call, the calls of the last hour and what is left of the quota.

    Calls are counted by second first, and time is cut into stretches that overlap by an hour, so that a busy key is many tasks.
    """
    stretch = 6 * 3600
    counts = calls.groupBy(key, F.col(seconds).alias("_s")).agg(F.count("*").alias("_n"))
    cut = F.floor(F.col("_s") / stretch)
    both = F.array_distinct(F.array(cut, F.floor((F.col("_s") + 3599) / stretch)))
    spread = counts.withColumn("_cut", F.explode(both))
    hour = Window.partitionBy(key, "_cut").orderBy("_s").rangeBetween(-3599, 0)
    used = spread.withColumn("used", F.sum("_n").over(hour)).filter(cut == F.col("_cut")).select(key, F.col("_s").alias(seconds), "used")
    rows = calls.join(used, [key, seconds])
    return rows.withColumn("left", F.greatest(F.least(F.lit(per_tick), F.lit(per_hour) - F.col("used")), F.lit(0)).cast("long"))


def last_state(decisions: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The latest state of each key."""
    return decisions.groupBy(key).agg(F.max(F.struct(*order, state))[state].alias(state))


def directory_totals(files: DataFrame, directory: str, size: str) -> DataFrame:
    """Files and bytes of each directory."""
    return files.groupBy(directory).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def usage(objects: DataFrame, size: str, seconds: str, since: int) -> DataFrame:
    """Objects and bytes, in all and of those newer than ``since``."""
    new = F.col(seconds) > since
    return objects.agg(F.count("*").alias("objects"), F.sum(size).alias("bytes"), F.count_if(new).alias("new_objects"), F.sum(F.when(new, F.col(size)).otherwise(0)).alias("new_bytes"))


def latency(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Nearest-rank percentiles; null values don't count.

    Values are counted first and cut into ranges by key and value, so that no task ranks all of a key's values: a range
    knows how many values lie below it from the sums of the ranges.
    """
    counts = samples.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    # Ranges are values' leading digits: the value in units of a power of ten that leaves about a thousand of them.
    unit = counts.groupBy("k").agg(F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(F.max(F.abs("v")) + 1)) - 2, F.lit(0))).alias("unit"))
    cut = counts.join(unit, "k").withColumn("range", F.floor(F.col("v") / F.col("unit")))
    sums = cut.groupBy("k", "range").agg(F.sum("n").alias("here"))
    below = Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("below", F.coalesce(F.sum("here").over(below), F.lit(0))).withColumn("total", F.sum("here").over(Window.partitionBy("k")))
    within = Window.partitionBy("k", "range").orderBy("v")
    rows = cut.join(sums.withColumnsRenamed({"k": "k_", "range": "r_"}), (F.col("k").eqNullSafe(F.col("k_"))) & (F.col("range") == F.col("r_")))
    rows = rows.withColumn("upto", F.col("below") + F.sum("n").over(within))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p - 1e-9), F.col("v")))
    return rows.groupBy(F.col("k").alias(key)).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("v").alias("longest"))


def extension_audit(files: DataFrame, ext: str, kind: str, size: str, top: int = 5) -> DataFrame:
    """A5: per extension its files, bytes and most frequent kinds; kinds are few, as they are counted first."""
    sums = files.groupBy(ext, kind).agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(kind).alias("k")))), 1, top)
    return sums.groupBy(ext).agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.array_join(F.transform(ranked, lambda x: x["k"]), ",").alias("kinds"))


def extension_samples(files: DataFrame, ext: str, path: str, n: int = 3) -> DataFrame:
    """A5, T4: the first ``n`` paths of each extension; each bucket of paths gives its first ones before they are gathered."""
    bucket = F.pmod(F.xxhash64(path), F.lit(256))
    by = lambda *parts: Window.partitionBy(ext, *parts).orderBy(path)
    few = files.select(ext, path).distinct().withColumn("_b", bucket).withColumn("_n", F.row_number().over(by("_b"))).filter(F.col("_n") <= n)
    return few.groupBy(ext).agg(F.slice(F.array_sort(F.collect_list(path)), 1, n).alias("samples"))


def strip_report(blobs: DataFrame, ext: str, size: str, mapped: Column, kept: Column) -> DataFrame:
    """Per extension, and in all under null, the blobs, bytes, those that are mapped and the pointers that are kept."""
    return blobs.rollup(ext).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.count_if(mapped).alias("mapped"), F.count_if(kept).alias("kept"))


def ext_totals(files: DataFrame, ext: str, size: str) -> DataFrame:
    """Files and bytes by extension, and the grand total under null."""
    return files.rollup(ext).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def phase_usage(samples: DataFrame, phases: DataFrame, key: str, seconds: str, value: str, width: int) -> DataFrame:
    """The highest sample of every phase (key, phase, start, stop), by an equi-join on buckets of ``width`` seconds."""
    cut = phases.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    rows = samples.withColumn("_b", F.floor(F.col(seconds) / width)).join(cut, [key, "_b"])
    rows = rows.filter((F.col(seconds) >= F.col("start")) & (F.col(seconds) < F.col("stop")))
    return rows.groupBy(key, "phase").agg(F.count("*").alias("samples"), F.max(value).alias("peak"))
