"""Exported tables: changes, manifests, scans, snapshots and declarations, read with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGE = "status string, path string, old_mode string, new_mode string, old_blob string, new_blob string, size bigint"


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """(store, commit, parent, ord, status, path, ...) from JSON lines with a commit and its changes each."""
    rows = spark.read.schema(f"store string, commit string, parent string, ord bigint, changes array<struct<{CHANGE}>>").json(path)
    return rows.filter("commit is not null").select("store", "commit", "parent", "ord", F.inline("changes"))


MANIFESTS = {
    "final_map": "path string, size bigint, blob string, sha256 string, mode string, kind string",
    "inventory": "class string, size bigint, mode string, digest string, path string",
    "decisions": "path string, decision string, note string",
}


def read_manifest(spark: SparkSession, path: str, kind: str, sep: str = "\t") -> DataFrame:
    """One of MANIFESTS; lines of another form are an error."""
    return spark.read.schema(MANIFESTS[kind]).option("sep", sep).option("mode", "FAILFAST").csv(path)


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """A row for each path of each scan of a work tree."""
    schema = "store string, scan_ts timestamp, path string, tracked boolean, staged boolean, unmerged boolean, present boolean, size bigint, mtime timestamp, symlink boolean"
    return spark.read.schema(schema).json(path).filter("path is not null")


def read_backup_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of backups; lines that can't be read or have no time are left out."""
    schema = "store string, at timestamp, host string, result string, snapshot_id string, snapshot_time timestamp, error string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter("at is not null")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots with their paths and tags."""
    return spark.read.schema("id string, time timestamp, host string, paths array<string>, tags array<string>").json(path).filter("id is not null")


#: The keys of a declaration and their types; anything else is refused.
DECLARATION = {
    "id": "string",
    "profile": "string",
    "archiveTreeDirs": "array<string>",
    "plansSlotRoot": "string",
    "rootNonNavFiles": "array<string>",
    "ownerLocalBucketPrefix": "string",
    "sidecarSourceExtensions": "array<string>",
    "enrichExclude": "array<string>",
    "personaMemoryPages": "array<string>",
    "genericPageSections": "array<string>",
    "enforcePageFrontmatter": "boolean",
}


def read_declarations(spark: SparkSession, path: str) -> DataFrame:
    """(store, fields..., problem): a row for each declaration, one JSON file a store, named after it.

    problem names the first key that isn't known, or whose value has another type; null for a valid declaration.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json\z", 1).alias("store"), F.col("value").alias("json"))
    schema = ", ".join(f"{k} {t}" for k, t in DECLARATION.items())
    rows = files.withColumn("_raw", F.from_json("json", "map<string, string>")).withColumn("_typed", F.from_json("json", schema))
    keys = F.map_keys("_raw")
    unknown = F.get(F.array_sort(F.filter(keys, lambda k: ~k.isin(*DECLARATION))), F.lit(0))
    mistyped = F.coalesce(*[F.when(F.element_at("_raw", k).isNotNull() & F.col(f"_typed.{k}").isNull(), F.lit(k)) for k in DECLARATION])
    problem = F.when(F.col("_raw").isNull(), "not an object").when(unknown.isNotNull(), F.concat(F.lit("unknown key "), unknown)).when(mistyped.isNotNull(), F.concat(F.lit("wrong type of "), mistyped))
    return rows.select("store", "_typed.*", problem.alias("problem"))


def read_stores(spark: SparkSession, path: str, declared: DataFrame | None = None) -> DataFrame:
    """(store_id, root, status) of a registry {"stores": {id: root}}; status is ok, or id-mismatch where ``declared`` (store, id) says so.

    A registry is one small file. An id of another form is an error.
    """
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.stores"), "map<string, string>")).alias("store_id", "root"))
    good = F.col("store_id").rlike(r"\A[a-z][a-z0-9]*(-[a-z0-9]+)*\z")
    rows = rows.select(F.when(good, F.col("store_id")).otherwise(F.raise_error(F.concat(F.lit("bad store id "), "store_id"))).alias("store_id"), "root")
    if declared is None:
        return rows.withColumn("status", F.lit("ok"))
    rows = rows.join(declared.select(F.col("store").alias("store_id"), F.col("id").alias("_id"), F.lit(True).alias("_there")), "store_id", "left")
    return rows.select("store_id", "root", F.when(F.col("_there").isNull(), "root-missing").when(F.col("_id").eqNullSafe(F.col("store_id")), "ok").otherwise("id-mismatch").alias("status"))
