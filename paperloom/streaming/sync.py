"""ST1: index pages kept up to date from a stream of changed pages, without reading the folders that no change can reach.

What the index pages are made of is kept in five tables, cut into buckets of folders: ``entries`` (a line for each page and folder), ``readmes``, ``files``,
``dirs`` (the files below each folder) and ``links`` (from a summary to the file it names). A batch reads the buckets of the folders it touches, of the folders
above them, and of those whose summaries link to a file that comes or goes; it writes these buckets anew, under its own number, and then a manifest that says
which version of each bucket counts. A batch that runs again starts from the manifest before it and overwrites its own files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import gate as G
from paperloom.operators import indexes as I
from paperloom.storage import checkpoint

#: The tables: columns, the one whose folder decides a row's bucket, and the key.
TABLES = {
    "entries": ("store string, readme string, is_dir boolean, link string, label string, summary string, source string", "readme", ["store", "readme", "link"]),
    "readmes": ("store string, path string, content string", "path", ["store", "path"]),
    "files": ("store string, path string", "path", ["store", "path"]),
    "dirs": ("store string, dir string, files long", "dir", ["store", "dir"]),
    "links": ("store string, resolved string, readme string, link string", "resolved", ["store", "resolved", "readme", "link"]),
}
#: What a batch of changes has.
CHANGE = "store string, path string, content string, kind string"


@dataclass
class IndexState:
    """The tables below ``folder`` as batch ``number`` left them; ``versions`` is which write of which batch made each bucket, by table."""

    spark: SparkSession
    folder: str
    buckets: int
    number: int
    versions: dict[tuple[str, int], str]
    writes: int = 0

    @classmethod
    def before(cls, spark: SparkSession, folder: str, buckets: int, number: int) -> IndexState:
        """The state that a batch starts from."""
        try:
            rows = spark.read.parquet(f"{folder}/manifest").filter(F.col("batch") < number).collect()  # a few rows for each bucket
        except AnalysisException:
            rows = []
        last = max((r["batch"] for r in rows), default=-1)
        return cls(spark, folder, buckets, number, {(r["name"], r["bucket"]): r["version"] for r in rows if r["batch"] == last})

    def bucket(self, folder: Column) -> Column:
        return F.pmod(F.xxhash64("store", folder), F.lit(self.buckets)).cast("int")

    def read(self, name: str, folders: DataFrame | None = None) -> DataFrame:
        """A table, or the rows of its buckets that some of ``folders`` (store, dir) fall into."""
        chosen = range(self.buckets) if folders is None else self._numbers(folders.select(self.bucket(F.col("dir")).alias("b")))
        return self._buckets(name, chosen)

    def _numbers(self, rows: DataFrame) -> list[int]:
        return sorted(r["b"] for r in rows.distinct().collect())  # at most as many as there are buckets

    def _buckets(self, name: str, chosen: Iterable[int]) -> DataFrame:
        schema = TABLES[name][0]
        paths = [f"{self.folder}/{name}/write={self.versions[name, b]}/bucket={b}" for b in chosen if (name, b) in self.versions]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def replace(self, name: str, gone: DataFrame, new: DataFrame) -> None:
        """Takes the rows with the keys of ``gone`` and of ``new`` out of a table and puts those of ``new`` in, both stored."""
        schema, of, key = TABLES[name]
        folder = F.col(of) if of == "dir" else X.directory(F.col(of))
        keys = gone.select(*key).union(new.select(*key)).distinct()
        touched = self._numbers(keys.select(self.bucket(folder).alias("b")))
        if not touched:
            return
        columns = [c.split()[0] for c in schema.split(", ")]
        rows = self._buckets(name, touched).join(keys, key, "left_anti").select(*columns).unionByName(new.select(*columns))
        rows = rows.withColumn("bucket", self.bucket(folder)).repartition("bucket")
        version, self.writes = f"{self.number}.{self.writes}", self.writes + 1
        path = f"{self.folder}/{name}/write={version}"
        rows.write.mode("overwrite").partitionBy("bucket").parquet(path)
        filled = self._numbers(self.spark.read.schema(f"{schema}, bucket int").parquet(path).select(F.col("bucket").alias("b")))
        for b in touched:
            self.versions.pop((name, b), None)
        self.versions |= {(name, b): version for b in filled}

    def commit(self) -> None:
        rows = [(name, b, v) for (name, b), v in self.versions.items()]
        frame = self.spark.createDataFrame(rows, "name string, bucket int, version string")
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={self.number}")


def _in_scope(pages: DataFrame, profile: I.Profile) -> DataFrame:
    kind = I.page_class(F.col("path"), profile)
    return pages.filter(~(kind["archive"] | kind["plans"] | kind["bucket"] | kind["hidden"]))


def _counts(files: DataFrame, profile: I.Profile, n: int) -> DataFrame:
    """(store, dir, n): n for each file in scope, added up over the folders above it."""
    return _in_scope(files, profile).select("store", F.explode(X.ancestors(F.col("path"))).alias("dir")).groupBy("store", "dir").agg((F.count("*") * n).alias("n"))


def _links(entries: DataFrame) -> DataFrame:
    return I.summary_links(entries).filter("resolved is not null").select("store", "resolved", "readme", "link").distinct()


def _folder(column: str) -> Column:
    return X.directory(F.col(column)).alias("dir")


def _with_ancestors(folders: DataFrame) -> DataFrame:
    """The folders (store, dir) and all above them, the root being an empty string."""
    return folders.select("store", F.explode(F.array_union(F.array("dir"), X.ancestors(F.col("dir")))).alias("dir")).distinct()


def _whole(state: IndexState, pages: DataFrame, profile: I.Profile) -> DataFrame:
    """(store, path, created) of a full pass over the stores of ``pages``, whose rows replace all of theirs in the state."""
    stores = pages.select("store").distinct()
    entries = checkpoint(I.index_entries(pages, profile))
    files = checkpoint(pages.select("store", "path"))
    readmes = checkpoint(I.readme_pages(pages).select("store", "path", "content"))
    done = I.settle_indexes(entries, readmes, files, checkpoint(I.readmes_of(I.folders(pages, profile))), profile, checkpoint)
    new = {"entries": done.entries, "readmes": done.readmes, "files": done.files, "dirs": _counts(done.files, profile, 1).withColumnRenamed("n", "files"), "links": _links(done.entries)}
    for name, rows in new.items():
        state.replace(name, checkpoint(state.read(name).join(stores, "store", "left_semi")), checkpoint(rows))
    return done.written


def _part(state: IndexState, changes: DataFrame, profile: I.Profile) -> DataFrame:
    """(store, path, created) of the index pages that the changes alter; (store, path, content), null content being a deletion."""
    touched = checkpoint(changes.select("store", _folder("path")).distinct())
    known = state.read("files", touched).join(changes.select("store", "path"), ["store", "path"], "left_semi").withColumn("known", F.lit(True))
    changes = checkpoint(changes.join(known, ["store", "path"], "left").filter("known or content is not null"))
    kept, gone = changes.filter("content is not null"), changes.filter("content is null").select("store", "path")
    added = kept.filter("known is null").select("store", "path")
    topology = checkpoint(added.union(gone))

    # Folders that come and go with their files.
    delta = checkpoint(_counts(added, profile, 1).union(_counts(gone, profile, -1)).groupBy("store", "dir").agg(F.sum("n").alias("n")))
    dirs = checkpoint(delta.join(state.read("dirs", delta), ["store", "dir"], "left").select("store", "dir", F.coalesce("files", F.lit(0)).alias("old"), (F.coalesce("files", F.lit(0)) + F.col("n")).alias("files")))
    lost = dirs.filter("old > 0 and files <= 0").select("store", "dir")

    # Entries of changed pages, of folders whose own page changed, and of folders that are new or lost.
    pages = I.leaf_entries(kept, profile)
    own = changes.filter(r"path rlike '(?:\\A|/)README\\.md\\z'").select("store", _folder("path"))
    renewed = dirs.filter("old <= 0 and files > 0").select("store", "dir").union(own).distinct().join(lost, ["store", "dir"], "left_anti")
    folders = I.folder_entries(_alive(state, renewed, dirs), I.readme_pages(kept).unionByName(_unchanged(state, renewed, changes), allowMissingColumns=True), profile)
    fresh = checkpoint(pages.unionByName(folders))
    readme_of = lambda path: F.when(X.directory(path) == "", "README.md").otherwise(F.concat(X.directory(path), F.lit("/README.md")))
    dead = changes.select("store", readme_of(F.col("path")).alias("readme"), F.substring_index("path", "/", -1).alias("link"))
    dead = dead.union(lost.filter("dir <> ''").select("store", readme_of(F.col("dir")), F.concat(F.substring_index("dir", "/", -1), F.lit("/README.md"))))
    dead = checkpoint(dead.union(fresh.select("store", "readme", "link")).distinct())

    # Index pages to look at: those of the folders above, those that link to what came or went, and those that a missing index page will join.
    met = lambda paths: state.read("links", paths.select("store", _folder("resolved"))).join(paths, ["store", "resolved"], "left_semi").select("store", "readme")
    first = dead.select("store", "readme").union(I.readmes_of(renewed)).union(met(topology.withColumnRenamed("path", "resolved")))
    first = checkpoint(first.distinct())
    near = _with_ancestors(first.select("store", _folder("readme")))
    second = near.union(met(I.readmes_of(near).withColumnRenamed("readme", "resolved")).select("store", _folder("readme")))
    near = checkpoint(_with_ancestors(second))
    alive = checkpoint(_alive(state, near, dirs))

    # Their rows as they were, and as they are with the changes.
    before = checkpoint(state.read("entries", near).join(I.readmes_of(near), ["store", "readme"], "left_semi"))
    here = I.readmes_of(alive)
    entries = checkpoint(before.join(dead, ["store", "readme", "link"], "left_anti").unionByName(fresh.join(here, ["store", "readme"], "left_semi")))
    readmes = _unchanged(state, alive, changes).unionByName(I.readme_pages(kept).select("store", "path", "content"))
    targets = checkpoint(I.summary_links(entries).select("store", F.col("resolved").alias("path")).union(here.toDF("store", "path")).distinct())
    files = state.read("files", targets.select("store", _folder("path"))).join(targets, ["store", "path"], "left_semi").join(gone, ["store", "path"], "left_anti")
    wanted = first.join(here, ["store", "readme"], "left_semi")
    done = I.settle_indexes(entries, checkpoint(readmes), checkpoint(files.unionByName(added).distinct()), checkpoint(wanted), profile, checkpoint)

    created = done.written.filter("created").select("store", "path")
    grown = _counts(created, profile, 1)
    counts = dirs.select("store", "dir", "files").union(state.read("dirs", grown).join(dirs.select("store", "dir"), ["store", "dir"], "left_anti").join(grown.select("store", "dir"), ["store", "dir"], "left_semi"))
    counts = counts.join(grown, ["store", "dir"], "left").select("store", "dir", (F.col("files") + F.coalesce("n", F.lit(0))).alias("files"))
    counts = checkpoint(counts)
    state.replace("dirs", counts.filter("files <= 0"), counts.filter("files > 0"))
    state.replace("files", gone, checkpoint(added.union(created)))
    state.replace("readmes", gone, done.readmes)
    lines = done.entries.join(before, before.columns, "left_anti")
    old = _links(before.join(done.entries, before.columns, "left_anti"))
    state.replace("links", checkpoint(old), checkpoint(_links(lines)))
    state.replace("entries", dead, checkpoint(lines))
    return done.written


def _alive(state: IndexState, folders: DataFrame, changed: DataFrame) -> DataFrame:
    """Those of ``folders`` that hold a file, by the state and the folders (store, dir, files) that have ``changed``."""
    key = ["store", "dir"]
    rows = state.read("dirs", folders).join(changed.select(*key), key, "left_anti").union(changed.select(*key, "files"))
    return folders.join(rows.filter("files > 0").select(*key), key, "left_semi")


def _unchanged(state: IndexState, folders: DataFrame, changes: DataFrame) -> DataFrame:
    """The index pages of ``folders`` that no change touches."""
    want = I.readmes_of(folders).toDF("store", "path")
    return state.read("readmes", folders).join(want, ["store", "path"], "left_semi").join(changes.select("store", "path"), ["store", "path"], "left_anti")


def start_state(pages: DataFrame, profile: I.Profile, folder: str, buckets: int = 64) -> DataFrame:
    """Stores the state of whole trees as batch -1: (store, path, created) of the index pages that had to be written."""
    state = IndexState(pages.sparkSession, folder, buckets, -1, {})
    written = _whole(state, pages, profile)
    state.commit()
    return written


def apply_changes(changes: DataFrame, number: int, folder: str, profile: I.Profile, whole_pages: Callable[[], DataFrame], buckets: int = 64) -> DataFrame:
    """Brings the state up to date: (store, mode, reason, path, created), a row for each index page written, or one with a null path.

    ``changes`` has (store, path, content, kind), each path once, with null content and kind missing for a deletion. A store whose changes can't be taken alone (a contract
    changed, a path is no file, see ``promote_to_full``) gets a full pass over its ``whole_pages``, which are read only then. Nothing else is read but the
    changes and the buckets that they reach.
    """
    state = IndexState.before(changes.sparkSession, folder, buckets, number)
    changes = checkpoint(changes.select("store", "path", "content", "kind"))
    modes = checkpoint(G.promote_to_full(changes, profile.schema_path))
    alone = modes.filter("mode = 'incremental'")
    part = checkpoint(changes.join(alone.select("store"), "store", "left_semi").drop("kind"))
    written = None
    if not part.isEmpty():
        written = _part(state, part, profile)
    full = modes.filter("mode = 'full'").select("store")
    if not full.isEmpty():
        readmes = state.read("readmes")
        pages = whole_pages().select("store", "path", "content").join(full, "store", "left_semi")
        pages = pages.unionByName(readmes.join(full, "store", "left_semi").join(pages.select("store", "path"), ["store", "path"], "left_anti"))
        pages = pages.join(changes.filter("content is null").select("store", "path"), ["store", "path"], "left_anti")
        done = _whole(state, checkpoint(pages), profile)
        written = done if written is None else written.unionByName(done)
    state.commit()
    report = modes.join(written, "store", "left") if written is not None else modes.withColumns({"path": F.lit(None).cast("string"), "created": F.lit(None).cast("boolean")})
    return report.select("store", "mode", "reason", "path", "created")


def sync_changes(stream: DataFrame, folder: str, profile: I.Profile, whole_pages: Callable[[], DataFrame], buckets: int = 64) -> DataFrame:
    """Runs ``apply_changes`` over all that a stream of changes (store, path, content, kind, ord) has brought; of several changes of a path in a batch
    the one with the greatest ord counts. Returns the rows of all batches, with their batch.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("store", "path").agg(F.max(F.struct("ord", "content", "kind")).alias("x")).select("store", "path", "x.content", "x.kind")
        apply_changes(last, number, folder, profile, whole_pages, buckets).write.mode("overwrite").parquet(f"{folder}/report/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/report")


def current_indexes(spark: SparkSession, folder: str, buckets: int = 64) -> DataFrame:
    """(store, path, content): the index pages as the last batch left them."""
    return IndexState.before(spark, folder, buckets, 1 << 62).read("readmes")
