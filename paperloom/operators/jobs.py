"""Jobs put together from operators: syncing a tree, checking it, and taking in results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import frontmatter as M
from paperloom.storage import checkpoint

from . import enrich as E
from . import indexes as I
from . import ingest as N
from . import pages as P
from . import rules as R
from .snapshots import sidecar_status


def lint_tree(pages: DataFrame, profile: I.Profile, stores: DataFrame | None = None, full: bool = True, wanted: DataFrame | None = None, writers: dict[str, str] | None = None) -> DataFrame:
    """B2: (store, file, code, detail, severity) of every rule that pages break.

    With ``full`` links, index regions and whole trees are checked too; with ``wanted`` (store, path) only those pages, and
    what is missing of them. ``stores`` is the registry; ``writers`` are the special files that the schema page must describe (none: it isn't checked).
    """
    chosen = pages if wanted is None else pages.join(wanted.select("store", "path").distinct(), ["store", "path"], "left_semi")
    checked = R.checked_pages(chosen, profile)
    found = R.typed_issues(checked, profile)
    if wanted is not None:
        found = found.union(R.missing_files(wanted, pages))
    if full:
        body = checked.filter(~F.col("type").isin("unchecked", "sidecar", "readme", "log", "result", "reference", "skill")).select("store", "path", F.col("body").alias("content"))
        links = P.nav_errors(P.links(body), pages).select("store", F.col("path").alias("file"), "code", F.col("target").alias("detail"))
        found = found.union(links).union(R.ledger_issues(checked))
        pointed = P.pointer_rows(chosen)
        judged = None if stores is None else P.pointers(chosen, stores, pages)
        found = found.union(R.cross_store_issues(pointed, judged))
        if writers is not None:
            found = found.union(R.schema_issues(pages, profile, writers))
        if wanted is None:
            found = found.union(R.navigation_issues(pages, profile, checkpoint))
            found = found.union(R.tree_issues(pages, profile, I.index_lines(I.index_entries(pages, profile))))
    return R.with_severity(found)


def sync(pages: DataFrame, profile: I.Profile, store_checkpoint, binaries: DataFrame | None = None, generator: E.Generator | None = None, most: int = 50, date: str = "") -> tuple[DataFrame, DataFrame]:
    """(pages, report): sidecars that are missing or old, fields that are empty or old, index pages, then the checks.

    report has (store, sidecars, enriched, indexes, issues, clean), what was written and what is left.
    """
    done = {}
    if binaries is not None:
        stamps = R.checked_pages(pages, profile).filter("type = 'sidecar'").select(F.concat_ws(":", "store", F.regexp_replace("path", r"\.md\z", "")).alias("path"), M.checked_text(F.col("fm"), "sha256").alias("sha"))
        now = binaries.select(F.concat_ws(":", "store", "path").alias("path"), F.sha2("content", 256).alias("sha"))
        due = sidecar_status(now, stamps).filter("status in ('missing', 'hash-changed')").select(F.col("path").alias("_key"))
        made = store_checkpoint(E.sidecar_pages(E.extract(binaries.join(due, F.concat_ws(":", "store", "path") == F.col("_key"), "left_semi")), date))
        done["sidecars"] = made.groupBy("store").agg(F.count("*").alias("sidecars"))
        pages = pages.join(made.select("store", "path"), ["store", "path"], "left_anti").select("store", "path", "content").unionByName(made)
    if generator is not None:
        filled = store_checkpoint(E.enrich(pages, profile, generator, most).filter("outcome = 'enriched'").select("store", "path", "content"))
        done["enriched"] = filled.groupBy("store").agg(F.count("*").alias("enriched"))
        pages = pages.join(filled.select("store", "path"), ["store", "path"], "left_anti").select("store", "path", "content").unionByName(filled)
    readmes, written, _ = I.index_fixed_point(pages, profile, store_checkpoint)
    done["indexes"] = written.groupBy("store").agg(F.count("*").alias("indexes"))
    pages = store_checkpoint(pages.join(readmes.select("store", "path"), ["store", "path"], "left_anti").select("store", "path", "content").unionByName(readmes))
    issues = lint_tree(pages, profile)
    done["issues"] = issues.filter("severity = 'error'").groupBy("store").agg(F.count("*").alias("issues"))
    report = pages.select("store").distinct()
    for name in ("sidecars", "enriched", "indexes", "issues"):
        report = report.join(done[name], "store", "left") if name in done else report.withColumn(name, F.lit(0).cast("long"))
    report = report.select("store", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("sidecars", "enriched", "indexes", "issues")])
    return pages, report.withColumn("clean", F.col("issues") == 0)


def ingest_results(results: DataFrame, tasks: DataFrame, files: DataFrame, stamps: DataFrame, pages: DataFrame, projects: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """(guarded, pages): why each result (path, millis, received, title, text) is skipped, and the pages of those that are taken.

    Every result that is taken is archived as results/<id>.result.md too.
    """
    guarded = N.guard_ingest(results, tasks, files, stamps)
    taken = guarded.filter("reason is null")
    sources = taken.select(F.col("task_id").cast("string").alias("slug"), "title", "text", F.col("path").alias("source"))
    made = N.ingest_pages(sources, pages, projects, date).select("path", "content", "refused")
    archive = taken.select(F.concat(F.lit("results/"), "task_id", F.lit(".result.md")).alias("path"), F.col("text").alias("content"), F.lit(False).alias("refused"))
    return guarded, made.unionByName(archive)
