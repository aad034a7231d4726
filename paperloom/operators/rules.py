"""Rules for typed pages: every page is read once, its type decides which rules hold, and each breach is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import frontmatter as M
from paperloom.functions import text as X

from .indexes import Profile, missing_regions, page_class, readme_pages, stale_regions
from .pages import links, reachable, resolve_nav

#: What the two special files must declare.
SPECIAL = {
    "dispatch-log.md": {
        "fields": {
            "title": ("string", "Dispatch Log"),
            "type": ("string", "special/dispatch-log"),
            "updated": ("datetime", None),
            "entry_format": ("string", "append-only-ledger"),
            "boot_priority": ("integer", 1),
        },
        "sections": ("Entries",),
        "ledger": True,
    },
    "decisions.md": {
        "fields": {
            "title": ("string", "Decisions"),
            "type": ("string", "special/decisions"),
            "updated": ("datetime", None),
            "entry_rule": ("string", "explicit-user-decision-only"),
            "source_of_truth": ("string", "user-direct"),
            "boot_priority": ("integer", 3),
        },
        "sections": ("About", "Decisions"),
        "ledger": False,
    },
}


def page_type(path: Column, profile: Profile, source: Column) -> Column:
    """the first type that fits, in a fixed order. ``source`` is the page's source field, for pages of managed skills."""
    kind, parts = page_class(path, profile), F.split(path, "/")
    first, deep = parts[0], F.size(parts)
    under = lambda name: (first == name) & (deep > 1) & F.endswith(path, F.lit(".md"))
    return (
        F.when(kind["root_non_nav"], "unchecked")
        .when(kind["plans"], "unchecked")
        .when(kind["bucket"] & kind["readme"], "unchecked")
        .when(kind["sidecar"], "sidecar")
        .when(kind["readme"], "readme")
        .when(~F.lit(profile.enforce_frontmatter), "plain")
        .when(path == "log.md", "log")
        .when(path == profile.schema_path, "schema")
        .when(under("calendar"), "calendar")
        .when((first == "memos") & (deep > 1), "memo")
        .when(under("learnings"), "learning")
        .when(under("lessons"), "lesson")
        .when(under("results"), "result")
        .when(path.isin(*profile.persona_pages), "persona")
        .when(((first == "docs") & (deep > 1)) | (F.lit(first.isin("domains", "projects")) & (deep > 2) & F.endswith(path, F.lit(".md"))), "reference")
        .when((first == "operational-rules") & (deep == 2) & F.endswith(path, F.lit(".md")), "rule")
        .when((first == "projects") & (deep == 2) & F.endswith(path, F.lit(".project-decisions.md")), "decision")
        .when((first == "domains") & (deep == 2) & F.startswith(source, F.lit("skills/")), "skill")
        .when(path.isin(*SPECIAL), "special")
        .otherwise("generic")
    )


def checked_pages(pages: DataFrame, profile: Profile) -> DataFrame:
    """(store, path, content, has_fm, fm, body, heads, type) of every page, read once in the checked dialect."""
    rows = pages.select("store", "path", "content", M.split_checked(F.col("content")).alias("_p"))
    rows = rows.select("store", "path", "content", F.col("_p.has").alias("has_fm"), M.parse_checked(F.col("_p.block")).alias("fm"), F.col("_p.body").alias("body"))
    heads = F.regexp_extract_all("body", F.lit(r"(?m)^##\s+([^\n]*?)[^\S\n]*$"), F.lit(1))
    rows = rows.withColumn("heads", heads).withColumn("_source", M.checked_text(F.col("fm"), "source"))
    return rows.withColumn("type", page_type(F.col("path"), profile, F.col("_source"))).drop("_source")


#: The fields that rules look at.
FIELDS = (
    *("title", "name", "domain", "tags", "created", "updated", "sources", "images", "moved_to", "last_verified", "type", "project"),
    *("boot_priority", "slug", "date", "start", "source", "sourcePath", "sha256", "extractor", "entry_format", "entry_rule", "source_of_truth"),
)


def _with_fields(checked: DataFrame) -> DataFrame:
    """Adds _f, a struct (text, raw, listed) for each of FIELDS, so that a field is looked up once a page."""

    def of(key: str) -> Column:
        raw = lambda r: F.trim(F.coalesce(r["text"], F.lit("")))
        listed = lambda r: F.coalesce(r["listed"], F.lit(False)) | raw(r).rlike(r"(?s)\A\[.*\]\z")
        return X.let(M.field(F.col("fm"), key), lambda r: F.struct(M.bare_text(raw(r)).alias("text"), raw(r).alias("raw"), listed(r).alias("listed"))).alias(key)

    return checked.withColumn("_f", F.struct(*[of(key) for key in FIELDS]))


def typed_issues(checked: DataFrame, profile: Profile) -> DataFrame:
    """B2, 2.11: (store, file, code, detail) of the rules of each page's type, found without moving a row.

    ``detail`` names the field or section where a rule has several.
    """
    checked = _with_fields(checked)
    text = lambda key: F.col(f"_f.{key}.text")
    raw = lambda key: F.col(f"_f.{key}.raw")
    listed = lambda key: F.col(f"_f.{key}.listed")
    day_or_time = lambda x: X.is_date(x) | X.is_datetime(x)
    section = lambda name: F.exists("heads", lambda h: (h == name) | F.startswith(h, F.lit(f"{name} ")))
    of = lambda *types: F.col("type").isin(*types)
    has, body = F.col("has_fm"), X.trim(F.col("body")) == ""
    moved = of("rule") & (text("moved_to") != "")
    rules: list[tuple[str, str, Column]] = []

    def rule(code: str, when: Column, detail: str = "") -> None:
        rules.append((code, detail, when))

    typed = ("generic", "memo", "learning", "lesson", "skill", "rule", "decision", "calendar", "persona", "schema")
    rule("missing-frontmatter", of(*typed, "sidecar", "special") & ~has)
    rule("missing-frontmatter-title", of(*(t for t in typed if t != "learning")) & has & (text("title") == ""))
    rule("missing-frontmatter-title", of("learning") & has & (text("title") == "") & (text("name") == ""))
    rule("deprecated-frontmatter-domain", of("generic", "memo", "learning", "lesson", "rule", "decision", "calendar", "persona", "readme") & has & (text("domain") != ""))
    rule("frontmatter-tags-format", has & ((of("generic") | (of("rule") & ~moved)) & ~listed("tags")))
    rule("frontmatter-tags-format", has & of("learning", "lesson") & (text("tags") != "") & ~listed("tags"))
    rule("frontmatter-created-format", has & of("generic") & ~X.is_date(raw("created")))
    rule("frontmatter-created-format", has & of("memo") & ~X.is_datetime(raw("created")))
    rule("frontmatter-created-format", has & of("learning", "lesson") & (text("created") != "") & ~day_or_time(text("created")))
    rule("frontmatter-updated-format", has & of("generic") & ~X.is_date(raw("updated")))
    rule("frontmatter-updated-format", has & of("memo", "decision") & ~X.is_datetime(raw("updated")))
    rule("frontmatter-updated-format", has & of("learning") & (text("updated") != "") & ~day_or_time(text("updated")))
    rule("frontmatter-updated-format", has & of("rule") & ~moved & (text("updated") != "") & ~X.is_date(text("updated")))
    rule("frontmatter-updated-format", has & of("persona") & ~day_or_time(text("updated")))
    rule("frontmatter-sources-format", has & of("generic") & (text("sources") != "") & ~listed("sources"))
    rule("frontmatter-images-format", has & of("memo") & ~listed("images"))
    rule("missing-frontmatter-verification", has & of("rule") & ~moved & (text("last_verified") == "") & (text("updated") == ""))
    rule("frontmatter-last-verified-format", has & of("rule") & ~moved & (text("last_verified") != "") & ~X.is_date(text("last_verified")))
    rule("frontmatter-type-mismatch", has & of("lesson") & (text("type") != "") & (text("type") != "lesson"), "type")
    rule("frontmatter-type-mismatch", has & of("decision") & (text("type") != "special/project-decisions"), "type")
    rule("frontmatter-type-mismatch", has & of("persona") & (text("type") != "") & (text("type") != "domain"), "type")
    rule("missing-frontmatter-project", has & of("decision") & (text("project") == ""))
    # A blank value reads as the number 0, which is whole.
    rule("frontmatter-boot-priority-format", has & of("decision") & (text("boot_priority") != "") & ~X.is_integer(text("boot_priority")))
    rule("missing-frontmatter-slug", has & of("persona") & (text("slug") == ""))
    rule("missing-frontmatter-date", has & of("calendar") & (text("date") == "") & (text("start") == ""))
    rule("missing-body", has & of("learning", "lesson") & body)
    rule("managed-skill-source", has & of("skill") & ~F.startswith(text("source"), F.lit("skills/")))
    rule("managed-skill-source-path", has & of("skill") & (text("sourcePath") == ""))
    for name in profile.page_sections:
        rule("missing-section", has & of("generic") & ~section(name), name)
    for name in ("Summary", "Related"):
        rule("missing-section", has & of("rule") & ~moved & ~section(name), name)
    rule("missing-section", has & of("rule") & ~moved & ~F.exists("heads", lambda h: ~h.isin("Summary", "Related")), "*")
    for name in ("About", "Decisions"):
        rule("missing-section", has & of("decision") & ~section(name), name)
    rule("missing-section", has & of("persona") & ~section("About"), "About")
    rule("missing-section", has & of("persona") & ~F.exists("heads", lambda h: F.contains(F.lower(h), F.lit("timeline")) | F.contains(h, F.lit("일지"))), "timeline")
    for name in ("Summary", "Directories", "Special Files"):
        rule("missing-section", has & of("schema") & ~F.contains("content", F.lit(f"## {name}")), name)
    rule("schema-heading", has & of("schema") & ~F.contains("content", F.lit(profile.schema_heading)))
    rule("log-heading", of("log") & ~F.startswith("content", F.lit(profile.log_heading)))
    rule("missing-log-date-section", of("log") & ~F.col("content").rlike(r"(?m)^## \d{4}-\d{2}-\d{2}$"))
    rule("missing-log-entry", of("log") & ~F.col("content").rlike(r"(?m)^- (INIT|MIGRATE|UPDATE|INGEST|CREATE|ARCHIVE|SYNC_SKILLS): "))
    for key in ("title", "source", "sha256", "extractor"):
        rule("sidecar-stamp-missing-field", has & of("sidecar") & (text(key) == ""), key)
    project = F.col("path").rlike(r"\Aprojects/[^/]+\.md\z") & ~F.endswith("path", F.lit(".project-decisions.md"))
    rule("project-ingest-marker", has & project & F.contains("body", F.lit("<!-- ingest:")))
    results = F.split(F.regexp_replace(raw("sources"), r"\A\[|\]\z", ""), ",")
    rule("project-result-sources", has & project & raw("sources").rlike(r"(?s)\A\[.*\]\z") & F.exists(results, lambda x: F.regexp_replace(F.trim(x), "[\"']", "").rlike(r"\.result\.md\z")))
    rule("managed-skill-inbox", has & F.col("path").rlike(r"\Ainbox/[^/]+\.md\z") & F.startswith(text("source"), F.lit("skills/")))
    rule("domain-top-level-drift", F.col("path").rlike(r"\Adomains/[^/]+\.md\z") & (F.col("path") != "domains/README.md") & ~F.col("path").isin(*profile.persona_pages))
    rule("legacy-index-file", F.col("path").rlike(r"(?:\A|/)index\.md\z") & ~page_class(F.col("path"), profile)["archive"])
    for name, spec in SPECIAL.items():
        here = has & of("special") & (F.col("path") == name)
        for key, (kind, exact) in spec["fields"].items():
            rule("missing-frontmatter-field", here & (text(key) == ""), key)
            good = X.is_datetime(text(key)) if kind == "datetime" else X.is_integer(text(key)) if kind == "integer" else F.lit(True)
            rule("frontmatter-type-mismatch", here & (text(key) != "") & ~good, key)
            if exact is not None:
                same = X.is_integer(text(key), exact=exact) if kind == "integer" else text(key) == exact
                rule("frontmatter-value-mismatch", here & (text(key) != "") & good & ~same, key)
        for part in spec["sections"]:
            rule("missing-section", here & ~section(part), part)
    codes = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(detail).alias("detail"))) for code, detail, when in rules]))
    rows = checked.withColumn("_x", F.explode_outer(codes)).filter("_x is not null")
    return rows.select("store", F.col("path").alias("file"), "_x.code", "_x.detail")


def ledger_issues(checked: DataFrame) -> DataFrame:
    """ledger-line-invalid: a row for each line of a ledger's entries that has no time and no fields."""
    ledgers = [name for name, spec in SPECIAL.items() if spec["ledger"]]
    entries = X.section(F.col("body"), "Entries")
    lines = F.when(~X.is_placeholder(entries), F.filter(X.content_lines(entries), lambda x: F.startswith(x, F.lit("- ")) & ~x.rlike(r"\A- \d{4}-\d{2}-\d{2}T[^|]+\| .+")))
    rows = checked.filter(F.col("path").isin(*ledgers) & (F.col("type") == "special") & F.col("has_fm"))
    return rows.select("store", F.col("path").alias("file"), F.lit("ledger-line-invalid").alias("code"), F.explode(lines).alias("detail"))


def schema_sections(pages: DataFrame, profile: Profile) -> DataFrame:
    """(store, name, text) of the special files that a tree's schema page lists."""
    rows = pages.filter(F.col("path") == profile.schema_path)
    rest = F.regexp_extract(F.concat(F.lit("\n"), F.replace("content", F.lit("\r"), F.lit(""))), r"(?s)\n## Special Files[^\n]*(.*?)(?=\n## |\z)", 1)
    part = F.explode(F.slice(F.split(rest, r"\n(?=### \d+\) `)"), 2, 2**31 - 1))
    rows = rows.select("store", part.alias("part"))
    return rows.select("store", F.regexp_extract("part", r"\A### \d+\) `([^`]+)`", 1).alias("name"), F.regexp_replace("part", r"\A[^\n]*\n?", "").alias("text")).filter("name <> ''")


def schema_issues(pages: DataFrame, profile: Profile, writers: dict[str, str]) -> DataFrame:
    """What a tree's schema page and its special files say of each other.

    ``writers`` names the primary writer of every special file that the runtime knows.
    """
    spark = pages.sparkSession
    known = spark.createDataFrame([(n, SPECIAL[n]["fields"]["type"][1], w) for n, w in writers.items()], "name string, type string, writer string")
    said = schema_sections(pages, profile)
    trees = pages.filter(F.col("path") == profile.schema_path).select("store").distinct()
    both = trees.crossJoin(F.broadcast(known)).join(said, ["store", "name"], "left")
    mark = lambda code, when: F.when(when, F.lit(code))
    codes = F.array_compact(
        F.array(
            mark("schema-missing-file", F.col("text").isNull()),
            mark("schema-type-mismatch", ~F.contains("text", F.concat(F.lit("type: "), F.col("type")))),
            mark("schema-writer-mismatch", ~F.contains("text", F.col("writer"))),
        )
    )
    issues = both.select("store", F.col("name").alias("file"), F.explode(codes).alias("code"), F.lit("").alias("detail"))
    missing = both.filter("text is null").select("store", F.col("name").alias("detail"))
    extra = said.join(F.broadcast(known), "name", "left_anti").select("store", F.col("name").alias("detail"))
    diverged = missing.union(extra).groupBy("store").agg(F.array_join(F.array_sort(F.collect_set("detail")), ",").alias("detail"))
    whole = lambda stores, code: stores.select("store", F.lit(profile.schema_path).alias("file"), F.lit(code).alias("code"), F.lit("").alias("detail"))
    absent = pages.select("store").distinct().join(trees, "store", "left_anti")
    issues = issues.union(whole(absent, "missing-schema")).union(whole(trees.join(said, "store", "left_anti"), "schema-special-files-missing"))
    return issues.union(diverged.select("store", F.lit(profile.schema_path).alias("file"), F.lit("schema-runtime-special-file-mismatch").alias("code"), "detail"))


def navigation_issues(pages: DataFrame, profile: Profile, store_checkpoint) -> DataFrame:
    """2.11, G1: (store, file, code, detail): pages that no way leads to from a tree's root over the regions of its index pages, and links of the
    index pages on these ways that mean nothing. Trees without a root page are left to ``tree_issues``.
    """
    kind = page_class(F.col("path"), profile)
    inside = pages.filter(~(kind["archive"] | kind["plans"] | kind["bucket"] | kind["hidden"] | kind["root_non_nav"]))
    files = store_checkpoint(inside.select("store", "path"))
    regions = readme_pages(inside).select("store", "path", X.region(F.col("content"), profile.region).alias("content")).filter("content is not null")
    nav = store_checkpoint(resolve_nav(links(regions), pages.select("store", "path")))
    seen = store_checkpoint(reachable(nav.filter("`to` is not null").select("store", "path", "to"), files.filter("path = 'README.md'"), store_checkpoint))
    rooted = files.filter("path = 'README.md'").select("store")
    lost = files.join(rooted, "store", "left_semi").join(seen, ["store", "path"], "left_anti")
    lost = lost.select("store", F.col("path").alias("file"), F.lit("unreachable-page").alias("code"), F.lit("").alias("detail"))
    wrong = nav.filter("code is not null").join(seen, ["store", "path"], "left_semi")
    return lost.union(wrong.select("store", F.col("path").alias("file"), "code", F.col("target").alias("detail")))


def tree_issues(pages: DataFrame, profile: Profile, lines: DataFrame) -> DataFrame:
    """2.11: rules of whole trees: index regions (``lines`` are the expected ones), folders without an index, shared buckets, old memos."""
    row = lambda df, file, code: df.select("store", file.alias("file"), F.lit(code).alias("code"), F.lit("").alias("detail"))
    all_dirs = pages.select("store", F.explode(X.ancestors(F.col("path"))).alias("dir")).distinct()
    readmes = pages.filter(F.endswith("path", F.lit("/README.md"))).select("store", X.directory(F.col("path")).alias("dir"))
    bare = all_dirs.join(readmes, ["store", "dir"], "left_anti").filter("dir = 'domains' or dir like 'domains/%'").filter(~F.col("dir").rlike(r"/(?:_[^/]*|assets|images)(?:/|\z)"))
    shared = all_dirs.filter(F.col("dir").rlike(r"\Aprojects/_[^/]*\z"))
    memos = pages.filter(F.col("path").rlike(r"\Araw/memos/[^/]+\.md\z")).select("store").distinct()
    no_root = pages.select("store").distinct().join(pages.filter("path = 'README.md'").select("store"), "store", "left_anti")
    out = [
        row(missing_regions(pages, profile), F.col("readme"), "missing-index-region"),
        row(stale_regions(lines, pages, profile), F.col("readme"), "index-region-stale"),
        row(bare.filter("dir <> 'domains'"), F.col("dir"), "domain-folder-index-missing"),
        row(bare.filter(F.col("dir").rlike(r"\Adomains/[^/]+\z")), F.col("dir"), "domain-category-dir-drift"),
        row(shared, F.col("dir"), "project-shared-evidence-bucket"),
        row(memos, F.lit("raw/memos"), "legacy-raw-memos"),
        row(no_root, F.lit("README.md"), "missing-root-readme"),
    ]
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def cross_store_issues(pointed: DataFrame, judged: DataFrame | None, problem: str | None = None) -> DataFrame:
    """2.11: issues of pointers to other stores. ``pointed`` are ``pages.pointer_rows``, ``judged`` what ``pages.pointers`` says of them;
    without a registry ``judged`` is None, and ``problem`` tells why one that is there can't be read.
    """
    names = {"unknown-store": "cross-store-unknown-store", "root-missing": "cross-store-store-root-missing", "registry-mismatch": "cross-store-registry-mismatch", "invalid": "cross-store-pointer-invalid", "unresolved": "cross-store-pointer-unresolved"}
    if judged is not None:
        code = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("code")]
        return judged.filter("code <> 'ok'").select(F.lit("").alias("store"), F.col("src").alias("file"), code.alias("code"), F.col("raw").alias("detail"))
    count = pointed.groupBy(F.col("src_store").alias("store")).agg(F.count("*").cast("string").alias("detail"))
    return count.select("store", F.lit("(registry)").alias("file"), F.lit("cross-store-registry-invalid" if problem else "cross-store-check-skipped").alias("code"), "detail")


def missing_files(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """missing-file: the requested (store, path) that are not there."""
    rows = wanted.join(pages.select("store", "path").distinct(), ["store", "path"], "left_anti")
    return rows.select("store", F.col("path").alias("file"), F.lit("missing-file").alias("code"), F.lit("").alias("detail"))


def with_severity(issues: DataFrame) -> DataFrame:
    """Every issue is an error, but for a check that was skipped."""
    return issues.withColumn("severity", F.when(F.col("code") == "cross-store-check-skipped", "warn").otherwise("error"))


def summary(issues: DataFrame, files: DataFrame) -> DataFrame:
    """A1: (store, ok, issues, errors, warnings, files) of every store in ``files``, those without issues included."""
    counts = issues.groupBy("store").agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    rows = files.groupBy("store").agg(F.count("*").alias("files")).join(counts, "store", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("issues", "errors", "warnings")}
    return rows.withColumns(zero).withColumn("ok", F.col("errors") == 0)


def report(issues: DataFrame, files: DataFrame, most: int = 20) -> DataFrame:
    """K3, T4: (store, text): a summary line and up to ``most`` issue lines, in order of file and code.

    Lines are ranked within (store, code) first, so that the final order is made of bounded numbers of rows.
    """
    top = issues.withColumn("_n", F.row_number().over(Window.partitionBy("store", "code").orderBy("file", "detail"))).filter(F.col("_n") <= most)
    line = F.concat_ws(" ", "severity", "code", "file", F.nullif("detail", F.lit("")))
    rows = top.groupBy("store").agg(F.slice(F.array_sort(F.collect_list(F.struct("file", "code", "detail", line.alias("line")))), 1, most).alias("rows"))
    head = F.format_string("%d issues (%d errors, %d warnings) in %d files", "issues", "errors", "warnings", "files")
    text = F.array_join(F.concat(F.array(head), F.transform(F.coalesce("rows", F.array().cast(dict(rows.dtypes)["rows"])), lambda r: r["line"])), "\n")
    return summary(issues, files).join(rows, "store", "left").select("store", text.alias("text"))
