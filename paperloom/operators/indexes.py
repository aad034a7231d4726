"""Folder indexes: their entries, their text, what is stale, and passes until nothing changes.

Tables: ``pages`` is (store, path, content) of all Markdown files, README.md files being the index pages. A link line is
one row until the text of an index page is put together, which is a file and so one row by nature.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import frontmatter as M
from paperloom.functions import text as X


@dataclass(frozen=True)
class Profile:
    """The contract of a tree; folders are compared by their first segment."""

    archive_dirs: tuple[str, ...] = ()
    plans_root: str | None = None
    root_non_nav: tuple[str, ...] = ()
    bucket_prefix: str = "_"
    sidecar_exts: tuple[str, ...] = ("pdf",)
    persona_pages: tuple[str, ...] = ()
    page_sections: tuple[str, ...] = ("Summary", "Details", "Related")
    enforce_frontmatter: bool = True
    schema_path: str = "schema.md"
    region: str = "index"
    region_heading: str = "Index"
    empty_summary: str = "Document."
    empty_folder: str = "Folder."
    log_heading: str = "# Change Log"
    schema_heading: str = "# Schema"
    exclude: tuple[str, ...] = field(default=())


def page_class(path: Column, profile: Profile) -> Column:
    """struct of flags: archive, plans, bucket, sidecar, root_non_nav, readme, legacy_index, hidden."""
    parts = F.split(path, "/")
    name, first = F.element_at(parts, -1), parts[0]
    deep = F.size(parts) > 1
    ext = "|".join(profile.sidecar_exts)
    return F.struct(
        (deep & first.isin(*profile.archive_dirs)).alias("archive"),
        (first == profile.plans_root if profile.plans_root else F.lit(False)).alias("plans"),
        F.exists(parts, lambda x: F.startswith(x, F.lit(profile.bucket_prefix))).alias("bucket"),
        F.lower(name).rlike(rf"[^/]\.(?:{ext})\.md\z").alias("sidecar"),
        path.isin(*profile.root_non_nav).alias("root_non_nav"),
        (name == "README.md").alias("readme"),
        (name == "index.md").alias("legacy_index"),
        F.exists(parts, lambda x: F.startswith(x, F.lit(".")) | (x == "node_modules")).alias("hidden"),
    )


def indexed_pages(pages: DataFrame, profile: Profile) -> DataFrame:
    """The pages that an index may list: no archive, plan, bucket, hidden or index page."""
    kind = page_class(F.col("path"), profile)
    out = kind["archive"] | kind["plans"] | kind["bucket"] | kind["hidden"] | kind["root_non_nav"] | kind["readme"] | kind["legacy_index"]
    return pages.filter(F.lower("path").rlike(r"\.md\z") & ~out)


def folders(pages: DataFrame, profile: Profile) -> DataFrame:
    """(store, dir) of every folder in scope that holds a page somewhere below it; the root is an empty string."""
    kind = page_class(F.col("path"), profile)
    inside = pages.filter(~(kind["archive"] | kind["plans"] | kind["bucket"] | kind["hidden"]))
    return inside.select("store", F.explode(X.ancestors(F.col("path"))).alias("dir")).distinct()


def readme_title(path: Column, root_title: str = "README") -> Column:
    """The folder's name of an index page."""
    return F.when(X.directory(path) == "", root_title).otherwise(F.substring_index(X.directory(path), "/", -1))


def default_readme(title: Column, profile: Profile) -> Column:
    """The content of an index page that isn't there yet."""
    mark = profile.region
    tail = f"\n\n## {profile.region_heading}\n\n<!-- {mark}:start -->\n\n<!-- {mark}:end -->\n"
    return F.concat(F.lit("---\ntitle: "), title, F.lit("\nstatus: active\n---\n\n# "), title, F.lit(tail))


def with_parts(pages: DataFrame) -> DataFrame:
    """The pages with body, fm (the rows of ``frontmatter.parse``) and said (the Summary section), each computed once."""
    rows = pages.withColumn("_parts", M.split_derived(F.col("content"))).withColumn("body", F.col("_parts.body"))
    return rows.withColumn("fm", M.parse(F.col("_parts.block"))).withColumn("said", X.section(F.col("body"), "Summary")).drop("_parts")


def index_summary(is_readme: bool, name: Column, profile: Profile) -> Column:
    """P5, of ``with_parts``: the description, else the Summary section, else an index page's intro or a page's first lines; in
    one line, and empty where it starts with a round bracket."""
    described = X.trim(F.coalesce(M.field(F.col("fm"), "description")["text"], F.lit("")))
    lead = X.let(X.intro(F.col("body")), lambda x: F.when(x != "", x).otherwise(profile.empty_folder))
    own = lead if is_readme else X.summary_of(F.col("body"), F.col("said"), name)
    text = F.coalesce(F.nullif(described, F.lit("")), F.nullif(F.col("said"), F.lit("")), own)
    clean = X.let(text, lambda x: F.when(F.startswith(x, F.lit("(")), "").otherwise(X.trim(F.regexp_replace(x, r"\n+", " "))))
    return X.let(clean, lambda x: F.when(x == "", profile.empty_summary).otherwise(x))


def leaf_entries(pages: DataFrame, profile: Profile) -> DataFrame:
    """(store, readme, is_dir, link, label, summary, source): the line of every page in its folder's index."""
    leaf = with_parts(indexed_pages(pages, profile).select("store", "path", "content"))
    name = X.stem(F.col("path"))
    title = F.nullif(X.trim(M.field(F.col("fm"), "title")["text"]), F.lit(""))
    heading = F.nullif(F.regexp_extract("body", r"(?m)^[^\S\n]*#\s+(.+?)[^\S\n]*$", 1), F.lit(""))
    return leaf.select(
        "store",
        _readme_of(X.directory(F.col("path"))).alias("readme"),
        F.lit(False).alias("is_dir"),
        F.substring_index("path", "/", -1).alias("link"),
        F.coalesce(title, heading, name).alias("label"),
        index_summary(False, name, profile).alias("summary"),
        F.col("path").alias("source"),
    )


def folder_entries(dirs: DataFrame, readmes: DataFrame, profile: Profile) -> DataFrame:
    """The line of every folder (store, dir) in the index above it, by its index page or, where that is missing, the default one."""
    rows = dirs.filter("dir <> ''").withColumn("path", F.concat("dir", F.lit("/README.md")))
    rows = rows.join(readmes.select("store", "path", "content"), ["store", "path"], "left")
    base = F.substring_index("dir", "/", -1)
    rows = with_parts(rows.withColumn("content", F.coalesce("content", default_readme(base, profile))))
    return rows.select(
        "store",
        _readme_of(X.directory(F.col("dir"))).alias("readme"),
        F.lit(True).alias("is_dir"),
        F.concat(base, F.lit("/README.md")).alias("link"),
        F.concat(base, F.lit("/")).alias("label"),
        index_summary(True, base, profile).alias("summary"),
        F.col("path").alias("source"),
    )


def readme_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("path").rlike(r"(?:\A|/)README\.md\z"))


def index_entries(pages: DataFrame, profile: Profile) -> DataFrame:
    """Every line of every index page, not yet ordered, as (store, readme, is_dir, link, label, summary, source)."""
    return leaf_entries(pages, profile).unionByName(folder_entries(folders(pages, profile), readme_pages(pages), profile))


def _readme_of(directory: Column) -> Column:
    return F.when(directory == "", "README.md").otherwise(F.concat(directory, F.lit("/README.md")))


#: A link in a summary: its label and its target.
_LINK = r"\[[^\]\n]+\]\([^)\n]+\)"


def summary_links(entries: DataFrame) -> DataFrame:
    """(store, readme, link, source, pos, raw, text, target, mark, resolved): the links in the summaries of entries, resolved from the page they stand in.

    Only entries whose summary holds a link are taken apart.
    """
    rows = entries.filter(F.col("summary").rlike(_LINK))
    rows = rows.select("store", "readme", "link", "source", F.posexplode(F.regexp_extract_all("summary", F.lit(f"({_LINK})"), F.lit(1))).alias("pos", "raw"))
    raw = F.regexp_extract("raw", r"\]\((.*)\)\z", 1)
    label = F.regexp_extract("raw", r"(?s)\A\[(.*)\]\(", 1)
    mark = F.regexp_extract(raw, r"\A[^#]*(#.*)\z", 1)
    target = F.trim(F.regexp_extract(raw, r"\A([^#]*)", 1))
    rows = rows.select("*", label.alias("text"), target.alias("target"), mark.alias("mark"))
    return rows.withColumn("resolved", X.resolve(X.directory(F.col("source")), F.col("target")))


def rebase_links(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Links in summaries, seen from the index page: kept if external, rebased if the target is there, else only their label.

    The links meet the files by path.
    """
    key = ["store", "readme", "link"]
    there = files.select("store", F.col("path").alias("resolved")).distinct().withColumn("there", F.lit(True))
    rows = summary_links(entries).join(there, ["store", "resolved"], "left")
    moved = F.concat(F.lit("["), F.col("text"), F.lit("]("), relative(X.directory(F.col("readme")), F.col("resolved")), F.col("mark"), F.lit(")"))
    new = F.when(X.is_external(F.col("target")) & ~F.startswith("target", F.lit("#")), F.col("raw")).when(F.col("there") & (F.col("target") != ""), moved).otherwise(F.col("text"))
    new = rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", new.alias("new")))), lambda x: x["new"]).alias("_new"))
    rows = entries.join(new, key, "left")
    between = F.split("summary", _LINK, -1)
    joined = F.aggregate(F.sequence(F.lit(1), F.size("_new")), between[0], lambda acc, k: F.concat(acc, F.element_at("_new", k), F.element_at(between, k + 1)))
    return rows.withColumn("summary", F.when(F.col("_new").isNotNull(), joined).otherwise(F.col("summary"))).drop("_new")


def relative(base: Column, path: Column) -> Column:
    """The path of ``path`` as seen from the folder ``base``."""
    up, to = F.filter(F.split(base, "/"), lambda x: x != ""), F.split(path, "/")
    places = lambda u: F.sequence(F.lit(1), F.greatest(F.size(u), F.lit(1)))
    same = lambda u, t: F.size(F.filter(places(u), lambda n: (n <= F.size(u)) & (n < F.size(t)) & (F.slice(u, F.lit(1), n) == F.slice(t, F.lit(1), n))))
    out = lambda u, t, k: F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(u) - k), F.slice(t, k + 1, F.size(t))), "/")
    return X.let(up, lambda u: X.let(to, lambda t: X.let(same(u, t), lambda k: out(u, t, k))))


def index_lines(entries: DataFrame) -> DataFrame:
    """(store, readme, is_dir, link, line): the line of each entry."""
    line = F.concat(F.lit("- ["), F.col("label"), F.lit("]("), X.encode_target(F.col("link")), F.lit(") — "), F.col("summary"))
    return entries.select("store", "readme", "is_dir", "link", line.alias("line"))


def index_texts(lines: DataFrame) -> DataFrame:
    """(store, readme, inside): the lines of each index page, pages before folders, then by link."""
    ordered = F.array_sort(F.collect_list(F.struct("is_dir", "link", "line")))
    return lines.groupBy("store", "readme").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("inside"))


def region_link_rows(pages: DataFrame, profile: Profile) -> DataFrame:
    """(store, readme, target): the links in the regions of the index pages, repeats included."""
    found = readme_pages(pages).select("store", F.col("path").alias("readme"), F.explode_outer(X.region_targets(X.region(F.col("content"), profile.region))).alias("target"))
    return found.filter("target is not null")


def stale_regions(lines: DataFrame, pages: DataFrame, profile: Profile) -> DataFrame:
    """(store, readme, missing, extra): index pages whose region links to other targets than it should, order aside.

    Both sides are counted link by link, so no page's links are gathered. Pages without a region are ``missing_regions``.
    """
    kept = pages.filter(X.region(F.col("content"), profile.region).isNotNull()).select("store", F.col("path").alias("readme"))
    want = lines.join(kept, ["store", "readme"], "left_semi").select("store", "readme", F.col("link").alias("target"), F.lit(1).alias("n"))
    have = region_link_rows(pages, profile).withColumn("n", F.lit(-1))
    diff = want.unionByName(have).groupBy("store", "readme", "target").agg(F.sum("n").alias("n")).filter("n <> 0")
    return diff.groupBy("store", "readme").agg(F.sum(F.greatest("n", F.lit(0))).alias("missing"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("extra"))


def missing_regions(pages: DataFrame, profile: Profile) -> DataFrame:
    """(store, readme) of the index pages without both markers."""
    readmes = readme_pages(pages).filter(~page_class(F.col("path"), profile)["bucket"])
    both = F.contains("content", F.lit(f"<!-- {profile.region}:start -->")) & F.contains("content", F.lit(f"<!-- {profile.region}:end -->"))
    return readmes.filter(~both).select("store", F.col("path").alias("readme"))


def readmes_of(dirs: DataFrame) -> DataFrame:
    """(store, readme): the index pages of folders (store, dir)."""
    return dirs.select("store", _readme_of(F.col("dir")).alias("readme"))


def changed_indexes(entries: DataFrame, wanted: DataFrame, readmes: DataFrame, files: DataFrame, profile: Profile) -> DataFrame:
    """(store, path, content, created) of those ``wanted`` index pages (store, readme) that differ from ``readmes``, given all their entries."""
    lines = index_lines(rebase_links(entries.join(wanted, ["store", "readme"], "left_semi"), files))
    texts = index_texts(lines).withColumnRenamed("readme", "path")
    want = wanted.select("store", F.col("readme").alias("path"))
    rows = want.join(texts, ["store", "path"], "left").join(readmes.select("store", "path", F.col("content").alias("old")), ["store", "path"], "left")
    old = X.trim_carriage(F.col("old"))
    now = F.coalesce(old, default_readme(readme_title(F.col("path")), profile))
    rows = rows.select("store", "path", old.alias("old"), X.replace_region(now, profile.region, F.coalesce("inside", F.lit("")), profile.region_heading).alias("content"))
    return rows.filter(~F.col("content").eqNullSafe(F.col("old"))).select("store", "path", "content", F.col("old").isNull().alias("created"))


def index_pass(pages: DataFrame, profile: Profile) -> DataFrame:
    """(store, path, content, created) of the index pages that have to be written, as one pass sees them."""
    return changed_indexes(index_entries(pages, profile), readmes_of(folders(pages, profile)), readme_pages(pages), pages, profile)


@dataclass
class Settled:
    """Tables after the passes: entries, index pages and files as they are now, what was written (store, path, created), and the number of passes."""

    entries: DataFrame
    readmes: DataFrame
    files: DataFrame
    written: DataFrame
    passes: int


def settle_indexes(entries: DataFrame, readmes: DataFrame, files: DataFrame, wanted: DataFrame, profile: Profile, store_checkpoint, passes: int = 10) -> Settled:
    """Passes over ``wanted`` index pages (store, readme) until one writes nothing; more than ``passes`` is an error.

    All tables must be stored. A page that was written changes what the index above says of its folder, and one that is new what links to it can
    say; the next pass takes only the index pages of which an entry changed in these ways.
    """
    key, written = ["store", "readme", "link"], None
    for turn in range(1, passes + 1):
        new = store_checkpoint(changed_indexes(entries, wanted, readmes, files, profile))
        if new.isEmpty():
            return Settled(entries, readmes, files, written if written is not None else new.select("store", "path", "created"), turn)
        done = new.select("store", "path", "created")
        written = store_checkpoint(done if written is None else written.unionByName(done).groupBy("store", "path").agg(F.bool_or("created").alias("created")))
        readmes = store_checkpoint(readmes.join(new, ["store", "path"], "left_anti").unionByName(new.drop("created")))
        created = new.filter("created").select("store", "path")
        files = store_checkpoint(files.unionByName(created))
        above = folder_entries(new.select("store", X.directory(F.col("path")).alias("dir")), new, profile)
        said = entries.filter("is_dir").select(*key, F.struct("label", "summary").alias("_old"))
        above = above.join(said, key, "left").filter(~F.struct("label", "summary").eqNullSafe(F.col("_old"))).drop("_old")
        above = store_checkpoint(above)
        if not above.isEmpty():
            entries = store_checkpoint(entries.join(above, key, "left_anti").unionByName(above))
        met = summary_links(entries).join(created.withColumnRenamed("path", "resolved"), ["store", "resolved"], "left_semi")
        wanted = store_checkpoint(above.select("store", "readme").union(met.select("store", "readme")).distinct())
        if wanted.isEmpty():
            return Settled(entries, readmes, files, written, turn)
    raise RuntimeError(f"index pages still change after {passes} passes")


def index_fixed_point(pages: DataFrame, profile: Profile, store_checkpoint, passes: int = 10) -> tuple[DataFrame, DataFrame, int]:
    """(index pages, what was written as (store, path, created), passes) of whole trees. Pages are read once."""
    entries = store_checkpoint(index_entries(pages, profile))
    wanted = store_checkpoint(readmes_of(folders(pages, profile)))
    readmes = store_checkpoint(readme_pages(pages).select("store", "path", "content"))
    done = settle_indexes(entries, readmes, store_checkpoint(pages.select("store", "path")), wanted, profile, store_checkpoint, passes)
    return done.readmes, done.written, done.passes


def self_heal(pages: DataFrame, profile: Profile, store_checkpoint) -> DataFrame:
    """The pages, with index pages made anew if a region is stale; an error if one still is."""
    stale = lambda p: stale_regions(index_lines(index_entries(p, profile)), p, profile)
    if stale(pages).isEmpty():
        return pages
    readmes, _, _ = index_fixed_point(pages, profile, store_checkpoint)
    healed = pages.join(readmes.select("store", "path"), ["store", "path"], "left_anti").select("store", "path", "content").unionByName(readmes)
    if not stale(healed).isEmpty():
        raise RuntimeError("index regions are stale after they were made anew")
    return healed


def index_structure(pages: DataFrame) -> DataFrame:
    """(store, path, pos, target, section, subsection) of every list link of a page, by its headings of level two and three.

    Lines are taken in page order within each page's own row, so no lines move.
    """
    lines = F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n")
    rows = pages.select("store", "path", lines.alias("lines"))
    places = lambda form: F.filter(F.transform("lines", lambda x, k: F.when(x.rlike(form), k)), lambda k: k.isNotNull())
    rows = rows.select("*", places(r"\A##\s+\S").alias("starts"), places(r"\A###?\s+\S").alias("subs"))
    above = lambda xs, k: F.element_at("lines", F.array_max(F.filter(xs, lambda n: n < k)) + 1)
    # Only links leave the page's row, each with the headings above it.
    link = lambda x, k: F.when(x.rlike(r"\A-\s+\[[^\]]+\]\([^)]+\.md\)"), F.struct(k.alias("pos"), x.alias("line"), above("starts", k).alias("head"), above("subs", k).alias("sub")))
    found = F.filter(F.transform("lines", link), lambda x: x["head"].isNotNull())
    rows = rows.select("store", "path", F.inline(found))
    name = lambda x, n: F.regexp_extract(x, rf"\A{'#' * n}\s+(.+?)\s*\z", 1)
    return rows.select("store", "path", "pos", F.trim(F.regexp_extract("line", r"\A-\s+\[[^\]]+\]\(([^)]+\.md)\)", 1)).alias("target"), name(F.col("head"), 2).alias("section"), F.when(F.col("sub").rlike(r"\A###\s"), name(F.col("sub"), 3)).alias("subsection"))
