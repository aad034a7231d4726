"""Tables derived from pages: fields, sections, links, rules, and what an index reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import frontmatter as M
from paperloom.functions import paths as Q
from paperloom.functions import text as X


def frontmatter_fields(pages: DataFrame) -> DataFrame:
    """(store, path, key, value) of the fields; of equal keys, the last counts; a list's items are joined by ", "."""
    rows = pages.select("store", "path", F.explode(M.parse(M.split_derived(F.col("content"))["block"])).alias("f"))
    return rows.select("store", "path", "f.key", F.when(F.col("f.listed"), F.array_join("f.items", ", ")).otherwise(F.col("f.text")).alias("value"))


def sections(pages: DataFrame) -> DataFrame:
    """(store, path, pos, heading, line, chars): the preamble under a null heading and position 0, and the sections under
    level-two headings in page order, with the body's line at which each starts."""
    rows = pages.select("store", "path", X.let(X.body(F.col("content")), lambda b: F.split(F.concat(F.lit("\n"), b), r"\n(?=##\s+[^\n])")).alias("parts"))
    sizes = F.transform("parts", lambda p, k: F.size(F.split(p, "\n")) - F.when(k == 0, 1).otherwise(0))
    starts = F.aggregate(sizes, F.array(F.lit(1)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    pairs = F.transform(F.arrays_zip("parts", F.slice("starts", F.lit(1), F.size("parts")).alias("line")), lambda x: F.struct(x["parts"].alias("part"), x["line"].alias("line")))
    rows = rows.withColumn("starts", starts).select("store", "path", F.posexplode(pairs).alias("pos", "x")).select("store", "path", "pos", "x.part", "x.line")
    heading = F.when(F.col("pos") > 0, F.trim(F.regexp_extract("part", r"\A##\s+([^\n]*)", 1)))
    text = X.trim(F.when(F.col("pos") > 0, F.regexp_replace("part", r"\A[^\n]*\n?", "")).otherwise(F.col("part")))
    found = rows.select("store", "path", "pos", heading.alias("heading"), "line", F.length(text).alias("chars"))
    return found.filter("pos > 0 or chars > 0")


def links(pages: DataFrame) -> DataFrame:
    """(store, path, pos, target, resolved) of the links within the tree; resolved is null outside it."""
    rows = pages.select("store", "path", F.posexplode_outer(X.link_targets(F.col("content"))).alias("pos", "raw")).filter("raw is not null")
    rows = rows.withColumn("target", X.clean_target(F.col("raw"))).filter((F.col("target") != "") & ~X.is_external(F.col("raw")))
    return rows.select("store", "path", "pos", "target", X.resolve(X.directory(F.col("path")), F.col("target")).alias("resolved"))


def broken_links(found: DataFrame, files: DataFrame) -> DataFrame:
    """The links that lead to no file; an anti-join on store and path."""
    there = files.select("store", F.col("path").alias("resolved")).distinct()
    return found.join(there, ["store", "resolved"], "left_anti")


def resolve_nav(found: DataFrame, files: DataFrame) -> DataFrame:
    """(store, path, pos, target, to, code): what each link means: the index page of a folder, else the file itself, else the
    one with .md; without any, out-of-root, case-mismatch (only another spelling is there) or broken-link."""
    there = files.select("store", F.col("path").alias("way"), F.lit(True).alias("there")).distinct()
    ways = F.array(F.concat_ws("/", F.nullif("resolved", F.lit("")), F.lit("README.md")), F.col("resolved"), F.when(~F.substring_index("resolved", "/", -1).contains("."), F.concat("resolved", F.lit(".md"))))
    key = ["store", "path", "pos", "target", "resolved"]
    rows = found.select(*key, F.posexplode_outer(F.when(F.col("resolved").isNotNull(), ways)).alias("rank", "way")).join(there, ["store", "way"], "left")
    lower = files.select("store", F.lower("path").alias("low")).distinct().withColumn("near", F.lit(True))
    rows = rows.withColumn("low", F.lower("way")).join(lower, ["store", "low"], "left")
    rows = rows.groupBy(*key).agg(F.min_by(F.when(F.col("there"), F.col("way")), F.when(F.col("there"), F.col("rank"))).alias("to"), F.bool_or("near").alias("near"))
    code = F.when(F.col("to").isNotNull(), None).when(F.col("resolved").isNull(), "out-of-root").when(F.coalesce("near", F.lit(False)), "case-mismatch").otherwise("broken-link")
    return rows.select("store", "path", "pos", "target", "to", code.alias("code"))


def nav_errors(found: DataFrame, files: DataFrame) -> DataFrame:
    """The links that mean nothing, with their codes."""
    return resolve_nav(found, files).filter("code is not null").select("store", "path", "target", "code")


def pointer_rows(pages: DataFrame) -> DataFrame:
    """(src_store, src, raw, store, path) of the `store:path` pointers outside code fences whose path is a page or a folder."""
    form = r"`\s*([a-z][a-z0-9]*(?:-[a-z0-9]+)*:[^`\s]+)\s*`"
    found = pages.select(F.col("store").alias("src_store"), F.col("path").alias("src"), F.explode_outer(F.regexp_extract_all(X.strip_fences(F.col("content")), F.lit(form), F.lit(1))).alias("raw")).filter("raw is not null")
    found = found.withColumn("store", F.substring_index("raw", ":", 1)).withColumn("path", F.expr("substring(raw, locate(':', raw) + 1)"))
    return found.filter(F.col("path").rlike(r"(?:\.md|/)\z") & ~F.startswith("path", F.lit("/")) & ~F.contains("path", F.lit("://")))


def pointers(pages: DataFrame, stores: DataFrame, files: DataFrame) -> DataFrame:
    """Every pointer with unknown-store, root-missing, registry-mismatch, invalid (it leaves the store), unresolved or ok.

    ``stores`` are the registered (store) with an optional status (ok, root-missing, id-mismatch), few by nature. A path
    that ends with a slash means a folder, any other a file.
    """
    known = stores.withColumn("status", F.col("status") if "status" in stores.columns else F.lit("ok"))
    found = pointer_rows(pages).join(known.select("store", "status"), "store", "left")
    found = found.withColumn("is_dir", F.endswith("path", F.lit("/"))).withColumn("at", X.resolve(F.lit(""), F.regexp_replace("path", r"/+\z", "")))
    dirs = files.select("store", F.explode(X.ancestors(F.col("path"))).alias("at")).distinct().select("store", "at", F.lit(True).alias("is_dir"))
    there = files.select("store", F.col("path").alias("at"), F.lit(False).alias("is_dir")).distinct().union(dirs).withColumn("there", F.lit(True))
    found = found.join(there, ["store", "at", "is_dir"], "left")
    code = (
        F.when(F.col("status").isNull(), "unknown-store")
        .when(F.col("status") == "root-missing", "root-missing")
        .when(F.col("status") == "id-mismatch", "registry-mismatch")
        .when(F.col("at").isNull(), "invalid")
        .when(F.col("there").isNull(), "unresolved")
        .otherwise("ok")
    )
    return found.select("src", "raw", code.alias("code"))


def lint(pages: DataFrame, required: list[str]) -> DataFrame:
    """B2 for generic pages: (store, file, code) of every rule that a page breaks, in one pass over the text."""
    pages = pages.withColumns({"_block": X.frontmatter_block(F.col("content")), "_body": X.body(F.col("content"))})
    block = F.col("_block")
    has = lambda key: block.rlike(rf"(?m)^{key}:")
    valid = lambda key: block.rlike(rf"(?m)^{key}: \d{{4}}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[ \t]*$")
    section = lambda name: F.col("_body").rlike(rf"(?m)^## {name}(?: |$)")
    rules: list[tuple[str, Column]] = [
        ("missing-frontmatter", block == ""),
        ("missing-frontmatter-title", (block != "") & ~has("title")),
        ("frontmatter-tags-format", (block != "") & ~block.rlike(r"(?m)^tags: \[.*\][ \t]*$")),
        ("frontmatter-created-format", (block != "") & ~valid("created")),
        ("frontmatter-updated-format", (block != "") & ~valid("updated")),
        ("deprecated-frontmatter-domain", has("domain")),
        *[(f"missing-section:{name}", ~section(name)) for name in required],
    ]
    codes = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules]))
    return pages.select("store", F.col("path").alias("file"), F.explode_outer(codes).alias("code")).filter("code is not null")


def lint_summary(issues: DataFrame) -> DataFrame:
    """A1: issues and files by store."""
    return issues.groupBy("store").agg(F.count("*").alias("issues"), F.count_distinct("file").alias("files"))


def tag_pool(pages: DataFrame) -> DataFrame:
    """A3: tags regardless of case, in the spelling of the first page, with the number of pages."""
    tags = M.field(M.parse(M.split_derived(F.col("content"))["block"]), "tags")["items"]
    rows = pages.select("store", "path", F.explode(tags).alias("tag")).withColumn("tag", X.trim(F.col("tag"))).filter("tag <> ''")
    return rows.groupBy("store", F.lower("tag").alias("key")).agg(F.min_by("tag", "path").alias("tag"), F.count_distinct("path").alias("pages")).drop("key")


def folder_children(files: DataFrame) -> DataFrame:
    """Pages of each folder besides its index."""
    rows = files.withColumn("dir", X.directory(F.col("path"))).filter(~F.col("path").rlike(r"(?:\A|/)README\.md\z"))
    return rows.groupBy("store", "dir").agg(F.count("*").alias("pages"), F.min("path").alias("first"))


def reachable(edges: DataFrame, roots: DataFrame, store_checkpoint) -> DataFrame:
    """G1: (store, path) reached from ``roots`` over ``edges`` (store, path, to): a frontier that grows until nothing is new.

    A round stores what is new and nothing else. Rounds are as many as the longest way has steps, which for index pages are folders.
    """
    seen = frontier = store_checkpoint(roots.select("store", "path").distinct())
    while not frontier.isEmpty():
        step = frontier.join(edges, ["store", "path"]).select("store", F.col("to").alias("path")).distinct()
        frontier = store_checkpoint(step.join(seen, ["store", "path"], "left_anti"))
        seen = seen.union(frontier)
    return seen


def connections(found: DataFrame, files: DataFrame, pointed: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """A2: pages, orphans (no link from another page), unresolved links, pointers to other stores and those to unknown ones, by store.

    ``found`` are links, each of which is resolved once; ``pointed`` are ``pointer_rows``. Without a registry (``known``
    stores) unknown is null.
    """
    nav = resolve_nav(found, files)
    good = nav.filter("`to` <> path").select("store", F.col("to").alias("path")).distinct()
    orphans = files.join(good, ["store", "path"], "left_anti").groupBy("store").agg(F.count("*").alias("orphans"))
    broken = nav.filter("code is not null").groupBy("store").agg(F.count("*").alias("unresolved"))
    out = files.groupBy("store").agg(F.count("*").alias("pages")).join(orphans, "store", "left").join(broken, "store", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    if pointed is None:
        return out.select("store", "pages", zero("orphans"), zero("unresolved"))
    there = F.lit(None).cast("boolean")
    rows = pointed
    if known is not None:
        rows, there = pointed.join(known.select("store", F.lit(True).alias("_known")), "store", "left"), F.col("_known").isNull()
    sums = rows.groupBy(F.col("src_store").alias("store")).agg(F.count("*").alias("pointers"), F.count_if(there).alias("unknown"))
    out = out.join(sums, "store", "left")
    return out.select("store", "pages", zero("orphans"), zero("unresolved"), zero("pointers"), (zero("unknown") if known is not None else F.lit(None).cast("long")).alias("unknown"))


def related_section(existing: Column, added: Column) -> Column:
    """The bullets of a section and new ones, each once, as a section's text."""
    return F.array_join(F.transform(F.array_distinct(F.concat(X.bullets(existing), added)), lambda x: F.concat(F.lit("- "), x)), "\n")


def grep_files(pages: DataFrame, pattern: str, scope: str = "") -> DataFrame:
    """(store, path) of the pages below ``scope`` with a match, regardless of case; folders of secrets are passed over."""
    inside = F.lit(True) if not scope else F.startswith("path", F.lit(scope.rstrip("/") + "/"))
    return pages.filter(inside & ~Q.crosses_secret_dir(F.col("path")) & F.col("content").rlike(f"(?i){pattern}")).select("store", "path")


def grep_lines(docs: DataFrame, id_col: str, text_col: str, pattern: str, context: int = 1) -> DataFrame:
    """the lines that match, and ``context`` lines around each, once; found within each text, so nothing moves."""
    lines = F.split(F.col(text_col), "\n")
    rows = docs.filter(F.col(text_col).rlike(f"(?i){pattern}")).select(id_col, lines.alias("lines"))
    rows = rows.withColumn("hits", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda k: F.element_at("lines", k + 1).rlike(f"(?i){pattern}")))
    near = F.array_distinct(F.flatten(F.transform("hits", lambda k: F.sequence(F.greatest(k - context, F.lit(0)), F.least(k + context, F.size("lines") - 1)))))
    # The lines to give are picked within the text, as an exploded row would carry all of them.
    found = F.transform(near, lambda k: F.struct(k.alias("line"), F.array_contains("hits", k).alias("hit"), F.element_at("lines", k + 1).alias("text")))
    return rows.select(id_col, F.inline_outer(found)).filter("line is not null")


def keyword_route(docs: DataFrame, id_col: str, text_col: str, lists: dict[str, list[str]], default: str) -> DataFrame:
    """Distinct keyword hits of each list and the list with most, by name where equal."""
    low = F.lower(F.col(text_col))
    score = lambda ws: sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0))
    rows = docs.select(id_col, *[score(ws).alias(name) for name, ws in lists.items()])
    best = F.array_sort(F.array(*[F.struct((-F.col(n)).alias("s"), F.lit(n).alias("n")) for n in lists]))[0]
    tied = sum(((F.col(n) == -best["s"]).cast("int") for n in lists), F.lit(0)) > 1
    return rows.withColumn("section", F.when(best["s"] < 0, best["n"]).otherwise(default)).withColumn("ambiguous", (best["s"] < 0) & tied)
