"""Filling in descriptions, tags and other names of pages, and texts taken out of binary files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import frontmatter as M
from paperloom.functions import paths as Q
from paperloom.functions import text as X

from .changes import enrich_need
from .indexes import Profile, page_class
from .snapshots import cap

FIELDS = ("description", "tags", "aliases")
#: How much of a body and of the known tags a prompt holds, and the sizes of tags and other names.
BODY_CHARS, POOL_TAGS = 8_000, 200
TAGS, ALIASES = (8, 40), (12, 60)


def enrich_target(path: Column, profile: Profile) -> Column:
    """why a path is no page to fill in, null if it is one: not-a-tree-path, declared-exclude or not-a-target."""
    kind, parts = page_class(path, profile), F.split(path, "/")
    no = kind["archive"] | kind["plans"] | kind["bucket"] | kind["sidecar"] | kind["root_non_nav"] | kind["readme"] | kind["legacy_index"] | kind["hidden"]
    no = no | ~F.lower(path).rlike(r"\.md\z") | Q.crosses_secret_dir(path)
    excluded = Q.match_patterns(path, profile.exclude, True).isNotNull()
    return F.when(F.exists(parts, lambda x: x.isin("", ".", "..")), "not-a-tree-path").when(excluded, "declared-exclude").when(no, "not-a-target")


def named_targets(wanted: DataFrame, files: DataFrame, profile: Profile, tracked: DataFrame | None = None) -> DataFrame:
    """(store, path, reason) of the requested paths; null reasons are to be filled in.

    ``files`` has (store, path, kind), kind being file, link or directory. With ``tracked``, only folders with tracked files count.
    """
    rows = wanted.select("store", F.regexp_replace("path", r"\A\./", "").alias("path")).distinct()
    rows = rows.join(files.select("store", "path", "kind"), ["store", "path"], "left")
    scope = F.lit(False)
    if tracked is not None:
        dirs = tracked.select("store", F.explode(X.ancestors(F.col("path"))).alias("_dir")).distinct().withColumn("_in", F.lit(True))
        rows = rows.withColumn("_dir", X.directory(F.col("path"))).join(dirs, ["store", "_dir"], "left")
        scope = F.col("_in").isNull()
    reason = F.coalesce(enrich_target(F.col("path"), profile), F.when(scope, "outside-scope").when(F.col("kind").isNull(), "missing").when(F.col("kind") == "link", "symlinked").when(F.col("kind") != "file", "not-a-file"))
    return rows.select("store", "path", reason.alias("reason"))


def prompt(path: Column, title: Column, body: Column, pool: Column) -> Column:
    """What a model is asked: three labelled lines for a page, with the start of its body and the known tags.

    The body's share is bounded, as the reply is about the page's gist.
    """
    tags = F.slice(F.filter(F.transform(pool, X.trim), lambda t: t != ""), 1, POOL_TAGS)
    known = F.when(F.size(tags) > 0, F.concat(F.lit("Prefer tags of this list, and coin one only where none fits: "), F.array_join(tags, ", "))).otherwise("No tags exist yet; choose short ones that other pages could share.")
    return F.concat_ws(
        "\n",
        F.lit("Describe the document below for a search index. Reply with exactly these three lines:"),
        F.lit("DESCRIPTION: <one line of 10 to 25 words>"),
        F.lit("TAGS: <2 to 6 tags between commas>"),
        F.lit("ALIASES: <other names between commas, or nothing>"),
        F.lit(""),
        F.lit("- Write DESCRIPTION in the document's language."),
        F.concat(F.lit("- "), known),
        F.lit("- No commas inside a tag or a name."),
        F.lit(""),
        F.concat(F.lit("Title: "), title),
        F.concat(F.lit("Path: "), path),
        F.lit("<document>"),
        F.substring(F.coalesce(body, F.lit("")), 1, BODY_CHARS),
        F.lit("</document>"),
    )


def parse_reply(reply: Column) -> Column:
    """Struct (description, tags, aliases) of a reply; of equal labels the last counts, and without a description the first bare line."""
    lines = F.split(X.trim_carriage(F.coalesce(reply, F.lit(""))), "\n")
    form = r"(?i)\A\s*(DESCRIPTION|TAGS|ALIASES)\s*:\s*(.*)\z"
    last = lambda name: F.try_element_at(F.filter(F.transform(lines, lambda x: F.when(F.upper(F.regexp_extract(x, form, 1)) == name, X.trim(F.regexp_extract(x, form, 2)))), lambda v: v.isNotNull()), F.lit(-1))
    bare = F.get(F.filter(F.transform(lines, X.trim), lambda x: (x != "") & ~x.rlike(form)), F.lit(0))
    listed = lambda v: F.filter(F.transform(F.split(F.coalesce(v, F.lit("")), ","), X.trim), lambda x: x != "")
    return F.struct(F.coalesce(last("DESCRIPTION"), bare, F.lit("")).alias("description"), listed(last("TAGS")).alias("tags"), listed(last("ALIASES")).alias("aliases"))


def first_words(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A rule-based generator for tests and dry runs: it describes a page by its title and first words."""
    for frame in rows:
        reply = [f"DESCRIPTION: {t}: {' '.join((b or '').split()[:8])}\nTAGS: {t}\nALIASES:" for t, b in zip(frame["title"], frame["body"], strict=True)]
        yield pd.DataFrame({"store": frame["store"], "path": frame["path"], "reply": reply, "error": [None] * len(frame)})


Generator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def generate(pages: DataFrame, generator: Generator) -> DataFrame:
    """(store, path, reply, error): a user's function run on batches of (store, path, title, body, prompt)."""
    return pages.select("store", "path", "title", "body", "prompt").mapInPandas(generator, "store string, path string, reply string, error string")


def page_state(pages: DataFrame) -> DataFrame:
    """The pages with title, body, body_hash and, for each of FIELDS, its text and its stamp, each read once."""
    rows = pages.withColumn("_p", M.split_derived(F.col("content"))).withColumn("fm", M.parse(F.col("_p.block"))).withColumn("body", F.col("_p.body"))
    rows = rows.withColumn("body_hash", F.sha2("body", 256)).withColumn("title", F.coalesce(M.field(F.col("fm"), "title")["text"], X.stem(F.col("path"))))
    shown = lambda name: X.let(M.field(F.col("fm"), name), lambda r: F.when(r["listed"], F.array_join(r["items"], ", ")).otherwise(r["text"]))
    return rows.withColumns({c: v for name in FIELDS for c, v in ((name, shown(name)), (f"{name}_stamp", M.field(F.col("fm"), f"{name}_hash")["text"]))}).drop("_p")


def enrich(pages: DataFrame, profile: Profile, generator: Generator, most: int, pool: DataFrame | None = None, now: DataFrame | None = None) -> DataFrame:
    """B5, ST12: (store, path, outcome, content): pages that need a field, filled in by ``generator``.

    outcome is enriched, failed (the generator reported an error or nothing), overflow (beyond ``most`` a store, by path) or
    raced: the page is another one in ``now`` (store, path, content) than the one that was read, so it is left as it is and
    comes up again. A field that a person wrote stays. ``pool`` has (store, tag), few rows a store.
    """
    rows = page_state(pages.filter(enrich_target(F.col("path"), profile).isNull()))
    need = enrich_need(rows, "body_hash", list(FIELDS))
    rows = rows.join(need.select("store", "path", "fields"), ["store", "path"])
    rows = cap(rows, "store", ["path"], most)
    tags = F.array().cast("array<string>")
    if pool is not None:
        ranked = pool.groupBy("store").agg(F.slice(F.array_sort(F.collect_set("tag")), 1, POOL_TAGS).alias("_pool"))
        rows = rows.join(ranked, "store", "left")
        tags = F.coalesce("_pool", tags)
    rows = rows.withColumn("prompt", prompt(F.col("path"), F.col("title"), F.col("body"), tags))
    replies = generate(rows.filter("within"), generator).withColumn("r", parse_reply(F.col("reply")))
    rows = rows.join(replies.select("store", "path", "r", "error"), ["store", "path"], "left")
    said = X.sanitize_description(F.col("r.description"))
    new = {
        "description": said,
        "tags": M.inline_list(X.sanitize_tokens(F.array_join("r.tags", ","), *TAGS)),
        "aliases": M.inline_list(X.sanitize_tokens(F.array_join("r.aliases", ","), *ALIASES)),
    }
    content = F.col("content")
    for name in FIELDS:
        asked = F.array_contains(F.split("fields", ","), name)
        content = X.let(content, _fill(name, new[name], asked))
    if now is not None:
        rows = rows.join(now.select("store", "path", F.sha2("content", 256).alias("_now")), ["store", "path"], "left")
        raced = ~F.col("_now").eqNullSafe(F.sha2("content", 256))
    else:
        raced = F.lit(False)
    failed = F.col("error").isNotNull() | (F.coalesce(said, F.lit("")) == "")
    outcome = F.when(~F.col("within"), "overflow").when(raced, "raced").when(failed, "failed").otherwise("enriched")
    return rows.select("store", "path", outcome.alias("outcome"), F.when(outcome == "enriched", content).otherwise(F.col("content")).alias("content"))


def _fill(name: str, value: Column, asked: Column) -> Callable[[Column], Column]:
    return lambda c: F.when(asked, M.upsert(c, {name: value, f"{name}_hash": F.col("body_hash")})).otherwise(c)


def read_binaries(spark: SparkSession, root: str, store: str, exts: list[str]) -> DataFrame:
    """(store, path, size, modified, content) of the files with these endings; content is read only where it is used."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    files = files.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*exts))
    relative = F.expr(f"substring(path, locate('{base}/', path) + {len(base) + 1})")
    return files.select(F.lit(store).alias("store"), relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def _plain(data: bytes) -> tuple[str, list[str]]:
    text = data.decode("utf-8", "replace")
    return text, ["not all bytes are UTF-8"] if "�" in text else []


#: Extractors by ending: bytes to text and warnings. Others, such as one for PDF, are the caller's.
EXTRACTORS: dict[str, Callable[[bytes], tuple[str, list[str]]]] = {"txt": _plain, "log": _plain, "json": _plain, "html": _plain}


def extract(sources: DataFrame, extractors: dict[str, Callable[[bytes], tuple[str, list[str]]]] | None = None) -> DataFrame:
    """Sources (store, path, content) with text, warnings and extractor, the file's ending; an ending without an extractor is an error."""
    known = extractors or EXTRACTORS

    @F.pandas_udf("text string, warnings array<string>")
    def of(exts: pd.Series, data: pd.Series) -> pd.DataFrame:
        rows = [known[e](bytes(x or b"")) for e, x in zip(exts, data, strict=True)]
        return pd.DataFrame({"text": [r[0] for r in rows], "warnings": [r[1] for r in rows]})

    ext = Q.extension(F.col("path"))
    checked = F.when(ext.isin(*known), ext).otherwise(F.raise_error(F.concat(F.lit("no extractor for "), "path")))
    rows = sources.withColumn("extractor", checked).withColumn("_x", of(F.col("extractor"), F.col("content")))
    html = F.when(F.col("extractor") == "html", X.html_to_text(F.col("_x.text"))).otherwise(F.col("_x.text"))
    return rows.withColumn("text", html).withColumn("warnings", F.col("_x.warnings")).drop("_x")


def sidecar_pages(extracted: DataFrame, date: str) -> DataFrame:
    """(store, path, content): the page beside each source: its stamp, its warnings and its text."""
    name = F.substring_index("path", "/", -1)
    stamp = {"title": name, "kind": F.lit("sidecar"), "source": name, "sha256": F.sha2("content", 256), "extractor": F.col("extractor"), "generated": F.lit(date)}
    head = F.concat(F.lit("---\n"), F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in stamp.items()]), F.lit("\n---\n\n# "), name)
    warned = F.when(F.size("warnings") > 0, F.concat(F.lit("\n\n## Warnings\n"), F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("- "), w)), "\n"))).otherwise("")
    return extracted.select("store", F.concat("path", F.lit(".md")).alias("path"), F.concat(head, warned, F.lit("\n\n"), X.trim(F.col("text")), F.lit("\n")).alias("content"))


def read_inbox(spark: SparkSession, root: str) -> DataFrame:
    """S3: (name, text) of the .md, .txt, .json and .log files of a folder, but for .done; one row a file, to be ordered by name."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("name"), F.col("value").alias("text"))
    return files.filter(F.lower("name").rlike(r"\.(md|txt|json|log)\z") & ~F.startswith("name", F.lit(".")))
