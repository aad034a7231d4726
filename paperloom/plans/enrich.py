"""Queries over pages whose fields are filled in, model replies, and texts of binary files."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import enrich as E
from paperloom.operators import indexes as I

from .history import read

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


PROFILE = I.Profile(archive_dirs=("raw",), plans_root="plans", root_non_nav=("log.md",), exclude=("drafts/",))
PATH = "CASE doc_id % 9 WHEN 0 THEN concat('a/../', doc_id, '.md') WHEN 1 THEN concat('drafts/', doc_id, '.md') WHEN 2 THEN concat('raw/', doc_id, '.md') WHEN 3 THEN concat('a/_b/', doc_id, '.md') WHEN 4 THEN concat('x/', doc_id, '.pdf.md') WHEN 5 THEN concat('gone/', doc_id, '.md') WHEN 6 THEN concat('link/', doc_id, '.md') WHEN 7 THEN concat('off/', doc_id, '.md') ELSE concat('on/', doc_id, '.md') END"


@query("enrich_targets", f"SELECT {PATH} AS path, CASE doc_id % 9 WHEN 0 THEN 'not-a-tree-path' WHEN 1 THEN 'declared-exclude' WHEN 2 THEN 'not-a-target' WHEN 3 THEN 'not-a-target' WHEN 4 THEN 'not-a-target' WHEN 5 THEN 'missing' WHEN 6 THEN 'symlinked' WHEN 7 THEN 'outside-scope' END AS reason FROM documents")
def _(spark, d):
    rows = read(spark, d, "documents").select(F.lit("s").alias("store"), F.expr(PATH).alias("path"), "doc_id")
    files = rows.filter("doc_id % 9 <> 5").select("store", "path", F.expr("CASE WHEN doc_id % 9 = 6 THEN 'link' ELSE 'file' END").alias("kind"))
    found = E.named_targets(rows, files, PROFILE, rows.filter("doc_id % 9 <> 7").select("store", "path"))
    return found.select("path", "reason")


#: Every third page has a person's description, every fifth a stale stamp of a made one.
PAGE = """concat('---', chr(10), 'title: T', doc_id, chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('description: mine', chr(10)) WHEN doc_id % 5 = 0 THEN concat('description: old', chr(10), 'description_hash: 00', chr(10)) ELSE '' END,
'tags: [t]', chr(10), 'aliases: [a]', chr(10), '---', chr(10), 'body ', md5(text), chr(10))"""
CUT = 20


@query("enriched_pages", f"""WITH d AS (SELECT doc_id, concat('s', doc_id % 7) AS store, concat('p/', doc_id, '.md') AS path, concat('body ', md5(text)) AS b FROM documents WHERE doc_id % 3 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY path) AS r FROM d), o AS (SELECT *, CASE WHEN r > {CUT} THEN 'overflow' WHEN doc_id % 11 = 0 THEN 'raced' ELSE 'enriched' END AS outcome FROM n)
SELECT store, path, outcome, CASE WHEN outcome = 'enriched' THEN md5(concat('---', chr(10), 'title: T', doc_id, chr(10), CASE WHEN doc_id % 5 = 0 THEN concat('description: T', doc_id, ': ', b, chr(10), 'description_hash: ', sha256(b), chr(10)) ELSE '' END, 'tags: [t]', chr(10), 'aliases: [a]', chr(10),
CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('description: T', doc_id, ': ', b, chr(10), 'description_hash: ', sha256(b), chr(10)) END, '---', chr(10), b, chr(10))) END AS content_md5 FROM o""")
def _(spark, d):
    pages = read(spark, d, "documents").select(F.expr("concat('s', doc_id % 7)").alias("store"), F.expr("concat('p/', doc_id, '.md')").alias("path"), F.expr(PAGE).alias("content"), "doc_id")
    now = pages.select("store", "path", F.when(F.expr("doc_id % 11 = 0"), F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"))
    found = E.enrich(pages.drop("doc_id"), PROFILE, E.first_words, CUT, now=now)
    return found.select("store", "path", "outcome", F.when(F.col("outcome") == "enriched", F.md5(F.col("content").cast("binary"))).alias("content_md5"))


@query("parsed_replies", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat('bare ', doc_id) ELSE concat('D', doc_id) END AS description, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('a|b', doc_id) END AS tags FROM documents")
def _(spark, d):
    said = "concat(md5(text), '\\nTags: x\\n')"
    reply = F.expr(f"concat(CASE WHEN doc_id % 4 = 0 THEN concat('\\n bare ', doc_id, ' \\n', {said}) ELSE concat('description : first\\n', {said}, 'Description: D', doc_id, '\\r\\n') END, CASE WHEN doc_id % 3 = 0 THEN 'TAGS:' ELSE concat('TAGS: a, , b', doc_id) END)")
    rows = read(spark, d, "documents").select("doc_id", E.parse_reply(reply).alias("r"))
    return rows.select("doc_id", "r.description", F.array_join("r.tags", "|").alias("tags"))


@query("prompt_sizes", "SELECT doc_id, least(length(text), 8000) AS body_chars, doc_id % 2 = 0 AS has_pool FROM documents")
def _(spark, d):
    pool = F.when(F.expr("doc_id % 2 = 0"), F.array(F.lit("x"), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    asked = E.prompt(F.lit("p.md"), F.lit("T"), F.col("text"), pool)
    rows = read(spark, d, "documents").select("doc_id", asked.alias("q"))
    body = F.regexp_extract("q", r"(?s)\n<document>\n(.*)\n</document>\z", 1)
    return rows.select("doc_id", F.length(body).alias("body_chars"), F.contains("q", F.lit("none fits: x\n")).alias("has_pool"))


@query("sidecar_texts", r"""SELECT concat('f/', page_id, CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.txt' END, '.md') AS path, sha256(html) AS sha256, page_id % 2 = 0 AS tags_gone FROM pages""")
def _(spark, d):
    rows = read(spark, d, "pages").select(F.lit("s").alias("store"), F.expr("concat('f/', page_id, CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.txt' END)").alias("path"), F.col("html").cast("binary").alias("content"))
    made = E.sidecar_pages(E.extract(rows), "2024-01-01")
    return made.select("path", F.regexp_extract("content", r"(?m)^sha256: ([0-9a-f]{64})$", 1).alias("sha256"), (~F.lower("content").rlike(r"<(html|body|p|a)\b")).alias("tags_gone"))
