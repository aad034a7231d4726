"""Queries over sources that are routed, guarded and put into pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import frontmatter as M
from paperloom.functions import text as X
from paperloom.operators import ingest as N

from .history import read

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


#: Texts with words of the three lists added by id; a third of them come from a URL, some name a project.
ROUTED = """concat(text, chr(10), CASE doc_id % 5 WHEN 0 THEN 'milestone roadmap backlog' WHEN 1 THEN 'runbook incident recovery' WHEN 2 THEN 'vendor pricing website portfolio' WHEN 3 THEN 'milestone runbook' ELSE '' END)"""
_HITS = {name: " + ".join(f"contains(t, '{w}')::INT" for w in words) for name, words in N.KEYWORDS.items()}


@query("routes", f"""WITH d AS (SELECT doc_id, lower({ROUTED}) AS t, doc_id % 7 = 0 AS p, doc_id % 3 = 0 AS u FROM documents),
s AS (SELECT doc_id, p, u, {_HITS["projects"]} + CASE WHEN p THEN 2 ELSE 0 END AS projects, {_HITS["learnings"]} AS learnings, {_HITS["domains"]} + u::INT AS domains FROM d),
c AS (SELECT doc_id, unnest(['projects', 'learnings', 'domains']) AS section, unnest([projects, learnings, domains]) AS score FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, section) AS n FROM c),
r AS (SELECT s.*, x.score AS top, y.score AS second FROM s JOIN k x ON x.doc_id = s.doc_id AND x.n = 1 JOIN k y ON y.doc_id = s.doc_id AND y.n = 2),
z AS (SELECT *, p AND projects >= 3 AND projects + 1 >= learnings AS a, learnings > 0 AND learnings >= domains AS b, domains > 0 OR u AS e FROM r),
o AS (SELECT doc_id, projects, learnings, domains, CASE WHEN a THEN 'projects' WHEN b THEN 'learnings' WHEN e THEN 'domains' WHEN p THEN 'projects' ELSE 'learnings' END AS section,
CASE WHEN top >= 4 AND top - second >= 2 THEN 'high' WHEN top >= 2 AND top - second >= 1 THEN 'medium' ELSE 'low' END AS confidence, top <= 1 OR (second > 0 AND top - second <= 1) OR NOT (a OR b OR e) AS ambiguous,
CASE WHEN a THEN 'project-id-and-project-keywords' WHEN b THEN 'learning-keywords' WHEN e THEN CASE WHEN u AND domains <= 1 THEN 'url-default' ELSE 'domain-keywords' END WHEN p THEN 'project-fallback' ELSE 'default-learning-fallback' END AS reason FROM z)
SELECT o.*, (SELECT string_agg(concat(k.section, ':', k.score), ',' ORDER BY (k.section <> o.section)::INT, k.n) FROM k WHERE k.doc_id = o.doc_id) AS candidates FROM o""")
def _(spark, d):
    project, is_url = F.when(F.expr("doc_id % 7 = 0"), "acme"), F.expr("doc_id % 3 = 0")
    rows = read(spark, d, "documents").select("doc_id", N.keyword_scores(F.expr(ROUTED), project, is_url).alias("s")).withColumn("r", N.route(F.col("s"), project, is_url))
    listed = F.array_join(F.transform("r.candidates", lambda c: F.concat(c["section"], F.lit(":"), c["score"])), ",")
    return rows.select("doc_id", "s.*", "r.section", "r.confidence", "r.ambiguous", "r.reason", listed.alias("candidates"))


NAMED = "concat(text, chr(10), CASE doc_id % 4 WHEN 0 THEN concat('see Acme App ', doc_id % 97, '.') WHEN 1 THEN 'xacme app' WHEN 2 THEN 'the acme_app' ELSE concat('acme-app-', doc_id % 97, 'z') END)"


@query("mentioned_projects", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('acme-app-', doc_id % 97) ELSE 'acme-app' END AS project FROM documents WHERE doc_id % 4 <> 1")
def _(spark, d):
    docs = read(spark, d, "documents")
    known = docs.select(F.expr("concat('acme-app-', doc_id % 97)").alias("project")).distinct().union(docs.select(F.lit("acme-app").alias("project")).distinct())
    return N.mentioned_project(docs.select("doc_id", F.expr(NAMED).alias("text")), "doc_id", "text", known)


SHAPED = """concat('lead', chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('## Notes', chr(10), 'a', chr(10)) ELSE '' END, '## Summary', chr(10), 's', chr(10), '## Notes', chr(10), replace(replace(replace(text, chr(10), ' '), '`', ''), '~', ''), chr(10),
CASE WHEN doc_id % 5 = 0 THEN concat('```', chr(10), '## inside', chr(10), '```', chr(10)) ELSE '' END, CASE WHEN doc_id % 11 = 0 THEN concat('~~~~', chr(10), '~~~', chr(10)) ELSE '' END)"""


@query("body_shapes", """WITH d AS (SELECT doc_id, 4 + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Notes' ELSE '' END AS duplicates, CASE WHEN doc_id % 5 = 0 THEN (n + 3)::VARCHAR ELSE '' END AS hazards, CASE WHEN doc_id % 11 = 0 THEN n + 2 + CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END END AS opened, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 11 <> 0 AS rewritable FROM d""")
def _(spark, d):
    pages = read(spark, d, "documents").select(F.lit("s").alias("store"), F.col("doc_id").cast("string").alias("path"), F.expr(SHAPED).alias("body"))
    found = N.body_shape(pages)
    return found.select(F.col("path").cast("long").alias("doc_id"), F.array_join("duplicates", ",").alias("duplicates"), F.array_join(F.transform("hazards", lambda x: x.cast("string")), ",").alias("hazards"), "opened", "rewritable")


@query("guarded_results", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'missing-result-file' WHEN o_orderkey % 7 = 0 THEN 'missing-task-metadata' WHEN o_orderkey % 5 = 0 THEN 'task-has-no-qa' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'signal-mismatch' WHEN o_orderkey % 13 = 0 THEN 'already-ingested' END AS reason FROM orders""")
def _(spark, d):
    path = F.concat(F.lit("r/"), "o_orderkey", F.lit(".result.md"))
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), path.alias("path"))
    results = rows.select("path", F.col("k").alias("millis"), F.when(F.expr("k % 2 = 0"), "done").alias("received"))
    tasks = rows.filter("k % 7 <> 0").select(F.col("k").alias("id"), F.col("path").alias("result"), F.when(F.expr("k % 5 <> 0"), "tests").alias("qa"), F.when(F.expr("k % 3 = 0"), "ready").otherwise("done").alias("signal"))
    stamps = rows.filter("k % 13 = 0").select(X.stamp_key(F.col("path"), F.col("k")).alias("stamp"))
    found = N.guard_ingest(results, tasks, rows.filter("k % 11 <> 0"), stamps)
    return found.select(F.col("millis").alias("id"), "reason")


@query("resolved_results", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN concat('named/', o_orderkey, '.md') WHEN o_orderkey % 3 = 1 THEN concat('a/', o_orderkey, '.result.md') WHEN o_orderkey % 2 = 0 THEN concat('b/', o_orderkey, '.result.md') END AS path FROM orders")
def _(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("k"))
    tasks = rows.select("id", F.concat(F.lit("named/"), "id", F.lit(".md")).alias("result"))
    files = rows.select(F.explode(F.array_compact(F.array(F.when(F.expr("k % 3 = 0"), F.concat(F.lit("named/"), "id", F.lit(".md"))), F.when(F.expr("k % 3 <> 2"), F.concat(F.lit("a/"), "id", F.lit(".result.md"))), F.when(F.expr("k % 2 = 0"), F.concat(F.lit("b/"), "id", F.lit(".result.md")))))).alias("path"))
    return N.resolve_results(rows.select("id"), tasks, files, ["a", "b"]).withColumn("id", F.col("id").cast("long"))


WORDS = "CASE doc_id % 3 WHEN 0 THEN 'runbook incident' WHEN 1 THEN 'pricing vendor website' ELSE concat('project milestone p', doc_id) END"


@query("ingested_pages", f"""WITH d AS (SELECT doc_id, concat('T', doc_id) AS t, concat({WORDS}, ' ', md5(text)) AS b, concat('x-', doc_id) AS slug FROM documents)
SELECT CASE doc_id % 3 WHEN 0 THEN concat('learnings/', slug, '.md') WHEN 1 THEN concat('domains/', slug, '.md') ELSE concat('projects/p', doc_id, '.md') END AS path, CASE WHEN doc_id % 4 = 0 THEN 'updated' ELSE 'created' END AS action, doc_id % 8 = 0 AS refused,
md5(CASE WHEN doc_id % 8 = 0 THEN concat('## Notes', chr(10), 'a', chr(10), '## Notes', chr(10), 'b', chr(10)) ELSE concat('---', chr(10), CASE WHEN doc_id % 4 = 0 THEN concat('tags: [x]', chr(10)) ELSE '' END, 'title: ', t, chr(10), 'updated: 2024-06-01', chr(10), '---', chr(10), chr(10) , CASE WHEN doc_id % 4 = 0 THEN '' ELSE '' END,
CASE WHEN doc_id % 4 = 0 THEN concat('## Summary', chr(10), t, chr(10), chr(10), 'Lead', chr(10), chr(10), '## Old', chr(10), 'o', chr(10), chr(10)) ELSE concat('## Summary', chr(10), t, chr(10), chr(10)) END, '## Details', chr(10), CASE WHEN doc_id % 4 = 0 THEN concat('Before', chr(10), chr(10)) ELSE '' END,
'<!-- ingest:', slug, ':start -->', chr(10), '### 2024-06-01 · ', t, chr(10), chr(10), '- Source: `note`', chr(10), '- Task: `', slug, '`', chr(10), '- QA Verdict: `passed`', chr(10), chr(10), b, chr(10), '<!-- ingest:', slug, ':end -->', chr(10), chr(10), '## Related', chr(10), '(empty)', chr(10)) END) AS content_md5 FROM d""")
def _(spark, d):
    docs = read(spark, d, "documents")
    slug = F.concat(F.lit("x-"), "doc_id")
    sources = docs.select(slug.alias("slug"), F.concat(F.lit("T"), "doc_id").alias("title"), F.concat(F.expr(WORDS), F.lit(" "), F.md5(F.col("text").cast("binary"))).alias("text"), F.lit("note").alias("source"))
    path = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('learnings/x-', doc_id, '.md') WHEN 1 THEN concat('domains/x-', doc_id, '.md') ELSE concat('projects/p', doc_id, '.md') END")
    old = F.when(F.expr("doc_id % 8 = 0"), "## Notes\na\n## Notes\nb\n").otherwise("---\ntags: [x]\n---\n\nLead\n\n## Old\no\n\n## Details\nBefore\n")
    pages = docs.filter("doc_id % 4 = 0").select(path.alias("path"), old.alias("content"))
    found = N.ingest_pages(sources, pages, docs.filter("doc_id % 3 = 2").select(F.concat(F.lit("p"), "doc_id").alias("project")), "2024-06-01")
    return found.select("path", "action", "refused", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("round_trip", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('[a, \"b ', doc_id, '\"]') ELSE '[]' END AS tags, concat('d', doc_id % 5) AS description, true AS same_body FROM documents")
def _(spark, d):
    page = F.concat(F.lit("---\ntags:\n"), F.when(F.expr("doc_id % 2 = 0"), F.concat(F.lit("  - a\n  - b "), "doc_id", F.lit("\n"))).otherwise(""), F.lit("old: x\n---\n"), "text")
    rows = read(spark, d, "documents").select("doc_id", "text", page.alias("page"))
    fields = M.parse(M.split_derived(F.col("page"))["block"])
    rows = rows.withColumn("new", M.upsert(F.col("page"), {"tags": M.inline_list(M.field(fields, "tags")["items"]), "description": F.expr("concat('d', doc_id % 5)")}))
    got = M.split_derived(F.col("new"))
    again = M.parse(got["block"])
    body = F.regexp_replace("new", r"(?s)\A---\n.*?\n---\n", "")
    return rows.select("doc_id", M.inline_list(M.field(again, "tags")["items"]).alias("tags"), M.field(again, "description")["text"].alias("description"), (body == F.col("text")).alias("same_body"))
