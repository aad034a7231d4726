"""Queries over the generated corpus, documents and web pages, and their SQL from the generator's arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import gate as G
from paperloom.operators import pages as P
from paperloom.sources import corpus as C

from paperloom.storage import checkpoint

from .history import read

QUERIES, ORACLES = {}, {}
D = f"d AS (SELECT *, {C.STORE} AS store, {C.PATH} AS path FROM documents), m AS (SELECT max(doc_id) AS last FROM documents)"
NEXT = "concat(CASE WHEN doc_id % 17 = 0 THEN 'missing-' ELSE '' END, CASE WHEN doc_id % 19 = 0 THEN 'D' ELSE 'd' END, doc_id + 20, '.md')"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def with_root(spark, d):
    return C.generated_pages(spark, d).select("store", "path").union(C.generated_index_lines(spark, d).select("store", "path").distinct())


@query("broken_links", f"WITH {D} SELECT store, path, {NEXT} AS target FROM d, m WHERE doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id + 20 > last")
def _(spark, d):
    return P.broken_links(P.links(C.generated_pages(spark, d)), with_root(spark, d)).select("store", "path", "target")


@query("nav_errors", f"WITH {D} SELECT store, path, {NEXT} AS target, CASE WHEN doc_id % 17 <> 0 AND doc_id % 19 = 0 AND doc_id + 20 <= last THEN 'case-mismatch' ELSE 'broken-link' END AS code FROM d, m WHERE doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id + 20 > last")
def _(spark, d):
    return P.nav_errors(P.links(C.generated_pages(spark, d)), with_root(spark, d))


@query("frontmatter_fields", f"""WITH {D} SELECT store, path, 'title' AS key, concat('Page ', doc_id) AS value FROM d UNION ALL SELECT store, path, 'tags', concat(lang, ', ', source) FROM d
UNION ALL SELECT store, path, 'created', concat('2024-01-0', doc_id % 9 + 1) FROM d UNION ALL SELECT store, path, 'updated', '2024-02-01' FROM d WHERE doc_id % 5 <> 0 UNION ALL SELECT store, path, 'domain', 'old' FROM d WHERE doc_id % 7 = 0""")
def _(spark, d):
    return P.frontmatter_fields(C.generated_pages(spark, d))


@query("sections", f"""WITH {D} SELECT store, path, 0 AS pos, NULL AS heading, 1 AS line, length(concat('# Page ', doc_id)) AS chars FROM d UNION ALL SELECT store, path, 1, 'Summary', 3, length(concat('Summary of ', doc_id, '.')) FROM d UNION ALL SELECT store, path, 2, 'Details', 6, NULL FROM d
UNION ALL SELECT store, path, 3, 'Related', 6 + 3 + length(text) - length(replace(text, chr(10), '')) + CASE WHEN doc_id % 13 = 0 THEN 3 ELSE 0 END + CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END + 1, 25 FROM d WHERE doc_id % 11 <> 0""")
def _(spark, d):
    rows = P.sections(C.generated_pages(spark, d))
    return rows.withColumn("chars", F.when(~F.col("heading").eqNullSafe("Details"), F.col("chars")))


@query("titles_and_summaries", f"WITH {D} SELECT store, path, concat('Page ', doc_id) AS title, concat('Summary of ', doc_id, '.') AS summary FROM d")
def _(spark, d):
    c, p = F.col("content"), F.col("path")
    return C.generated_pages(spark, d).select("store", "path", X.page_title(c, p).alias("title"), X.summary_section(c).alias("summary"))


@query("body_hashes", f"WITH {D} SELECT store, path, sha256(trim(regexp_replace({C.CONTENT}, '(?s)^---.*?\\n---\\n', ''), chr(10) || ' ')) AS sha FROM d")
def _(spark, d):
    return C.generated_pages(spark, d).select("store", "path", F.sha2(X.body(F.col("content")), 256).alias("sha"))


LINT = f"""{D}, i AS (SELECT store, path AS file, 'frontmatter-updated-format' AS code FROM d WHERE doc_id % 5 = 0 UNION ALL SELECT store, path, 'deprecated-frontmatter-domain' FROM d WHERE doc_id % 7 = 0
UNION ALL SELECT store, path, 'missing-section:Related' FROM d WHERE doc_id % 11 = 0)"""


@query("lint", f"WITH {LINT} SELECT * FROM i")
def _(spark, d):
    return P.lint(C.generated_pages(spark, d), ["Summary", "Details", "Related"])


@query("lint_summary", f"WITH {LINT} SELECT store, count(*) AS issues, count(DISTINCT file) AS files FROM i GROUP BY 1")
def _(spark, d):
    return P.lint_summary(P.lint(C.generated_pages(spark, d), ["Summary", "Details", "Related"]))


@query("tag_pool", f"WITH {D}, t AS (SELECT store, path, unnest([lang, source]) AS tag FROM d) SELECT store, tag, count(DISTINCT path) AS pages FROM t GROUP BY 1, 2")
def _(spark, d):
    return P.tag_pool(C.generated_pages(spark, d))


@query("folder_children", f"WITH {D} SELECT store, concat('domains/', source) AS dir, count(*) AS pages, min(path) AS first FROM d GROUP BY ALL")
def _(spark, d):
    return P.folder_children(with_root(spark, d))


@query("unreachable_pages", f"WITH {D} SELECT store, path FROM d WHERE substr(source, 4)::INT % 4 = 0 OR doc_id % 37 = 0 UNION ALL SELECT DISTINCT store, concat('domains/', source, '/README.md') FROM d WHERE substr(source, 4)::INT % 4 = 0")
def _(spark, d):
    edges = checkpoint(P.links(C.generated_index_lines(spark, d)).select("store", "path", F.col("resolved").alias("to")))
    files = with_root(spark, d)
    return files.join(P.reachable(edges, files.filter("path = 'README.md'"), checkpoint), ["store", "path"], "left_anti")


@query("connections", f"""WITH {D}, b AS (SELECT store, count(*) AS n FROM d, m WHERE doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id + 20 > last GROUP BY 1),
o AS (SELECT store, count(*) AS n FROM d WHERE doc_id < 20 OR (doc_id - 20) % 17 = 0 OR (doc_id - 20) % 19 = 0 GROUP BY 1), f AS (SELECT store, count(DISTINCT source) AS n FROM d GROUP BY 1)
SELECT d.store, count(*) + any_value(f.n) + 1 AS pages, any_value(o.n) + any_value(f.n) AS orphans, any_value(b.n) AS unresolved, count(*) FILTER (doc_id % 23 = 0) AS pointers, count(*) FILTER (doc_id % 23 = 0 AND doc_id % 4 = 3) AS unknown FROM d JOIN b USING (store) JOIN o USING (store) JOIN f USING (store) GROUP BY 1""")
def _(spark, d):
    pages = C.generated_pages(spark, d)
    return P.connections(P.links(pages), with_root(spark, d), P.pointer_rows(pages), pages.select("store").distinct())


@query("store_pointers", f"WITH {D} SELECT path AS src, concat('s', doc_id % 4, ':', path) AS raw, CASE WHEN doc_id % 4 = 3 THEN 'unknown-store' WHEN concat('s', doc_id % 4) <> store THEN 'unresolved' ELSE 'ok' END AS code FROM d WHERE doc_id % 23 = 0")
def _(spark, d):
    pages = C.generated_pages(spark, d)
    return P.pointers(pages, pages.select("store").distinct(), pages)


@query("grep_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents), h AS (SELECT *, regexp_matches(text, '(?i)licen[sc]ed') AS hit FROM l),
n AS (SELECT *, coalesce(lag(hit) OVER w, false) OR coalesce(lead(hit) OVER w, false) AS near FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line)) SELECT doc_id, line, hit, text FROM n WHERE hit OR near""")
def _(spark, d):
    return P.grep_lines(read(spark, d, "documents"), "doc_id", "text", "licen[sc]ed")


ROUTES = {"decisions": ["license", "rights", "version"], "operations": ["token", "password", "example.com"], "people": ["@", "phone", "+1"]}


@query("keyword_routes", "WITH s AS (SELECT doc_id, " + ", ".join(f"{' + '.join(f'contains(lower(text), {w!r})::INT' for w in ws)} AS {n}" for n, ws in ROUTES.items()) + """ FROM documents), g AS (SELECT *, greatest(decisions, operations, people) AS b FROM s)
SELECT doc_id, decisions, operations, people, CASE WHEN b = 0 THEN 'inbox' WHEN decisions = b THEN 'decisions' WHEN operations = b THEN 'operations' ELSE 'people' END AS section, b > 0 AND (decisions = b)::INT + (operations = b)::INT + (people = b)::INT > 1 AS ambiguous FROM g""")
def _(spark, d):
    return P.keyword_route(read(spark, d, "documents"), "doc_id", "text", ROUTES, "inbox")


#: The tags whose places become lines, and what is trimmed at both ends, as the text's rules have them.
LINE_TAGS = "main|article|section|p|div|li|h[1-6]|br|tr|td|th|blockquote"
ENDS = r"[\s\x0B\p{Zs}\x{2028}\x{2029}\x{FEFF}]+"


@query("web_page_text", rf"""WITH n AS (SELECT page_id, regexp_replace(coalesce(html, ''), '\r\n?', chr(10), 'g') AS t FROM pages),
a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<noscript\b.*?</noscript>', ' ', 'g') AS t FROM n),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?({LINE_TAGS})[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(regexp_replace(t, '&nbsp;', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') AS t FROM b),
s AS (SELECT page_id, regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g') AS t FROM c)
SELECT page_id, md5(regexp_replace(t, '\A{ENDS}|{ENDS}\z', '', 'g')) AS text_md5 FROM s""")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(X.html_to_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("slugs", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query("case_collisions", f"WITH {D} SELECT lower(path) AS key, 2::BIGINT AS spellings FROM d WHERE doc_id % 29 = 0")
def _(spark, d):
    paths = C.generated_pages(spark, d).select("path")
    number = F.regexp_extract("path", r"(\d+)\.md\z", 1).cast("long")
    added = paths.filter(number % 29 == 0).select(F.replace("path", F.lit("/d"), F.lit("/D")).alias("path"))
    one = lambda df: df.select(F.lit("").alias("store"), "path")
    return G.case_collisions(one(paths.union(added)), one(added), ["store"]).select(F.col("case_key").alias("key"), "spellings")
