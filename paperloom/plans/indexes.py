"""Queries over folder indexes of the deep corpus, and their SQL from its arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import indexes as I
from paperloom.sources import corpus as C
from paperloom.storage import checkpoint

QUERIES, ORACLES = {}, {}
PROFILE = I.Profile()


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


#: Documents with their folders, the line that an index has for each, and the folders (level 3 is the lowest).
DEEP = f"""m AS (SELECT max(doc_id) AS last FROM documents), d AS (SELECT doc_id, source, {C.STORE} AS store, {C.DEEP_DIR} AS dir, {C.CUT.format(400)} AS c, {C.CUT.format(40000)} AS b FROM documents),
leaf AS (SELECT *, concat(dir, '/README.md') AS readme, concat('d', doc_id, '.md') AS link, CASE WHEN doc_id % 6 = 1 THEN concat('Head ', doc_id) ELSE concat('Page ', doc_id) END AS label,
CASE doc_id % 4 WHEN 0 THEN concat('About ', doc_id, '.') WHEN 1 THEN concat('Sum of ', doc_id, ' with ', CASE WHEN doc_id + 20 <= last AND floor((doc_id + 20) / 400) = c THEN concat('[next](d', doc_id + 20, '.md#top)') ELSE 'next' END, '.')
WHEN 2 THEN concat('Prose ', doc_id, '.') ELSE 'Document.' END AS summary FROM d, m),
folder AS (SELECT DISTINCT store, concat('domains/', source, '/b', b, '/README.md') AS readme, concat('c', c, '/README.md') AS link, concat('c', c, '/') AS label, CASE WHEN c % 3 = 2 THEN 'Folder.' ELSE concat('Folder ', c, ' of ', source, '.') END AS summary FROM d
UNION SELECT store, concat('domains/', source, '/README.md'), concat('b', b, '/README.md'), concat('b', b, '/'), 'Folder.' FROM d UNION SELECT store, 'domains/README.md', concat(source, '/README.md'), concat(source, '/'), 'Folder.' FROM d
UNION SELECT store, 'README.md', 'domains/README.md', 'domains/', 'Folder.' FROM d)"""


@query("index_entries", f"WITH {DEEP} SELECT store, readme, link, label, summary FROM leaf UNION ALL SELECT * FROM folder")
def _(spark, d):
    pages = C.deep_pages(spark, d)
    return I.rebase_links(I.index_entries(pages, PROFILE), pages).select("store", "readme", "link", "label", "summary")


@query("stale_regions", f"WITH {DEEP} SELECT * FROM (SELECT store, readme, count(*) FILTER (doc_id % 37 = 0)::BIGINT AS missing, any_value(CASE WHEN c % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS extra FROM leaf WHERE c % 3 <> 2 GROUP BY ALL) WHERE missing + extra > 0")
def _(spark, d):
    pages = C.deep_pages(spark, d)
    return I.stale_regions(I.index_lines(I.index_entries(pages, PROFILE)), pages, PROFILE)


@query("index_fixed_point", f"""WITH {DEEP}, t AS (SELECT store, readme AS path, any_value(source) AS source, any_value(c) AS c, string_agg(concat('- [', label, '](', link, ') — ', summary), chr(10) ORDER BY link) AS inside FROM leaf GROUP BY ALL)
SELECT store, path, c % 3 = 2 AS created, md5(concat(CASE WHEN c % 3 = 2 THEN concat('---', chr(10), 'title: c', c, chr(10), 'status: active', chr(10), '---', chr(10), chr(10), '# c', c, chr(10), chr(10), '## Index', chr(10), chr(10))
ELSE concat('# Index ', c, chr(10), chr(10), 'Folder ', c, ' of ', source, '.', chr(10), chr(10)) END, '<!-- index:start -->', chr(10), inside, chr(10), '<!-- index:end -->', chr(10))) AS content_md5 FROM t""")
def _(spark, d):
    readmes, written, _ = I.index_fixed_point(C.deep_pages(spark, d), PROFILE, checkpoint)
    done = readmes.join(written, ["store", "path"]).filter(r"path rlike '/c[0-9]+/README'")
    return done.select("store", "path", "created", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("index_structure", f"WITH {DEEP} SELECT store, readme AS path, link AS target FROM leaf WHERE c % 3 <> 2 AND doc_id % 37 <> 0 UNION ALL SELECT DISTINCT store, readme, 'gone.md' FROM leaf WHERE c % 3 <> 2 AND c % 5 = 0")
def _(spark, d):
    readmes = I.readme_pages(C.deep_pages(spark, d))
    headed = readmes.withColumn("content", F.concat(F.lit("## All\n"), "content"))
    return I.index_structure(headed).filter("section = 'All'").select("store", "path", "target")
