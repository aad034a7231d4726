"""Queries over changes to the generated corpus, over text columns, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import changes as N
from paperloom.sources import corpus as C

from .history import EV, LI, events, files, read, snapshot
from .pages import D, with_root

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def placed(spark, d, *columns):
    """Documents with the store and path of their page."""
    return read(spark, d, "documents").select(F.expr(C.STORE).alias("store"), F.expr(C.PATH).alias("path"), *columns)


@query("changed_paths", f"WITH {D} SELECT store, path, doc_id % 2 = 0 OR doc_id % 5 = 0 AS topology FROM d WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0")
def _(spark, d):
    part = lambda n, status: placed(spark, d, "doc_id").filter(F.col("doc_id") % n == 0).select("store", "path", F.lit(status).alias("status"))
    return N.changed_paths(part(2, "A"), part(3, "M"), part(5, "?"))


@query("enrich_need", f"""WITH {D}, f AS (SELECT store, path, CASE WHEN doc_id % 4 = 0 THEN 'hash-stale' WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 3 = 0 THEN 'missing' END AS a, CASE WHEN doc_id % 5 = 0 THEN 'missing' END AS b FROM d)
SELECT store, path, CASE WHEN a = 'missing' OR b = 'missing' THEN 'missing' ELSE 'hash-stale' END AS reason, concat_ws(',', CASE WHEN a IS NOT NULL THEN 'description' END, CASE WHEN b IS NOT NULL THEN 'tags' END) AS fields FROM f WHERE a IS NOT NULL OR b IS NOT NULL""")
def _(spark, d):
    rows = placed(spark, d, "doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    rows = rows.withColumns({
        "description": F.expr("if(doc_id % 3 = 0, ' ', 'written')"),
        "description_stamp": F.expr("case when doc_id % 4 = 0 then 'old' when doc_id % 4 = 1 then sha end"),
        "tags": F.expr("if(doc_id % 5 = 0, null, 'some')"),
        "tags_stamp": F.lit(None).cast("string"),
    })
    return N.enrich_need(rows, "sha", ["description", "tags"])


@query("attributed_projects", """WITH s AS (SELECT doc_id, concat(source, '-', lang, '-', doc_id) AS slug FROM documents), p AS (SELECT DISTINCT source AS project FROM documents WHERE doc_id % 3 = 0 AND source IS NOT NULL UNION SELECT concat(source, '-', lang) FROM documents WHERE doc_id % 7 = 0)
SELECT doc_id, arg_max(project, length(project)) AS project FROM s LEFT JOIN p ON slug = project OR starts_with(slug, project || '-') GROUP BY doc_id""")
def _(spark, d):
    docs = read(spark, d, "documents")
    projects = docs.filter("doc_id % 3 = 0").select(F.col("source").alias("project")).union(docs.filter("doc_id % 7 = 0").select(F.concat("source", F.lit("-"), "lang")))
    return N.attribute_project(docs.select("doc_id", F.concat_ws("-", "source", "lang", "doc_id").alias("slug")), "doc_id", "slug", projects)


@query("unique_prefixes", """WITH n AS (SELECT DISTINCT md5(doc_id::VARCHAR) AS name FROM documents), e AS (SELECT name, unnest(range(5, 33)) AS len FROM n), c AS (SELECT substr(name, 1, len) AS prefix FROM e GROUP BY 1 HAVING count(*) = 1)
SELECT name, min(c.prefix) AS prefix FROM e JOIN c ON c.prefix = substr(name, 1, len) GROUP BY name""")
def _(spark, d):
    return N.shortest_unique_prefix(read(spark, d, "documents").select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("name")), "name", 5)


@query("got_pages", f"WITH {D}, w AS (SELECT store, concat('domains/', source) AS wanted, concat('domains/', source, '/README.md') AS path FROM d UNION SELECT store, concat('domains/', source, '/d', doc_id), path FROM d UNION SELECT store, path, path FROM d WHERE doc_id % 2 = 0 UNION SELECT store, concat(path, 'x'), NULL FROM d WHERE doc_id % 3 = 0) SELECT * FROM w")
def _(spark, d):
    rows = placed(spark, d, "doc_id", "source")
    stem = F.regexp_replace("path", r"\.md\z", "")
    wanted = rows.select("store", F.concat(F.lit("domains/"), "source").alias("wanted")).union(rows.select("store", stem)).union(rows.filter("doc_id % 2 = 0").select("store", "path"))
    wanted = wanted.union(rows.filter("doc_id % 3 = 0").select("store", F.concat("path", F.lit("x"))))
    return N.get_pages(wanted.distinct(), with_root(spark, d))


@query("strip_candidates", "SELECT l_partkey AS blob, bool_or(l_quantity < 10) AS both_kinds FROM lineitem GROUP BY 1 HAVING bool_or(l_quantity >= 10) AND blob NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def _(spark, d):
    history = read(spark, d, "lineitem").select(F.col("l_partkey").alias("blob"), (F.col("l_quantity") >= 10).alias("large"))
    return N.strip_candidates(history, read(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("blob")))


@query("drift_counts", f"""WITH {LI}, c AS (SELECT count(*) AS total, count(*) FILTER (k % 7 = 0) AS created, count(*) FILTER (k % 7 <> 0 AND k % 13 <> 0) AS unchanged FROM l WHERE k % 11 <> 0)
SELECT *, total - created - unchanged AS changed, total = unchanged AS clean FROM c""")
def _(spark, d):
    return N.drift_counts(snapshot(spark, d, 1), snapshot(spark, d, 0), ["path"], "blob")


@query("rows_to_write", f"WITH {LI} SELECT path, CASE WHEN k % 13 = 0 THEN 'XX' ELSE blob END AS blob, k % 7 = 0 AS created FROM l WHERE k % 11 <> 0 AND (k % 7 = 0 OR k % 13 = 0)")
def _(spark, d):
    return N.differing_rows(snapshot(spark, d, 1), snapshot(spark, d, 0), ["path"], "blob")


GATE = f"""{LI}, c AS (SELECT concat('s', k % 5) AS store, k AS "commit", path, size * 1000000 AS size, k % 4 = 0 AS large FROM l),
j AS (SELECT store, "commit", path, 'plain-size' AS rule, CASE WHEN size > 33554432 THEN 'violation' ELSE 'warning' END AS level FROM c WHERE NOT large AND size > 10485760
UNION ALL SELECT store, "commit", path, 'junk-name', 'violation' FROM c WHERE path LIKE '%/3' UNION ALL SELECT store, "commit", path, 'freeze', 'violation' FROM c WHERE store = 's1')"""


def gate(spark, d):
    rows = files(spark, d).select(F.concat(F.lit("s"), F.expr("k % 5")).alias("store"), F.col("k").alias("commit"), "path", (F.col("size") * 1_000_000).alias("size"), F.expr("k % 4 = 0").alias("large"))
    stores = rows.select("store").distinct()
    freezes = stores.filter("store in ('s1', 's2')").select("store", F.when(F.col("store") == "s1", "migration").otherwise("mine").alias("id"))
    return N.judge_changes(rows, F.col("path").like("%/3"), freezes, "mine")


@query("judged_changes", f"WITH {GATE} SELECT * FROM j")
def _(spark, d):
    return gate(spark, d)


@query("change_summary", f'WITH {GATE} SELECT rule, level, count(*) AS paths, count(DISTINCT "commit") AS commits FROM j GROUP BY ALL')
def _(spark, d):
    return N.change_summary(gate(spark, d))


@query("retention_plan", """WITH o AS (SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS "at" FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT id, "at", 'expired' AS state, "at" < 820454400 AS forget FROM o""")
def _(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.unix_timestamp("o_orderdate").alias("at"), "o_orderpriority")
    return N.retention_plan(rows, F.col("o_orderpriority") == "1-URGENT", "at", 820454400, 90, 946684800).select("id", "at", "state", "forget")


@query("final_map", f"WITH {D} SELECT store, path, CASE WHEN doc_id % 3 = 0 THEN concat('cached-', doc_id) ELSE sha256(coalesce(text, '')) END AS oid, doc_id % 3 <> 0 AS hashed FROM d")
def _(spark, d):
    rows = placed(spark, d, "doc_id", "text", "n_chars")
    cache = rows.filter("doc_id % 3 = 0").select("store", "path", "n_chars", F.concat(F.lit("cached-"), "doc_id").alias("oid"))
    stale = rows.filter("doc_id % 3 = 1").select("store", "path", (F.col("n_chars") + 1).alias("n_chars"), F.lit("stale").alias("oid"))
    return N.final_map(rows, cache.union(stale), ["store", "path", "n_chars"], "text").select("store", "path", "oid", "hashed")


@query("open_changes", f"WITH {EV} SELECT user_id, count(*) AS open, count(*) FILTER (s <= 1706745600 - 864000) AS overdue, min(s) AS oldest, overdue > 0 AS alarm FROM e WHERE event_type = 'click' GROUP BY 1")
def _(spark, d):
    return N.alarm_counts(events(spark, d).filter("event_type = 'click'"), "user_id", "s", 1706745600, 864000)


LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query("descriptions", rf"""WITH t AS (SELECT doc_id, coalesce({LINES}[1], '') AS x FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(x, '^[>#\-*\s]+', ''), '^["''`]+|["''`]+$', '', 'g') AS x FROM t)
SELECT doc_id, substr(trim(regexp_replace(x, '\s+', ' ', 'g')), 1, 240) AS description FROM b""")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", X.sanitize_description(F.col("text")).alias("description"))


@query("short_errors", rf"""WITH t AS (SELECT doc_id, {LINES} AS xs FROM documents), e AS (SELECT doc_id, coalesce(xs[1], '') AS f, coalesce(list_filter(xs, lambda x: regexp_matches(x, '(?i)error|fail|denied|refus|not supported|timed out'))[-1], '') AS l FROM t)
SELECT doc_id, substr(CASE WHEN l <> '' AND l <> f THEN f || ' … ' || l ELSE f END, 1, 400) AS error FROM e""")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", X.short_error(F.col("text")).alias("error"))


@query("link_targets_encoded", "SELECT doc_id, md5(replace(replace(replace(replace(text, '%', '%25'), '(', '%28'), ')', '%29'), ' ', '%20')) AS encoded FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(X.encode_target(F.col("text")).cast("binary")).alias("encoded"))


@query("pointer_files", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(coalesce(text, '')) END AS oid, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS size FROM documents")
def _(spark, d):
    made = X.render_pointer(F.sha2(F.coalesce("text", F.lit("")), 256), F.col("n_chars"))
    content = F.when(F.expr("doc_id % 3 = 0"), made).when(F.expr("doc_id % 3 = 1"), F.concat(made, F.lit("more\n"))).otherwise(F.col("text"))
    return read(spark, d, "documents").select("doc_id", X.parse_pointer(content).alias("p")).select("doc_id", "p.oid", "p.size")


@query("ledger_lines", f"WITH {EV} SELECT event_id, s::VARCHAR AS at, event_type AS state, CASE WHEN event_id % 4 <> 0 THEN user_id::VARCHAR END AS task FROM e")
def _(spark, d):
    line = X.ledger_line(F.col("s"), {"task": F.when(F.expr("event_id % 4 <> 0"), F.col("user_id")), "state": F.col("event_type")})
    rows = events(spark, d).select("event_id", X.parse_ledger_line(line).alias("x"))
    return rows.select("event_id", "x.at", F.try_element_at("x.fields", F.lit("state")).alias("state"), F.try_element_at("x.fields", F.lit("task")).alias("task"))
