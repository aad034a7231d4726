"""Queries over backups, drills, scans, merges and what depends on changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import pages as P
from paperloom.operators import upkeep as U
from paperloom.sources import corpus as C

from .history import EV, START, events, read

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


END = START + 19 * 86_400


@query("clean_days", f"""WITH {EV}, x AS (SELECT user_id % 7 AS store, s, event_type = 'purchase' AS backup, event_id % 400 = 0 OR event_id % 600 = 1 AS dirty, event_id % 90 = 0 AS ahead FROM e),
i AS (SELECT *, (s - {END - 3 * 86_400} - 1) // 3600 AS h, (s - {END - 3 * 86_400} - 1) // 86400 AS d FROM x WHERE s > {END - 3 * 86_400} AND s <= {END}),
g AS (SELECT store, count(DISTINCT h) AS hours, count(*) FILTER (dirty) AS dirty, count(DISTINCT d) FILTER (backup) AS backup_days, count(*) FILTER (backup AND ahead) AS ahead FROM i GROUP BY 1),
k AS (SELECT DISTINCT store FROM x), w AS (SELECT store, min(h) AS first_gap FROM (SELECT store, unnest(range(72)) AS h FROM k) a WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.store = a.store AND i.h = a.h) GROUP BY 1)
SELECT k.store, 72 - coalesce(hours, 0) AS missing, first_gap, coalesce(dirty, 0) AS dirty, coalesce(backup_days, 0) AS backup_days, coalesce(ahead, 0) AS ahead, coalesce(hours = 72 AND dirty = 0 AND backup_days >= 3 AND ahead = 0, false) AS clean FROM k LEFT JOIN g USING (store) LEFT JOIN w USING (store)""")
def _(spark, d):
    flag = lambda sql: F.expr(f"CASE WHEN {sql} THEN 1 ELSE 0 END")
    rows = events(spark, d).select(F.expr("user_id % 7").alias("store"), F.col("s").alias("ts"), F.expr("CASE WHEN event_type = 'purchase' THEN 'backup' ELSE 'probe' END").alias("kind"), flag("event_id % 400 = 0").alias("uncollected"), flag("event_id % 600 = 1").alias("large_outside"), flag("event_id % 90 = 0").alias("ahead"))
    return U.clean_days(rows, "store", END)


@query("restore_drills", "WITH n AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 10 <> 0) AS m FROM orders) SELECT s AS snapshot, least(300, n) AS required, CASE WHEN s = 2 THEN m ELSE n END AS available, least(400, n) AS sampled, CASE WHEN s = 1 THEN 0 ELSE least(400, n) END AS matched, CASE WHEN s IN (1, 2) THEN 'failed' ELSE 'ok' END AS result FROM n, (SELECT unnest(range(4)) AS s)")
def _(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("path"))
    live = rows.select("path", F.sha2("path", 256).alias("sha"))
    taken = rows.withColumn("snapshot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).filter("not (snapshot = 2 and k % 10 = 0)")
    restored = taken.select("snapshot", "path", F.when(F.col("snapshot") == 1, "bad").otherwise(F.sha2("path", 256)).alias("sha"))
    return U.restore_drill(restored, live, 300, 400, 7)


@query("rewrite_checks", """SELECT 'tree-deleted' AS "check", o_orderkey::VARCHAR AS path FROM orders WHERE o_orderkey % 31 = 0 UNION ALL SELECT 'tree-changed', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 37 = 0 AND o_orderkey % 31 <> 0 UNION ALL SELECT 'object-missing', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 41 = 0
UNION ALL SELECT 'object-wrong-size', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 43 = 0 AND o_orderkey % 41 <> 0 UNION ALL SELECT 'oid-outside-map', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 47 = 0""")
def _(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("path"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("oid"))
    before = rows.select("path", F.col("oid").alias("blob"))
    after = rows.filter("k % 31 <> 0").select("path", F.expr("CASE WHEN k % 37 = 0 THEN 'other' ELSE oid END").alias("blob"))
    pointers = rows.select("path", "oid", F.lit(5).cast("long").alias("size"))
    objects = rows.filter("k % 41 <> 0").select("oid", F.expr("CASE WHEN k % 43 = 0 THEN 6L ELSE 5L END").alias("size"))
    return U.verify_rewrite(before, after, pointers, objects, rows.filter("k % 47 <> 0").select("oid"))


@query("retirements", """SELECT c_custkey AS store, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'reenable' ELSE 'stay-retired' END WHEN c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 THEN 'retire' ELSE 'keep-running' END AS action,
concat_ws(',', CASE WHEN c_custkey % 3 = 0 THEN 'backups' END, CASE WHEN c_custkey % 7 = 0 THEN 'probe' END, CASE WHEN c_custkey % 11 = 0 THEN 'clean' END) AS failed FROM customer""")
def _(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("store"), F.col("c_custkey").alias("k"))
    runs = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(4)))).select("store", F.col("n").alias("at"), F.expr("CASE WHEN k % 3 = 0 AND n = 3 THEN 'failed' ELSE 'ok' END").alias("result"), F.concat(F.lit("snap"), "n").alias("snapshot"))
    drills = rows.select("store", F.lit(9).alias("at"), F.lit("ok").alias("result"), F.lit("snap4").alias("snapshot"))
    state = rows.select("store", F.expr("k % 5 <> 0").alias("enabled"), F.expr("k % 5 = 0").alias("retired"), F.expr("CASE WHEN k % 2 = 0 THEN 30000 ELSE 10 END").alias("red"))
    conditions = {"backups": U.backup_judgement(runs, drills, "store"), "probe": rows.filter("k % 7 <> 0").select("store", F.lit(True).alias("ok")), "clean": rows.select("store", F.expr("k % 11 <> 0").alias("ok"))}
    return U.retirement(rows, "store", conditions, state)


#: A tree a document: three files, of which a rewrite changed one in some commits, lost one in others, and left some commits without a name.
@query("history_faults", """WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY doc_id % 2) AS n FROM documents),
s AS (SELECT * FROM d WHERE place <= 50 OR place > n - 50 OR doc_id % 9 = 0), c AS (SELECT concat('s', doc_id % 2) AS store, concat('old', doc_id) AS "commit", doc_id FROM s)
SELECT 'tree-changed' AS "check", store, "commit", 'a.md' AS path FROM c WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0 UNION ALL SELECT 'tree-deleted', store, "commit", 'b.md' FROM c WHERE doc_id % 11 = 0 AND doc_id % 7 <> 0
UNION ALL SELECT 'commit-unnamed', store, "commit", NULL FROM c WHERE doc_id % 7 = 0""")
def _(spark, d):
    k = read(spark, d, "documents").select("doc_id", "text")
    store, old, new = F.expr("concat('s', doc_id % 2)").alias("store"), F.expr("concat('old', doc_id)"), F.expr("concat('new', doc_id)")
    odd = k.filter("doc_id % 9 = 0").select(store, old.alias("commit"))
    picked = U.sampled_commits(k.select(store, old.alias("commit"), F.col("doc_id").alias("ord")), odd, most=0)
    files = F.explode(F.array(F.lit("a.md"), F.lit("b.md"), F.lit("free.md"))).alias("path")
    trees = k.select("doc_id", "text", files).withColumns({"mode": F.lit("100644"), "blob": F.sha1(F.concat("path", "text").cast("binary"))})
    before = trees.select(store, old.alias("commit"), "path", "mode", "blob")
    blob = F.when(F.expr("path = 'free.md' or path = 'a.md' and doc_id % 5 = 0"), "other").otherwise(F.col("blob"))
    after = trees.filter("not (path = 'b.md' and doc_id % 11 = 0)").select(store, new.alias("commit"), "path", "mode", blob.alias("blob"))
    renamed = k.filter("doc_id % 7 <> 0").select(store, old.alias("commit"), new.alias("new"))
    return U.history_faults(picked, renamed, before, after, k.select(store, F.lit("free.md").alias("path")).distinct())


@query("content_faults", """SELECT CASE WHEN doc_id % 13 = 0 THEN 'object-missing' WHEN doc_id % 5 = 0 THEN 'object-hash' ELSE 'object-size' END AS "check", doc_id::VARCHAR AS path FROM documents WHERE doc_id % 13 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0""")
def _(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content")).withColumn("content", F.concat("content", F.col("doc_id").cast("string").cast("binary")))
    oid = F.sha2("content", 256).alias("oid")
    pointers = docs.select(F.col("doc_id").cast("string").alias("path"), oid, (F.octet_length("content") + F.expr("CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END")).alias("size"))
    objects = docs.filter("doc_id % 13 <> 0").select(oid, F.when(F.expr("doc_id % 5 = 0"), F.lit(b"x")).otherwise(F.col("content")).alias("content"))
    return U.content_faults(pointers, objects)


#: A ledger of four lines before the text; our side drops the first and adds two at the end, theirs changes the third and adds two.
LEDGER = {"base": "concat('a', chr(10), 'm', chr(10), 'b', chr(10), 'c', chr(10), text, chr(10))", "ours": "concat('m', chr(10), 'b', chr(10), 'c', chr(10), text, chr(10), 'our ', doc_id, chr(10), 'same', chr(10))"}
LEDGER["theirs"] = "concat('a', chr(10), 'm', chr(10), 'B', chr(10), 'c', chr(10), text, chr(10), 'their', chr(10), 'same', chr(10))"
PAGE = "concat('head', chr(10), '<!-- index:start -->', chr(10), '{}', chr(10), '<!-- index:end -->', chr(10), text)"


@query("merge_actions", f"""SELECT concat(CASE doc_id % 6 WHEN 0 THEN 'log/' WHEN 1 THEN 'graph/' WHEN 2 THEN 'f/' ELSE 'd/' END, doc_id, CASE WHEN doc_id % 6 = 2 THEN '/README.md' ELSE '.md' END) AS path, CASE doc_id % 6 WHEN 0 THEN 'union' WHEN 1 THEN 'derived' WHEN 2 THEN 'derived' WHEN 3 THEN 'general' ELSE 'delete-modify' END AS class,
CASE doc_id % 6 WHEN 0 THEN 'both' WHEN 4 THEN 'local' ELSE 'remote' END AS kept, doc_id % 6 = 3 AS copied,
md5(CASE doc_id % 6 WHEN 0 THEN concat('m', chr(10), 'B', chr(10), 'c', chr(10), text, chr(10), 'our ', doc_id, chr(10), 'their', chr(10), 'same', chr(10)) WHEN 4 THEN {PAGE.format('ours')} ELSE concat({PAGE.format('theirs')}, 'x') END) AS content_md5 FROM documents WHERE doc_id % 10 <> 9""")
def _(spark, d):
    path = F.expr("concat(CASE doc_id % 6 WHEN 0 THEN 'log/' WHEN 1 THEN 'graph/' WHEN 2 THEN 'f/' ELSE 'd/' END, doc_id, CASE WHEN doc_id % 6 = 2 THEN '/README.md' ELSE '.md' END)")
    page = lambda x: F.when(F.expr("doc_id % 6 = 0"), F.expr(LEDGER[x])).otherwise(F.expr(PAGE.format(x)))
    docs = read(spark, d, "documents").select("doc_id", "text", path.alias("path"))
    base = docs.select("path", page("base").alias("content"))
    ours = docs.filter("doc_id % 6 <> 5").select("path", page("ours").alias("content"))
    theirs = docs.filter("doc_id % 6 <> 4").select("path", F.when(F.expr("doc_id % 10 = 9 and doc_id % 6 <> 5"), page("base")).when(F.expr("doc_id % 10 = 9"), page("base")).otherwise(F.concat(page("theirs"), F.expr("CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'x' END"))).alias("content"))
    ours = ours.union(docs.filter("doc_id % 10 = 9 and doc_id % 6 = 5").select("path", page("base")))
    theirs = theirs.union(docs.filter("doc_id % 10 = 9 and doc_id % 6 = 4").select("path", page("base")))
    found = U.merge_actions(base, ours, theirs, F.startswith("path", F.lit("graph/")), F.startswith("path", F.lit("log/")), "index")
    return found.withColumn("content_md5", F.md5(F.col("content").cast("binary"))).drop("content")


@query("two_level_totals", "WITH d AS (SELECT concat('domains/', source) AS dir, count(*) AS files, sum(length(text))::BIGINT AS bytes FROM documents GROUP BY 1) SELECT dir, files, bytes, row_number() OVER (ORDER BY bytes DESC, files DESC, dir) AS place FROM d")
def _(spark, d):
    rows = read(spark, d, "documents").select(F.lit("s").alias("store"), F.expr(C.PATH).alias("path"), F.length("text").cast("long").alias("size"))
    return U.two_level_totals(rows, ["store"], "size").drop("store")


@query("top_directories", f"WITH {EV}, s AS (SELECT event_type, s // 86400 * 86400 AS bucket, concat('u', user_id) AS dir, sum(bytes)::BIGINT AS bytes FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, bucket ORDER BY bytes DESC, dir) AS n FROM s) SELECT event_type, bucket, dir, bytes FROM r WHERE n = 1")
def _(spark, d):
    return U.top_directory(events(spark, d), "event_type", F.concat(F.lit("u"), "user_id"), "bytes", "s", 86_400)


@query("commit_origins", "SELECT o_orderkey AS commit, CASE o_orderkey % 4 WHEN 0 THEN 'fetch' WHEN 1 THEN 'update by push' WHEN 2 THEN 'fetch' END AS message, o_orderkey % 4 IN (0, 2) AS from_server FROM orders")
def _(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("commit"))
    state = lambda n, message, where: rows.filter(where).select("commit", F.lit(n).alias("ord"), F.lit(message).alias("message"))
    states = state(1, "update by push", "commit % 4 <> 3").union(state(2, "fetch", "commit % 4 in (0, 2)")).union(state(3, "update by push", "false"))
    return U.commit_origin(rows, states)


@query("residue_alarms", "WITH o AS (SELECT o_custkey % 50 AS store, concat('a', CASE WHEN o_orderkey % 500 = 0 THEN '.png' ELSE '.md' END) AS path, floor(o_totalprice)::BIGINT AS size, o_orderkey AS changed FROM orders) SELECT store, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (path LIKE '%.png') AS large, min(changed) AS oldest, count(*) FILTER (path LIKE '%.png') > 0 OR sum(size) >= 60000000 AS outside, sum(size) >= 70000000 OR 100000 - min(changed) >= 99950 AS residue FROM o GROUP BY 1")
def _(spark, d):
    rows = read(spark, d, "orders").select(F.expr("o_custkey % 50").alias("store"), F.expr("concat('a', CASE WHEN o_orderkey % 500 = 0 THEN '.png' ELSE '.md' END)").alias("path"), F.floor("o_totalprice").cast("long").alias("size"), F.col("o_orderkey").alias("changed"))
    outside = U.ignored_outside(rows, "store", 60_000_000).withColumnRenamed("active", "outside")
    residue = U.reject_residue(rows, "store", 100_000, 70_000_000, 99_950).select("store", "oldest", F.col("active").alias("residue"))
    return outside.join(residue, "store")


@query("dependent_indexes", f"SELECT DISTINCT {C.STORE} AS store, concat('domains/', source, '/README.md') AS path FROM documents WHERE doc_id % 37 <> 0 AND doc_id % 101 = 0")
def _(spark, d):
    links = P.links(C.generated_index_lines(spark, d))
    changed = C.generated_pages(spark, d).select("store", "path", (F.regexp_extract("path", r"d(\d+)\.md\z", 1).try_cast("long") % 101 == 0).alias("topology"))
    return U.dependent_indexes(changed, links)


@query("phase_totals", "SELECT o_custkey AS run, sum(o_orderkey % 60) AS seconds, sum(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 60 ELSE 0 END) AS cold, sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 60 END) AS warm FROM orders GROUP BY 1")
def _(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.lit(0).cast("long").alias("start"), F.expr("o_orderkey % 60").alias("stop"), F.expr("o_orderkey % 3 = 0").alias("cold"))
    return U.phase_totals(rows, "run", F.col("cold"))
