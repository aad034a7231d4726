"""Queries over events, orders, line items and parts, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import history as H
from paperloom.operators import snapshots as S

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir):
    """Events with whole seconds and a size in bytes."""
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_timestamp("ts").alias("s"), F.floor(F.coalesce("value", F.lit(0.0)) * 1000).cast("long").alias("bytes"))


EV = "e AS (SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS s, floor(coalesce(value, 0) * 1000)::BIGINT AS bytes FROM events)"
#: 2024-01-01, as seconds.
START = 1704067200


@query("consecutive_ok", f"""WITH {EV}, r AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id DESC) AS n FROM e)
SELECT user_id, coalesce(min(n) FILTER (NOT ok), least(max(n), 30) + 1) - 1 AS streak FROM r WHERE n <= 30 GROUP BY user_id""")
def _(spark, d):
    return H.consecutive_ok(events(spark, d), "user_id", ["s", "event_id"], F.col("event_type") != "error")


@query("first_wins", f"WITH {EV} SELECT user_id, event_type, arg_min(event_id, s::HUGEINT * 1000000000 + event_id) AS event_id FROM e GROUP BY ALL")
def _(spark, d):
    return H.first_wins(events(spark, d), ["user_id", "event_type"], ["s", "event_id"]).select("user_id", "event_type", "event_id")


@query("ledger_tail", f"WITH {EV} SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY s DESC, event_id DESC) AS back FROM e QUALIFY back <= 20")
def _(spark, d):
    return H.tail(events(spark, d), "event_type", ["s", "event_id"], 20).select("event_type", "event_id", "back")


@query("fold_by_id", f"""WITH {EV} SELECT user_id, min(s) AS first_seen, arg_max(event_type, s::HUGEINT * 1000000000 + event_id) AS event_type,
arg_max(bytes, s::HUGEINT * 1000000000 + event_id) FILTER (event_type = 'purchase') AS bought FROM e GROUP BY user_id""")
def _(spark, d):
    rows = events(spark, d).withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("bytes")))
    return H.fold_by_id(rows, "user_id", ["s", "event_id"], ["event_type", "bought"])


#: Lines of a conflict ledger: fields come and go, a status may be set to null, and every 13th line can't be read.
CONFLICT = """CASE WHEN event_id % 13 = 0 THEN 'not json' ELSE concat('{"id":"u', user_id, '"', CASE WHEN event_id % 3 = 0 THEN ',"status":"open"' WHEN event_id % 3 = 1 THEN ',"status":null' ELSE '' END,
',"n', event_id % 2, '":', event_id, '}') END"""


@query("open_conflicts", f"""WITH {EV}, l AS (SELECT user_id, s::HUGEINT * 1000000000 + event_id AS pos, event_id, s FROM e WHERE event_id % 13 <> 0)
SELECT concat('u', user_id) AS id, min(s) AS first_seen, arg_max(event_id % 3, pos) FILTER (event_id % 3 <> 2) AS status, arg_max(event_id, pos) FILTER (event_id % 2 = 0) AS n0, arg_max(event_id, pos) FILTER (event_id % 2 = 1) AS n1
FROM l GROUP BY user_id HAVING status = 0""")
def _(spark, d):
    lines = events(spark, d).select("s", "event_id", F.expr(CONFLICT).alias("line"))
    found = H.open_conflicts(H.fold_json(lines, "line", ["s", "event_id"]))
    number = lambda c: F.try_element_at("fields", F.lit(c)).cast("long").alias(c)
    return found.select("id", F.col("first_seen.s").alias("first_seen"), F.lit(0).cast("long").alias("status"), number("n0"), number("n1"))


@query("assign_seq", f"""WITH {EV}, p AS (SELECT user_id, count(*) AS seq FROM e WHERE event_type = 'signup' GROUP BY 1)
SELECT event_id, coalesce(p.seq, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY s, event_id) AS seq FROM e LEFT JOIN p USING (user_id) WHERE event_type <> 'signup'""")
def _(spark, d):
    rows = events(spark, d)
    seen = rows.filter("event_type = 'signup'").groupBy("user_id").agg(F.count("*").alias("seq"))
    return H.assign_seq(rows.filter("event_type <> 'signup'"), "user_id", ["s", "event_id"], seen).select("event_id", "seq")


@query("hour_coverage", f"""WITH {EV}, h AS (SELECT DISTINCT event_type, (s - {START} - 1) // 3600 AS hour FROM e WHERE s > {START} AND s <= {START} + 720 * 3600),
w AS (SELECT * FROM (SELECT DISTINCT event_type FROM e), range(720) t(hour))
SELECT event_type, count(*) AS missing, min(hour) AS first_gap FROM w ANTI JOIN h USING (event_type, hour) GROUP BY 1""")
def _(spark, d):
    return H.hour_coverage(events(spark, d), "event_type", "s", START, 720)


@query("rolling_growth", f"""WITH {EV}, b AS (SELECT event_type, s // 600 * 600 AS bucket, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM e GROUP BY ALL)
SELECT event_type, bucket, sum(files) OVER w ::BIGINT AS files_24h, sum(bytes) OVER w ::BIGINT AS bytes_24h FROM b
WINDOW w AS (PARTITION BY event_type ORDER BY bucket RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return H.rolling_growth(events(spark, d), "event_type", "s", "bytes")


@query("alarm_onset", f"""WITH {EV}, a AS (SELECT *, event_type IN ('click', 'view') AS on_, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - row_number() OVER (PARTITION BY user_id, event_type IN ('click', 'view') ORDER BY s, event_id) AS g FROM e)
SELECT user_id, min(s) AS since, max(s) AS until, count(*) AS samples FROM a WHERE on_ GROUP BY user_id, g""")
def _(spark, d):
    return H.alarm_onset(events(spark, d), "user_id", ["s", "event_id"], F.col("event_type").isin("click", "view"), "s")


@query("rate_cap", f"""WITH {EV}, c AS (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS used FROM e)
SELECT event_id, used, greatest(least(2, 10 - used), 0) AS "left" FROM c""")
def _(spark, d):
    return H.rate_cap(events(spark, d), "event_type", "s", 2, 10).select("event_id", "used", "left")


@query("last_state", f"WITH {EV} SELECT user_id, arg_max(event_type, s::HUGEINT * 1000000000 + event_id) AS event_type FROM e WHERE event_type IN ('signup', 'purchase') GROUP BY 1")
def _(spark, d):
    return H.last_state(events(spark, d).filter("event_type in ('signup', 'purchase')"), "user_id", ["s", "event_id"], "event_type")


@query("directory_totals", f"WITH {EV} SELECT user_id, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM e GROUP BY 1")
def _(spark, d):
    return H.directory_totals(events(spark, d), "user_id", "bytes")


@query("object_usage", f"WITH {EV} SELECT count(*) AS objects, sum(bytes)::BIGINT AS bytes, count(*) FILTER (s > {START} + 1728000) AS new_objects, coalesce(sum(bytes) FILTER (s > {START} + 1728000), 0)::BIGINT AS new_bytes FROM e")
def _(spark, d):
    return H.usage(events(spark, d), "bytes", "s", START + 1728000)


@query("latency", f"WITH {EV} SELECT event_type, quantile_disc(bytes, 0.5) AS p50, quantile_disc(bytes, 0.95) AS p95, max(bytes) AS longest FROM e GROUP BY 1")
def _(spark, d):
    return H.latency(events(spark, d), "event_type", "bytes")


@query("extension_audit", """WITH p AS (SELECT string_split(p_type, ' ')[-1] AS ext, p_brand AS brand, p_size::BIGINT AS size FROM part),
g AS (SELECT ext, brand, count(*) AS n, sum(size)::BIGINT AS b FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY n DESC, brand) AS k FROM g)
SELECT ext, sum(n)::BIGINT AS files, sum(b)::BIGINT AS bytes, string_agg(brand, ',' ORDER BY k) FILTER (k <= 5) AS kinds FROM r GROUP BY ext""")
def _(spark, d):
    rows = read(spark, d, "part").select(F.element_at(F.split("p_type", " "), -1).alias("ext"), F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size"))
    return H.extension_audit(rows, "ext", "brand", "size")


@query("extension_totals", "SELECT string_split(p_type, ' ')[-1] AS ext, count(*) AS files, sum(p_size)::BIGINT AS bytes FROM part GROUP BY ROLLUP (1)")
def _(spark, d):
    rows = read(spark, d, "part").select(F.element_at(F.split("p_type", " "), -1).alias("ext"), F.col("p_size").cast("long").alias("size"))
    return H.ext_totals(rows, "ext", "size")


@query("phase_usage", f"""WITH {EV}, p AS (SELECT user_id, event_id AS phase, s AS start, s + 7200 AS stop FROM e WHERE event_type = 'purchase')
SELECT p.user_id, phase, count(*) AS samples, max(bytes) AS peak FROM p JOIN e ON e.user_id = p.user_id AND e.s >= start AND e.s < stop GROUP BY ALL""")
def _(spark, d):
    rows = events(spark, d)
    phases = rows.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("phase"), F.col("s").alias("start"), (F.col("s") + 7200).alias("stop"))
    return H.phase_usage(rows.select("user_id", "s", "bytes"), phases, "user_id", "s", "bytes", 7200)


def files(spark, d):
    """Line items as files: a path for each order and line, which the table repeats. They are dealt out before they are grouped, as
    hardly any two meet in a task that reads, which would only gather them."""
    rows = read(spark, d, "lineitem").repartition("l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("blob"), F.min(F.floor("l_quantity")).cast("long").alias("size"))
    path = F.concat_ws("/", F.lit("o"), "l_orderkey", "l_linenumber")
    return rows.select(path.alias("path"), F.col("l_orderkey").alias("k"), "blob", "size", F.md5(path.cast("binary")).alias("oid"))


def snapshot(spark, d, which):
    """One snapshot lacks every 7th order, the other every 11th and differs in every 13th."""
    rows = files(spark, d)
    if which == 0:
        return rows.filter("k % 7 <> 0").select("path", "blob")
    return rows.filter("k % 11 <> 0").select("path", F.when(F.expr("k % 13 = 0"), "XX").otherwise(F.col("blob")).alias("blob"))


LI = """l AS (SELECT concat_ws('/', 'o', l_orderkey, l_linenumber) AS path, l_orderkey AS k, min(l_returnflag || l_linestatus) AS blob, min(floor(l_quantity))::BIGINT AS size,
md5(concat_ws('/', 'o', l_orderkey, l_linenumber)) AS oid FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


@query("compare_snapshots", f"""WITH {LI} SELECT path, CASE WHEN k % 7 <> 0 THEN blob END AS before, CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 13 = 0 THEN 'XX' ELSE blob END END AS after,
CASE WHEN k % 7 = 0 THEN 'added' WHEN k % 11 = 0 THEN 'deleted' ELSE 'changed' END AS change FROM l WHERE NOT (k % 7 = 0 AND k % 11 = 0) AND (k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0)""")
def _(spark, d):
    return S.compare_snapshots(snapshot(spark, d, 0), snapshot(spark, d, 1), "path", "blob")


@query("inventory_diff", f"""WITH {LI} SELECT path, blob, 'before' AS side FROM l WHERE k % 7 <> 0 AND (k % 11 = 0 OR k % 13 = 0)
UNION ALL SELECT path, CASE WHEN k % 13 = 0 THEN 'XX' ELSE blob END, 'after' FROM l WHERE k % 11 <> 0 AND (k % 7 = 0 OR k % 13 = 0)""")
def _(spark, d):
    return S.inventory_diff(snapshot(spark, d, 0), snapshot(spark, d, 1))


@query("inventory_report", f"""WITH {LI}, x AS (SELECT path, blob, 'before' AS side FROM l WHERE k % 7 <> 0 AND (k % 11 = 0 OR k % 13 = 0)
UNION ALL SELECT path, CASE WHEN k % 13 = 0 THEN 'XX' ELSE blob END, 'after' FROM l WHERE k % 11 <> 0 AND (k % 7 = 0 OR k % 13 = 0))
SELECT side, path, blob, count(*) OVER (PARTITION BY side) AS rows FROM x QUALIFY row_number() OVER (PARTITION BY side ORDER BY path, blob) <= 20""")
def _(spark, d):
    return S.inventory_report(S.inventory_diff(snapshot(spark, d, 0), snapshot(spark, d, 1)), ["path", "blob"])


@query("three_way", f"""WITH {LI} SELECT path, CASE WHEN k % 11 = 0 AND k % 5 = 0 THEN 'same' WHEN k % 11 = 0 AND k % 7 <> 0 AND k % 3 = 0 THEN 'delete-modify'
WHEN k % 5 = 0 AND k % 13 = 0 THEN 'delete-modify' WHEN k % 3 = 0 AND k % 13 = 0 THEN 'conflict' WHEN k % 5 = 0 OR k % 3 = 0 THEN 'theirs' ELSE 'ours' END AS action
FROM (SELECT * FROM l WHERE k % 7 <> 0) WHERE k % 11 = 0 OR k % 13 = 0 OR k % 5 = 0 OR k % 3 = 0""")
def _(spark, d):
    base = snapshot(spark, d, 0)
    k = F.split("path", "/")[1].cast("long")
    ours = base.filter(k % 11 != 0).withColumn("blob", F.when(k % 13 == 0, "XX").otherwise(F.col("blob")))
    theirs = base.filter(k % 5 != 0).withColumn("blob", F.when(k % 3 == 0, "YY").otherwise(F.col("blob")))
    return S.three_way(base, ours, theirs, "path", "blob")


@query("sidecar_status", f"""WITH {LI} SELECT path, CASE WHEN k % 7 = 0 THEN 'orphan' WHEN k % 11 = 0 THEN 'missing' WHEN k % 13 = 0 THEN 'hash-changed' ELSE 'skipped' END AS status FROM l WHERE NOT (k % 7 = 0 AND k % 11 = 0)""")
def _(spark, d):
    return S.sidecar_status(snapshot(spark, d, 0).withColumnRenamed("blob", "sha"), snapshot(spark, d, 1).withColumnRenamed("blob", "sha"))


@query("object_check", f"WITH {LI} SELECT path, oid, CASE WHEN k % 7 = 0 THEN 'missing' ELSE 'wrong-size' END AS problem FROM l WHERE k % 7 = 0 OR k % 11 = 0")
def _(spark, d):
    rows = files(spark, d)
    objects = rows.filter("k % 7 <> 0").select("oid", F.expr("size + if(k % 11 = 0, 1, 0)").alias("size"))
    return S.cas_check(rows.select("path", "oid", "size"), objects)


@query("carried_pointers", f"WITH {LI} SELECT path, CASE WHEN k % 13 = 0 THEN 'XX' ELSE blob END AS blob FROM l WHERE k % 7 <> 0 OR k % 13 = 0")
def _(spark, d):
    changed = files(spark, d).filter("k % 13 = 0")
    return S.carry_pointers(snapshot(spark, d, 0), changed, changed.select("path", F.lit("XX").alias("blob")), "path")


@query("evictable", """WITH n AS (SELECT max(o_orderdate) AS backup FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey AS oid, CASE WHEN o_orderpriority = '1-URGENT' THEN 'dirty' WHEN o_orderstatus = 'O' THEN 'not-on-server' WHEN backup <= o_orderdate THEN 'no-backup-since' ELSE 'evict' END AS decision FROM orders, n""")
def _(spark, d):
    o = read(spark, d, "orders").withColumnsRenamed({"o_orderkey": "oid", "o_orderdate": "seen"})
    return S.evictable(o.select("oid", "seen"), o.filter("o_orderstatus <> 'O'"), o.filter("o_orderstatus = 'F'").select(F.col("seen").alias("at")), o.filter("o_orderpriority = '1-URGENT'"))


@query("evict_until", f"""WITH {LI}, r AS (SELECT k % 100 AS cache, path, size FROM l),
s AS (SELECT *, sum(size) OVER (PARTITION BY cache) - coalesce(sum(size) OVER (PARTITION BY cache ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS have FROM r)
SELECT cache, path FROM s WHERE have > 5000""")
def _(spark, d):
    return S.evict_until(files(spark, d).select(F.expr("k % 100").alias("cache"), "path", "size"), "cache", ["path"], "size", 5000).drop("size")


@query("pending_cap", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3 AS within FROM orders")
def _(spark, d):
    return S.cap(read(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 3)
