"""Streaming queries: each reads a table as a stream to its end. The SQL says what has come out by then."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import history as H
from paperloom.sources import corpus as C
from paperloom.streaming import logs as L

from .history import EV

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def events(spark, d):
    rows = L.read_log(spark, f"{d}/events.parquet")
    return rows.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.unix_timestamp("ts").alias("s"), F.floor(F.coalesce("value", F.lit(0.0)) * 1000).cast("long").alias("bytes"))


@query("stream_first_deliveries", f"WITH {EV} SELECT event_id, user_id, event_type FROM e WHERE event_id > 100")
def _(spark, d):
    twice = events(spark, d).union(events(spark, d).filter("event_id % 10 = 0"))
    return L.drain(L.first_deliveries(twice, "event_id", "ts", "1 hour", after=100).select("event_id", "user_id", "event_type"))


@query("stream_growth_alarm", f"""WITH {EV}, b AS (SELECT event_type, s // 600 * 600 AS bucket, count(*) AS f, sum(bytes)::BIGINT AS b FROM e GROUP BY ALL),
r AS (SELECT event_type, bucket, sum(f) OVER w ::BIGINT AS files, sum(b) OVER w ::BIGINT AS bytes FROM b WINDOW w AS (PARTITION BY event_type ORDER BY bucket RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)),
a AS (SELECT *, files >= 70 OR bytes >= 2000000 AS alarm FROM r), g AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bucket) - row_number() OVER (PARTITION BY event_type, alarm ORDER BY bucket) AS g FROM a),
c AS (SELECT event_type, bucket, files, bytes, CASE WHEN alarm THEN min(bucket) OVER (PARTITION BY event_type, alarm, g) END AS since FROM g) SELECT c.* FROM c, (SELECT max(epoch(ts)) AS last FROM events) WHERE bucket + 600 <= last - 600""")
def _(spark, d):
    return L.drain(L.growth_alarm(events(spark, d), "event_type", "ts", "bytes", 70, 2_000_000))


#: A scan of a user's store at each of the user's events, in which changes of the last days are open.
@query("stream_uncollected", f"""WITH {EV}, x AS (SELECT user_id % 20 AS store, s, count(*) FILTER (event_id % 7 < 5) AS n FROM e GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY s) - row_number() OVER (PARTITION BY store, n > 0 ORDER BY s) AS g FROM x),
o AS (SELECT store, s AS scan, n, CASE WHEN n > 0 THEN min(s) OVER (PARTITION BY store, n > 0, g) END AS since FROM g) SELECT store, scan, n, since, coalesce(scan - since >= 3600, false) AS active FROM o, (SELECT max(epoch(ts)) AS last FROM events) WHERE scan + 1 <= last - 600""")
def _(spark, d):
    changed = F.when(F.expr("event_id % 7 < 5"), F.col("ts") - F.expr("interval 1 hour"))
    rows = events(spark, d).select(F.expr("user_id % 20").alias("store"), "ts", changed.alias("changed"))
    return L.drain(L.uncollected_alarm(rows, "store", "ts", "changed"))


@query("stream_enrich_queue", None)
def _(spark, d):
    name = F.expr("CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'queued' WHEN 'purchase' THEN 'tick' WHEN 'error' THEN 'failed' ELSE 'tick' END")
    rows = events(spark, d).select(F.expr("user_id % 20").alias("store"), "ts", name.alias("event"), F.concat(F.lit("p"), F.expr("user_id % 50")).alias("page"))
    return L.drain(L.enrich_queue(rows, "store", "ts", "event", "page"))


@query("stream_ready_paths", None)
def _(spark, d):
    return L.drain(L.ready_paths(events(spark, d), "user_id", "ts", F.col("user_id") % 2 == 0))


#: How the kinds of events stand for the events of a task.
TASK = {"signup": "dispatched", "view": "worker-done", "purchase": "qa-passed", "click": "qa-rejected", "error": "failed"}
STATES = "(VALUES ('signup', 0, 'dispatched'), ('view', 0, 'worker-done'), ('view', 1, 'awaiting-qa'), ('purchase', 0, 'qa-passed'), ('purchase', 1, 'signal-emitted'), ('click', 0, 'qa-rejected'), ('error', 0, 'failed')) t(event_type, pos, state)"


@query("stream_ledger_entries", f"WITH {EV} SELECT event_id, pos, concat('- ', s, ' | task=', user_id, ' | state=', state) AS line FROM e JOIN {STATES} USING (event_type)")
def _(spark, d):
    name = F.create_map(*[F.lit(x) for pair in TASK.items() for x in pair])[F.col("event_type")]
    rows = L.ledger_entries(events(spark, d).withColumn("event", name), "event", F.col("s"), {"task": F.col("user_id")})
    return L.drain(rows.select("event_id", "pos", "line"))


@query("stream_last_state", f"WITH {EV} SELECT user_id, arg_max(event_type, s::HUGEINT * 1000000000 + event_id) AS event_type FROM e GROUP BY 1")
def _(spark, d):
    return L.drain(H.last_state(events(spark, d), "user_id", ["s", "event_id"], "event_type"), "update", ["user_id"])


@query("stream_fold", f"WITH {EV} SELECT user_id, min(s) AS first_seen, arg_max(bytes, s::HUGEINT * 1000000000 + event_id) FILTER (event_type = 'purchase') AS bought FROM e GROUP BY 1")
def _(spark, d):
    rows = events(spark, d).withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("bytes")))
    return L.drain(H.fold_by_id(rows, "user_id", ["s", "event_id"], ["bought"]), "update", ["user_id"])


@query("stream_hourly", f"WITH {EV} SELECT event_type, s // 3600 * 3600 AS hour, count(*) AS samples, count(*) FILTER (bytes > 50000) AS flagged FROM e GROUP BY ALL")
def _(spark, d):
    return L.drain(L.hourly(events(spark, d).withWatermark("ts", "1 hour"), "event_type", "ts", F.col("bytes") > 50_000), "update", ["event_type", "hour"])


@query("stream_inbox", "SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS content_sha FROM documents GROUP BY 2")
def _(spark, d):
    return L.ingest_once(L.read_log(spark, f"{d}/documents.parquet"), "text", "doc_id")


@query("stream_affected_indexes", f"WITH d AS (SELECT {C.STORE} AS store, source FROM documents) SELECT DISTINCT store, unnest(['README.md', 'domains/README.md', concat('domains/', source, '/README.md')]) AS path FROM d")
def _(spark, d):
    changed = L.read_log(spark, f"{d}/documents.parquet").select(F.expr(C.STORE).alias("store"), F.expr(C.PATH).alias("path"))
    return L.drain(L.affected_indexes(changed))
