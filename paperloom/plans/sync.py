"""ST1 as a query: index pages kept up to date from a stream of changes, and the SQL of what a full pass would say."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import indexes as I
from paperloom.sources import corpus as C
from paperloom.streaming import logs as L
from paperloom.streaming import sync as S

from .indexes import DEEP

QUERIES, ORACLES = {}, {}
PROFILE = I.Profile()


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


#: In half of the folders, a tenth of the pages each comes, changes, or has a neighbour that goes.
TURN = f"CASE WHEN {C.CUT.format(400)} % 2 = 0 THEN CAST(floor(doc_id / 20) AS BIGINT) % 10 END"


@query("incremental_sync", f"""WITH {DEEP}, t AS (SELECT store, readme AS path, any_value(source) AS source, any_value(c) AS c, coalesce(bool_or({TURN} IN (3, 5, 7)), false) AS rewritten,
string_agg(concat('- [', label, '](', link, ') — ', summary), chr(10) ORDER BY link) AS inside FROM leaf GROUP BY ALL)
SELECT store, path, rewritten, md5(concat(CASE WHEN c % 3 = 2 THEN concat('---', chr(10), 'title: c', c, chr(10), 'status: active', chr(10), '---', chr(10), chr(10), '# c', c, chr(10), chr(10), '## Index', chr(10), chr(10))
ELSE concat('# Index ', c, chr(10), chr(10), 'Folder ', c, ' of ', source, '.', chr(10), chr(10)) END, '<!-- index:start -->', chr(10), inside, chr(10), '<!-- index:end -->', chr(10))) AS content_md5 FROM t""")
def _(spark, d):
    now, turn = C.deep_pages(spark, d), F.expr(TURN)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    store, path = F.expr(C.STORE).alias("store"), F.concat(F.expr(C.DEEP_DIR), F.lit("/d"), "doc_id", F.lit(".md"))
    other = docs.filter(turn == 7).select(store, path.alias("path"), F.lit("---\ntitle: Old\n---\nOld.\n").alias("content"))
    extra = F.concat(F.expr(C.DEEP_DIR), F.lit("/x"), "doc_id", F.lit(".md"))
    extras = docs.filter(turn == 5).select(store, extra.alias("path"), F.lit("# Extra\n").alias("content"))
    changing = docs.filter(turn.isin(3, 7)).select(store, path.alias("path"))
    then = now.join(changing, ["store", "path"], "left_anti").unionByName(other).unionByName(extras)
    folder = L.shared_folder(spark)
    S.start_state(then, PROFILE, folder)
    changes = L.read_log(spark, f"{d}/documents.parquet").filter(turn.isin(3, 5, 7))
    gone = turn == 5
    changes = changes.select(
        store,
        F.when(gone, extra).otherwise(path).alias("path"),
        F.when(~gone, F.expr(C.DEEP_CONTENT)).alias("content"),
        F.when(gone, "missing").otherwise("file").alias("kind"),
        F.col("doc_id").alias("ord"),
    )
    report = S.sync_changes(changes, folder, PROFILE, lambda: now)
    written = report.filter("path is not null").select("store", "path", F.lit(True).alias("rewritten")).distinct()
    rows = S.current_indexes(spark, folder).filter(X.directory(F.col("path")).rlike(r"/c[0-9]+\z")).join(written, ["store", "path"], "left")
    return rows.select("store", "path", F.coalesce("rewritten", F.lit(False)).alias("rewritten"), F.md5(F.col("content").cast("binary")).alias("content_md5"))
