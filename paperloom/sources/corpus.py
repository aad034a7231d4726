"""Page tables: recursive Markdown trees, and a generated corpus over the ``documents`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.indexes import Profile, page_class


def read_tree(spark: SparkSession, root: str, store: str) -> DataFrame:
    """(store, path, content) of every Markdown file below ``root``; dot folders and node_modules are skipped.

    Spark lists no folders or files whose names start with an underscore, which are buckets here and never walked.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    files = files.select(F.lit(store).alias("store"), F.expr(f"substring(path, locate('{root.rstrip('/')}/', path) + {len(root.rstrip('/')) + 1})").alias("path"), F.col("content").cast("string").alias("content"))
    return files.filter(~F.col("path").rlike(r"(^|/)(\.[^/]*|node_modules)/"))


def scan_pages(pages: DataFrame, profile: Profile) -> DataFrame:
    """The pages that a scan takes: none in hidden folders, archives, plans or buckets."""
    kind = page_class(F.col("path"), profile)
    return pages.filter(~(kind["hidden"] | kind["archive"] | kind["plans"] | kind["bucket"]))


def read_jsonl(spark: SparkSession, path: str, schema: str, id_col: str) -> DataFrame:
    """An append log; unreadable lines and rows without an id are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter(F.col(id_col).isNotNull())


#: The corpus that FIXTURES.md describes, as an expression that Spark and DuckDB share.
CONTENT = """concat('---', chr(10), 'title: Page ', doc_id, chr(10), 'tags: [', lang, ', ', source, ']', chr(10), 'created: 2024-01-0', doc_id % 9 + 1, chr(10),
CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('updated: 2024-02-01', chr(10)) END, CASE WHEN doc_id % 7 = 0 THEN concat('domain: old', chr(10)) ELSE '' END, '---', chr(10), chr(10),
'# Page ', doc_id, chr(10), chr(10), '## Summary', chr(10), 'Summary of ', doc_id, '.', chr(10), chr(10), '## Details', chr(10), text, chr(10),
'[next](', CASE WHEN doc_id % 17 = 0 THEN 'missing-' ELSE '' END, CASE WHEN doc_id % 19 = 0 THEN 'D' ELSE 'd' END, doc_id + 20, '.md#top)', chr(10),
CASE WHEN doc_id % 13 = 0 THEN concat('```', chr(10), '[code](nowhere.md)', chr(10), '```', chr(10)) ELSE '' END,
CASE WHEN doc_id % 23 = 0 THEN concat('See `s', doc_id % 4, ':domains/', source, '/d', doc_id, '.md`', chr(10)) ELSE '' END,
CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat(chr(10), '## Related', chr(10), '- [root](../../README.md)', chr(10)) END)"""
STORE = "concat('s', doc_id % 20 % 3)"
PATH = "concat('domains/', source, '/d', doc_id, '.md')"


def generated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(store, path, content), a page for each document; a document's source decides its folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.expr(STORE).alias("store"), F.expr(PATH).alias("path"), F.expr(CONTENT).alias("content"))


def generated_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(store, path, content): the index pages of ``generated_pages``, line by line; the root leaves every 4th folder out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.expr(STORE).alias("store"), "source", "doc_id")
    line = F.concat(F.lit("- [Page "), F.col("doc_id"), F.lit("](d"), F.col("doc_id"), F.lit(".md)"))
    inner = rows.filter("doc_id % 37 <> 0").select("store", F.concat(F.lit("domains/"), F.col("source"), F.lit("/README.md")).alias("path"), line.alias("content"))
    named = rows.select("store", "source").distinct().filter("cast(substring(source, 4) as int) % 4 <> 0")
    line = F.concat(F.lit("- ["), F.col("source"), F.lit("](domains/"), F.col("source"), F.lit("/README.md)"))
    return inner.unionByName(named.select("store", F.lit("README.md").alias("path"), line.alias("content")))


#: Pages in folders of twenty: domains/<source>/b<n>/c<n>/d<id>.md. Titles, descriptions and summaries come and go with the id.
CUT = "CAST(floor(doc_id / {}) AS BIGINT)"
DEEP_DIR = f"concat('domains/', source, '/b', {CUT.format(40000)}, '/c', {CUT.format(400)})"
DEEP_CONTENT = """concat('---', chr(10), CASE WHEN doc_id % 6 = 1 THEN '' ELSE concat('title: Page ', doc_id, chr(10)) END,
CASE doc_id % 4 WHEN 0 THEN concat('description: About ', doc_id, '.', chr(10)) WHEN 3 THEN concat('description: (draft)', chr(10)) ELSE '' END, 'status: open', chr(10), '---', chr(10), chr(10), '# Head ', doc_id, chr(10), chr(10),
CASE WHEN doc_id % 4 = 1 THEN concat('## Summary', chr(10), 'Sum of ', doc_id, ' with [next](d', doc_id + 20, '.md#top).', chr(10), chr(10)) WHEN doc_id % 4 = 2 THEN concat('Prose ', doc_id, '.', chr(10), chr(10)) ELSE '' END,
'## Details', chr(10), '- ', replace(text, chr(10), concat(chr(10), '- ')), chr(10))"""


def deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(store, path, content): those pages, and index pages of two folders in three, without every 37th page and with a stray link in some.

    An index page gathers twenty lines at most.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, number = F.expr(DEEP_DIR), F.expr(CUT.format(400))
    pages = docs.select(F.expr(STORE).alias("store"), F.concat(folder, F.lit("/d"), F.col("doc_id"), F.lit(".md")).alias("path"), F.expr(DEEP_CONTENT).alias("content"))
    line = F.when(F.col("doc_id") % 37 != 0, F.concat(F.lit("- [P](d"), F.col("doc_id"), F.lit(".md) — old")))
    lines = docs.groupBy(F.expr(STORE).alias("store"), folder.alias("dir"), number.alias("c"), "source").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    stray = F.when(F.col("c") % 5 == 0, "\n- [gone](gone.md) — old").otherwise("")
    head = F.concat(F.lit("# Index "), F.col("c"), F.lit("\n\nFolder "), F.col("c"), F.lit(" of "), F.col("source"), F.lit(".\n\n<!-- index:start -->\n"))
    text = F.concat(head, F.col("lines"), stray, F.lit("\n<!-- index:end -->\n"))
    return pages.unionByName(lines.filter("c % 3 <> 2").select("store", F.concat("dir", F.lit("/README.md")).alias("path"), text.alias("content")))
