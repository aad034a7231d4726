"""The pages that nothing leads to, in a folder whose index page is made anew and then taken away."""

import duckdb
from pyspark.sql import functions as F

from paperloom import plans


def test_pages_of_a_folder_without_index_are_lost(spark, tmp_path):
    docs = spark.range(4_395, 4_405).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit("en").alias("lang"), F.lit("src0").alias("source"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["navigation_issues"](spark, str(tmp_path)).select("store", "file", "code", "detail").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.execute(f"SELECT store, file, code, detail FROM ({plans.ORACLES['navigation_issues']})").fetchall())
