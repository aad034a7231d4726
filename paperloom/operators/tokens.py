"""Commit names in texts: which of them are references, what they become, and the texts with new names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKEN = r"(?<![0-9A-Za-z_])[0-9a-f]{7,40}(?![0-9A-Za-z_])"


def read_commit_map(spark: SparkSession, path: str) -> DataFrame:
    """(old, new) of a two-column map; blank lines, remarks, the header and empty targets are passed over.

    A line of another form and a name that is mapped twice are errors, raised when the rows are read.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> '' and line not like '#%'").filter(~F.col("line").rlike(r"\Aold\s+new\z"))
    form = r"\A([0-9a-f]{40})\s+([0-9a-f]{40})\z"
    rows = lines.select(F.when(F.col("line").rlike(form), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("not two names: "), "line"))).alias("line"))
    rows = rows.select(F.regexp_extract("line", form, 1).alias("old"), F.regexp_extract("line", form, 2).alias("new")).filter(~F.col("new").rlike(r"\A0+\z"))
    once = rows.groupBy("old").agg(F.min("new").alias("new"), F.count("*").alias("n"))
    return once.select(F.when(F.col("n") == 1, F.col("old")).otherwise(F.raise_error(F.concat("old", F.lit(" is mapped twice")))).alias("old"), "new")


def token_rows(texts: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """(key..., path, line, token): every token of (key..., path, content), lines counted from 1; within each text, so nothing moves."""
    lines = texts.select(*key, "path", F.posexplode(F.split("content", "\n")).alias("_n", "_line"))
    return lines.select(*key, "path", (F.col("_n") + 1).alias("line"), F.explode(F.regexp_extract_all("_line", F.lit(f"({TOKEN})"), F.lit(1))).alias("token"))


def _unique_length(objects: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """(key..., sha, type, need): how many letters tell an object from all others; its neighbours in order decide, within seven letters."""
    by = Window.partitionBy(*key, F.substring("sha", 1, 7)).orderBy("sha")
    rows = objects.groupBy(*key, "sha").agg(F.first("type").alias("type")).withColumn("_a", F.lag("sha").over(by)).withColumn("_b", F.lead("sha").over(by))
    same = lambda other: F.coalesce(F.size(F.filter(F.sequence(F.lit(1), F.lit(40)), lambda k: F.substring("sha", F.lit(1), k) == F.substring(F.col(other), F.lit(1), k))), F.lit(0))
    return rows.select(*key, "sha", "type", (F.greatest(F.when(F.col("_a").isNotNull(), same("_a")).otherwise(0), F.when(F.col("_b").isNotNull(), same("_b")).otherwise(0)) + 1).alias("need"))


def decide(tokens: DataFrame, objects: DataFrame, commit_map: DataFrame, targets: DataFrame, others: DataFrame | None = None, key: tuple[str, ...] = ()) -> DataFrame:
    """(key..., token, replace, review) of every distinct token; neither is set for a token that names no commit here.

    ``objects`` and ``targets`` have (sha, type) of the old and the new repository, ``others`` (token, repo) what other
    repositories know. Tokens meet objects by their first seven letters, which random names spread evenly. With a ``key``, such as the store, each of these
    tables and ``commit_map`` has it, and a token names objects of its own store only.
    """
    distinct = tokens.select(*key, "token").distinct().withColumn("_k", F.substring("token", 1, 7))
    old = objects.select(*key, "sha", "type", F.substring("sha", 1, 7).alias("_k"))
    met = distinct.join(old, [*key, "_k"]).filter(F.expr("startswith(sha, token)")).groupBy(*key, "token").agg(F.count_distinct("sha").alias("n"), F.min(F.struct("sha", "type")).alias("o"))
    rows = distinct.select(*key, "token").join(met, [*key, "token"], "left").select(*key, "token", "n", F.col("o.sha").alias("old"), F.col("o.type").alias("type"))
    rows = rows.join(commit_map, [*key, "old"], "left")
    if others is not None:
        rows = rows.join(others.groupBy(*key, "token").agg(F.min("repo").alias("repo")), [*key, "token"], "left")
    else:
        rows = rows.withColumn("repo", F.lit(None).cast("string"))
    rows = rows.join(_unique_length(targets, key).withColumnsRenamed({"sha": "new", "type": "new_type"}), [*key, "new"], "left")
    length = F.greatest(F.length("token"), F.col("need"))
    review = (
        F.when(F.col("n").isNull(), None)
        .when(F.col("token").rlike(r"\A[0-9]+\z"), "all-digits")
        .when(F.col("n") > 1, "ambiguous-from")
        .when(F.col("type") != "commit", None)
        .when(F.col("new").isNull(), "not-in-map")
        .when(F.col("repo").isNotNull(), F.concat(F.lit("other-repo:"), "repo"))
        .when(F.col("new_type").isNull(), "target-missing")
        .when((F.col("new_type") != "commit") | (length > 40), "target-ambiguous")
    )
    named = (F.col("n") == 1) & (F.col("type") == "commit") & (F.col("new_type") == "commit")
    rows = rows.withColumn("review", review)
    return rows.select(*key, "token", F.when(named & F.col("review").isNull(), F.substring("new", F.lit(1), length)).alias("replace"), "review")


def rewrite(texts: DataFrame, decisions: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """(key..., path, content, replaced) of the texts that change, with new names in the places of the old ones."""
    tokens = F.regexp_extract_all("content", F.lit(f"({TOKEN})"), F.lit(1))
    rows = texts.select(*key, "path", F.posexplode(tokens).alias("_at", "token")).join(decisions.filter("replace is not null"), [*key, "token"], "left")
    new = rows.groupBy(*key, "path").agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("replace", "token").alias("new")))).alias("_new"), F.count("replace").alias("replaced")).filter("replaced > 0")
    both = texts.join(new, [*key, "path"])
    between = F.split("content", TOKEN, -1)
    put = F.transform(F.array(between), lambda b: F.concat(b[0], F.array_join(F.transform("_new", lambda r: F.concat(r["new"], F.element_at(b, r["_at"] + 2))), "")))[0]
    return both.select(*key, "path", put.alias("content"), "replaced")


def review_rows(rows: DataFrame, decisions: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """K4: (key..., path, line, token, reason) of the tokens that a person has to look at; write it with ``write_rows``."""
    return rows.join(decisions.filter("review is not null"), [*key, "token"]).select(*key, "path", "line", "token", F.col("review").alias("reason"))


def write_rows(rows: DataFrame, path: str) -> None:
    """K4: the rows as tab-separated files with a header."""
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def by_reason(review: DataFrame, samples: int = 5) -> DataFrame:
    """(reason, n, paths, sample): reviews by the reason's kind, and the first ``samples`` paths of each.

    Paths are counted once by a first aggregation, and ranked before they are gathered.
    """
    kind = F.substring_index("reason", ":", 1)
    paths = review.groupBy(kind.alias("reason"), "path").agg(F.count("*").alias("n"))
    top = paths.withColumn("_r", F.row_number().over(Window.partitionBy("reason", F.substring("path", 1, 3)).orderBy("path"))).filter(F.col("_r") <= samples)
    top = top.groupBy("reason").agg(F.slice(F.array_sort(F.collect_list("path")), 1, samples).alias("sample"))
    return paths.groupBy("reason").agg(F.sum("n").alias("n"), F.count("*").alias("paths")).join(top, "reason")
