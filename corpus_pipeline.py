"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, language_id, line_dedup, mixing, simhash_dedup
from paperloom.llm.common import checkpoint, held_out, table

#: A document goes if less than this share of the evidence speaks for its likeliest language.
LEAST_SCORE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language, which becomes their lang.

    Null texts and texts without a letter go, and so do those whose likeliest language has less than half of the evidence.
    Rows are judged one by one, so repeated ones go or stay together.
    """
    docs = docs.select(*COLUMNS)
    model = language_id.fit_language_model(docs.filter(~held_out(F.col("doc_id"))))
    found = language_id.predict_language(docs, model)
    found = found.filter((F.col("language.lang") != "und") & (F.col("language.score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("language.lang")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat earlier ones; n_chars is counted anew.

    Null texts stay null; rows equal in id and text count as one document, and each stays.
    """
    found = line_dedup.dedup_lines(docs.select(*COLUMNS), exact_words=1)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Texts without words are copies of each other. Rows that repeat this id stay; a group without any id stays whole.
    """
    return simhash_dedup.keep_one(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Null and empty texts stay; repeated rows go or stay together."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many of their words, repeats counted.

    Documents without words, and those beyond their source's target, are taken 0 times and left out.
    """
    found = mixing.mix_sources(docs.select(*COLUMNS), (5.0, 2.0, 1.0), 3.0).filter("mix.taken > 0")
    return found.select(*COLUMNS, "mix.target", "mix.repeats", "mix.taken")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("decontamination", decontaminated),
    ("mixing", mix),
]

#: Language scores and SimHash groups have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each on the stored result of the one before it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
