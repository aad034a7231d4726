"""Every operator on columns with its own names, null and empty and very long texts, repeated rows, and an empty table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import decontaminate, embedding_dedup, language_id, line_dedup, mixing, quality, secret_scan, simhash_dedup, toxicity, url_filter
from paperloom.llm import queries as Q

NAMES = (
    *("_at", "_of", "_doc", "_split", "_stay", "_lines", "_kept", "_size", "size", "mix", "s", "at", "row", "id", "host", "path", "rule", "verdict", "judged", "label", "length", "features"),
    *("fold", "suffix", "language", "lang_pred", "secrets", "toxicity", "quality", "_gone", "_hash", "_id", "root", "node", "w", "total", "n", "h", "token", "doc", "item_id", "words", "url_"),
)
SMALL = "/root/testdata/sf0.001"
MORE = ("held_out", "score", "part", "placed", "encoded", "code", "error", "shard", "slot", "h_", "mask", "cell", "vec", "dim", "rep", "node_", "component_id", "n_links", "kept", "fingerprint", "sketch", "df", "least", "most")
LONG = "\n".join(" ".join(f"w{k * 7 + j}" for j in range(9)) for k in range(20_000))
TEXTS = ["one two three four five six\nseven", "one two three four five six\nseven", None, "", "   \n ", LONG, "https://a.example.com/en/1?q=2"]


@pytest.fixture(scope="module")
def docs(spark):
    ids = [1, 1, None, 2, None, 3, 4]
    rows = spark.createDataFrame([(i, t, "en", "a" if i == 1 else None) for i, t in zip(ids, TEXTS, strict=True)], "doc_id long, text string, lang string, source string")
    return rows.select("*", *[F.lit("mine").alias(c) for c in NAMES]).coalesce(2).cache()


def bench(spark):
    return spark.createDataFrame([(1, "nothing of this kind is anywhere"), (2, None), (3, "")], "item_id long, text string")


LEXICON = toxicity.Lexicon({" one": 1.0}, [], (1.0, 1.0, -2.0))
MODEL = quality.OrdinalModel([0.0, 1.0], np.zeros(64), np.zeros(1))
OPS = {
    "op1": lambda spark, df: simhash_dedup.keep_one(df),
    "op2": lambda spark, df: url_filter.judge_urls(df, Q.URL_RULES, url_col="text"),
    "op3": lambda spark, df: line_dedup.dedup_lines(df, exact_words=1),
    "op4": lambda spark, df: decontaminate.without_leaks(df, bench(spark)),
    "op5": lambda spark, df: language_id.predict_language(df, language_id.fit_language_model(df)),
    "op7": lambda spark, df: secret_scan.scan_secrets(df),
    "op8": lambda spark, df: toxicity.score_toxicity(df, LEXICON),
    "op9": lambda spark, df: mixing.mix_sources(df),
    "op10": lambda spark, df: quality.score_quality(df, MODEL, tail_from=1.0),
}


@pytest.mark.parametrize("name", OPS)
def test_rows_and_columns_of_the_caller_stay(spark, docs, name):
    got = OPS[name](spark, docs)
    assert got.columns[: len(docs.columns)] == docs.columns and len(set(map(str.lower, got.columns))) == len(got.columns)
    rows = got.collect()
    assert all(r[c] == "mine" for r in rows for c in NAMES)
    new = [c for c in got.columns if c not in docs.columns]
    if name == "op1":  # the blank texts are alike, and so are the two equal rows, of which each stays
        assert sorted(r["doc_id"] for r in rows) == [1, 1, 2, 3, 4]
    else:
        assert len(rows) == len(TEXTS)
    same = [tuple(map(str, (r[c] for c in new))) for r in rows if r["text"] is not None and r["text"].startswith("one two")]
    assert len(set(same)) <= 1 and len(same) in (0, 2)
    if name != "op3":
        assert {r["text"] for r in rows} <= set(TEXTS)


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """The smallest tables with a column more for every name that the operators use."""
    folder = str(tmp_path_factory.mktemp("clash"))
    for name in ("documents", "pages", "embeddings", "labels", "benchmark"):
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")
        taken = {c.lower() for c in rows.columns}
        rows.select("*", *[F.lit("mine").alias(c) for c in (*NAMES, *MORE) if c not in taken]).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_read_their_own_columns(spark, clashing, name):
    rows = lambda folder: sorted(map(str, Q.QUERIES[name](spark, folder).collect()))
    assert rows(clashing) == rows(SMALL)


def test_the_first_stage_reads_its_own_columns(spark, clashing):
    rows = lambda folder: sorted(map(str, corpus_pipeline.identify_language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()))
    assert rows(clashing) == rows(SMALL)


def test_the_first_stage_reads_each_text_once(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = corpus_pipeline.identify_language(spark, documents, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, docs, name):
    assert OPS[name](spark, docs.limit(0)).count() == 0


def test_lines_of_a_long_text(spark, docs):
    got = {r["text"]: r["_lines_"] for r in line_dedup.dedup_lines(docs, exact_words=1).collect() if r["doc_id"] == 3}
    assert got == {LONG: 20_000}  # no line repeats


def test_a_long_text_is_scanned_to_its_end(spark):
    tail = LONG + "\npassword=hunter22 toxici " + "½"
    frame = spark.createDataFrame([(1, tail)], "doc_id long, text string")
    found = secret_scan.scan_secrets(frame).first()["secrets"]
    assert [(x["kind"], x["end"] > len(LONG)) for x in found] == [("assign", True)]
    lexicon = toxicity.Lexicon({" toxici ": 5.0}, [], (1.0, 1.0, 0.0))
    assert toxicity.score_toxicity(frame, lexicon).first()["toxicity"] > 0.5


def test_leaks_ignore_clashing_columns_and_repeats(spark, docs):
    items = spark.createDataFrame([(7, "one two three four five six seven", "x")], "item_id long, text string, w string")
    got = decontaminate.find_leaks(docs, items).collect()
    assert [(r["doc"]["id"], r["item_id"], r["start_word"], r["similarity"]) for r in got] == [(1, 7, 0, 1.0)]
    assert decontaminate.without_leaks(docs, items).count() == 5


def test_vectors_with_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0, "x"), (1, [1.0, 0.0], 0, "x"), (None, [1.0, 0.0], 0, "x"), (2, [1.0, 0.001], 0, "x"), (3, [1.0, 0.0], None, "x"), (4, [1.0], 0, "x"), (5, [2.0], 0, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cell string")
    got = sorted((str(r["id"]), r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_near_dups(frame).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("2", 2, 1, False), ("3", 0, 3, True), ("4", 1, 4, True), ("5", 1, 4, False), ("None", 0, None, False)]


def test_vectors_in_many_cells_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    x[900:1400] = x[:500] + rng.normal(size=(500, 24)) * 0.13
    frame = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cos = unit @ unit.T
    np.fill_diagonal(cos, 0)
    want = (cos >= 0.98).sum(axis=1)
    got = {r["id"]: r["n_links"] for r in embedding_dedup.embedding_near_dups(frame, cell_rows=3, block_rows=64, fan=48).collect()}
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.99 * want.sum() > 400
