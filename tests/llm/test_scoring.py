"""Scores and findings: held-out accuracy, known cases and odd rows."""

import base64
import json
import re

import pytest
from pyspark.sql import functions as F

from paperloom.llm import language_id, mixing, quality, secret_scan, toxicity, url_filter
from paperloom.llm import queries as Q

DATA = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = Q.op5_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_without_letters_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "12 !?", None), (5, "the the", "fr")], "doc_id long, text string, lang string")
    model = language_id.fit_language_model(frame)
    got = {r["doc_id"]: r["language"]["lang"] for r in language_id.predict_language(frame, model).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("en", "fr", "und", "und")
    nothing = language_id.fit_language_model(frame.limit(0))
    assert {r["language"]["lang"] for r in language_id.predict_language(frame, nothing).collect()} == {"und"}


def test_a_small_language_keeps_its_words_and_all_counts(spark):
    rows = [(k, "the cat and the dog " * 20, "en") for k in range(40)] + [(99, "zorq zorq vluk vluk cat", "xx"), (100, "α" * 70 + "βγδεζ", "el")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(frame)
    assert {"the", "zorq", "vluk"} <= set(model.words)
    row = lambda w: dict(zip(model.langs, model.word_logs[model.words.index(w)], strict=True))
    assert row("cat")["xx"] - row("cat")["el"] > row("and")["xx"] - row("and")["el"] + 0.5  # its single "cat" counts
    got = {r["doc_id"]: r["language"]["lang"] for r in language_id.predict_language(frame, model).collect()}
    assert got[99] == "xx" and got[0] == "en"
    whole = language_id.Scorer(["el"], [], model.word_logs[:0, :1], ["βγδεζ", "α"], model.gram_logs[:2, :1])
    assert whole.grams_of("α" * 70 + "βγδεζ") == [0]


def test_base_secrets_follow_the_plain_patterns():
    text = 'Token = "abc" secret:xy password=hunter22 token=token: abcdefgh API-KEY: "AKIA' + "A" * 16 + '" ' + "ab12" * 6 + " \u017fecret=longenough"
    assign = [("assign", m.start(), m.end()) for m in re.finditer(secret_scan.ASSIGN.pattern, text, re.I | re.A) if len(m[2]) >= 6]
    got = secret_scan.find_secrets(text)
    assert [x for x in got if x[0] == "assign"] == assign and len(assign) == 1
    assert [x[0] for x in got] == ["assign", "access", "hex"]
    assert secret_scan.find_secrets(None) == [] == secret_scan.find_secrets("")


def test_structure_decides():
    der = bytes([0x30, 0x30, 2, 1, 0, 4, 0x2B]) + bytes(range(43))
    pem = "-----BEGIN PRIVATE KEY-----\n" + base64.b64encode(der).decode() + "\n-----END PRIVATE KEY-----"
    assert [x[0] for x in secret_scan.find_secrets(pem)] == ["pem", "der"]
    assert not any(x[0] == "der" for x in secret_scan.find_secrets(base64.b64encode(der[:-1]).decode() + "AA"))
    ssh = b"\0\0\0\x0bssh-ed25519\0\0\0\x20" + bytes(32)
    assert [x[0] for x in secret_scan.find_secrets(base64.b64encode(ssh).decode())] == ["ssh"]
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    assert any(x[0] == "signed" for x in secret_scan.find_secrets(f"{part({'alg': 'none'})}.{part({'a': 1})}.c2ln"))
    assert not any(x[0] == "signed" for x in secret_scan.find_secrets(f"{part({'x': 'y'})}.{part({'a': 1})}.c2ln"))


def test_secrets_query_counts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in Q.op7_secret_scan(spark, DATA).collect()}
    for r in docs:
        assert got[r["doc_id"]]["n_hex"] == sum(len(m) >= 24 for m in re.findall("[0-9a-f]+", r["text"]))
        assert got[r["doc_id"]]["n_access"] == sum(len(m) >= 20 for m in re.findall("AKIA[A-Z0-9]+", r["text"]))


def test_redact(spark):
    frame = spark.createDataFrame([("a password=hunter22 b",), (None,)], "text string")
    assert [r["text"] for r in secret_scan.redact(frame).collect()] == ["a [secret] b", None]


def test_fold():
    assert toxicity.fold("You 1d10t! Id!ot іdіоt réeux??? 2021 wow!!") == "you idiot idiot idiot reeux 2021 wow"
    assert toxicity.fold(None) == ""


def test_toxicity_held_out(spark):
    got = Q.op8_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out")
    hit, said, true = got.selectExpr("count_if(predicted = 1 and toxic = 1)", "count_if(predicted = 1)", "count_if(toxic = 1)").first()
    assert hit / said > 0.9 and hit / true > 0.9
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_without_labels(spark):
    frame = spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id long, text string, toxic int")
    lexicon = toxicity.fit_lexicon(frame)
    assert lexicon.weights == {}
    assert toxicity.score_toxicity(frame, lexicon).filter("toxicity between 0 and 1").count() == 2


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = Q.op10_quality(spark, DATA).join(labels, "doc_id").filter("held_out")
    assert got.select(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.9


def test_quality_grades_are_ordered(spark):
    rows = [(k, ("good words here " * 9, "plain text 12 ", "### $$$ !!! ")[k % 3] * (k % 5 + 2), (2, 1, 0)[k % 3]) for k in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rating int")
    model = quality.fit_quality(frame, rating_col="rating")
    assert model.grades == [0.0, 1.0, 2.0] and model.thresholds[0] <= model.thresholds[1]
    got = quality.score_quality(frame, model, tail_from=1.0).groupBy("rating").agg(F.avg("quality.expected").alias("e")).orderBy("rating").collect()
    assert got[0]["e"] < got[1]["e"] < got[2]["e"]
    none = quality.fit_quality(frame.limit(0), rating_col="rating")
    assert quality.score_quality(frame, none, tail_from=1.0).filter("quality.expected is null").count() == 120


def mixed(frame):
    found = mixing.mix_sources(frame, (5.0, 2.0, 1.0), 3.0)
    return found.select(*frame.columns, *[F.col(f"mix.{c}").alias(f"_{c}") for c in ("size", "target", "taken")])


def test_mixing_fills_like_water(spark):
    rows = [(k, " ".join(["w"] * (k % 7)), s) for k in range(600) for s in ("b", "a", "é", None) if k % {"b": 1, "a": 3, "é": 50, None: 2}[s] == 0]
    frame = spark.createDataFrame([*rows, (None, None, "a"), (None, None, "a")], "doc_id long, text string, source string")
    got = mixed(frame).toPandas()
    assert len(got) == len(rows) + 2
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("a", "b", "é", None)}
    left, open_, want = float(sum(sizes.values())), dict(zip(("a", "b", "é", None), (5, 2, 1, 5), strict=True)), {}
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if 3 * sizes[s] <= level * w]
        if not full:
            want |= {s: level * w for s, w in open_.items()}
            break
        for s in full:
            want[s] = 3 * sizes[s]
            left -= want[s]
            del open_[s]
    for s, part in got.groupby(got["source"].fillna("-")):
        key = None if s == "-" else s
        assert part["_target"].iloc[0] == pytest.approx(want[key])
        assert abs(part["_taken"].sum() - want[key]) <= 1
    assert (got["_taken"] <= 3 * got["_size"]).all()
    again = mixed(frame.repartition(5)).toPandas()
    assert sorted(map(str, again[["doc_id", "source", "_taken"]].values.tolist())) == sorted(map(str, got[["doc_id", "source", "_taken"]].values.tolist()))
    assert mixed(frame.limit(0)).count() == 0


def test_url_parts_and_rules(spark):
    urls = ["https://WWW.Example.com/en/1?q#f", "http://example.com", "example.com/en/", None, "x://a.net/es/b#c", "x://badexample.com/en/", "y://?q", "z://example.com:8/en/"]
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    got = [tuple(r["judged"][c] for c in ("host", "path", "rule", "verdict")) for r in url_filter.judge_urls(frame, Q.URL_RULES).orderBy("page_id").collect()]
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[1][:3] == ("example.com", "", None)
    assert got[2][:3] == got[3][:3] == ("", "", None)
    assert got[4] == ("a.net", "/es/b", "net/es/", "block")
    assert got[5][2] == "com/" and got[6][:2] == ("", "") and got[7][:3] == ("example.com:8", "/en/", None)
    assert all(v in ("allow", "block") for *_, v in got)
    assert url_filter.judge_urls(frame.limit(0), Q.URL_RULES).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < got.count() <= docs.count()
    assert got.join(docs, "doc_id", "left_anti").count() == 0
