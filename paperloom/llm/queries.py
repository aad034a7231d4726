"""The registered queries of the training-data operators, thin layers over the operators themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import code_compression, decontaminate, embedding_dedup, filter_audit, language_id, line_dedup, mixing, quality, secret_scan, sharding, simhash_dedup, toxicity, url_filter
from .common import bounded_sample, checkpoint, held_out, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, repeated rows included. Null, empty and blank texts have fingerprint zero and are linked like any other;
    a null doc_id gets the smallest id of its group, or null.
    """
    found = simhash_dedup.simhash_near_dups(table(spark, sf_dir, "documents"), size=3, bits=64, tables=1, distance=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.col("sketch")[0]), 16, "0")).alias("fingerprint"), "component_id")


#: (verdict, host and path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page, repeated ones included. A null URL has an empty host and path, fits no rule and is judged by its features."""
    found = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return found.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", F.col("judged.blocked").alias("blocked_probability"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document. A null text has no line and stays null (its digest is null), an empty one has one line; documents equal
    in id and text get equal results, nulls come last in the order of ids.
    """
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=6, exact_words=1)
    return found.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_kept").cast("long").alias("n_kept"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


#: Lines are numbered by document and place, so numbers order them as the operator does. Exact repeats of every line that
#: isn't blank go; near ones within a word go from six words on.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS k FROM d),
w AS (SELECT doc_id, raw, k, doc_id::HUGEINT * 1000000 + k AS id, regexp_extract_all(raw, '[^\x20\x09-\x0D]+') AS ws FROM l),
f AS (SELECT ws, min(id) AS id FROM w WHERE len(ws) >= 1 GROUP BY ws),
g AS (SELECT id, ws, unnest(range(1, len(ws) + 1)) AS j FROM f WHERE len(ws) >= 6),
gap AS (SELECT id, ws[1:j-1] || [chr(10)] || ws[j+1:] AS holed, ws[1:j-1] || ws[j+1:] AS less FROM g),
a AS (SELECT id, min(id) OVER (PARTITION BY holed) AS first FROM gap),
b AS (SELECT greatest(gap.id, f.id) AS id FROM gap JOIN f ON f.ws = gap.less WHERE len(f.ws) >= 6),
gone AS (SELECT id FROM a WHERE id > first UNION SELECT id FROM b),
s AS (SELECT w.*, len(w.ws) < 1 OR (f.id IS NOT NULL AND gone.id IS NULL) AS stays FROM w LEFT JOIN f ON f.id = w.id LEFT JOIN gone ON gone.id = w.id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (stays) AS n_kept,
       md5(coalesce(string_agg(raw, chr(10) ORDER BY k) FILTER (stays), '')) AS text_md5
FROM s GROUP BY doc_id
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and item of which a window is similar enough. Null and empty texts and items match nothing; rows equal in id
    and text count once; of equal windows the first counts.
    """
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc.id").alias("doc_id"), "item_id", "start_word", "n_words", "similarity")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, repeated ones included. Null texts, and texts without a letter, are und with score 0; a null doc_id counts
    as held out; of languages with equal scores the first by code point counts.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = language_id.fit_language_model(docs.filter("not held_out"))
    found = language_id.predict_language(docs, model)
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per vector, repeated ones included. Null labels, and vectors that are null, zero or not finite, link with nothing."""
    return embedding_dedup.embedding_near_dups(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, repeated ones included. A null text counts as empty: no findings, and the digest of an empty text."""
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = listed(F.filter("secrets", lambda x: x["kind"].isin("assign", "access", "hex")))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def _with_labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """Documents with their labels. A held-out document gets none. At most 40,000 labelled rows, so they are broadcast."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", column)
    labels = bounded_sample(labels, ["doc_id"], 40_000, 3)
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(labels), "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, repeated ones included. Null and empty texts get the score of a text without matches; labels that are null
    aren't learned from; a null doc_id counts as held out.
    """
    lexicon = toxicity.fit_lexicon(_with_labels(spark, sf_dir, "toxic"))
    found = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), lexicon)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, repeated ones included, which share the words on an edge evenly. Null and empty texts have size 0 and take 0;
    a null source is a source of its own, the last.
    """
    found = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), (5.0, 2.0, 1.0), 3.0)
    return found.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, repeated ones included. A null text counts as empty; ratings that are null aren't learned from; without two
    grades to learn from all documents get the same result.
    """
    model = quality.fit_quality(_with_labels(spark, sf_dir, "quality"))
    found = quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), model, tail_from=1.0)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality.expected").alias("expected_grade"), F.col("quality.tail").alias("tail_probability"), (F.col("quality.tail") >= 0.5).alias("kept"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per source, order of the five filters and step. Null texts count as empty, a null source as the empty string; rows equal in id and text
    repeat no smaller id, so filter E passes them; an empty table has no source, and so no row.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = filter_audit.document_failures(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), labels)
    found = filter_audit.audit_filters(rows, {c: F.col(c) for c in "ABCDE"}, F.col("part"), {"good": F.col("quality"), "toxic": F.col("toxic")}, F.col("n"))
    counts = ("kept", "removed", "redundant", "unique_fails")
    return found.select("part", "filter_order", "step", *counts, F.col("lost_good").alias("good_lost"), F.col("lost_toxic").alias("toxic_lost"), "shapley")


OP11_SQL = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
                    regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS fails,
             coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY ALL),
v AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM v a, v b, v c, v d, v e
      WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT ks, unnest([1, 2, 3, 4, 5]) AS step FROM o),
r AS (SELECT part, ks, step, ks[step] AS k, n, n_good, n_toxic, fails[ks[step]] AS fail,
             len(list_filter(ks[1:step-1], lambda x: fails[x])) > 0 AS before, len(list_filter(fails, lambda x: x)) AS n_fails
      FROM m, s),
q AS (SELECT part, ks, step, k, sum(n) FILTER (NOT fail AND NOT before) AS kept, sum(n) FILTER (fail AND NOT before) AS removed,
             sum(n) FILTER (fail AND before) AS redundant, sum(n) FILTER (fail AND n_fails = 1) AS unique_fails,
             sum(n_good) FILTER (fail AND NOT before) AS good_lost, sum(n_toxic) FILTER (fail AND NOT before) AS toxic_lost
      FROM r GROUP BY ALL),
z AS (SELECT part, list_aggregate(list_transform(ks, lambda x: chr(64 + x)), 'string_agg', '') AS filter_order, step, k,
             coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
             coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost FROM q)
SELECT * EXCLUDE (k), (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM z
"""


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document, repeated ones included. A null text has no bytes, and so the checksum of none; equal texts, whatever their ids, share a shard.
    The law kept is ``bytes``, so grown_shard is null.
    """
    found = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8, keep=["doc_id"])
    return found.select("doc_id", "placed.size", "placed.text_crc32", F.lit("bytes").alias("law"), "placed.shard", "placed.slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per vector that is there and holds finite components only, repeated ones included. Vectors without an id are the last to start a codebook;
    null labels count as equal; an empty table has no rows.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = code_compression.fit_codebooks(vectors)
    found = code_compression.encode_vectors(vectors, books)
    found = checkpoint(found.select("vec_id", "label", F.col("encoded.code").alias("code"), F.col("encoded.error").alias("error")))
    found = code_compression.with_label_error(found, F.col("label"), F.col("error"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _op13_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """One assignment after the other, each of all parts to all entries."""
    steps = ""
    for k in range(rounds + 1):
        steps += f"""
c{k} AS (SELECT x.r, x.p, b.e, list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{k} b ON b.p = x.p),
n{k} AS (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM c{k} GROUP BY r, p),"""
        if k < rounds:
            steps += f"""
u{k} AS (SELECT n.p, n.e, g.i, floor(sum(x.x[g.i]) / count(*)::DOUBLE)::BIGINT AS v
        FROM n{k} n JOIN x ON x.r = n.r AND x.p = n.p, w, unnest(range(1, w.n + 1)) AS g(i) GROUP BY ALL),
l{k} AS (SELECT p, e, list(v ORDER BY i) AS x FROM u{k} GROUP BY p, e),
b{k + 1} AS (SELECT b.p, b.e, coalesce(l.x, b.x) AS x FROM b{k} b LEFT JOIN l{k} l ON l.p = b.p AND l.e = b.e),"""
    return f"""
WITH v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r,
                  list_transform(embedding, lambda z: floor(z::DOUBLE * 256)::BIGINT) AS x
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
w AS (SELECT max(len(x)) // {parts} AS n FROM v),
x AS (SELECT r, p.p, v.x[p.p * w.n + 1 : (p.p + 1) * w.n] AS x FROM v, w, unnest(range({parts})) AS p(p)),
b0 AS (SELECT p, r - 1 AS e, x FROM x WHERE r <= {entries}),{steps}
s AS (SELECT sha256(coalesce(string_agg(array_to_string(x, ','), ',' ORDER BY p, e), '')) AS codebooks_sha256 FROM b{rounds}),
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM n{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (r), s
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_toxicity": op8_toxicity,
    "op9_source_mixing": op9_source_mixing,
    "op10_quality": op10_quality,
    "op11_filter_audit": op11_filter_audit,
    "op12_sharding": op12_sharding,
    "op13_code_compression": op13_code_compression,
}
ORACLES: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op11_filter_audit": OP11_SQL, "op13_code_compression": _op13_sql()}
