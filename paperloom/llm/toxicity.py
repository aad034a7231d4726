"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

The lexicon is learned from labelled rows: whole words and word beginnings that toxic documents hold far more often
than clean ones, weighted by log odds; and exception phrases, two words around a term that clean documents hold as often.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, checkpoint, free_name

#: Characters of other scripts and digits or signs that stand for Latin letters.
HOMOGLYPHS = str.maketrans("авеёзікмнорстухѕјԁοαερτυνικβγ", "abeeзikmhopctyxsjdoaeptuvikby")
DIGITS = str.maketrans("013457@$!|", "oieastasil")
#: Punctuation becomes a blank, accents go, and look-alike letters become Latin.
PLAIN = HOMOGLYPHS | dict.fromkeys(map(ord, "\t\n\r\x0b\x0c\"#%&'()*+,-./:;<=>?[\\]^_`{}~«»“”„‘’‚–—…¿¡·•"), " ") | dict.fromkeys(range(0x300, 0x370))
#: Signs that end a word aren't letters; a word with letters may hold digits and signs in their place.
ENDING = re.compile(r"[@$!|]+(?=\s|$)")
MASKED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])\S*[013457@$!|]\S*")
SIGNS = frozenset("013457@$!|")
STEMS = (4, 5, 6, 7, 8)


def fold(text: str | None) -> str:
    """The words of a text in lower case, between single blanks, without accents, look-alike letters and masking digits."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    text = text.translate(PLAIN)
    if not SIGNS.isdisjoint(text):
        text = MASKED.sub(lambda m: m[0].translate(DIGITS), ENDING.sub(" ", text))
    return " ".join(text.split())


def terms_of(text: str | None) -> list[str]:
    """Every distinct whole word (" word ") and word beginning (" word") of a text."""
    out = set()
    for w in set(fold(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in STEMS if len(w) > n)
    return list(out)


@dataclass
class Lexicon:
    """Weighted terms, phrases that excuse a term, and the line from a text's two features to its score."""

    weights: dict[str, float]
    phrases: list[str]
    line: tuple[float, float, float]


class Matcher:
    """The lexicon's automaton; made once in a task."""

    def __init__(self, weights: dict[str, float], phrases: list[str], line: tuple[float, float, float]):
        self.line = line
        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (weight, len(term.strip())))
        for phrase in phrases:
            self.automaton.add_word(f" {phrase} ", (None, len(phrase)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def find(self, folded: str) -> tuple[float, int]:
        """The sum of the weights of the matched words, each word by its heaviest term, and how many there are."""
        if not len(self.automaton):
            return 0.0, 0
        joined = f" {folded} "
        hits: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (weight, size) in self.automaton.iter(joined):
            start = end - size if joined[end] == " " else end - size + 1
            if weight is None:
                excused.append((start, end))
            else:
                hits[start] = max(hits.get(start, 0.0), weight)
        for a, b in excused:
            for k in [k for k in hits if a <= k < b]:
                del hits[k]
        return sum(hits.values()), len(hits)

    def features(self, text: str | None) -> tuple[float, float]:
        """The summed weight, damped, over the damped length in words, and the plain one over the length's square root."""
        folded = fold(text)
        total, _ = self.find(folded)
        length = max(folded.count(" ") + 1, 16)
        return math.log1p(total) / math.log1p(length), total / math.sqrt(length)

    def score(self, text: str | None) -> float:
        a, b, c = self.line
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b * y + c))))


def fit_lexicon(
    labelled: DataFrame,
    text_col: str = "text",
    label_col: str = "toxic",
    key: tuple[str, ...] = ("doc_id",),
    max_docs: int = 12_000,
    min_docs: int = 4,
    precision: float = 0.5,
    seed: int = 8,
) -> Lexicon:
    """A lexicon from a bounded sample of ``max_docs`` labelled rows.

    Terms are kept if ``min_docs`` toxic documents hold them, and if of the documents with the term a share of
    ``precision`` is toxic; a word beginning stands for the longer terms that it covers. The sample is the only bound; it bounds
    the terms that reach the driver. Null labels are passed over, a null text counts as empty, repeated rows count as often as
    they occur. Without labelled rows, or without toxic ones, no term has a weight.
    """
    rows = labelled.filter(F.col(label_col).isNotNull()).select(*key, text_col, (F.col(label_col) == 1).cast("int").alias("y"))
    sample = checkpoint(bounded_sample(rows, [*key, text_col], max_docs, seed))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    terms = F.pandas_udf(lambda texts: pd.Series([terms_of(x) for x in texts]), "array<string>")
    counts = sample.select("y", F.explode_outer(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    kept = counts.filter((F.col("bad") >= min_docs) & (F.col("bad") >= precision * (F.col("bad") + F.col("good"))))
    weights: dict[str, float] = {}
    for r in kept.orderBy(F.desc("bad"), F.length("term"), "term").toPandas().itertuples():
        if not any(r.term[:n] in weights for n in range(2, len(r.term))):
            weights[r.term] = math.log((r.bad + 0.5) / (bad - r.bad + 0.5)) - math.log((r.good + 0.5) / (good - r.good + 0.5))
    weights = {k: v for k, v in weights.items() if v > 0}
    phrases = _exceptions(sample, text_col, weights, min_docs)
    return Lexicon(weights, phrases, _calibrate(sample, text_col, Lexicon(weights, phrases, (0.0, 0.0, 0.0))))


def _shared(df: DataFrame, lexicon: Lexicon):
    return df.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.phrases, lexicon.line))


def _exceptions(sample: DataFrame, text_col: str, weights: dict[str, float], min_docs: int) -> list[str]:
    """Pairs of neighbouring words, one of them a term, that are found in ``min_docs`` clean documents and rarely in toxic ones."""
    shared = _shared(sample, Lexicon(weights, [], (0.0, 0.0, 0.0)))

    @F.pandas_udf("array<string>")
    def pairs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(*shared.value)
        for texts in batches:
            out = []
            for x in texts:
                found = fold(x).split()
                bad = {w for w in set(found) if matcher.find(w)[1]}
                hit = [w in bad for w in found]
                out.append(sorted({f"{found[k]} {found[k + 1]}" for k in range(len(found) - 1) if hit[k] or hit[k + 1]}))
            yield pd.Series(out)

    counts = sample.select("y", F.explode_outer(pairs(F.col(text_col))).alias("pair")).groupBy("pair").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    kept = counts.filter("pair is not null").filter((F.col("good") >= min_docs) & (F.col("bad") * 4 < F.col("good")))
    return [r["pair"] for r in kept.orderBy("pair").select("pair").collect()]


def _calibrate(sample: DataFrame, text_col: str, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic regression of the labels on the two features, by Newton steps over three sums."""
    shared = _shared(sample, lexicon)

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(*shared.value)
        for texts in batches:
            yield pd.Series([list(matcher.features(x)) for x in texts])

    found = sample.select("y", of(F.col(text_col)).alias("f")).toPandas()
    if found.empty:
        return 0.0, 0.0, -2.0
    x = np.column_stack([np.vstack(found["f"].to_numpy()), np.ones(len(found))])
    y = found["y"].to_numpy(float)
    w = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w += np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return tuple(float(v) for v in w)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds ``out``, the score from 0 to 1 of each whole text.

    Null and empty texts get the score of a text without matches. Each row is read by itself, so repeated rows get equal scores
    and an empty table stays empty. The columns of ``docs`` stay; if one is called ``out``, the new one gets an underscore more.
    """
    shared = _shared(docs, lexicon)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(*shared.value)
        for texts in batches:
            yield pd.Series([matcher.score(x) for x in texts], dtype=float)

    return docs.withColumn(free_name(docs, out), of(F.col(text_col)))
