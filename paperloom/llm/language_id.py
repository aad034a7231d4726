"""Language identification: words first, then ever shorter character n-grams for unseen words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, checkpoint, free_name

#: Runs of letters and of the few signs that Python's \\w has besides letters and digits, such as fractions.
RUNS = re.compile(r"[^\W\d_]+")
LETTERS = regex.compile(r"\p{L}+")
#: Grams of these lengths, the longest first, over words with a blank at either end.
GRAMS = (5, 4, 3, 2, 1)


@dataclass
class LanguageModel:
    """Log frequencies: a row per word or n-gram, a column per language of ``langs``."""

    langs: list[str]
    words: list[str]
    word_logs: np.ndarray
    grams: list[str]
    gram_logs: np.ndarray


def letter_words(text: str | None) -> Counter[str]:
    """The runs of letters of a text in lower case, with their counts."""
    found = Counter(RUNS.findall((text or "").lower()))
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        for part in LETTERS.findall(w):
            found[part] += n
    return found


class Scorer:
    """The model, ready to look up; made once in a task."""

    def __init__(self, langs, words, word_logs, grams, gram_logs):
        self.langs, self.gram_logs = langs, gram_logs
        self.row = {w: k for k, w in enumerate(words)}
        self.gram = {g: k for k, g in enumerate(grams)}
        self.unseen: dict[str, list[int]] = {}
        self.logs = np.vstack([word_logs, np.zeros((1, len(langs)), np.float32)])

    def grams_of(self, word: str) -> list[int]:
        """The word's longest known n-grams; none, if not even a letter is known."""
        rows = self.unseen.get(word)
        if rows is None:
            padded, rows = f" {word} ", []
            for n in GRAMS:
                rows = [k for k in map(self.gram.get, [padded[i : i + n] for i in range(len(padded) - n + 1)]) if k is not None]
                if rows:
                    break
            if len(self.unseen) > 100_000:
                self.unseen.clear()
            if len(word) <= 64:  # longer ones hardly recur
                self.unseen[word] = rows
        return rows

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the posterior; ("und", 0.0) for a text without letters."""
        found = letter_words(text)
        if not found or not self.langs:
            return "und", 0.0
        rows = np.fromiter(map(self.row.get, found, repeat(-1)), np.int64, len(found))
        times = np.fromiter(found.values(), np.float64, len(found))
        total = times @ self.logs[rows]
        grams, shares = [], []
        unseen = np.flatnonzero(rows < 0)
        if len(unseen):
            distinct = list(found)
            for k in unseen.tolist():  # a word counts once, by the mean of its n-grams
                if of := self.grams_of(distinct[k]):
                    grams += of
                    shares += [times[k] / len(of)] * len(of)
        if grams:
            total = total + np.array(shares) @ self.gram_logs[grams]
        # Words aren't independent; the evidence of a long text is damped.
        p = np.exp((total - total.max()) / max(1.0, times.sum() / 20))
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def fit_language_model(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    key: tuple[str, ...] = ("doc_id",),
    max_docs: int = 12_000,
    seed: int = 5,
) -> LanguageModel:
    """Word and n-gram log frequencies from a bounded sample of ``max_docs`` labelled rows.

    The sample is the only bound; it bounds the model, which every task gets. All its words and n-grams count, in every
    language, those seen once included. Null labels and texts are passed over, repeated rows count as often as they occur,
    and rows equal in ``key`` and text are in the sample together or not at all. Without labelled rows no language is known.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample = bounded_sample(labelled, [*key, text_col], max_docs, seed)
    letters = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(\p{L}+)"), F.lit(1))
    counts = sample.select(F.col(lang_col).alias("lang"), F.explode_outer(letters).alias("word")).filter("word is not null").groupBy("lang", "word").count()
    counts = checkpoint(counts)
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    # A match takes one letter and looks ahead, so a long word takes time in proportion.
    cut = [F.when(F.length("p") < n, F.array("p")).otherwise(F.regexp_extract_all("p", F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))) for n in GRAMS]
    grams = counts.select("lang", "count", padded.alias("p")).select("lang", "count", F.explode_outer(F.concat(*cut)).alias("gram"))
    grams = checkpoint(grams.groupBy("lang", "gram").agg(F.sum("count").alias("count")))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    return LanguageModel(langs, *_logs(counts, "word", langs), *_logs(grams, "gram", langs))


def _logs(counts: DataFrame, name: str, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """The names, and their centred log frequencies; n-grams have frequencies among those of their length.

    Spark lays the languages side by side, and what reaches the driver is Arrow columns, a row for each name.
    """
    side = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("count"))), F.lit(0)).cast("float").alias(f"c{k}") for k, lang in enumerate(langs)]
    if not side:
        return [], np.zeros((0, 0), np.float32)
    got = counts.groupBy(name).agg(*side).toArrow()
    names = got.column(0).to_pylist()
    wide = np.column_stack([c.to_numpy() for c in got.columns[1:]]).astype(np.float64) + 0.5
    kinds = np.fromiter(map(len, names), np.int64, len(names)) if name == "gram" else np.zeros(len(names), np.int64)
    for kind in np.unique(kinds):
        wide[kinds == kind] /= wide[kinds == kind].sum(axis=0)
    logs = np.log(wide)
    return names, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """Adds ``out``, struct<lang, score>, to every row.

    Texts that are null, empty or hold no letter get ("und", 0); of languages with equal scores, the first by code point.
    Whole texts count, however long. Each row is read by itself, so repeated rows get equal results and an empty table stays
    empty. The columns of ``docs`` stay; if one is called ``out``, the new one gets an underscore more.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.word_logs, model.grams, model.gram_logs))

    @F.pandas_udf("lang string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*shared.value)
        for texts in batches:
            yield pd.DataFrame([scorer.predict(x) for x in texts], columns=["lang", "score"])

    # Else Spark would push a caller's filter on the result below this column, and read each text twice, in two Python workers a core.
    return docs.withColumn(free_name(docs, out), of.asNondeterministic()(F.col(text_col)))
