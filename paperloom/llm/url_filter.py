"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest. DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, checkpoint, free_name, lower_ascii, sized

LEXICAL = ("length", "host_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters", "has_port")
#: What counts and blocked shares are taken of: the host's last label, the path's first segment, and both together.
SUFFIXES = ("suffix", "segment", "suffix_segment")
FEATURES = (*LEXICAL, *(f"{name}_{kind}" for name in SUFFIXES for kind in ("count", "blocked")))
#: Parts of the labelled URLs; a URL's blocked share of its suffix comes from the other parts, so no label tells itself.
FOLDS = 5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path. The host runs from the first :// to the next of / ? # and has A-Z in lower case; the path runs on to
    ? or #. Both are empty for null, or without ://."""
    whole = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(url, whole, 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(F.regexp_extract(url, whole, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does.

    A rule is (verdict, "host/path"): it fits its host and all subdomains, for paths that start with its own.
    """
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(what)).otherwise(verdict)
    return found, verdict


def lexical_features(df: DataFrame) -> DataFrame:
    """Adds the features of url, host and path that need no other row, and SUFFIXES."""
    url = F.coalesce("url", F.lit(""))
    chars = F.array_distinct(F.split(url, ""))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / F.length(url)
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return df.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "digit_ratio": F.length(F.regexp_replace(url, r"[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "entropy": F.when(F.length(url) > 0, entropy).otherwise(0.0),
            "parameters": F.when(F.locate("?", url) > 0, F.regexp_count(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(r"[^&=]+(?:=|&|\z)"))).otherwise(0).cast("double"),
            "has_port": F.col("host").rlike(r":\d+\z").cast("double"),
            "suffix": F.substring_index("host", ".", -1),
            "segment": F.regexp_extract("path", r"(?s)\A/([^/]*)", 1),
            "suffix_segment": F.concat(F.substring_index("host", ".", -1), F.regexp_extract("path", r"(?s)\A(/[^/]*)?", 0)),
        }
    )


def _shares(rows: DataFrame, name: str) -> DataFrame:
    """Rows (``name``, fold, label, ...) with its count, of all rows, and its blocked share, of the labelled rows of other folds."""
    part = rows.groupBy(name, "fold").agg(F.count("*").alias("n"), F.sum("label").alias("bad"), F.count("label").alias("known"))
    part = checkpoint(part.select(name, "fold", "n", F.coalesce("bad", F.lit(0.0)).alias("bad"), "known"))
    whole = part.groupBy(name).agg(F.sum("n").alias("all"), F.sum("bad").alias("all_bad"), F.sum("known").alias("all_known"))
    share = (F.col("all_bad") - F.col("bad") + 0.5) / (F.col("all_known") - F.col("known") + 1.0)
    part = part.join(whole, name).select(F.col(name).alias("_s"), F.col("fold").alias("_f"), F.log1p("all").alias(f"{name}_count"), share.alias(f"{name}_blocked"))
    return rows.join(sized(checkpoint(part)), (F.col(name) == F.col("_s")) & (F.col("fold") == F.col("_f"))).drop("_s", "_f")


def url_features(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """(row, url, host, path, rule, label, fold and FEATURES) of every row of ``pages``; label is 1 where a rule blocks, 0 where one allows.

    fold is -1 for URLs without a label; their share comes from all labelled ones.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.struct("*").alias("row"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    label = F.when(verdict == "block", 1.0).when(verdict == "allow", 0.0)
    fold = F.when(label.isNotNull(), F.pmod(F.xxhash64(F.lit(1), "url"), F.lit(FOLDS)).cast("int")).otherwise(-1)
    rows = lexical_features(rows.withColumns({"rule": rule, "label": label, "fold": fold}))
    for name in SUFFIXES:
        rows = _shares(rows, name)
    return rows


def fit_trees(labelled: DataFrame, trees: int = 10, depth: int = 4, seed: int = 2) -> GBTClassificationModel | None:
    """Boosted trees over FEATURES of rows with a label; None unless both labels occur."""
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    rows = checkpoint(gather.transform(labelled.select("label", *FEATURES)).select("features", "label"))
    if rows.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed).fit(rows)


def score_trees(rows: DataFrame, model: GBTClassificationModel | None) -> DataFrame:
    """Adds blocked, the trees' probability of a block; 0 without trees."""
    if model is None:
        return rows.withColumn("blocked", F.lit(0.0))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    return scored.withColumn("blocked", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    url_col: str = "url",
    max_labelled: int = 20_000,
    trees: int = 10,
    depth: int = 4,
    seed: int = 2,
    out: str = "judged",
) -> DataFrame:
    """Adds ``out`` to ``pages``: struct<host, path, rule, blocked, verdict>, blocked being the trees' probability.

    The verdict is the longest fitting rule's, else the trees': block from 0.5. The trees learn from the URLs that a
    rule decides, of which a bounded sample of ``max_labelled`` is taken; counts and blocked shares of
    suffixes come from all URLs, a labelled URL's share from the labels of the other ``FOLDS``. If the rules decide for only one
    verdict, or for none, the trees give 0.

    A null URL has an empty host and path and is judged by its features alone. Equal URLs get equal results, however often they
    are repeated; long ones count whole; an empty table gives an empty result. The columns of ``pages`` stay; if one is
    called ``out``, the new one gets an underscore more.
    """
    rows = url_features(pages, rules, url_col)
    labelled = bounded_sample(rows.filter("label is not null").select("url", "label", *FEATURES), ["url"], max_labelled, seed)
    rows = score_trees(rows, fit_trees(labelled, trees, depth, seed))
    verdict = F.coalesce(F.when(F.col("label") == 1, "block").when(F.col("label") == 0, "allow"), F.when(F.col("blocked") >= 0.5, "block").otherwise("allow"))
    return rows.select("row.*", F.struct("host", "path", "rule", "blocked", verdict.alias("verdict")).alias(free_name(pages, out)))
