"""Audit of filters and of the orders they can be applied in, by decision diagrams weighted with counts.

A document's failures are a mask of bits, one for each filter. Spark counts the masks of each part, so that a part is at most
2^k rows for k filters, however many documents it has; from these a diagram is built, whose variables then move through all orders
by exchanging adjacent levels. The path on which every filter is passed gives what each step removes and keeps.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, words

#: More filters have too many orders for one row each.
MOST_FILTERS = 7


class Diagram:
    """A decision diagram of failure masks with a level for each filter. Nodes are numbers; nodes with equal children are one.

    A node has a child for documents that pass its level's filter and one for those that fail it; leaves hold counts. ``total``
    has the sum of counts below each node, by one path to each leaf.
    """

    def __init__(self, counts: Mapping[int, tuple[int, ...]], filters: int, width: int):
        self.order = list(range(filters))
        self.children: list[tuple[int, int] | None] = []
        self.total: list[np.ndarray] = []
        self._known: dict = {}

        def build(level: int, mask: int) -> int:
            if level == filters:
                return self._leaf(counts.get(mask, (0,) * width))
            return self._node(build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _new(self, key: tuple, children: tuple[int, int] | None, total: np.ndarray) -> int:
        if key not in self._known:
            self._known[key] = len(self.total)
            self.children.append(children)
            self.total.append(total)
        return self._known[key]

    def _leaf(self, counts: tuple[int, ...]) -> int:
        return self._new(("leaf", counts), None, np.array(counts, np.int64))

    def _node(self, passed: int, failed: int) -> int:
        return self._new((passed, failed), (passed, failed), self.total[passed] + self.total[failed])

    def swap(self, level: int) -> None:
        """Exchanges the filters of a level and the next one: nodes of these two levels are built anew, those below stay."""
        done: dict[int, int] = {}

        def of(node: int, depth: int) -> int:
            if node not in done:
                passed, failed = self.children[node]
                if depth == level:
                    (pp, pf), (fp, ff) = self.children[passed], self.children[failed]
                    done[node] = self._node(self._node(pp, fp), self._node(pf, ff))
                else:
                    done[node] = self._node(of(passed, depth + 1), of(failed, depth + 1))
            return done[node]

        self.root = of(self.root, 0)
        self.order[level : level + 2] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(filter, counts it removes, counts kept after it), along the path on which all filters are passed."""
        node = self.root
        for at in self.order:
            node, failed = self.children[node]
            yield at, self.total[failed], self.total[node]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to exchange with the next one, one after the other, so that each order of n filters comes up once."""
    if n < 2:
        return
    inner, down = adjacent_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        level = next(inner, None)
        if level is None:
            return
        yield level + down
        down = not down


def _audit(filters: int, width: int, rows: pd.DataFrame) -> pd.DataFrame:
    """A row for each order and step of one part, from its rows (mask, c0, c1, ...)."""
    counts = {int(r[0]): tuple(map(int, r[1:])) for r in rows[["mask", *(f"c{k}" for k in range(width))]].itertuples(index=False)}
    diagram = Diagram(counts, filters, width)
    found = [(tuple(diagram.order), list(diagram.steps()))]
    for level in adjacent_swaps(filters):
        diagram.swap(level)
        found.append((tuple(diagram.order), list(diagram.steps())))
    first, last, shapley = {}, {}, dict.fromkeys(range(filters), 0)
    for order, steps in found:
        first[order[0]], last[order[-1]] = int(steps[0][1][0]), int(steps[-1][1][0])
        for at, removed, _ in steps:
            shapley[at] += int(removed[0])
    out = [
        ([*order], k + 1, at, int(kept[0]), int(removed[0]), first[at] - int(removed[0]), last[at], shapley[at], removed[1:].tolist())
        for order, steps in found
        for k, (at, removed, kept) in enumerate(steps)
    ]
    return pd.DataFrame(out, columns=["filters", "step", "filter", "kept", "removed", "redundant", "unique_fails", "shapley", "lost"])


def audit_filters(rows: DataFrame, fails: Mapping[str, Column], part: Column, marks: Mapping[str, Column] | None = None, times: Column | None = None) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, shapley, lost_<mark>...): a row for each part, order and step.

    ``fails`` has a condition for each filter, null counting as passed; ``marks`` has conditions that documents are counted by where they
    are removed; ``times`` is how many documents a row stands for. redundant are documents that fail the step's filter and were removed
    before, unique_fails those that fail no other, shapley the filter's removals summed over all orders. Null is a part of its own.
    Rows are counted by part and mask before anything is gathered, so neither a large part nor copies make a large task. An empty table gives
    no rows; further columns are ignored.
    """
    names, marks = list(fails), dict(marks or {})
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"an audit takes 1 to {MOST_FILTERS} filters")
    mask = reduce(lambda a, b: a + b, [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails.values())])
    n = F.lit(1).cast("long") if times is None else times.cast("long")
    counted = [F.sum(n).alias("c0"), *[F.sum(F.when(c, n).otherwise(0)).alias(f"c{k + 1}") for k, c in enumerate(marks.values())]]
    counts = rows.groupBy(part.alias("part"), mask.cast("int").alias("mask")).agg(*counted)
    kind = dict(counts.dtypes)["part"]
    filters, width = len(names), len(counted)

    def of(key: tuple, part_rows: pd.DataFrame) -> pd.DataFrame:
        found = _audit(filters, width, part_rows)
        found.insert(0, "part", pd.Series([key[0]] * len(found), dtype=part_rows["part"].dtype))
        return found

    columns = "filters array<int>, step int, filter int, kept long, removed long, redundant long, unique_fails long, shapley long, lost array<long>"
    found = counts.groupBy("part").applyInPandas(of, f"part {kind}, {columns}")
    name = F.array(*map(F.lit, names))
    return found.select(
        "part",
        F.array_join(F.transform("filters", lambda k: F.get(name, k)), "").alias("filter_order"),
        "step",
        F.get(name, F.col("filter")).alias("filter"),
        *("kept", "removed", "redundant", "unique_fails", "shapley"),
        *[F.get("lost", F.lit(k)).alias(f"lost_{m}") for k, m in enumerate(marks)],
    )


def document_failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, quality, toxic, n): how many documents of a part fail which of five filters and have which labels.

    A: under 200 words; B: distinct words are less than half of the words; C: over 2 % of the characters are A-Z; D: holds one of
    ``#$%&*|``; E: a row with a smaller id has the same text. A null text counts as empty, a null part as the empty string. A null id is neither
    smaller nor greater than another and has no label; of several labels of an id any counts. Equal texts are those that agree in two hashes
    of 64 bits.

    Copies are counted by id, then by text, part and labels, before the smallest ids meet, so no task gets a text's copies as rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("id", "part", "t", words(F.col("t")).alias("w"))
    capitals = F.length(F.regexp_replace("t", "[^A-Z]+", ""))
    rows = rows.select(
        *("id", "part", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g")),
        (F.size("w") < 200).alias("A"),
        (100 * F.size(F.array_distinct("w")) < 50 * F.size("w")).alias("B"),
        (100 * capitals.cast("long") > 2 * F.length("t").cast("long")).alias("C"),
        F.col("t").rlike("[#$%&*|]").alias("D"),
    )
    kinds = ["part", "h", "g", "A", "B", "C", "D"]
    rows = rows.groupBy("id", *kinds).agg(F.count("*").alias("n"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marked = labels.filter("quality = 1 or toxic = 1").groupBy(F.col(id_col).alias("id")).agg(is_one("quality"), is_one("toxic"))
    rows = rows.join(marked, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("quality", "toxic")})
    # One row for each text, part and labels: the number of its documents, and the smallest id with how many rows have it.
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    texts = rows.groupBy(*kinds, "quality", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), least.alias("least"))
    texts = checkpoint(texts)
    first = texts.groupBy("h", "g").agg(F.min("least.id").alias("first"))
    texts = texts.join(first, ["h", "g"])
    passed = F.col("nameless") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.lit(False).alias("E"), passed.alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - passed).alias("n"))))
    counted = texts.select("part", "A", "B", "C", "D", "quality", "toxic", split.alias("x")).filter("x.n > 0")
    return counted.groupBy("part", "A", "B", "C", "D", "x.E", "quality", "toxic").agg(F.sum("x.n").alias("n"))
