"""Near-duplicate vectors: spherical k-means cells, and blocked cosine products within cells.

Cells that are too large are split again by centres of their own, level by level, so that the number of cells grows with the
table while no task fits more than a bounded sample or assigns more than a bounded part of a cell.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, sized


#: Vectors of a length from which on they are dealt to cells, and cells that a vector is in at most, on average, where the number of centres allows it.
HANDFUL, COPIES = 16, 3.0


def spherical_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k unit centres of unit rows; empty cells start anew from a random row."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        lost = norms < 1e-9
        sums[lost], norms[lost] = x[rng.choice(len(x), lost.sum())], 1.0
        c = sums / norms[:, None]
    return c


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each of n nodes' components, given links of indices."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root[a] == root[b]).all():
            break
    while (root != root[root]).any():
        root = root[root]
    return root


def _compare(threshold: float):
    """Of two blocks of a cell, or of one: by vector, how many it links to, and the smallest one it is connected to."""

    def of(key, rows: pd.DataFrame) -> pd.DataFrame:
        cell, left, right = key[-3:]
        rows = rows.sort_values("vec", ignore_index=True)
        x = np.array(rows["x"].tolist(), dtype=np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        cells, block = rows["cells"].tolist(), rows["block"].to_numpy()
        one, two = np.flatnonzero(block == left), np.flatnonzero(block == right)
        # A pair is counted in the first cell that both of its vectors are in.
        firsts = {}
        kinds = {c: n for n, c in enumerate(dict.fromkeys(map(tuple, cells)))}
        kind = np.array([kinds[tuple(c)] for c in cells])
        counts, links = np.zeros(len(rows), np.int64), []
        times = rows["times"].to_numpy()
        sets = [set(c) for c in kinds]
        for at in range(0, len(one), 512):
            part = one[at : at + 512]
            i, j = np.nonzero(x[part] @ x[two].T >= threshold)
            i, j = part[i], two[j]
            if left == right:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            code = kind[i] * len(kinds) + kind[j]
            for c in np.unique(code):
                if c not in firsts:
                    firsts[c] = min(sets[c // len(kinds)] & sets[c % len(kinds)]) == cell
            here = np.array([firsts[c] for c in code])
            i, j = i[here], j[here]
            np.add.at(counts, i, times[j])
            np.add.at(counts, j, times[i])
            root = _components(len(rows), i, j)
            links.append(np.column_stack([i, root[i]]))
            links.append(np.column_stack([j, root[j]]))
        if not links:
            return pd.DataFrame({"vec": [], "n": [], "root": []})
        pairs = np.concatenate(links)
        root = _components(len(rows), pairs[:, 0], pairs[:, 1])
        some = np.flatnonzero(counts)
        ids = rows["vec"].to_numpy()
        return pd.DataFrame({"vec": ids[some], "n": counts[some], "root": ids[root[some]]})

    return of


def _near(x: np.ndarray, c: np.ndarray, threshold: float, margin: float | None) -> np.ndarray:
    """Which centres each unit row is close to: the nearest one, and those less than the margin further."""
    if margin is None:
        margin = 4.5 * math.sqrt(2 - 2 * threshold) * math.sqrt(2) / math.sqrt(x.shape[1])
    near = x @ c.T
    return near >= near.max(axis=1)[:, None] - margin


def _units(xs: pd.Series) -> np.ndarray:
    x = np.array(xs.tolist(), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _split_cells(rows: DataFrame, threshold: float, margin: float | None, cell_rows: int, fan: int, max_fit: int, seed: int) -> DataFrame:
    """rows (rep, label, dim, vec, times, x) with ``cell``, a row for each cell that a vector is in; cells of a length begin with it.

    Vectors of a length are dealt to cells at any number, down to a handful: as many centres as a sample of ``max_fit`` has 16 vectors, ``fan`` at most,
    or the quarter of that, and so on, until a vector is in ``COPIES`` cells or fewer by the sample; two centres at the least. Cells that still have more
    than twice ``cell_rows`` vectors of a label are split further, if that, by the sample, at least halves the work, a copy of a vector
    being as much as ``cell_rows`` products; a cluster that is narrower than the margin isn't, and stays a cell.
    """
    rows = rows.withColumn("cell", F.col("dim").cast("string"))
    kinds = dict(rows.dtypes)

    def fit_first(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, k = _units(part["x"]), max(2, min(fan, len(part) // 16))
        while True:
            c = spherical_kmeans(x, k, seed)
            if k == 2 or _near(x, c, threshold, margin).sum(axis=1).mean() <= COPIES:
                return pd.DataFrame({"cell": [key[0]], "centres": [c.ravel()]})
            k = max(2, k // 4)

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = _units(part["x"])
        c = spherical_kmeans(x, max(1, min(fan, len(part) // 8)), seed)
        shares = _near(x, c, threshold, margin).mean(axis=0)
        cost = (shares**2).sum() + shares.sum() * cell_rows / part["most"].iloc[0]
        return pd.DataFrame({"cell": [key[0]], "centres": pd.Series([c.ravel() if cost <= 0.5 else None], dtype=object)})

    def assign(key: tuple, part: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if part.empty or centres.empty:
            return part.drop(columns=["part"]).head(0)
        x = _units(part["x"])
        close = _near(x, np.reshape(centres["centres"].iloc[0], (-1, x.shape[1])), threshold, margin)
        at, cell = np.nonzero(close)
        out = part.drop(columns=["part"]).iloc[at].reset_index(drop=True)
        return out.assign(cell=[f"{key[0]}.{c}" for c in cell])

    done = None
    while True:
        sizes = rows.groupBy("cell", "label", "dim").count().groupBy("cell", "dim").agg(F.max("count").alias("most"), F.sum("count").alias("total"))
        big = checkpoint(sizes.filter(F.col("total") >= HANDFUL if done is None else F.col("most") > 2 * cell_rows))
        few = F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(2**31)) < F.lit(2.0**31 * max_fit) / F.col("total")
        sample = rows.join(sized(big.select("cell", "total", "most")), "cell").filter(few).select("cell", "x", "most")
        centres = checkpoint(sample.groupBy("cell").applyInPandas(fit_first if done is None else fit, "cell string, centres array<double>").filter("centres is not null"))
        if centres.isEmpty():
            return rows if done is None else done.union(rows)
        parts = big.join(centres, "cell").select("cell", "centres", F.ceil(F.col("total") * F.col("dim") / 2_000_000).cast("int").alias("parts"))
        left = rows.join(sized(parts.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")).drop("parts")
        right = parts.select(F.col("cell").alias("_cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"), F.col("centres").alias("_centres"))
        right = right.toDF("cell", "part", "centres")
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in left.columns if c != "part")
        rest = rows.join(centres.select("cell"), "cell", "left_anti")
        done = checkpoint(rest.select(*rows.columns) if done is None else done.union(rest.select(*rows.columns)))
        split = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInPandas(lambda key, a, b: assign(key, a, b), schema)
        rows = checkpoint(split.select(*rows.columns))


def embedding_near_dups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    threshold: float = 0.98,
    margin: float | None = None,
    cell_rows: int = 1000,
    block_rows: int = 2048,
    fan: int = 256,
    max_fit: int = 20_000,
    seed: int = 6,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors link if their labels are equal and not null (all vectors, without ``label_col``), they are as long as
    each other, and their cosine is ``threshold`` or more. Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing. kept is true for the smallest id of a component; rows with a null id form no links.

    Equal vectors count as one until the end. A vector is in the cell of its nearest centre and in every cell whose
    centre is less than ``margin`` further by dot product; left out, it is 4.5 standard deviations of what two vectors
    at the threshold can differ by, along a direction taken at random. All vectors but a handful are dealt to cells, and cells with more than twice
    ``cell_rows`` vectors of a label again, by ``fan`` centres or fewer, which come from bounded samples of ``max_fit`` vectors of the cell.
    Cells are cut into blocks of ``block_rows``, and pairs of blocks are compared, so no task holds a whole cell. Rows that
    repeat an id count as one more vector each. An empty table gives an empty result; further columns are ignored.
    """
    x = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), x.alias("x"), F.coalesce(fine, F.lit(False)).alias("fine"))
    fit = rows.filter("fine and label is not null").select("id", "label", F.size("x").alias("dim"), F.xxhash64("x").alias("h"), F.xxhash64(F.lit(1), "x").alias("g"), "x")
    # Equal vectors meet by a hash of their components; the label, length and two hashes stand for them from here on.
    same = ["label", "dim", "h", "g"]
    reps = fit.groupBy(*same).agg(F.min("id").alias("vec"), F.count("*").alias("times"), F.first("x").alias("x"))
    reps = checkpoint(reps.withColumn("rep", F.monotonically_increasing_id()))
    placed = _split_cells(reps.select("rep", "label", "dim", "vec", "times", "x"), threshold, margin, cell_rows, fan, max_fit, seed)
    spread = placed.join(placed.groupBy("rep").agg(F.collect_list("cell").alias("cells")), "rep")
    counts = spread.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    spread = spread.join(sized(checkpoint(counts)), ["label", "dim", "cell"])
    spread = spread.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = spread.withColumn("other", pair).withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other"))
    kind = dict(rows.dtypes)["id"]
    found = spread.select("label", "dim", "cell", "a", "b", "block", "vec", "times", "x", "cells").groupBy("label", "dim", "cell", "a", "b")
    found = checkpoint(found.applyInPandas(_compare(threshold), f"vec {kind}, n long, root {kind}"))
    links = found.groupBy("vec").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")))
    done = reps.join(links, "vec", "left").join(roots, reps["vec"] == roots["node"], "left")
    done = checkpoint(done.select(*same, (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "vec").alias("component_id")))
    out = rows.withColumns({"dim": F.size("x"), "h": F.xxhash64("x"), "g": F.xxhash64(F.lit(1), "x")}).withColumn("label", F.when(F.col("fine"), F.col("label")))
    out = out.join(done, same, "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")) & F.col("id").isNotNull())
