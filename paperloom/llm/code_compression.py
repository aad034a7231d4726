"""Compression of vectors to codes: the parts of a vector are replaced by the nearest entries of small codebooks.

Distances come from a lexicographic trie over the distinct parts: parts that begin alike share the accumulated distances of their common
beginning to all entries, and only leaves take the nearest entry. Tasks build tries of a bounded number of rows and return sums by entry,
so a round moves as many rows as the codebooks have numbers, and vectors never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free_name, sized

#: Rows of a trie, and distinct parts below a node from which on its levels are taken together.
TRIE_ROWS, BLOCK = 32_768, 4_096


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, which of them each row is, and how many rows each is."""
    order = np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))
    ranked = parts[order]
    new = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)])[: len(parts)]
    which = np.empty(len(parts), np.int64)
    which[order] = np.cumsum(new) - 1
    return ranked[new], which, np.bincount(which, minlength=int(new.sum()))


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry to each of the distinct, sorted parts (of equal ones the lowest), and the squared distance.

    The trie is walked depth first; its nodes are ranges of the sorted parts. A node has the distances of its prefix to all
    entries, to which each child adds one dimension. Below a node of at most ``BLOCK`` parts, a level's nodes are taken at once.
    """
    best, least = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    stack = [(0, len(parts), 0, np.zeros(len(entries), np.int64))] if len(parts) else []
    while stack:
        low, high, depth, base = stack.pop()
        here = parts[low:high]
        if len(here) > BLOCK:
            value = here[:, depth]
            starts = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(here)]])
            for a, b in zip(starts[-2::-1], starts[:0:-1], strict=True):
                stack.append((low + a, low + b, depth + 1, base + (value[a] - entries[:, depth]) ** 2))
            continue
        dist, node = base[None, :], np.zeros(len(here), np.int64)
        new = np.zeros(max(0, len(here) - 1), bool)
        for at in range(depth, parts.shape[1]):
            new |= here[1:, at] != here[:-1, at]
            first = np.concatenate([[0], np.flatnonzero(new) + 1])
            dist = dist[node[first]] + (here[first, at][:, None] - entries[None, :, at]) ** 2
            node = np.concatenate([[0], np.cumsum(new)])
        nearest = dist.argmin(axis=1)
        best[low:high], least[low:high] = nearest[node], dist[np.arange(len(dist)), nearest][node]
    return best, least


def _whole(vectors: list, width: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), zeros behind shorter vectors."""
    found = np.zeros((len(vectors), width), np.int64)
    for row, x in zip(found, vectors, strict=True):
        row[: len(x)] = np.floor(np.asarray(x, np.float64) * scale)
    return found


def _matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """The same of an Arrow column of lists, without a loop if all are as long as each other."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * width and (column.value_lengths().to_numpy(zero_copy_only=False) == width).all():
        return np.floor(flat.astype(np.float64) * scale).astype(np.int64).reshape(-1, width)
    return _whole(column.to_pylist(), width, scale)


@dataclass
class Codebooks:
    """The entries by part, number and position within the part, and the factor by which components became integers."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        """Of all numbers in this order, in decimal, between commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def vector(self, code: str) -> list[float]:
        """What a code stands for."""
        return [v / self.scale for p, k in enumerate(bytes.fromhex(code)) for v in self.entries[p, k].tolist()]


def fine_vectors(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector is there and holds finite components only."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(x.isNotNull() & F.coalesce(fine, F.lit(False)))


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks of ``entries`` integers parts for each of ``parts`` positions, from ``rounds`` assignments of all vectors.

    They start as the vectors with the smallest ids (nulls last, equal ids by vector); with fewer vectors there are fewer entries. Each round
    replaces an entry by the floor of the mean of the parts nearest to it; entries that are nearest to none stay. Vectors that are null or hold null or
    non-finite components don't count. Shorter vectors are taken to end in zeros, and so is a length that isn't a multiple of ``parts``. Components are
    integers of 64 bits, so distances are exact for components below about a million.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, so there are 1 to 256 entries")
    rows = fine_vectors(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    width = -(-max(1, rows.agg(F.max(F.size("x"))).first()[0] or 0) // parts)
    first = rows.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").collect()
    books = _whole([r["x"] for r in first], parts * width, scale).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        books = _next(rows.select("x"), books, scale)
    return Codebooks(books, scale)


def _next(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after one assignment of all rows. The driver gets the sums, of which there are as many as numbers in the codebooks."""
    parts, entries, width = books.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), np.int64)

        def add(held: list[np.ndarray]) -> None:
            x = np.concatenate(held).reshape(-1, parts, width)
            for p in range(parts):
                found, _, times = distinct_parts(x[:, p])
                best, _ = nearest_entries(found, books[p])
                np.add.at(sums[p], best, np.column_stack([found * times[:, None], times]))

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(_matrix(batch.column(0), parts * width, scale))
                n += batch.num_rows
            if n >= TRIE_ROWS:
                add(held)
                held, n = [], 0
        if held:
            add(held)
        flat = sums.ravel()
        cell = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(flat[cell])], ["cell", "value"])

    found = rows.mapInArrow(of, "cell long, value long").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    sums = np.zeros(parts * entries * (width + 1), np.int64)
    sums[found["cell"].to_numpy(np.int64)] = found["value"].to_numpy(np.int64)
    sums = sums.reshape(parts, entries, width + 1)
    times = sums[:, :, -1:]
    return np.where(times > 0, sums[:, :, :-1] // np.maximum(times, 1), books)


def encode_vectors(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding", out: str = "encoded") -> DataFrame:
    """The rows with fine vectors, with ``out``: struct<code, error>, two hex digits for each part and the sum of the squared distances.

    Other rows go. The columns of ``vectors`` stay, and if one is called ``out``, the new one gets an underscore more; equal vectors get equal codes.
    """
    parts, _, width = books.entries.shape

    @F.pandas_udf("struct<code: string, error: long>")
    def of(xs: pd.Series) -> pd.DataFrame:
        x = _matrix(pa.array(xs, pa.list_(pa.float64())), parts * width, books.scale).reshape(-1, parts, width)
        codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
        for p in range(parts):
            found, which, _ = distinct_parts(x[:, p])
            best, least = nearest_entries(found, books.entries[p])
            codes[:, p] = best[which]
            error += least[which]
        digits = codes.tobytes().hex()
        return pd.DataFrame({"code": [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)], "error": error})

    return fine_vectors(vectors, vector_col).withColumn(free_name(vectors, out), of(F.col(vector_col).cast("array<double>")))


def with_label_error(encoded: DataFrame, label: Column, error: Column, out: str = "label_error") -> DataFrame:
    """encoded, which must be stored, with the sum of the errors of all rows of equal label; nulls count as equal."""
    key, total, out = free_name(encoded, "_label", "_total", out)
    sums = sized(checkpoint(encoded.groupBy(label.alias(key)).agg(F.sum(error).alias(total))))
    found = encoded.join(sums, label.eqNullSafe(sums[key]), "left")
    return found.withColumn(out, F.col(total)).drop(key, total)
