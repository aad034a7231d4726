"""Filter audits, shards and codes against plain versions that share no code with them."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import code_compression, filter_audit, sharding
from paperloom.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


def store(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).withColumn("h", F.lit("mine")).withColumn("placed", F.lit("mine")).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


# --- 11: audits


def plain_audit(docs, labels):
    """Every order of every part, document by document."""
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    first, parts = {}, defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": any(c in t for c in "#$%&*|"),
            "E": i is not None and i > first[t],
        }
        parts[source or ""].append((fails, i in good, i in toxic))
    out, shapley = [], Counter()
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if r[0][f]], [r for r in left if not r[0][f]]
                redundant = sum(r[0][f] for r in rows) - len(gone)
                only = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                shapley[part, f] += len(gone)
                out.append([part, "".join(order), step, len(stay), len(gone), redundant, only, sum(r[1] for r in gone), sum(r[2] for r in gone)])
                left = stay
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_plain(spark, tmp_path):
    rng = random.Random(1)
    pool = [" ".join(f"w{rng.randrange(size)}" for _ in range(n)) for size, n in ((20, 300), (900, 300), (900, 100))] + ["Ab #", "½\x1fx", "", None, "A" * 40]
    docs = [(rng.choice([*range(40), None]), rng.choice(pool) if k % 2 else f"{rng.choice(pool)} {k}", rng.choice(["a", "b", "", None])) for k in range(150)]
    docs += docs[:5]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(40)] + [(3, 1, 1), (None, 1, 1)]
    folder = store(spark, tmp_path, documents=(docs, "doc_id long, text string, source string"), labels=(labels, "doc_id long, quality int, toxic int"))
    got = [tuple(r) for r in Q.op11_filter_audit(spark, folder).select(*AUDIT).collect()]
    assert sorted(got) == plain_audit(docs, labels)


def test_audit_of_given_tables_and_of_none(spark, tmp_path):
    read = lambda n: [tuple(r) for r in spark.read.parquet(f"{SMALL}/{n}.parquet").select(*(("doc_id", "text", "source") if n == "documents" else ("doc_id", "quality", "toxic"))).collect()]
    got = [tuple(r) for r in Q.op11_filter_audit(spark, SMALL).select(*AUDIT).collect()]
    assert sorted(got) == plain_audit(read("documents"), read("labels"))
    folder = store(spark, tmp_path, documents=([], "doc_id long, text string, source string"), labels=([], "doc_id long, quality int, toxic int"))
    assert Q.op11_filter_audit(spark, folder).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_swaps_visit_each_order_once(n):
    order = list(range(n))
    seen = [tuple(order)]
    for k in filter_audit.adjacent_swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert len(set(seen)) == len(seen) == math.factorial(n)


def test_diagram_shares_equal_parts():
    same = filter_audit.Diagram(dict.fromkeys(range(8), (2,)), 3, 1)
    assert len(same.total) == 4 and same.total[same.root].tolist() == [16]  # a node for each level, and a leaf


def test_audit_of_own_filters(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 50, "x").alias("p"), "id")
    got = filter_audit.audit_filters(rows, {"even": F.col("id") % 2 == 0, "low": F.col("id") < 10, "none": F.lit(None).cast("boolean")}, F.col("p"), {"ten": F.col("id") % 10 == 0})
    found = {(r["part"], r["filter_order"], r["filter"]): tuple(r)[4:] for r in got.collect()}
    assert len(found) == 2 * 6 * 3
    assert found["x", "evenlownone", "low"] == (20, 5, 5, 5, 5 * 3 + 10 * 3, 0)
    assert found["x", "lowevennone", "even"] == (20, 20, 5, 20, 20 * 3 + 25 * 3, 4)
    assert found[None, "noneevenlow", "even"] == (25, 25, 0, 25, 150, 5)
    with pytest.raises(ValueError, match="filters"):
        filter_audit.audit_filters(rows, {}, F.col("p"))


# --- 12: shards


def fits(sizes, capacity, shards):
    at, used = 0, 1
    for s in sizes:
        if s > capacity:
            return False
        if at + s > capacity:
            at, used = 0, used + 1
        at += s
    return used <= shards


def groups_of(spark, rng, n, heavy=()):
    sizes = [*heavy, *(rng.randrange(1, 400) for _ in range(n))]
    hashes = [rng.randrange(-(2**63), 2**63) for _ in sizes]
    return dict(zip(hashes, sizes, strict=True)), spark.createDataFrame(list(zip(hashes, sizes, strict=True)), "h long, size long")


@pytest.mark.parametrize(("n", "heavy", "most"), [(3000, (), 64), (3000, (70_000, 65_000), 256), (500, (200_000, 30_000, 9_000), 1 << 16), (4000, (40_000,) * 9, 100), (5, (), 8), (0, (), 8), (0, (5,), 8)])
def test_capacity_is_the_smallest(spark, n, heavy, most):
    sizes, groups = groups_of(spark, random.Random(n), n, heavy)
    plan = sharding.plan_shards(groups.cache(), 8, most)
    rest = [sizes[h] for h in sorted(sizes) if h not in plan.alone]
    left = 8 - len(plan.alone)
    if rest:
        assert fits(rest, plan.capacity, left) and not fits(rest, plan.capacity - 1, left) or plan.capacity == -(-sum(rest) // left) or plan.capacity == max(rest)
    placed = {r["h"]: r["shard"] for r in groups.select("h", plan.shard(F.col("h")).alias("shard")).collect()}
    totals = Counter()
    for h, shard in placed.items():
        totals[shard] += sizes[h]
    assert set(placed.values()) <= set(range(8)) and all(t <= plan.capacity for s, t in totals.items() if s >= len(plan.alone))
    assert [placed[h] for h in plan.alone] == list(range(len(plan.alone)))
    if n >= 3000 and not heavy:
        even = sum(rest) / left
        assert len(totals) == 8 and all(abs(totals[s] - even) < 0.02 * even for s in range(len(plan.alone), 8))


def test_shards_of_odd_rows(spark, tmp_path):
    docs = [(k, f"text ½ {k % 60}") for k in range(200)] + [(None, None), (None, ""), (7, None), (7, None), (8, "long " * 50_000), (9, "long " * 50_000), (1, "text ½ 1")] + [(5, "same")] * 40
    folder = store(spark, tmp_path, documents=(docs, "doc_id long, text string"))
    got = Q.op12_sharding(spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in docs)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in shards.values()) and set(shards) <= set(range(8))
    assert all(len({r["shard"] for r in g}) == 1 for g in ([r for r in got if r["text_crc32"] == c] for c in {r["text_crc32"] for r in got}))
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    empty = store(spark, tmp_path / "none", documents=([], "doc_id long, text string"))
    assert Q.op12_sharding(spark, empty).count() == 0


def test_shards_keep_columns_and_are_written_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("placed", F.lit("mine")).withColumn("SIZE", F.lit(1))
    placed = sharding.shard_documents(docs, shards=3)
    assert placed.columns == [*docs.columns, "placed_"]
    sharding.write_shards(placed, str(tmp_path / "out"), files=4, column="placed_")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.filter("placed = 'mine' and shard = placed_.shard").count() == docs.count()
    for path in {r["f"] for r in back.select(F.input_file_name().alias("f")).collect()}:
        slots = [r["s"] for r in spark.read.parquet(path).select(F.col("placed_.slot").alias("s")).collect()]
        assert slots == sorted(slots)
    sizes = [r["n"] for r in placed.groupBy("placed_.shard").agg(F.sum("placed_.size").alias("n")).collect()]
    assert len(sizes) == 3 and max(sizes) < 1.1 * min(sizes)


# --- 13: codes


def plain_codes(rows, parts=16, entries=64):
    """(code, error) by row and the codebooks, entry by entry in Python's integers."""
    kept = [(i, x, lab) for i, x, lab in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(v * 256) for v in x] for _, x, _ in kept]
    width = len(whole[0]) // parts
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for x in whole]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    near = lambda x, p: min((far(x[p], e), k) for k, e in enumerate(books[p]))
    for _ in range(2):
        for p in range(parts):
            own = defaultdict(list)
            for x in cut:
                own[near(x, p)[1]].append(x[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    codes = [[near(x, p) for p in range(parts)] for x in cut]
    errors, by_label = [sum(d for d, _ in c) for c in codes], Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by_label[lab] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in c), e, by_label[lab], digest) for (i, _, lab), c, e in zip(kept, codes, errors, strict=True))


def test_codes_equal_plain(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(k, [float(np.float32(v)) for v in rng.normal(size=32) * (0.2 if k % 3 else 0.01)], int(k % 3) if k % 5 else None) for k in range(150)]
    rows += rows[:70] + [(None, rows[9][1], 4), (500, None, 1), (501, [None] * 32, 1), (502, [math.nan] * 32, 1), (503, [math.inf] * 32, 1), (504, [0.0] * 32, None)]
    rng.shuffle(rows)
    rows = [(None if i is None else int(i), x, lab) for i, x, lab in rows]
    folder = store(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    got = [tuple(r) for r in Q.op13_code_compression(spark, folder).collect()]
    assert sorted((str(i), *rest) for i, *rest in got) == plain_codes(rows)


def test_codes_of_few_short_or_no_vectors(spark, tmp_path):
    folder = store(spark, tmp_path / "a", embeddings=([], "vec_id long, embedding array<float>, label int"))
    assert Q.op13_code_compression(spark, folder).count() == 0
    folder = store(spark, tmp_path / "b", embeddings=([(1, [], None), (2, [0.5] * 17, None), (3, [0.5] * 17, 1)], "vec_id long, embedding array<double>, label int"))
    got = sorted(tuple(r)[:4] for r in Q.op13_code_compression(spark, folder).collect())
    assert got == [(1, "00" * 16, 0, 0), (2, "01" * 9 + "00" * 7, 0, 0), (3, "01" * 9 + "00" * 7, 0, 0)]


def test_trie_equals_products(monkeypatch):
    monkeypatch.setattr(code_compression, "BLOCK", 7)
    rng = np.random.default_rng(2)
    for width in (1, 2, 5):
        x = rng.integers(-3, 4, size=(400, width))
        entries = rng.integers(-3, 4, size=(20, width))
        found, which, times = code_compression.distinct_parts(x)
        assert (found[which] == x).all() and times.sum() == len(x) and sorted(map(tuple, found)) == list(map(tuple, found)) and len(set(map(tuple, found))) == len(found)
        best, least = code_compression.nearest_entries(found, entries)
        dist = ((found[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (best == dist.argmin(axis=1)).all() and (least == dist.min(axis=1)).all()


def test_codes_stand_for_near_vectors(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").withColumn("encoded", F.lit(1))
    books = code_compression.fit_codebooks(rows)
    got = code_compression.encode_vectors(rows, books).collect()
    assert got[0]["encoded"] == 1 and len(got) == rows.count()
    for r in got[:50]:
        whole = np.floor(np.array(r["embedding"]) * 256)
        assert ((np.array(books.vector(r["encoded_"]["code"])) * 256 - whole) ** 2).sum() == r["encoded_"]["error"]
