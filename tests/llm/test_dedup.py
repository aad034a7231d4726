"""Near-duplicates, lines, leaks and vectors against brute force, and on odd rows."""

import random
import time
from collections import Counter

import numpy as np
import xxhash

import corpus_pipeline
from paperloom.llm import common, decontaminate, embedding_dedup, line_dedup, simhash_dedup

DOC = "doc_id long, text string, text_md5 string"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "clash") for k, t in enumerate(texts)], DOC)


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    pairs = {frozenset(x) for x in links}
    want = roots(sorted({x for p in links for x in p}), lambda a, b: frozenset((a, b)) in pairs)
    assert got == {k: v for k, v in want.items() if any(k in p and len(p) == 2 for p in pairs)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [] if not w else [b" ".join(w)] if len(w) < 3 else [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(20)]
    texts = [None, "", "  ", "A b", "a B", *base, *base[:3]]
    texts += [t + " " + rng.choice(words) for t in base for _ in range(3)]
    frame = docs(spark, texts)
    got = {r["id"]: r for r in simhash_dedup.simhash_near_dups(frame, size=3, bits=64, tables=1, distance=2).collect()}
    prints = {k: fingerprint(t) for k, t in enumerate(texts)}
    assert {k: r["sketch"][0] % 2**64 for k, r in got.items()} == prints
    assert {k: r["component_id"] for k, r in got.items()} == roots(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)


def test_keep_one_of_near_copies(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(300)) for _ in range(8)]
    near = [t.replace(t.split()[150], "changed", 1) for t in texts]
    kept = simhash_dedup.keep_one(docs(spark, texts + near + texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(8))
    assert kept.columns == ["doc_id", "text", "text_md5"]
    odd = spark.createDataFrame([(None, None, None), (None, None, None), (1, "a", "x"), (1, "a", "x")], DOC)
    assert simhash_dedup.keep_one(odd).count() == 4
    assert simhash_dedup.keep_one(odd.limit(0)).count() == 0


def jaccard(x, y):
    x, y = (Counter(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in (x, y))
    return (x & y).total() / (x | y).total()


def test_near_copies_are_those_of_exact_similarity(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        most = rng.choice([8, 10, 11, 12, 14])  # of 100 shingles; 11 changed ones give 89 / 111
        other = [*words[:-most], *(f"v{rng.randrange(10**6)}" for _ in range(most))]
        texts += [" ".join(words), " ".join(other)]
    got = {r["doc_id"] for r in simhash_dedup.keep_one(docs(spark, texts)).collect()}
    want = {k for k in range(len(texts)) if k % 2 == 0 or jaccard(texts[k - 1], texts[k]) < 0.8}
    assert got == want and 60 < len(want) < 120


def test_near_copies_behind_an_unlike_leader(spark):
    rng = random.Random(6)
    texts = []
    for s in range(40):
        for _ in range(8):
            at, n = rng.randrange(12), rng.randrange(8, 20)
            texts.append(" ".join(f"s{s}w{k}" for k in range(at, at + n)))
    linked = roots(range(len(texts)), lambda a, b: a // 8 == b // 8 and jaccard(texts[a], texts[b]) >= 0.8)
    got = {r["doc_id"] for r in simhash_dedup.keep_one(docs(spark, texts)).collect()}
    assert got == set(linked.values())


def test_near_copies_start_from_simhash_groups(spark, monkeypatch):
    seen, of, compared = [], simhash_dedup.simhash_near_dups, []
    monkeypatch.setattr(simhash_dedup, "simhash_near_dups", lambda *a, **b: seen.append(1) or of(*a, **b))
    text = " ".join(f"w{k}" for k in range(400))
    rows = docs(spark, [text, text + " more", " ".join(f"v{k}" for k in range(400))])
    first = simhash_dedup._first_links
    monkeypatch.setattr(simhash_dedup, "_first_links", lambda *a: compared.append(first(*a)) or compared[0])
    assert sorted(r["doc_id"] for r in simhash_dedup.keep_one(rows).collect()) == sorted(rows.toPandas()["doc_id"].iloc[[0, 2]])
    assert seen and compared[0].count() == 1


def test_turns_keep_guessed_sizes_small(spark):
    rows = [(t, n, n, 10, 5, True) for t in (1, 2) for n in range(1, 6)]
    left = spark.createDataFrame(rows, "token long, node long, root long, n int, rest int, small boolean")
    links = simhash_dedup.checkpoint(spark.createDataFrame([(1, 2)], "a long, b long"))
    for _ in range(4):
        left, cross = simhash_dedup._apart(simhash_dedup._merged(left, links))
    assert cross == 2 * (25 - 7)
    assert int(str(left._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 2**64


def test_keep_one_tells_rows_of_an_id_apart(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(50)) for x in "abc")
    rows = spark.createDataFrame([(None, a, ""), (None, b, ""), (1, a, ""), (2, a, ""), (2, c, "")], DOC)
    assert {(r[0], r[1]) for r in simhash_dedup.keep_one(rows).collect()} == {(None, b), (1, a), (2, c)}


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
    x, y = sorted((x, y), key=len)
    return len(y) - len(x) == 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randrange(3, 10))] for _ in range(40)]
    lines = []
    for _ in range(160):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(x))
            x[k : k + rng.randrange(2)] = [rng.choice("abcxyz")] * rng.randrange(2)
        lines.append(x)
    texts = ["\n".join("  ".join(x) for x in lines[k : k + 5]) for k in range(0, 160, 5)] + ["", None, "one  line\n\n of \t few"]
    seen, want = [], {}
    for k, t in enumerate(texts):
        if t is None:
            want[k] = (None, 0, 0)
            continue
        kept = []
        for raw in t.split("\n"):
            w = raw.split()
            if len(w) < 6 or not any(near(w, s) for s in seen):
                kept.append(raw)
            if len(w) >= 6 and w not in seen:
                seen.append(w)
        want[k] = ("\n".join(kept), len(t.split("\n")), len(kept))
    got = line_dedup.dedup_lines(docs(spark, texts))
    assert {r["doc_id"]: (r["text"], r["_lines"], r["_kept"]) for r in got.collect()} == want
    assert got.columns[:3] == ["doc_id", "text", "text_md5"]
    assert line_dedup.dedup_lines(docs(spark, texts).limit(0)).count() == 0


def test_short_lines_that_repeat(spark):
    texts = ["All rights reserved.\nOne\n\na b c d e f", "One\n \nAll  rights reserved.\nAll rights removed.\n", "a b c d e x\na b c d e\nTwo"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts), exact_words=1).collect()}
    assert got == {0: texts[0], 1: " \nAll rights removed.\n", 2: "a b c d e\nTwo"}
    staged = corpus_pipeline.dedup_lines(spark, docs(spark, texts).selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars"), "")
    assert {r["doc_id"]: r["text"] for r in staged.collect()} == got
    again = spark.createDataFrame([(None, "a b c d e f", None)] * 2, DOC)
    assert [r["text"] for r in line_dedup.dedup_lines(again).collect()] == ["a b c d e f"] * 2


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    items = [" ".join(rng.choices(words, k=rng.randrange(15, 40))) for _ in range(12)] + ["two words", ""]
    texts = [None, "", "short"]
    for k in range(60):
        w = items[k % 12].split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "other"
        texts.append(" ".join([*rng.choices(words, k=rng.randrange(40)), *w, *rng.choices(words, k=rng.randrange(40))]).title())
    texts += ["x Two  WORDS y", items[0]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc"]["id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(docs(spark, texts), bench).collect()}

    def runs(w):
        return [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []

    want = {}
    for d, t in enumerate(texts):
        w = (t or "").lower().split()
        for i, item in enumerate(items):
            iw = item.split()
            y = Counter(runs(iw))
            for s in range(max(1, len(w) - len(iw) + 1)) if w and iw else []:
                x = Counter(runs(w[s : s + len(iw)]))
                j = sum((x & y).values()) / sum((x | y).values())
                if j >= 0.8:
                    want[d, i] = max(want.get((d, i), 0), j)
    assert got == want and len(want) >= 20
    left = decontaminate.without_leaks(docs(spark, texts), bench)
    assert {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert left.columns == ["doc_id", "text", "text_md5"]
    assert decontaminate.find_leaks(docs(spark, texts), bench.limit(0)).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    x[200:300] = x[:100] + rng.normal(size=(100, 16)) * 0.12
    x[300:330] = x[0]
    rows = [(k, v.tolist(), int(k % 3)) for k, v in enumerate(x)]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, []]
    rows += [(400 + k, v, 0) for k, v in enumerate(odd)] + [(405, x[0].tolist(), None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_near_dups(frame, cell_rows=40, block_rows=16).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cos = unit @ unit.T
    linked = lambda a, b: a < 400 and b < 400 and rows[a][2] == rows[b][2] and cos[a, b] >= 0.98
    root = roots(list(range(406)), linked)
    want = {k: (sum(linked(k, j) for j in range(406) if j != k), root[k], root[k] == k) for k in range(406)}
    found = sum(v[0] for v in got.values()) / sum(v[0] for v in want.values())
    assert found >= 0.99 and all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k] == want[k] for k in want) >= 400
    assert embedding_dedup.embedding_near_dups(frame.limit(0)).count() == 0


def test_frequent_tokens_and_repetitive_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "FREQUENT", 3)
    test_near_copies_are_those_of_exact_similarity(spark)
    test_near_copies_behind_an_unlike_leader(spark)
    began = time.time()
    tokens = simhash_dedup.shingle_tokens("word " * 300_000, 5)
    assert len(set(tokens.tolist())) == len(tokens) == 299_996 and time.time() - began < 5
