"""Queries and the pipeline against plain Python versions that share no code with them."""

import base64
import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import language_id, quality, secret_scan, toxicity, url_filter
from paperloom.llm import queries as Q

DATA, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def read(spark, name, folder=DATA):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


# --- 5: languages


def runs_of_letters(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] == "L":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


class PlainLanguages:
    """Word-first backoff as one loop over dictionaries."""

    def __init__(self, rows):
        self.words, self.grams = defaultdict(Counter), defaultdict(Counter)
        for text, lang in rows:
            for w in runs_of_letters(text):
                self.words[lang][w] += 1
        self.langs = sorted(self.words)
        for lang in self.langs:
            for w, n in self.words[lang].items():
                for size in (5, 4, 3, 2, 1):
                    for k in range(len(w) + 3 - size):
                        self.grams[lang][f" {w} "[k : k + size]] += n
        known = {w for c in self.words.values() for w in c}
        sums = {lang: sum(self.words[lang][w] + 0.5 for w in known) for lang in self.langs}
        self.word_logs = {w: self.centred([math.log((self.words[x][w] + 0.5) / sums[x]) for x in self.langs]) for w in known}
        all_grams = {g for c in self.grams.values() for g in c}
        sums = {(x, n): sum(self.grams[x][g] + 0.5 for g in all_grams if len(g) == n) for x in self.langs for n in range(1, 6)}
        self.gram_logs = {g: self.centred([math.log((self.grams[x][g] + 0.5) / sums[x, len(g)]) for x in self.langs]) for g in all_grams}

    @staticmethod
    def centred(logs):
        return [v - sum(logs) / len(logs) for v in logs]

    def predict(self, text):
        found = Counter(runs_of_letters(text))
        if not found:
            return "und", 0.0
        total = [0.0] * len(self.langs)
        for w, n in found.items():
            logs = [self.word_logs[w]] if w in self.word_logs else []
            for size in (5, 4, 3, 2, 1):
                logs = logs or [self.gram_logs[g] for k in range(len(w) + 3 - size) if (g := f" {w} "[k : k + size]) in self.gram_logs]
            for row in logs:
                total = [t + n * v / len(logs) for t, v in zip(total, row, strict=True)]
        damp = max(1.0, sum(found.values()) / 20)
        p = [math.exp((t - max(total)) / damp) for t in total]
        return self.langs[p.index(max(p))], max(p) / sum(p)


def test_languages_equal_plain_version(spark):
    docs = read(spark, "documents").select("doc_id", "text", "lang").collect()
    plain = PlainLanguages([(r["text"], r["lang"]) for r in docs if not held_out(r["doc_id"]) and r["lang"] is not None and r["text"] is not None])
    got = {r["doc_id"]: r for r in Q.op5_language_id(spark, DATA).collect()}
    assert len(got) == len(docs)
    for r in docs:
        lang, score = plain.predict(r["text"])
        mine = got[r["doc_id"]]
        assert mine["held_out"] == held_out(r["doc_id"]) and mine["score"] == pytest.approx(score, abs=2e-3)
        assert mine["lang_pred"] == lang or score < 0.51
    assert {language_id.Scorer(["en"], ["a"], np.ones((1, 1)), ["a"], np.ones((1, 1))).predict(x)[0] for x in ("½ ²", "①", "Ⅷ", "12", "_", None)} == {"und"}
    assert language_id.letter_words("x²y ½z") == Counter(["x", "y", "z"])


# --- 7: secrets


def plain_base(text):
    found = [("assign", m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    found += [("access", m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1][0], ["assign", "access", "hex"].index(x[0])))


def test_secrets_query_equals_plain_patterns(spark):
    got = {r["doc_id"]: r for r in Q.op7_secret_scan(spark, DATA).collect()}
    for r in read(spark, "documents").collect():
        base = plain_base(r["text"] or "")
        listed = [f"{k}:{a}:{b}" for k, (a, b) in base]
        mine = got[r["doc_id"]]
        assert (mine["n_assign"], mine["n_access"], mine["n_hex"]) == tuple(sum(k == kind for k, _ in base) for kind in ("assign", "access", "hex"))
        assert mine["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [x for x in mine["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex")] == listed
    assert sum(bool(plain_base(r["text"] or "")) for r in read(spark, "documents").collect()) > 10


def test_random_bytes_raise_nothing():
    rng = random.Random(7)
    for k in range(4000):
        data = bytes([0x30, rng.choice([0xFF, 0x80, 0x81, 0x84, 0x2A, 0])]) + rng.randbytes(rng.randrange(22, 90))
        data = data if k % 3 else rng.randbytes(60)
        for text in (base64.b64encode(data).decode(), data.hex(), data.hex().upper(), base64.urlsafe_b64encode(data).decode(), "-----BEGIN KEY-----\n" + base64.b64encode(data).decode() + "\n-----END KEY-----"):
            secret_scan.find_secrets(text)
    nested = base64.urlsafe_b64encode(b'{"a":' * 100_000).decode().rstrip("=")
    assert not any(x[0] == "signed" for x in secret_scan.find_secrets(f"eyJ{nested}.eyJh.c2ln"))
    deep = base64.urlsafe_b64encode(b'{"a":' + b"[" * 200_000).decode().rstrip("=")
    assert not any(x[0] == "signed" for x in secret_scan.find_secrets(f"{deep}.eyJh.c2ln"))


def test_openssh_keys_are_parsed():
    part = lambda x: len(x).to_bytes(4, "big") + x
    public = part(b"ssh-ed25519") + part(bytes(32))
    whole = secret_scan.SSH_MAGIC + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4, "big") + part(public) + part(bytes(64))
    assert secret_scan.is_ssh_key(whole) and not secret_scan.is_ssh_key(whole + b"x") and not secret_scan.is_ssh_key(whole[:-1])
    assert not secret_scan.is_ssh_key(secret_scan.SSH_MAGIC + bytes(40))
    assert secret_scan.is_ssh_key(public) and not secret_scan.is_ssh_key(part(b"ssh-ed25519"))


# --- 8: toxicity


def test_toxicity_scores_equal_plain_search(spark):
    labelled = read(spark, "documents").join(read(spark, "labels"), "doc_id")
    lexicon = toxicity.fit_lexicon(labelled)
    docs = read(spark, "documents").limit(200).collect()
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(spark.createDataFrame(docs), lexicon).collect()}
    assert lexicon.weights
    for r in docs:
        words = toxicity.fold(r["text"]).split()
        excused = {k for k in range(len(words) - 1) if f"{words[k]} {words[k + 1]}" in lexicon.phrases}
        total = 0.0
        for k, w in enumerate(words):
            if k in excused or k - 1 in excused:
                continue
            total += max((v for t, v in lexicon.weights.items() if (t == f" {w} " if t.endswith(" ") else f" {w}".startswith(t))), default=0.0)
        size = max(len(words), 1, 16)
        a, b, c = lexicon.line
        z = a * math.log1p(total) / math.log1p(size) + b * total / math.sqrt(size) + c
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_long_words_and_rare_terms_count(spark):
    long = "x" * 200
    rows = [(k, f"{long} plain", 1) for k in range(6)] + [(k + 10, f"plain text number{k}", 0) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit_lexicon(frame)
    assert any(f" {long} ".startswith(t) for t in lexicon.weights)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(frame, lexicon).collect()}
    assert min(got[k] for k in range(6)) > 0.5 > max(got[k + 10] for k in range(20))


# --- 10: quality


def plain_features(text, dims):
    data, x = (text or "").encode(), [0.0] * dims
    for n in (1, 2, 4):
        hits = Counter()
        for k in range(len(data) - n + 1):
            code = n
            for byte in data[k : k + n]:
                code = (code * 0x01000193 % 2**32) ^ byte
            hits[(code * 0x9E3779B1 % 2**32) >> (32 - dims.bit_length() + 1)] += 1
        for b, m in hits.items():
            x[b] += m / sum(hits.values())
    return np.sqrt(np.array(x))


def test_quality_equals_plain_regression(spark):
    rng = random.Random(10)
    good, bad = "the story of a river town and its people", "zz!! 99 $$ xq"
    rows = [(k, " ".join(rng.choices((good if y == 2 else bad if y == 0 else good[:9] + bad).split(), k=rng.randrange(4, 30))), y) for k in range(150) for y in [k % 3]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rating int")
    dims = 64
    model = quality.fit_quality(frame, rating_col="rating", dims=dims, steps=1500)
    x = np.array([plain_features(t, dims) for _, t, _ in rows])
    assert np.abs(x - np.array([quality.features(t, dims) for _, t, _ in rows])).max() < 2e-3
    above = np.array([[float(y >= 1), float(y >= 2)] for *_, y in rows])

    def loss(w, cuts):
        p = 1 / (1 + np.exp(-((x @ w)[:, None] - cuts)))
        return -(above * np.log(p) + (1 - above) * np.log(1 - p)).sum() / len(x) + 0.5e-4 * w @ w

    at, cuts = np.zeros(dims), np.array([-0.5, 0.5])  # plain gradient descent on the same loss
    for _ in range(20_000):
        err = (1 / (1 + np.exp(-((x @ at)[:, None] - cuts))) - above) / len(x)
        at, cuts = at - 2.0 * (x.T @ err.sum(axis=1) + 1e-4 * at), cuts + 2.0 * err.sum(axis=0)
    assert loss(model.weights, model.thresholds) <= loss(at, cuts) * 1.05 + 1e-3 and model.thresholds[0] < model.thresholds[1]
    got = {r["doc_id"]: r["quality"] for r in quality.score_quality(frame, model, tail_from=2.0).collect()}
    for k, t, _ in rows:
        tails = 1 / (1 + np.exp(-(plain_features(t, dims) @ model.weights - model.thresholds)))
        assert got[k]["expected"] == pytest.approx(tails.sum(), abs=0.05) and got[k]["tail"] == pytest.approx(tails[1], abs=0.05)


# --- 2: URLs


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for what, rule in Q.URL_RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (what, rule)
    return host, path, best


def test_url_query_equals_plain_rules(spark):
    got = {r["page_id"]: r for r in Q.op2_url_filter(spark, DATA).collect()}
    for r in read(spark, "pages").collect():
        host, path, best = plain_rule(r["url"])
        mine = got[r["page_id"]]
        assert (mine["host"], mine["path"], mine["rule"]) == (host, path, best and best[1])
        assert mine["verdict"] == best[0] if best else mine["verdict"] == ("block" if mine["blocked_probability"] >= 0.5 else "allow")


def test_trees_on_a_held_out_fold(spark):
    rows = url_filter.url_features(read(spark, "pages", "/root/testdata/sf0.1").select("page_id", "url"), Q.URL_RULES).filter("label is not null").cache()
    model = url_filter.fit_trees(rows.filter("fold <> 0"))
    tested = url_filter.score_trees(rows.filter("fold = 0"), model).select("label", F.col("blocked") >= 0.5).collect()
    right = sum((y == 1.0) == hit for y, hit in tested) / len(tested)
    most = max(Counter(y for y, _ in tested).values()) / len(tested)
    assert len(tested) > 200 and right > max(most + 0.02, 0.8)


# --- the pipeline, stage by stage


def shingles(text, n=5):
    w = text.lower().split() if text else []
    return Counter(" ".join(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))) if w else Counter()


def plain_lines(docs):
    """doc_id to text, without repeats of earlier lines, and of six words on, without those within a word of one."""
    seen, near, out = set(), set(), {}
    for i, text in sorted(docs.items()):
        kept = []
        for raw in text.split("\n"):
            w = tuple(re.findall(r"[^\x20\x09-\x0D]+", raw))
            marks = {(len(w), k, w[:k] + w[k + 1 :]) for k in range(len(w))} | {("less", w[:k] + w[k + 1 :]) for k in range(len(w))} if len(w) >= 6 else set()
            hit = bool(w) and (w in seen or bool(marks & near) or ("less", w) in near and len(w) >= 6 or any((w[:k] + w[k + 1 :]) in seen and len(w) >= 7 for k in range(len(w))))
            if not hit:
                kept.append(raw)
            if w and w not in seen:
                seen.add(w)
                near |= marks
        out[i] = "\n".join(kept)
    return out


def plain_groups(texts):
    """The smallest id of each group of texts whose weighted shingle similarity is 0.8 or more."""
    sets, holders = {i: shingles(t) for i, t in texts.items()}, defaultdict(list)
    for i, s in sets.items():
        for g in s or ["no words"]:
            holders[g].append(i)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j in {j for g in s or ["no words"] for j in holders[g] if j < i}:
            if not s and not sets[j] or (s & sets[j]).total() >= 0.8 * (s | sets[j]).total() - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def plain_leaks(texts, items):
    out, items = set(), [i.lower().split() for i in items if i and i.split()]
    for i, text in texts.items():
        w = (text or "").lower().split()
        for iw in items:
            y = shingles(" ".join(iw))
            if not set(y) & set(shingles(text)) and len(iw) >= 5 or not w:
                continue
            for s in range(max(1, len(w) - len(iw) + 1)):
                x = shingles(" ".join(w[s : s + len(iw)]))
                if len(iw) < 5 and w[s : s + len(iw)] != iw:
                    continue
                if (x & y).total() >= 0.8 * (x | y).total() - 1e-9:
                    out.add(i)
                    break
    return out


def test_pipeline_equals_plain_stages(spark):
    docs = read(spark, "documents", SMALL)
    rows = {r["doc_id"]: r for r in docs.collect()}
    plain = PlainLanguages([(r["text"], r["lang"]) for r in rows.values() if not held_out(r["doc_id"]) and r["lang"] is not None])
    found = {i: plain.predict(r["text"]) for i, r in rows.items()}
    kept = {i: rows[i]["text"] for i, (lang, score) in found.items() if lang != "und" and score >= corpus_pipeline.LEAST_SCORE}
    staged = corpus_pipeline.identify_language(spark, docs, SMALL)
    assert {r["doc_id"]: r["lang"] for r in staged.collect()} == {i: found[i][0] for i in kept}
    kept = plain_lines(kept)
    staged = corpus_pipeline.dedup_lines(spark, staged, SMALL)
    assert {r["doc_id"]: r["text"] for r in staged.collect()} == kept
    groups = plain_groups(kept)
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    staged = corpus_pipeline.dedup_near(spark, staged.cache(), SMALL)
    assert {r["doc_id"] for r in staged.collect()} == set(kept)
    leaks = plain_leaks(kept, [r["text"] for r in read(spark, "benchmark", SMALL).collect()])
    kept = {i: t for i, t in kept.items() if i not in leaks}
    staged = corpus_pipeline.decontaminated(spark, staged.cache(), SMALL)
    assert {r["doc_id"] for r in staged.collect()} == set(kept) and leaks
    mixed = corpus_pipeline.mix(spark, staged.cache(), SMALL).collect()
    sizes = Counter()
    for i, t in kept.items():
        sizes[rows[i]["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    left, rest, want = sum(sizes.values()), set(sizes), {}
    while rest:
        level = left / sum(weights[s] for s in rest)
        full = {s for s in rest if 3 * sizes[s] <= level * weights[s]}
        want |= {s: 3 * sizes[s] for s in full} | ({} if full else {s: level * weights[s] for s in rest})
        left, rest = left - sum(3 * sizes[s] for s in full), rest - full if full else set()
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 < r["taken"] <= 3 * len(r["text"].split())
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted((r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted((r["doc_id"], r["taken"]) for r in mixed)


def test_keys_are_told_from_certificates():
    def der(tag, *parts):
        body = b"".join(parts)
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body

    number = der(2, bytes(range(1, 30)))
    algorithm, octets = der(0x30, der(6, b"\x2a\x86\x48\x86"), der(5)), der(4, bytes(range(40)))
    keys = {
        "PRIVATE KEY": der(0x30, der(2, b"\0"), algorithm, octets),
        "RSA PRIVATE KEY": der(0x30, der(2, b"\0"), *[number] * 8),
        "EC PRIVATE KEY": der(0x30, der(2, b"\1"), octets, der(0xA0, der(6, b"\x2a\x86\x48"))),
        "ENCRYPTED PRIVATE KEY": der(0x30, algorithm, octets),
    }
    certificate = der(0x30, der(0x30, der(0xA0, der(2, b"\2")), number, algorithm), algorithm, der(3, bytes(200)))
    public = der(0x30, algorithm, der(3, bytes(70)))
    pem = lambda label, data, head="": f"-----BEGIN {label}-----\n{head}{base64.encodebytes(data).decode()}-----END {label}-----"
    for label, data in keys.items():
        assert [k for k, _, _ in secret_scan.find_secrets(f"x {pem(label, data)} y")][:1] == ["pem"]
        assert "der" in [k for k, _, _ in secret_scan.find_secrets(base64.b64encode(data).decode())]
        assert "der" in [k for k, _, _ in secret_scan.find_secrets(data.hex().replace("a", "A"))]
    for data in (certificate, public, der(0x30, number, number), b"\x30\x82"):
        assert not secret_scan.is_der_key(data)
        assert not [k for k, _, _ in secret_scan.find_secrets(pem("CERTIFICATE", data)) if k in ("pem", "der", "ssh")]
    old = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    assert [k for k, _, _ in secret_scan.find_secrets(pem("RSA PRIVATE KEY", bytes(64), old))] == ["pem"]
    assert secret_scan.find_secrets(pem("RSA PRIVATE KEY", bytes(64))) == []
