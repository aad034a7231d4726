"""Readers, indexes, gates and writers on small trees, against hand-made and plain-Python results."""

import json
import posixpath
import re

import pytest
from pyspark.sql import functions as F

from paperloom.functions import paths as Q
from paperloom.functions import text as X
from paperloom.operators import changes as N
from paperloom.operators import enrich as E
from paperloom.operators import gate as G
from paperloom.operators import history as H
from paperloom.operators import indexes as I
from paperloom.operators import ingest as Y
from paperloom.operators import jobs as J
from paperloom.operators import pages as P
from paperloom.operators import rules as R
from paperloom.operators import tokens as K
from paperloom.sources import corpus as C
from paperloom.sources import exports as S
from paperloom.storage import checkpoint

PAGES = "store string, path string, content string"


def pages(spark, tree, store="s"):
    return spark.createDataFrame([(store, p, c) for p, c in tree.items()], PAGES)


def test_tree_and_log_readers(spark, tmp_path):
    for name in ("a.md", "sub/b.md", ".git/c.md", "node_modules/d.md", "sub/e.txt", "raw/f.md", "plans/g.md", "sub/_x/h.md"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(name)
    found = C.read_tree(spark, str(tmp_path / "t"), "s")
    assert sorted(r["path"] for r in found.collect()) == ["a.md", "plans/g.md", "raw/f.md", "sub/b.md"]
    profile = I.Profile(archive_dirs=("raw",), plans_root="plans")
    assert sorted(r["path"] for r in C.scan_pages(found, profile).collect()) == ["a.md", "sub/b.md"]
    (tmp_path / "log.jsonl").write_text('{"id": "a", "n": 1}\nbroken\n{"n": 2}\n{"id": "b", "n": 3}\n')
    assert sorted(r["id"] for r in C.read_jsonl(spark, str(tmp_path / "log.jsonl"), "id string, n long", "id").collect()) == ["a", "b"]


def test_export_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"store": "s", "commit": "c1", "ord": 1, "changes": [{"status": "A", "path": "x"}, {"status": "D", "path": "y"}]}))
    assert sorted((r["commit"], r["path"]) for r in S.read_changes(spark, str(tmp_path / "c.json")).collect()) == [("c1", "x"), ("c1", "y")]
    (tmp_path / "m.tsv").write_text("O\t5\t100644\tab\tp q\n")
    assert S.read_manifest(spark, str(tmp_path / "m.tsv"), "inventory").first()["path"] == "p q"
    (tmp_path / "reg.json").write_text('{\n"stores": {"a-b": "/x", "c": "/y", "d": "/z"}}')
    declared = spark.createDataFrame([("a-b", "a-b"), ("c", "other")], "store string, id string")
    assert sorted((r["store_id"], r["status"]) for r in S.read_stores(spark, str(tmp_path / "reg.json"), declared).collect()) == [("a-b", "ok"), ("c", "id-mismatch"), ("d", "root-missing")]
    for name, text in {"ok": '{"id": "x", "archiveTreeDirs": ["raw"]}', "odd": '{"id": "x", "more": 1}', "typed": '{"archiveTreeDirs": "raw"}'}.items():
        (tmp_path / "decl").mkdir(exist_ok=True)
        (tmp_path / "decl" / f"{name}.json").write_text(text)
    assert {r["store"]: r["problem"] for r in S.read_declarations(spark, str(tmp_path / "decl")).collect()} == {"ok": None, "odd": "unknown key more", "typed": "wrong type of archiveTreeDirs"}
    (tmp_path / "runs.json").write_text('{"store": "s", "at": "2024-01-01T00:00:00Z", "result": "ok"}\nx\n')
    assert S.read_backup_runs(spark, str(tmp_path / "runs.json")).count() == 1


def test_binaries_inbox_and_sidecars(spark, tmp_path):
    for name, data in {"a.txt": b"plain", "sub/b.HTML": b"<p>one</p><script>x</script>two", "c.bin": b"\x00", "bad.txt": b"\xff"}.items():
        (tmp_path / "b" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "b" / name).write_bytes(data)
    found = E.read_binaries(spark, str(tmp_path / "b"), "s", ["txt", "html"])
    assert sorted(r["path"] for r in found.collect()) == ["a.txt", "bad.txt", "sub/b.HTML"]
    made = {r["path"]: r["content"] for r in E.sidecar_pages(E.extract(found), "2024-01-01").collect()}
    assert made["sub/b.HTML.md"].endswith("\n\none\n two\n") and "## Warnings" in made["bad.txt.md"] and "## Warnings" not in made["a.txt.md"]
    with pytest.raises(Exception, match="no extractor"):
        E.extract(E.read_binaries(spark, str(tmp_path / "b"), "s", ["bin"])).collect()
    (tmp_path / "in").mkdir()
    for name in ("2.md", "1.txt", "x.pdf", ".done"):
        (tmp_path / "in" / name).write_text(f"text of {name}\nmore")
    assert [tuple(r) for r in E.read_inbox(spark, str(tmp_path / "in")).orderBy("name").collect()] == [("1.txt", "text of 1.txt\nmore"), ("2.md", "text of 2.md\nmore")]


def test_results_are_guarded_and_taken(spark):
    results = spark.createDataFrame([("r/1.md", 5, None, "One", "runbook"), ("r/2.md", 5, None, "Two", "x")], "path string, millis long, received string, title string, text string")
    tasks = spark.createDataFrame([(1, "r/1.md", "qa", None)], "id long, result string, qa string, signal string")
    empty = spark.createDataFrame([], "stamp string")
    none = spark.createDataFrame([], "path string, content string")
    projects = spark.createDataFrame([], "project string")
    guarded, made = J.ingest_results(results, tasks, results.select("path"), empty, none, projects, "2024-01-01")
    assert {r["path"]: r["reason"] for r in guarded.collect()} == {"r/1.md": None, "r/2.md": "missing-task-metadata"}
    got = {r["path"]: r["content"] for r in made.collect()}
    assert set(got) == {"learnings/1.md", "results/1.result.md"} and "runbook" in got["learnings/1.md"]


def test_commit_map(spark, tmp_path):
    a, b, zero = "a" * 40, "b" * 40, "0" * 40
    (tmp_path / "m").write_text(f"old new\n# x\n\n{a} {b}\n{b} {zero}\n")
    assert [tuple(r) for r in K.read_commit_map(spark, str(tmp_path / "m")).collect()] == [(a, b)]
    (tmp_path / "twice").write_text(f"{a} {b}\n{a} {a}\n")
    with pytest.raises(Exception, match="mapped twice"):
        K.read_commit_map(spark, str(tmp_path / "twice")).collect()


GLOBS = [
    ("*.tmp", "a/b.tmp", True), ("*.tmp", "a.tmp/b", True), ("*.tmp", "a.tmpx", False), ("/a", "a/b", True), ("/a", "b/a", False), ("a/b", "a/b/c", True), ("a/b", "x/a/b", False), ("a/", "a", False), ("a/", "x/a/b", True),
    ("**/c", "a/b/c", True), ("**/c", "c", True), ("a/**", "a/b/c", True), ("a/**/d", "a/d", True), ("a/**/d", "a/b/c/d", True), ("a**b", "aXb", True), ("a**b", "a/b", False), ("?.md", "x.md", True), ("?.md", "xy.md", False),
    ("[a-c]x", "bx", True), ("[!a]x", "ax", False), ("[^a]x", "bx", True), (r"\*x", "*x", True), (r"\*x", "ax", False), ("a.b", "axb", False), ("[", "[", True), ("x+(1)", "x+(1)", True),
]


def test_patterns(spark):
    row = spark.createDataFrame([(1,)], "n int").select(*[Q.match_patterns(F.lit(path), [glob]).alias(f"c{k}") for k, (glob, path, _) in enumerate(GLOBS)]).first()
    assert [row[k] is not None for k in range(len(GLOBS))] == [want for *_, want in GLOBS]
    first = spark.range(1).select(Q.match_patterns(F.lit("b/a.tmp"), ["*.tmp", "b/"]).alias("x"), Q.match_patterns(F.lit("B"), ["b"], True).alias("y"), Q.match_patterns(F.lit("a"), ["# no", " "]).alias("z")).first()
    assert tuple(first) == ("b/", "b", None)
    with pytest.raises(ValueError):
        Q.match_patterns(F.lit("a"), ["!a"])
    assert Q.rebased_patterns(("*.tmp", "a/b/", "/a", "# x", "", "b/ "), "/t/") == ["t/**/*.tmp", "t/a/b/", "t/a", "t/**/b/"]


def test_unicode_keys_and_checkout(spark):
    names = ["Straße", "STRASSE", "é", "é", "x͸", None, "İ", "a"]
    keys = [r["k"] for r in spark.createDataFrame([(n,) for n in names], "p string").select(Q.unicode_keys(F.col("p")).alias("k")).collect()]
    assert keys[0]["case_key"] == keys[1]["case_key"] and keys[2]["case_key"] == keys[3]["case_key"] and keys[2]["nfc"] == "é"
    assert keys[4]["unassigned"] and not keys[0]["unassigned"] and keys[5]["nfc"] is None
    rows = [b"ok/a", b"\xff", b".GIT /x", "é".encode(), b"a//b", b"x/" + b"n" * 256, b"d/" * 400 + b"x", "‌.git".encode()]
    frame = spark.createDataFrame([(r,) for r in rows], "p binary").select(Q.checkout_problems(F.col("p"), Q.unicode_keys(F.when(F.is_valid_utf8(F.col("p").cast("string")), F.col("p").cast("string")))).alias("x"))
    assert [r["x"] for r in frame.collect()] == [[], ["not-utf8"], ["dot-git"], ["not-nfc"], ["bad-component"], ["long-name"], ["long-path"], ["dot-git"]]


def test_ancestors_over_merges(spark):
    commits = spark.createDataFrame([("s", "d", "b", 4), ("s", "d", "c", 4), ("s", "b", "a", 2), ("s", "c", "a", 3), ("s", "a", None, 1), ("s", "x", None, 1)], "store string, commit string, parent string, ord int")
    updates = spark.createDataFrame([("s", "a", "d"), ("s", "b", "c"), ("s", "c", "d"), ("s", "a", "a"), ("s", "x", "d")], "store string, old string, new string")
    assert sorted((r["old"], r["new"]) for r in G.is_ancestor(updates, commits, checkpoint).collect()) == [("a", "a"), ("a", "d"), ("c", "d")]


TREE = {
    "top.md": "# Top\n\nTop text\n",
    "a/one.md": "---\ntitle: One\ndescription: The one, see [two](b/two.md#x)\n---\nbody\n",
    "a/b/two.md": "## Summary\n(draft)\n",
    "a/b/three.md": "---\ntitle: Three\n---\n# x\n\nText [gone](no.md) and [web](https://x.org)\n",
    "a/README.md": "# A\n\nAll of a.\n",
    ".git/x.md": "no",
    "_own/x.md": "no",
}


def plain_indexes(tree, profile):
    """The index pages of a tree, by passes over dictionaries."""
    tree = {p: c for p, c in tree.items() if not re.search(r"(^|/)[._]", p)}

    def parts(text):
        m = re.match(r"---\n(.*?)\n?---\n?(.*)", text, re.S)
        fields = dict(re.findall(r"^(\w+): (.*)$", m[1], re.M)) if m else {}
        return fields, (m[2] if m else text).strip()

    def summary(path, text):
        fields, body = parts(text)
        said = re.findall(r"^## Summary\n(.*?)(?=^## |\Z)", body, re.S | re.M)
        prose = [x.strip() for x in body.split("\n") if x.strip()]
        if path.endswith("README.md"):
            own = next((x for x in prose if not x.startswith(("#", "<!--"))), profile.empty_folder)
        else:
            own = " ".join([x for k, x in enumerate(prose) if not re.match(r"(##?#?|[-*])\s", x)][:3])
        found = fields.get("description") or (said[-1].strip() if said else "") or own or path.rsplit("/", 1)[-1][:-3]
        return profile.empty_summary if found.startswith("(") or not found else " ".join(found.split("\n"))

    def relative(base, to):
        base, to = [x for x in base.split("/") if x], to.split("/")
        k = 0
        while k < len(base) and k < len(to) - 1 and base[k] == to[k]:
            k += 1
        return "/".join([".."] * (len(base) - k) + to[k:])

    for _ in range(10):
        dirs = {"/".join(p.split("/")[:k]) for p in tree for k in range(p.count("/") + 1)}
        new = {}
        for d in dirs:
            readme = f"{d}/README.md" if d else "README.md"
            lines = []
            for p in tree:
                if p.rpartition("/")[0] == d and not p.endswith("README.md"):
                    fields, body = parts(tree[p])
                    head = re.search(r"^# (.+)$", body, re.M)
                    lines.append((False, p.rsplit("/", 1)[-1], fields.get("title") or (head and head[1]) or p.rsplit("/", 1)[-1][:-3], summary(p, tree[p]), p))
            for sub in dirs:
                if sub and sub.rpartition("/")[0] == d:
                    name = sub.rsplit("/", 1)[-1]
                    own = f"{sub}/README.md"
                    lines.append((True, f"{name}/README.md", f"{name}/", summary(own, tree.get(own, f"# {name}\n")), own))
            text = []
            for _, link, label, said, source in sorted(lines):
                def moved(m, source=source, d=d):
                    target, _, mark = m[2].partition("#")
                    if "://" in target:
                        return m[0]
                    at = posixpath.normpath("/".join([*source.split("/")[:-1], target]))
                    return f"[{m[1]}]({relative(d, at)}{'#' + mark if mark else ''})" if at in tree else m[1]

                text.append(f"- [{label}]({link}) — " + re.sub(r"\[([^\]]+)\]\(([^)]+)\)", moved, said))
            title = d.rsplit("/", 1)[-1] if d else "README"
            old = tree.get(readme, f"---\ntitle: {title}\nstatus: active\n---\n\n# {title}\n\n## Index\n\n<!-- index:start -->\n\n<!-- index:end -->\n")
            block = "<!-- index:start -->\n" + "\n".join(text) + "\n<!-- index:end -->"
            put = re.sub(r"(?s)<!-- index:start -->.*<!-- index:end -->", lambda m: block, old.rstrip()) if "index:start" in old else old.rstrip() + "\n\n## Index\n\n" + block
            if put + "\n" != tree.get(readme):
                new[readme] = put + "\n"
        if not new:
            return {p: c for p, c in tree.items() if p.endswith("README.md")}
        tree = tree | new


def test_index_fixed_point_equals_plain_passes(spark):
    profile = I.Profile()
    readmes, written, passes = I.index_fixed_point(pages(spark, TREE), profile, checkpoint)
    assert {r["path"]: r["content"] for r in readmes.collect()} == plain_indexes(TREE, profile)
    assert {r["path"]: r["created"] for r in written.collect()} == {"README.md": True, "a/README.md": False, "a/b/README.md": True} and passes > 1
    whole = pages(spark, {p: c for p, c in TREE.items() if not p.endswith("README.md")}).unionByName(readmes)
    assert I.index_pass(whole, profile).count() == 0 and I.stale_regions(I.index_lines(I.index_entries(whole, profile)), whole, profile).count() == 0
    broken = whole.withColumn("content", F.when(F.col("path") == "a/README.md", F.replace("content", F.lit("one.md"), F.lit("old.md"))).otherwise(F.col("content")))
    healed = {r["path"]: r["content"] for r in I.self_heal(broken, profile, checkpoint).collect()}
    assert healed["a/README.md"] == plain_indexes(TREE, profile)["a/README.md"]
    with pytest.raises(RuntimeError):
        I.index_fixed_point(pages(spark, TREE), profile, checkpoint, passes=1)


def test_navigation_candidates_and_pointers(spark):
    tree = pages(spark, {"a.md": "[b](b) [c](c) [C](C.md) [out](../x.md) [no](no) `t:d/` `t:d/e.md` `t:../x.md` `u:x.md` `v:x.md` `w:x.md` `t:e.txt`\n```\n`u:y.md`\n```", "b/README.md": "", "c.md": "", "b.md": ""})
    got = {r["target"]: (r["to"], r["code"]) for r in P.resolve_nav(P.links(tree), tree).collect()}
    assert got == {"b": ("b/README.md", None), "c": ("c.md", None), "C.md": (None, "case-mismatch"), "../x.md": (None, "out-of-root"), "no": (None, "broken-link")}
    files = spark.createDataFrame([("t", "d/e.md")], "store string, path string")
    stores = spark.createDataFrame([("t", "ok"), ("v", "root-missing"), ("w", "id-mismatch")], "store string, status string")
    assert {r["raw"]: r["code"] for r in P.pointers(tree, stores, files).collect()} == {"t:d/": "ok", "t:d/e.md": "ok", "t:../x.md": "invalid", "u:x.md": "unknown-store", "v:x.md": "root-missing", "w:x.md": "registry-mismatch"}
    got = N.get_pages(spark.createDataFrame([("s", "t:d/e"), ("s", "c"), ("s", "b"), ("s", "z")], "store string, wanted string"), tree.select("store", "path").union(files))
    assert {r["wanted"]: r["path"] for r in got.collect()} == {"t:d/e": "d/e.md", "c": "c.md", "b": "b.md", "z": None}


def test_schema_and_ledger_rules(spark):
    schema = "# Schema\n## Special Files\n### 1) `decisions.md`\ntype: special/decisions\nwho: somebody\n### 2) `other.md`\nx\n## End\n### 3) `late.md`\n"
    tree = pages(spark, {"schema.md": schema, "dispatch-log.md": "---\ntitle: Dispatch Log\n---\n## Entries\n- 2024-01-01T00:00:00Z | a=1\n- broken\nno entry\n"})
    profile = I.Profile()
    got = sorted((r["file"], r["code"], r["detail"]) for r in R.schema_issues(tree, profile, {"decisions.md": "user-direct", "dispatch-log.md": "hook"}).collect())
    assert got == [("decisions.md", "schema-writer-mismatch", ""), ("dispatch-log.md", "schema-missing-file", ""), ("schema.md", "schema-runtime-special-file-mismatch", "dispatch-log.md,other.md")]
    assert [r["detail"] for r in R.ledger_issues(R.checked_pages(tree, profile)).collect()] == ["- broken"]
    wanted = spark.createDataFrame([("s", "schema.md"), ("s", "gone.md")], "store string, path string")
    assert [r["file"] for r in R.missing_files(wanted, tree).collect()] == ["gone.md"]


def test_write_if_changed(spark, tmp_path):
    rows = lambda d: spark.createDataFrame(list(d.items()), "path string, content string")
    put = lambda d, **kw: sorted((r["path"], r["created"]) for r in N.write_if_changed(spark, rows(d), f"{tmp_path}/out", ["path"], "content", **kw).collect())
    assert put({"a": "1", "b": "1"}, check=True) == [("a", True), ("b", True)]
    assert put({"a": "1", "b": "1"}) == [("a", True), ("b", True)]
    assert put({"a": "2", "b": "1", "c": "1"}) == [("a", False), ("c", True)]
    assert put({"a": "2", "b": "1", "c": "1"}) == [] == put({"a": "2"}, check=True)


def test_change_log_and_related(spark):
    one = lambda column, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(column.alias("x")).first()["x"]
    log = Y.append_log(F.col("c"), "# Log", "2024-01-02", F.lit("- INGEST: a → b"))
    assert one(log, c=None) == "# Log\n\n## 2024-01-02\n- INGEST: a → b\n"
    text = "# Log\n\n## 2024-01-02\n- INIT: x\n\n## 2024-01-03\n- y\n"
    assert one(log, c=text) == "# Log\n\n## 2024-01-02\n- INIT: x\n- INGEST: a → b\n\n## 2024-01-03\n- y\n"
    assert one(P.related_section(F.col("s"), F.array(F.lit("b"), F.lit("c"))), s="- a\n- b") == "- a\n- b\n- c"
    done = spark.createDataFrame([("x.md", "p.md", "passed"), ("y", "q.md", None)], "source string, path string, verdict string")
    assert [r["line"] for r in Y.ledger_rows(done, "INGEST", "2024-01-01").collect()] == ["- INGEST: x.md → p.md (qa: passed)", "- INGEST: y → q.md"]


def test_final_map_and_retention_states(spark):
    files = spark.createDataFrame([("a", 1, b"x"), ("b", 1, b"x"), ("c", 2, None)], "path string, inode long, content binary")
    cache = spark.createDataFrame([("a", 1, "cached", "blob")], "path string, inode long, oid string, blob string")
    got = N.final_map(files, cache, ["path", "inode"], "content")
    assert {r["path"]: (r["oid"][:6], r["hashed"]) for r in got.collect()} == {"a": ("cached", False), "b": ("2d7116", True), "c": ("e3b0c4", True)}
    assert tuple(N.unique_totals(got.withColumn("size", F.lit(5)), "size").first()) == (3, 3, 15)
    snaps = spark.createDataFrame([("s1", 10, True), ("s2", 500, True), ("s3", 10, False)], "id string, at long, tagged boolean")
    plan = lambda **kw: sorted((r["id"], r["state"], r["forget"]) for r in N.retention_plan(snaps, F.col("tagged"), "at", **kw).collect())
    assert plan(clock_started=None, retention_days=1, now=0)[0] == ("s1", "clock-not-started", False)
    assert plan(clock_started=100, retention_days=1, now=200)[0] == ("s1", "keeping", False)
    assert plan(clock_started=100, retention_days=1, now=100_000) == [("s1", "expired", True), ("s2", "expired", False)]
    assert plan(clock_started=5, retention_days=1, now=100_000)[0] == ("s1", "deleted", False)


def test_extension_samples_and_strip_report(spark):
    rows = spark.createDataFrame([(f"d/{k}.{e}", e, k, k % 2 == 0, k % 3 == 0) for e in ("png", "pdf") for k in range(9)], "path string, ext string, size long, mapped boolean, kept boolean")
    got = {r["ext"]: r["samples"] for r in H.extension_samples(rows, "ext", "path").collect()}
    assert got == {e: [f"d/{k}.{e}" for k in range(3)] for e in ("png", "pdf")}
    report = {r["ext"]: tuple(r)[1:] for r in H.strip_report(rows, "ext", "size", F.col("mapped"), F.col("kept")).collect()}
    assert report == {"png": (9, 36, 5, 3), "pdf": (9, 36, 5, 3), None: (18, 72, 10, 6)}


def test_brackets_in_titles_do_not_break_regions(spark):
    frame = spark.createDataFrame([("- [[x] y](a.md) — s",)], "c string")
    assert frame.select(X.region_targets(F.col("c")).alias("x")).first()["x"] == ["a.md"]
