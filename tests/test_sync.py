"""Index pages that follow a stream of changes, against whole passes over dictionaries."""

from pyspark.sql import functions as F
from test_corpus import TREE, plain_indexes

from paperloom.operators import indexes as I
from paperloom.plans import indexes, sync
from paperloom.streaming import sync as S

PROFILE = I.Profile()
#: Changes one batch after the other; null is a deletion.
BATCHES = [
    {"a/one.md": "---\ntitle: Uno\ndescription: Now with [no](b/no.md)\n---\nbody\n", "a/b/no.md": "# No\n\nIt is [here](../../top.md).\n", "a/b/two.md": None, "nowhere.md": None},
    {"c/d/e.md": "# E\n\nSee [readme](../README.md).\n", "_own/y.md": "no", "a/README.md": "# A\n\nAll of a, and [c](../c/README.md).\n"},
    {"c/d/e.md": None, "c/d/README.md": None, "c/README.md": None, "top.md": "# Top\n\nNew [c](c/README.md)\n", "a/b/README.md": None},
    {"schema.md": "# Schema\n", "a/b/three.md": None},
]


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def test_changes_end_where_whole_passes_end(spark, tmp_path):
    folder, tree = str(tmp_path), dict(TREE)
    here = lambda: frame(spark, [("s", p, c) for p, c in tree.items()], "store string, path string, content string")
    S.start_state(here(), PROFILE, folder, buckets=8)
    tree |= plain_indexes(tree, PROFILE)
    for number, batch in enumerate(BATCHES):
        before = {p: c for p, c in tree.items() if p.endswith("README.md")}
        for path, content in batch.items():
            tree.pop(path, None) if content is None else tree.update({path: content})
        changes = frame(spark, [("s", p, c, "missing" if c is None else "file") for p, c in batch.items()], S.CHANGE)
        report = S.apply_changes(changes, number, folder, PROFILE, here, buckets=8).collect()
        if number == 1:  # a batch that runs once more
            again = S.apply_changes(changes, number, folder, PROFILE, here, buckets=8)
            assert [r["path"] for r in again.collect()] == [r["path"] for r in report]
        want = plain_indexes(tree, PROFILE)
        tree |= want
        got = {r["path"]: r["content"] for r in S.current_indexes(spark, folder, 8).collect()}
        assert got == want, number
        assert {r["mode"] for r in report} == {"full" if "schema.md" in batch else "incremental"}
        assert {r["path"] for r in report if r["path"]} >= {p for p, c in want.items() if {**before, **batch}.get(p) != c}



def test_other_folders_are_not_read(spark, tmp_path, monkeypatch):
    rows = [(s, f"{x}/{y}/p{k}.md", f"# P {k}\n") for s in ("s", "t") for x in "abc" for y in "uvw" for k in range(3)]
    S.start_state(frame(spark, rows, "store string, path string, content string"), PROFILE, str(tmp_path), buckets=4096)
    read = set()
    inner = S.IndexState._buckets
    monkeypatch.setattr(S.IndexState, "_buckets", lambda self, name, chosen: inner(self, name, [b for b in chosen if not read.add((name, b))]))
    change = frame(spark, [("s", "a/u/p1.md", "# New\n", "file")], S.CHANGE)
    report = S.apply_changes(change, 0, str(tmp_path), PROFILE, lambda: 1 / 0, buckets=4096).collect()
    assert [(r["store"], r["path"], r["created"]) for r in report] == [("s", "a/u/README.md", False)]
    number = lambda store, folder: frame(spark, [(store, folder)], "store string, dir string").select(S.IndexState(spark, "", 4096, 0, {}).bucket(F.col("dir"))).first()[0]
    chain = {number("s", d) for d in ("", "a", "a/u")}
    assert {b for name, b in read if name in ("entries", "readmes")} == chain
    others = {number("s", d) for d in ("a/v", "b/u", "c")} | {number("t", "a/u")}
    assert not others & {b for name, b in read if name != "files"}  # files are also looked up where summaries link to


def test_last_change_of_a_path_counts_and_stores_are_kept_apart(spark, tmp_path):
    pages = frame(spark, [("s", "a/x.md", "# X\n"), ("t", "a/x.md", "# X\n")], "store string, path string, content string")
    S.start_state(pages, PROFILE, f"{tmp_path}/state", buckets=4)
    rows = [("s", "a/x.md", "# Y\n", "file", 1), ("s", "a/x.md", None, "missing", 2), ("t", "a/x.md", None, "missing", 1), ("t", "a/x.md", "# Z\n", "file", 2), ("t", "b", "", "directory", 3)]
    frame(spark, rows, f"{S.CHANGE}, ord int").write.parquet(f"{tmp_path}/changes")
    stream = spark.readStream.schema(f"{S.CHANGE}, ord int").parquet(f"{tmp_path}/changes")
    now = lambda: frame(spark, [("s", "a/q.md", ""), ("t", "a/x.md", "# Z\n")], "store string, path string, content string")
    report = {(r["store"], r["mode"], r["reason"]) for r in S.sync_changes(stream, f"{tmp_path}/state", PROFILE, now, buckets=4).collect()}
    assert report == {("s", "incremental", "changed-paths"), ("t", "full", "non-file-change:b")}
    got = {(r["store"], r["path"]): r["content"] for r in S.current_indexes(spark, f"{tmp_path}/state", 4).collect()}
    assert "[X]" not in got["s", "a/README.md"] and "[Y]" not in got["s", "a/README.md"] and "[Z](x.md)" in got["t", "a/README.md"]


def test_incremental_and_whole_agree_on_a_corpus(spark):

    data = "/root/testdata/sf0.001"
    whole = {(r["store"], r["path"]): r["content_md5"] for r in indexes.QUERIES["index_fixed_point"](spark, data).collect()}
    part = {(r["store"], r["path"]): r["content_md5"] for r in sync.QUERIES["incremental_sync"](spark, data).collect()}
    assert {k: part[k] for k in whole} == whole
