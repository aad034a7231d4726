"""Frontmatter in both dialects, written back and changed field by field; regions and summaries of pages."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import frontmatter as M
from paperloom.functions import text as X


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first()["x"]


PAGE = """---
title: 'A page'
tags: [a, "b c", 'd', "q \\" u"]
list:
  - one
  - "two"
empty:
title: "Later"
note: plain: text
---

# Head

Body
"""


def test_derived_dialect(spark):
    got = one(spark, M.parse(M.split_derived(F.col("c"))["block"]), c=PAGE)
    found = {r["key"]: r["items"] if r["listed"] else r["text"] for r in got}
    assert found == {"title": "Later", "tags": ["a", "b c", "d", 'q " u'], "list": ["one", "two"], "empty": [], "note": "plain: text"}
    assert [r["key"] for r in got] == ["title", "tags", "list", "empty", "note"]
    parts = M.split_derived(F.col("c"))
    assert one(spark, parts["body"], c=PAGE) == "# Head\n\nBody"
    assert one(spark, parts["has"], c="---\na: b\n") is False and one(spark, parts["body"], c="---\na: b\n") == "---\na: b"
    assert one(spark, parts["has"], c=" --- \na: b\n ---") is True
    assert one(spark, parts["body"], c=None) == ""


def test_checked_dialect(spark):
    parts = M.split_checked(F.col("c"))
    got = one(spark, M.parse_checked(parts["block"]), c="---\na key: 'v'\nlist:\n- x\n- y\nb: 1\n- c: 2\n---\n\nbody")
    assert [(r["key"], r["text"], r["listed"]) for r in got] == [("a key", "'v'", False), ("list", "", True), ("b", "1", False), ("- c", "2", False)]
    assert one(spark, M.checked_text(M.parse_checked(parts["block"]), "a key"), c="---\na key: 'v'\n---") == "v"
    assert one(spark, parts["has"], c=" ---\na: b\n---") is False
    assert one(spark, parts["has"], c="---\na: b") is True and one(spark, parts["body"], c="---\na: b") == ""
    assert one(spark, parts["body"], c="---\n---\n\n\ntext") == "text"


def test_round_trip(spark):
    block = M.split_derived(F.col("c"))["block"]
    text = one(spark, M.serialize(M.parse(block)), c=PAGE)
    assert text == '---\ntitle: Later\ntags: [a, "b c", d, "q \\" u"]\nlist: [one, two]\nempty: []\nnote: plain: text\n---'
    assert one(spark, M.serialize(M.parse(M.split_derived(F.col("c"))["block"])), c=text) == text


def test_upsert_replaces_named_fields_only(spark):
    new = {"list": M.inline_list(F.array(F.lit("x y"))), "description": F.lit("cost $1 \\ 2")}
    got = one(spark, M.upsert(F.col("c"), new), c=PAGE)
    want = PAGE.replace('list:\n  - one\n  - "two"\n', 'list: ["x y"]\n').replace("note: plain: text\n", "note: plain: text\ndescription: cost $1 \\ 2\n")
    assert got == want
    assert one(spark, M.upsert(F.col("c"), new), c=got) == got
    only = {"a": F.lit("1")}
    assert one(spark, M.upsert(F.col("c"), only), c="\n\ntext") == "---\na: 1\n---\n\ntext"
    assert one(spark, M.upsert(F.col("c"), only), c="---\nb: 2\ntext") == "---\na: 1\n---\n\nb: 2\ntext"
    assert one(spark, M.upsert(F.col("c"), only), c="---\n---\n") == "---\na: 1\n---\n"


def test_sources_and_tags(spark):
    of = M.sources(M.parse(M.split_derived(F.col("c"))["block"]))
    assert one(spark, of, c="---\nsources: [a, b]\nsource: c\n---\n") == ["a", "b"]
    assert one(spark, of, c="---\nsources: []\nsource: c\n---\n") == ["c"]
    assert one(spark, of, c="---\nsourcePath: p\n---\n") == ["p"] and one(spark, of, c="none") == []
    assert one(spark, M.merge_tags(F.split("a", ","), F.split("b", ",")), a="x, y", b="y,z,") == ["x", "y", "z"]
    assert one(spark, M.infer_tags(F.col("s"), F.col("p"), F.col("g")), s="memos", p=None, g="Fix_it-now-memos") == ["memos", "fix", "now"]


def test_regions(spark):
    text = "a\n<!-- r:start -->\nold\n<!-- r:end -->\nb\n<!-- r:start -->\nmore\n<!-- r:end -->\n\n"
    assert one(spark, X.region(F.col("c"), "r"), c=text) == "old"
    assert one(spark, X.replace_region(F.col("c"), "r", F.lit("new $1"), "Index"), c=text) == "a\n<!-- r:start -->\nnew $1\n<!-- r:end -->\n"
    assert one(spark, X.replace_region(F.col("c"), "r", F.lit("x"), "Index"), c="t") == "t\n\n## Index\n\n<!-- r:start -->\nx\n<!-- r:end -->\n"
    assert one(spark, X.strip_region(F.col("c"), "r"), c=text).startswith("a\n\nb\n")
    assert one(spark, X.region_targets(F.col("c")), c="- [a](z%20x.md) — s\n- [[b] c](a.md)\n no [d](e.md)\n- [f](g.md) tail") == ["a.md", "z x.md"]


def test_code_and_links(spark):
    assert one(spark, X.link_targets(F.col("c")), c="[a](1)\n  ~~~\n[b](2)\n~~~\n`[c](3)` [d [e] f](4) \\[g](5)\n```\n[h](6)") == ["1", "4"]
    long = "[" + "x" * 200_000 + "\n" + "```\n" + "line\n" * 50_000 + "```\n[a](b)"
    assert one(spark, X.link_targets(F.col("c")), c=long) == ["b"]


@pytest.mark.parametrize("text, want", [("## Summary\n- x\nOne\nTwo\n## D\nno", "One Two"), ("# T\n\nFirst\n## H\n- l\nSecond", "First Second"), ("## Summary\nold\n## Summary\nnew", "new"), ("", "F")])
def test_summaries(spark, text, want):
    assert one(spark, X.summary_section(F.col("c"), F.lit("F")), c=text) == want


def test_names(spark):
    assert one(spark, X.file_slug(F.col("c")), c=" Über Uns.RESULT") == "ber-uns" and one(spark, X.file_slug(F.col("c")), c="!") == "untitled"
    assert one(spark, X.stem(F.col("c")), c="a/b.result.md") == "b" and one(spark, X.humanize(F.col("c")), c="a-b_c") == "a b c"
    assert tuple(one(spark, X.path_parts(F.col("c")), c="a/b/c.TAR.GZ")) == ("a/b", "c.TAR.GZ", "gz", 2)
    assert one(spark, X.blob_sha1(F.col("c").cast("binary")), c="hello\n") == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert one(spark, X.intro(F.col("c")), c="# T\n<!-- x -->\n\n A  b\nc") == "A b"
    assert one(spark, X.is_datetime(F.col("c")), c="2024-01-01T10:00:00Z") is True and one(spark, X.is_datetime(F.col("c")), c="2024-01-01") is False
    assert one(spark, X.parse_ledger_line(F.col("c"))["fields"], c="- t | a=1 | b=x=y | a=2 | none") == {"a": "2", "b": "x=y"}
