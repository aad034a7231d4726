"""Page text functions on the shapes that pages come in."""

import random

from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import history as H
from paperloom.operators import pages as P
from paperloom.operators import snapshots as S


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_links_skip_code_and_take_nested_brackets(spark):
    text = "[a](b.md) `[c](d.md)` \\[e](f.md) [x [y]](z.md)\n```\n[g](h.md)\n```\n![i](j.png)"
    assert one(spark, text, X.link_targets) == ["b.md", "z.md", "j.png"]


def test_clean_target(spark):
    assert one(spark, "a%20b+c.md#top", X.clean_target) == "a b+c.md"
    assert one(spark, "bad%zz.md", X.clean_target) == "bad%zz.md"
    assert one(spark, 'a.md "title"', X.clean_target) == "a.md"


def test_resolve(spark):
    assert one(spark, "../c/./d.md", lambda t: X.resolve(F.lit("a/b"), t)) == "a/c/d.md"
    assert one(spark, "../../../d.md", lambda t: X.resolve(F.lit("a/b"), t)) is None
    assert one(spark, "d.md", lambda t: X.resolve(F.lit(""), t)) == "d.md"


def test_frontmatter_and_body(spark):
    page = "---\ntitle: A\n---\n\n# B \n"
    assert one(spark, page, X.frontmatter_block) == "title: A\n"
    assert one(spark, page, X.body) == "# B"
    assert one(spark, "---\ntitle: A\n", X.frontmatter_block) == ""


def test_frontmatter_last_key_wins_and_null_content(spark):
    pages = spark.createDataFrame([("s", "p", "---\na: 1\na: 2\n---\n"), ("s", "q", None)], "store string, path string, content string")
    assert [tuple(r) for r in P.frontmatter_fields(pages).collect()] == [("s", "p", "a", "2")]
    assert P.links(pages).count() == 0
    assert P.sections(pages).count() == 0


def test_rolling_growth_is_strict_at_a_day(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 86_400, 5), ("a", 85_800, 1)], "k string, s long, b long")
    got = {r["bucket"]: r["bytes_24h"] for r in H.rolling_growth(rows, "k", "s", "b").collect()}
    assert got == {0: 10, 85_800: 11, 86_400: 6}


def plain_diff3(base, ours, theirs):
    """Three-way merge by longest common subsequences from full tables."""

    def lcs(a, b):
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
        i = j = 0
        found = []
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                found.append((i, j))
                i, j = i + 1, j + 1
            elif n[i + 1][j] >= n[i][j + 1]:
                i += 1
            else:
                j += 1
        return found

    o, t = dict(lcs(base, ours)), dict(lcs(base, theirs))
    out, b0, o0, t0 = [], 0, 0, 0
    for k in [*sorted(o.keys() & t.keys()), len(base)]:
        ok, tk = o.get(k, len(ours)), t.get(k, len(theirs))
        b, x, y = base[b0:k], ours[o0:ok], theirs[t0:tk]
        if x == b or x == y:
            out += y
        elif y == b:
            out += x
        else:
            i = j = 0
            for p, q in [*lcs(x, y), (len(x), len(y))]:
                out += x[i:p] + y[j:q] + x[p : p + 1]
                i, j = p + 1, q + 1
        out += base[k : k + 1]
        b0, o0, t0 = k + 1, ok + 1, tk + 1
    return out


def test_union_merge_equals_plain(spark):
    rng, rows = random.Random(4), []
    for _ in range(60):
        base = [f"l{k}" for k in range(rng.randrange(12))]

        def side(base=base):
            out = [x for x in base if rng.random() > 0.2]
            for _ in range(rng.randrange(4)):
                out.insert(rng.randrange(len(out) + 1), f"n{rng.randrange(6)}")
            return out

        rows.append((base, side(), side()))
    text = lambda x: "".join(f"{y}\n" for y in x)
    frame = spark.createDataFrame([(text(b), text(o), text(t), text(plain_diff3(b, o, t))) for b, o, t in rows] + [(None, "a\n", None, "a\n"), (None, None, None, ""), ("x", "x\ny", "z", "x\ny\nz")], "b string, o string, t string, want string")
    assert [(r["got"], r["want"]) for r in S.union_merge(frame, "b", "o", "t", "got").collect() if r["got"] != r["want"]] == []


def test_text_of_notes(spark):
    rows = spark.createDataFrame([("# A\r\n## B c\n#no\n##### D",), ("",), (None,)], "x string")
    got = [tuple(r) for r in rows.select(X.demote_headings(F.col("x")), X.strip_leading_title(F.col("x")), X.sanitize_description(F.col("x")), X.short_error(F.col("x"))).collect()]
    assert got == [("### A\n#### B c\n#no\n###### D", "## B c\n#no\n##### D", "A", "# A"), ("", "", "", ""), (None, None, "", "")]
    tokens = spark.createDataFrame([("'Ab', ab\n[x y],, \"\" ,c,d",), (None,)], "x string").select(X.sanitize_tokens(F.col("x"), 3, 40)).collect()
    assert [r[0] for r in tokens] == [["Ab", "x y", "c"], []]


def test_dates_numbers_and_remarks(spark):
    rows = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), (" 7 ",), ("7.5",), ("(none yet)",), (None,)], "x string")
    x = F.col("x")
    assert [r[0] for r in rows.select(X.is_date(x)).collect()] == [True, False, False, False, False, False]
    assert [r[0] for r in rows.select(X.is_integer(x, 7)).collect()] == [False, False, True, False, False, False]
    assert [r[0] for r in rows.select(X.is_placeholder(x)).collect()] == [False, False, False, False, True, None]


def test_ledger_lines_there_and_back(spark):
    line = X.ledger_line(F.lit("2024-01-01"), {"a": F.lit(" 1 "), "b": F.lit(""), "c": F.lit(None), "d": F.lit("x=y")})
    row = spark.range(1).select(line.alias("l")).select("l", X.parse_ledger_line(F.col("l")).alias("p"), X.parse_ledger_line(F.lit("- t | a=1 | a=2")).alias("twice"), X.parse_ledger_line(F.lit("t")).alias("none")).first()
    assert row.l == "- 2024-01-01 | a=1 | d=x=y"
    assert (row.p["at"], row.p["fields"]) == ("2024-01-01", {"a": "1", "d": "x=y"})
    assert row.twice["fields"] == {"a": "2"} and row.none is None


def test_ancestors_and_bullets(spark):
    row = spark.range(1).select(X.ancestors(F.lit("a/b/c.md")), X.ancestors(F.lit("c.md")), X.bullets(F.lit("- x\ny\n - z"))).first()
    assert tuple(row) == (["", "a", "a/b"], [""], ["x", "z"])


def test_trim_does_not_try_every_run_of_blanks(spark):
    blanks = " \t\n\x0b\f\r\u00a0\ufeff"
    rows = [("a", f"{blanks}a{blanks}b{blanks}"), ("b", blanks), ("c", ""), ("d", None), ("e", "\u2003x\u2003")]
    got = spark.createDataFrame(rows, "k string, text string").select("k", X.trim(F.col("text")).alias("x"))
    assert {r["k"]: r["x"] for r in got.collect()} == {"a": f"a{blanks}b", "b": "", "c": "", "d": None, "e": "\u2003x\u2003"}
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
