"""Scans over keys that hold all rows, and folds of JSON lines, against loops."""

import json
import random
import re

from pyspark.sql import functions as F

from paperloom.operators import changes as C
from paperloom.operators import gate as G
from paperloom.operators import history as H
from paperloom.operators import ingest as N
from paperloom.operators import scans
from paperloom.operators import snapshots as S
from paperloom.operators import tokens as K
from paperloom.operators import upkeep as U
from paperloom.plans.history import files
from paperloom.storage import checkpoint, loop_checkpoint


def test_scans_over_one_key_and_many(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), at, rng.choice([None, 1, 5, -2])) for at in rng.sample(range(10_000), 1_000)]
    ranged = scans.ranges(spark.createDataFrame(rows, "k string, at int, v int"), ["k"], ["at"], 16)
    assert ranged.filter("k = 'hot'").select("_range").distinct().count() > 4
    got = scans.running_sum(ranged, ["k"], ["at"], F.col("v"), "upto")
    got = scans.running_sum(got, ["k"], ["at"], F.col("v"), "before", inclusive=False)
    got = scans.previous(scans.numbered(got, ["k"], ["at"], "n"), ["k"], ["at"], "v", "last")
    sums, numbers, last, want = {}, {}, {}, []
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        before = sums.get(k, 0)
        sums[k], numbers[k] = before + (v or 0), numbers.get(k, 0) + 1
        want.append((k, at, v, sums[k], before, numbers[k], last.get(k)))
        last[k] = v
    assert sorted(map(tuple, scans.plain(got).collect()), key=lambda r: r[1]) == want
    assert scans.plain(scans.numbered(scans.ranges(spark.createDataFrame([], "k string, at int"), ["k"], ["at"]), ["k"], ["at"], "n")).count() == 0


def test_operators_over_one_key(spark):
    rows = spark.range(2_000).select(F.lit("hot").alias("k"), F.col("id").alias("at"), F.lit(1).alias("size"))
    assert [r["at"] for r in S.cap(rows, "k", ["at"], 3).filter("within").collect()] == [0, 1, 2]
    assert S.evict_until(rows, "k", ["at"], "size", 500).agg(F.count("*"), F.max("at")).first()[:] == (1_500, 1_499)
    seen = spark.createDataFrame([("hot", 10)], "k string, seq long")
    assert H.assign_seq(rows, "k", ["at"], seen).filter("seq <> at + 11").count() == 0
    runs = H.alarm_onset(rows, "k", ["at"], F.col("at") % 500 >= 400, "at").orderBy("since").collect()
    assert [(r["since"], r["until"], r["samples"]) for r in runs] == [(k + 400, k + 499, 100) for k in range(0, 2_000, 500)]


def test_fold_of_json_lines(spark):
    lines = ['{"id": "a", "status": "open", "x": {"y": [1]}}', "no", '{"id": "b", "status": "open"}', '{"id": 0, "status": "open"}', '{"id": null}', "[1]", None, '{"id": "a", "x": null}', '{"id": "b", "status": null}', '{"id": "a", "new key": 1.5}', '{"id": "0", "status": "open"}', "{}"]
    frame = spark.createDataFrame(list(enumerate(lines)), "at int, line string")
    want = {}
    for line in lines:
        try:
            row = json.loads(line)
        except (TypeError, ValueError):
            continue
        if isinstance(row, dict) and row.get("id"):
            want.setdefault(row["id"], {}).update(row)
    folded = H.fold_json(frame, "line", ["at"])
    assert {r["id"]: {k: json.loads(v) for k, v in r["fields"].items()} for r in folded.collect()} == want
    assert [(r["id"], r["first_seen"]["at"]) for r in H.open_conflicts(folded).collect()] == [("a", 0), ("0", 10)]


def test_ancestry_of_a_long_chain_takes_few_rounds(spark):
    n, rounds = 20_000, []
    commits = spark.range(n).select(F.lit("s").alias("store"), F.col("id").cast("string").alias("commit"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"), F.col("id").alias("ord"))
    merge = spark.createDataFrame([("s", "x", "5", 10**6), ("s", "y", "x", 10**6 + 1), ("s", "y", str(n - 1), 10**6 + 1)], "store string, commit string, parent string, ord long")
    updates = spark.createDataFrame([("s", "0", str(n - 1)), ("s", str(n - 1), "0"), ("s", "7", "x"), ("s", "5", "x"), ("s", "x", "y"), ("s", "12345", "y"), ("s", "no", "y")], "store string, old string, new string")
    keep = lambda df: rounds.append(1) or checkpoint(df)
    got = sorted((r["old"], r["new"]) for r in G.is_ancestor(updates, commits.union(merge), keep).collect())
    assert got == [("0", str(n - 1)), ("12345", "y"), ("5", "x"), ("x", "y")] and len(rounds) < 40


def test_ancestry_meets_only_branches_between_both_commits(spark):
    n, sizes = 3_000, []
    m, s = F.concat(F.lit("m"), "id"), F.concat(F.lit("s"), "id")
    row = lambda df, c, p, at: df.select(F.lit("h").alias("store"), c.alias("commit"), p.alias("parent"), at.alias("ord"))
    ids = spark.range(n)
    commits = row(ids, m, F.when(F.col("id") > 0, F.concat(F.lit("m"), F.col("id") - 1)), F.col("id") * 2)
    tenth = spark.range(0, n - 2, 10)
    commits = commits.union(row(tenth, s, m, F.col("id") * 2 + 1)).union(row(tenth, F.concat(F.lit("m"), F.col("id") + 2), s, F.col("id") * 2 + 4))
    updates = tenth.select(F.lit("h").alias("store"), s.alias("old"), F.concat(F.lit("m"), F.col("id") + 2).alias("new"))
    updates = updates.union(tenth.select(F.lit("h"), s, F.concat(F.lit("m"), F.col("id") + 1)))

    def keep(df):
        sizes.append(df.count())
        return loop_checkpoint(df)

    got = {(r["old"], r["new"]) for r in G.is_ancestor(updates, commits, keep).collect()}
    assert got == {(f"s{k}", f"m{k + 2}") for k in range(0, n - 2, 10)}
    assert max(sizes) < 5 * commits.count()


def test_a_commit_named_zero_is_no_deletion(spark):
    updates = spark.createDataFrame([("a", "refs/heads/main", "8", "0", None), ("b", "refs/heads/main", "8", "0" * 40, None)], "store string, ref string, old string, new string, role string")
    forward = updates.select("store", "old", "new").limit(0)
    assert {(r["store"], r["problem"]) for r in G.ref_problems(updates, forward).collect()} == {("a", "not-fast-forward"), ("b", "deletes-main")}


def test_short_names_mean_commits_of_their_own_store(spark):
    one, two = "abcdef0" + "1" * 33, "abcdef0" + "2" * 33
    frame = lambda rows, columns: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split()))
    objects = frame([("a", one, "commit"), ("b", two, "blob"), ("c", one, "commit"), ("c", two, "commit")], "store sha type")
    mapped, targets = frame([("a", one, "9" * 40), ("c", one, "9" * 40)], "store old new"), frame([("a", "9" * 40, "commit"), ("c", "9" * 40, "commit")], "store sha type")
    tokens = frame([(s, "abcdef0") for s in "abc"], "store token")
    found = K.decide(tokens, objects, mapped, targets, key=("store",)).collect()
    assert {(r["store"], r["replace"], r["review"]) for r in found} == {("a", "9" * 7, None), ("b", None, None), ("c", None, "ambiguous-from")}


def test_sampled_commits(spark):
    commits = spark.range(2_000).select(F.when(F.col("id") < 1_900, "a").otherwise("b").alias("store"), F.concat(F.lit("c"), "id").alias("commit"), F.col("id").alias("ord"))
    odd = spark.createDataFrame([("a", "c700"), ("a", "no")], "store string, commit string")
    rows = [(r["store"], r["place"]) for r in U.sampled_commits(commits, odd).collect()]
    a = sorted(p for s, p in rows if s == "a")
    assert len(set(rows)) == len(rows) and sum(s == "b" for s, _ in rows) == 100 and len(a) in (300, 301) and 701 in a
    assert a[:50] == list(range(1, 51)) and a[-50:] == list(range(1_851, 1_901))
    assert sorted(rows) == sorted((r["store"], r["place"]) for r in U.sampled_commits(commits, odd).collect())


def test_null_is_a_value_of_a_snapshot(spark):
    side = lambda *rows: spark.createDataFrame(list(rows), "path string, blob string")
    left, right = side(("a", None), ("b", None), ("c", "1"), ("d", "1")), side(("a", None), ("c", None), ("d", "2"), ("e", None))
    got = {r["path"]: r["change"] for r in S.compare_snapshots(left, right, "path", "blob", side(("d", ""))).collect()}
    assert got == {"b": "deleted", "c": "changed", "e": "added"}
    assert {r["path"]: r["action"] for r in S.three_way(side(("a", None)), side(), side(("a", "x")), "path", "blob").collect()} == {"a": "delete-modify"}


def test_projects_with_names_of_any_script(spark):
    names = ["가나", "été-plan", "app", "app-2", ".net", "!!"]
    texts = ["see 가나 now", "다가나라", "x가나", "the ÉTÉ plan", "my app_2!", "happy", "use .NET", None, "what !! is"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["project"] for r in N.mentioned_project(rows, "id", "text", spark.createDataFrame([(n,) for n in names], "project string")).collect()}

    def plain(text):
        form = lambda n: r"(?:^|[^a-z0-9])" + r"[-_\s]*".join(re.escape(x) for x in re.split(r"[-_\s]+", n)) + r"(?:[^a-z0-9]|$)"
        return max((n for n in names if re.search(form(n), (text or "").lower())), key=lambda n: (len(n), n), default=None)

    assert got == {k: plain(t) for k, t in enumerate(texts) if plain(t)}


def test_projects_are_matched_once_and_only_where_their_parts_stand_in_a_row(spark):
    names = spark.createDataFrame([(f"a-b-{n}",) for n in range(30)], "project string")
    found = N.mentioned_project(spark.createDataFrame([(1, "a b_7. 8 9"), (2, "a-b 12x"), (3, "b a 7")], "id int, text string"), "id", "text", names)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("rlike") == 1 and "contains(" in plan and "forall(" not in plan
    assert [tuple(r) for r in found.collect()] == [(1, "a-b-7")]


def last_stages(df):
    """The text of a plan below each of its lowest exchanges: what tasks do that read the inputs."""
    lines = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    tops = [n for n, line in enumerate(lines) if "Exchange" in line or "Repartition" in line]
    ends = [next((m for m in range(n + 1, len(lines)) if depth(lines[m]) <= depth(lines[n])), len(lines)) for n in tops]
    return ["\n".join(lines[n + 1 : end]) for n, end in zip(tops, ends, strict=True)]


def test_tasks_that_read_line_items_gather_none(spark):
    found = [x for x in last_stages(files(spark, "/root/testdata/sf0.001")) if "Scan" in x]
    assert found and not any("Aggregate" in x for x in found)


def test_snapshots_are_dealt_out_by_path_before_they_are_grouped(spark):
    side = spark.createDataFrame([("a", "x")], "path string, blob string")
    for df in (S.compare_snapshots(side, side, "path", "blob"), S.three_way(side, side, side, "path", "blob")):
        found = last_stages(df)
        assert found and not any("Aggregate" in x for x in found)


def test_changes_of_a_store_do_not_meet_for_its_freeze(spark):
    rows = spark.range(10).selectExpr("concat('s', id % 2 + 1) store", "id commit", "'p' path", "1L size", "true large")
    freezes = spark.createDataFrame([("s1", "theirs"), ("s2", "mine")], "store string, id string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = C.judge_changes(rows, F.lit(False), freezes, "mine")
        assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.count() == 5 and {r["rule"] for r in found.collect()} == {"freeze"}
