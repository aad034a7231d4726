"""The change gate: what a push may change, judged commit by commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import paths as Q
from paperloom.functions import text as X

from .changes import PLAIN_CAP, PLAIN_WARNING

#: A name of zeros only; git shortens names to seven letters at the least, so "0" is one like any other.
ZERO = r"\A0{7,}\z"
LINK, SUBMODULE = "120000", "160000"


def commit_chains(commits: DataFrame, store_checkpoint) -> DataFrame:
    """(store, commit, ord, chain, place): every commit once, on a chain of commits of which each is a parent of the next; ``place`` counts from the oldest.

    A commit goes on the chain of its latest parent, if it is that one's latest child. Chains are followed by pointer doubling: each round,
    a commit that knows one 2^k places before it takes over what that one knows, so rounds grow with the logarithm of the longest chain.
    """
    ords = commits.groupBy("store", "commit").agg(F.max("ord").alias("ord"))
    edges = commits.filter("parent is not null").select("store", "commit", "parent").distinct().join(ords.withColumnsRenamed({"commit": "parent", "ord": "parent_ord"}), ["store", "parent"])
    latest = edges.groupBy("store", "commit").agg(F.max(F.struct("parent_ord", "parent"))["parent"].alias("parent"))
    child = latest.join(ords, ["store", "commit"]).groupBy("store", "parent").agg(F.max(F.struct("ord", "commit"))["commit"].alias("commit"))
    rows = ords.join(child, ["store", "commit"], "left").select("store", "commit", "ord", F.coalesce("parent", "commit").alias("up"), F.col("parent").isNotNull().cast("long").alias("place"))
    rows = store_checkpoint(rows)
    while True:
        above = rows.select("store", F.col("commit").alias("up"), F.col("up").alias("next"), F.col("place").alias("more"))
        moved = rows.join(above, ["store", "up"]).select("store", "commit", "ord", F.col("next").alias("up"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved"))
        moved = store_checkpoint(moved)
        rows = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return rows.select("store", "commit", "ord", F.col("up").alias("chain"), "place")


def _blocks(low: Column, high: Column, levels: int) -> Column:
    """Blocks (level, at) of 2^level numbers that together make up the numbers from low to high, two a level at most."""

    def of(level: Column) -> Column:
        start, end = -F.call_function("shiftright", -low, level), F.call_function("shiftright", high + 1, level)
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        block = lambda when, at: F.when((start < end) & when, F.struct(level.alias("level"), at.alias("at")))
        return F.array(block(odd(start), start), block(odd(end), end - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of)))


def is_ancestor(updates: DataFrame, commits: DataFrame, store_checkpoint) -> DataFrame:
    """The (store, old, new) of ``updates`` in which old is an ancestor of new, or new itself.

    ``commits`` has (store, commit, parent, ord), ord growing along every parent edge. Commits older than all old ones of their store, or later
    than all new ones, are left out. The others are cut into chains; a search then knows of each chain the latest commit it has reached, by its ord,
    which stands for all before it, and goes from there to other chains, but never below its old commit. So a round crosses whole chains, and rounds
    grow with the logarithm of the depth and with how often a way must change chains, not with the depth. Ranges of a chain meet the
    edges that leave it by blocks of powers of two, so only edges between old and new are met.
    """
    pairs = updates.select("store", "old", "new").distinct()
    ords = commits.groupBy("store", "commit").agg(F.max("ord").cast("long").alias("ord"))
    ends = pairs.join(ords.withColumnsRenamed({"commit": "old", "ord": "low"}), ["store", "old"]).join(ords.withColumnsRenamed({"commit": "new", "ord": "high"}), ["store", "new"])
    ends = store_checkpoint(ends.filter("low <= high"))
    span = ends.groupBy("store").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    some = store_checkpoint(commits.join(span, "store").filter("ord between low and high").select(*commits.columns))
    chains = store_checkpoint(commit_chains(some, store_checkpoint))
    at = lambda df, c, a, o: df.join(chains.select("store", F.col("commit").alias(c), F.col("chain").alias(a), F.col("ord").cast("long").alias(o)), ["store", c])
    # Edges that leave a chain, and where each search starts and has to come to.
    leaving = at(at(some.filter("parent is not null").select("store", "commit", "parent").distinct(), "commit", "chain", "from"), "parent", "to_chain", "to")
    leaving = store_checkpoint(leaving.filter("chain <> to_chain").select("store", "chain", "from", "to_chain", "to").distinct())
    widest = leaving.agg(F.greatest(F.abs(F.min("from")), F.abs(F.max("from")))).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(int(widest).bit_length()))
    leaving = store_checkpoint(leaving.withColumn("block", F.explode(F.transform(levels, lambda n: F.struct(n.alias("level"), F.call_function("shiftright", "from", n).alias("at"))))))
    goals = store_checkpoint(at(at(ends, "new", "chain", "ord"), "old", "goal", "low_").drop("low_", "high"))
    search = ["store", "old", "new", "goal", "low"]
    reached = store_checkpoint(goals.select(*search, "chain", "ord"))
    frontier, found = reached.withColumn("before", F.col("low")), None
    while True:
        hit = frontier.filter("chain = goal and ord >= low").select("store", "old", "new").distinct()
        found = store_checkpoint(hit if found is None else found.union(hit).distinct())
        step = frontier.join(found, ["store", "old", "new"], "left_anti").filter("ord > before")
        step = step.select(*search, "chain", F.explode(_blocks(F.col("before") + 1, F.col("ord"), int(widest).bit_length())).alias("block"))
        step = step.join(leaving, ["store", "chain", "block"]).filter("to >= low")
        step = step.groupBy(*search, F.col("to_chain").alias("chain")).agg(F.max("to").alias("ord"))
        known = reached.select("store", "old", "new", "chain", F.col("ord").alias("before"))
        step = step.join(known, ["store", "old", "new", "chain"], "left").filter("before is null or ord > before").withColumn("before", F.coalesce("before", "low"))
        frontier = store_checkpoint(step.select(*search, "chain", "ord", "before"))
        if frontier.isEmpty():
            return found
        reached = store_checkpoint(reached.join(frontier, ["store", "old", "new", "chain"], "left_anti").unionByName(frontier.drop("before")))


def ref_problems(updates: DataFrame, forward: DataFrame) -> DataFrame:
    """(store, ref, rule, problem) of updates (store, ref, old, new, role): main only, no deletion, fast-forward; replace refs
    for admins. ``forward`` is what ``is_ancestor`` found."""
    rows = updates.join(forward.withColumn("_ff", F.lit(True)), ["store", "old", "new"], "left")
    deleting, new_ref = F.col("new").rlike(ZERO), F.col("old").rlike(ZERO)
    main, replace = F.col("ref") == "refs/heads/main", F.startswith("ref", F.lit("refs/replace/"))
    problem = (
        F.when(main & deleting, "deletes-main")
        .when(main & ~new_ref & F.col("_ff").isNull(), "not-fast-forward")
        .when(replace & (F.coalesce("role", F.lit("")) != "admin"), "replace-needs-admin")
        .when(replace & deleting, "deletes-replace")
        .when(~main & ~replace, "not-main")
    )
    return rows.select("store", "ref", F.lit("refs").alias("rule"), problem.alias("problem")).filter("problem is not null")


def spelled_prefixes(paths: DataFrame, key: list[str]) -> DataFrame:
    """(key..., prefix, case_key): every folder and file name of the paths once, with its caseless key."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    rows = paths.select(*key, F.explode(prefixes).alias("prefix")).distinct()
    return rows.select(*key, "prefix", Q.unicode_keys(F.col("prefix"))["case_key"].alias("case_key"))


def case_collisions(tree: DataFrame, added: DataFrame, key: list[str]) -> DataFrame:
    """(key..., case_key, spellings, first): names with several spellings in a tree that an added path goes through."""
    many = spelled_prefixes(tree, key).groupBy(*key, "case_key").agg(F.count("*").alias("spellings"), F.min("prefix").alias("first")).filter("spellings > 1")
    touched = spelled_prefixes(added, key).select(*key, "case_key").distinct()
    return many.join(touched, [*key, "case_key"], "left_semi")


def content_problems(changes: DataFrame, objects: DataFrame, reject: list[str], junk: list[str] | tuple[str, ...] = Q.JUNK_PATTERNS) -> DataFrame:
    """(store, commit, path, rule, level, problem) of every rule that a change breaks, deletions aside.

    ``changes`` has (store, commit, path, mode, size, head), head being the start of the content in bytes, whole for
    pointers and links; ``objects`` has (store, oid, size). Only pointers meet the objects.
    """
    rows = changes.withColumn("keys", Q.unicode_keys(F.col("path")))
    rows = rows.withColumns({"junk": Q.match_patterns(F.col("path"), junk, True), "reject": Q.match_patterns(F.col("path"), reject, True), "large": Q.is_large_path(F.col("path"))})
    pointer = X.parse_pointer(F.when(F.is_valid_utf8(F.col("head").cast("string")) & (F.col("size") <= 1024), F.col("head").cast("string")))
    rows = rows.withColumn("pointer", F.when(F.col("large") & (F.col("mode") != LINK) & (F.col("size") > 0), pointer))
    have = objects.select("store", "oid", F.col("size").alias("have"))
    rows = rows.withColumn("oid", F.col("pointer.oid")).join(have, ["store", "oid"], "left")
    link, blob = F.col("mode") == LINK, ~F.col("mode").isin(LINK, SUBMODULE)
    good_link = (F.col("size") > 0) & (F.col("size") <= Q.LINK_BYTES) & F.col("head").isNotNull() & ~F.contains("head", F.lit(b"\x00"))
    refused, large = F.col("reject").isNotNull(), F.col("large")
    plain, row = blob & ~large, lambda rule, problem, level="violation": F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), problem.alias("problem"))
    text = lambda x: F.lit(x).cast("string")
    found = F.array(
        F.when(F.col("junk").isNotNull(), row("junk", F.col("junk"))),
        F.when(link & ~good_link, F.struct(F.when(large, "pointer").when(refused, "binary").otherwise("size").alias("rule"), F.lit("violation").alias("level"), text("not-a-link-target").alias("problem"))),
        F.when(link & good_link & Q.is_modules_link(F.col("path")), row("checkout", text("modules-link"))),
        F.when(link & good_link & (F.col("size") > Q.LINK_CHECKOUT_BYTES), row("checkout", text("long-link"))),
        F.when(link & good_link & refused & large, row("binary", F.col("reject"))),
        F.when(blob & refused & (large | Q.looks_binary(F.col("head"))), row("binary", F.col("reject"))),
        F.when(blob & large & (F.col("size") > 0) & F.col("pointer").isNull(), row("pointer", text("not-a-pointer"))),
        F.when(F.col("pointer").isNotNull() & F.col("have").isNull(), row("pointer", text("object-missing"))),
        F.when(F.col("pointer").isNotNull() & (F.col("have") != F.col("pointer.size")), row("pointer", text("size-differs"))),
        F.when(plain & (F.col("size") > PLAIN_CAP), row("size", text("too-large"))),
        F.when(plain & (F.col("size") > PLAIN_WARNING) & (F.col("size") <= PLAIN_CAP), row("size", text("large"), "warning")),
    )
    unsafe = F.transform(Q.checkout_problems(F.col("path").cast("binary"), F.col("keys")), lambda p: row("checkout", p))
    rows = rows.select("store", "commit", "path", F.explode(F.concat(F.array_compact(found), unsafe)).alias("x"))
    return rows.select("store", "commit", "path", "x.rule", "x.level", "x.problem")


def nameless_objects(incoming: DataFrame, changes: DataFrame) -> DataFrame:
    """(store, blob, size) of incoming objects beyond the cap that no changed path names."""
    return incoming.filter(F.col("size") > PLAIN_CAP).join(changes.select("store", "blob").distinct(), ["store", "blob"], "left_anti").select("store", "blob", "size")


def nfc_groups(paths: DataFrame, key: list[str]) -> DataFrame:
    """(key..., nfc, names, error): the spellings of each composed path; more than one that exists is an error.

    ``paths`` has (key..., path, exists).
    """
    rows = paths.withColumn("nfc", Q.unicode_keys(F.col("path"))["nfc"]).groupBy(*key, "nfc", "path").agg(F.bool_or("exists").alias("exists"))
    rows = rows.groupBy(*key, "nfc").agg(F.count("*").alias("names"), F.count_if("exists").alias("existing"))
    return rows.select(*key, "nfc", "names", (F.col("existing") > 1).alias("error"))


def twin_deletes(changes: DataFrame, tree: DataFrame, key: list[str]) -> DataFrame:
    """(key..., nfc, deletes, survivors, conflict): composed paths deleted under one spelling while another survives.

    ``changes`` has (key..., path, status, mode, blob), ``tree`` (key..., path) is the state before. conflict tells that
    the written spellings hold different contents.
    """
    nfc = Q.unicode_keys(F.col("path"))["nfc"]
    changed = changes.select(*key, "path", nfc.alias("nfc"), (F.col("status") == "D").alias("gone"), F.when(F.col("status") != "D", F.struct("mode", "blob")).alias("new"))
    kept = tree.select(*key, "path").join(changed.select(*key, "path"), [*key, "path"], "left_anti")
    kept = kept.select(*key, "path", nfc.alias("nfc"), F.lit(False).alias("gone"), F.lit(None).cast(dict(changed.dtypes)["new"]).alias("new"))
    rows = changed.unionByName(kept).groupBy(*key, "nfc")
    found = rows.agg(F.count_if("gone").alias("deletes"), F.count_if(~F.col("gone")).alias("survivors"), (F.min("new") != F.max("new")).alias("conflict"))
    return found.filter("deletes > 0 and survivors > 0").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def in_scope(paths: DataFrame, tracked: DataFrame) -> DataFrame:
    """the paths whose folder holds a tracked file somewhere below it, or is the root."""
    dirs = tracked.select("store", F.explode(X.ancestors(F.col("path"))).alias("_dir")).distinct()
    return paths.withColumn("_dir", X.directory(F.col("path"))).join(dirs, ["store", "_dir"], "left_semi").drop("_dir")


def promote_to_full(changed: DataFrame, schema_path: str = "schema.md", contracts: tuple[str, ...] = (".gitattributes", ".gitignore", ".gitmodules")) -> DataFrame:
    """F16, ST1: (store, mode, reason): whether a store's changes (store, path, kind) can be taken alone, else why not.

    kind is file, directory, link or missing. Of several reasons the first by path counts.
    """
    parts, name = F.split("path", "/"), F.substring_index("path", "/", -1)
    reason = (
        F.when(F.col("path").isNull() | F.exists(parts, lambda x: x.isin("", ".", "..")), "invalid-changed-paths")
        .when(name.isin(*contracts) | (F.col("path") == schema_path), F.concat(F.lit("contract-changed:"), "path"))
        .when(F.col("kind").isin("directory", "link"), F.concat(F.lit("non-file-change:"), "path"))
    )
    rows = changed.withColumn("_why", reason).groupBy("store").agg(F.min(F.when(F.col("_why").isNotNull(), F.struct("path", "_why")))["_why"].alias("reason"))
    return rows.select("store", F.when(F.col("reason").isNull(), "incremental").otherwise("full").alias("mode"), F.coalesce("reason", F.lit("changed-paths")).alias("reason"))
