"""Routing sources to pages, guarding results, and putting pages together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import frontmatter as M
from paperloom.functions import text as X

#: The words that speak for each section.
KEYWORDS = {
    "projects": (
        *("project", "milestone", "roadmap", "backlog", "issue", "issues", "todo", "task", "tasks", "architecture", "migration", "release", "deploy", "deployment", "sprint", "spec", "prd"),
        *("프로젝트", "마일스톤", "로드맵", "백로그", "이슈", "할일", "작업", "아키텍처", "마이그레이션", "릴리즈", "배포", "명세"),
    ),
    "learnings": (
        *("rule", "rules", "guideline", "guidelines", "playbook", "runbook", "checklist", "postmortem", "rca", "debug", "debugging", "troubleshoot", "troubleshooting", "lesson", "lessons"),
        *("benchmark", "performance", "timeout", "flaky", "incident", "recovery", "pattern"),
        *("규칙", "원칙", "가이드", "가이드라인", "플레이북", "런북", "체크리스트", "장애", "원인", "복구", "디버깅", "교훈", "벤치마크", "성능", "패턴"),
    ),
    "domains": (
        *("company", "service", "product", "vendor", "market", "competitor", "website", "homepage", "pricing", "price", "plan", "feature", "platform", "api", "sdk", "library", "tool"),
        *("resume", "portfolio", "candidate"),
        *("회사", "서비스", "제품", "사이트", "홈페이지", "가격", "요금", "플랜", "기능", "플랫폼", "api", "라이브러리", "도구", "이력서", "포트폴리오", "후보자"),
    ),
}


def keyword_scores(text: Column, project: Column, is_url: Column) -> Column:
    """Struct (projects, learnings, domains): words of each list that the text holds, two for a known project, one for a URL."""

    def of(low: Column) -> Column:
        hits = {name: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))) for name, words in KEYWORDS.items()}
        extra = {"projects": F.when(project.isNotNull(), 2).otherwise(0), "learnings": F.lit(0), "domains": F.when(is_url, 1).otherwise(0)}
        return F.struct(*[(hits[name] + extra[name]).cast("int").alias(name) for name in KEYWORDS])

    return X.let(F.lower(F.coalesce(text, F.lit(""))), of)


def route(scores: Column, project: Column, is_url: Column) -> Column:
    """Struct (section, confidence, ambiguous, reason, candidates), from scores of ``keyword_scores``.

    candidates are (section, score), the chosen one first, then by score and name.
    """

    def of(s: Column) -> Column:
        ranked = F.array_sort(F.array(*[F.struct((-s[name]).alias("less"), F.lit(name).alias("section")) for name in KEYWORDS]))

        def chosen(r: Column) -> Column:
            top, lead = -r[0]["less"], r[1]["less"] - r[0]["less"]
            second = -r[1]["less"]
            unclear = (top <= 1) | ((second > 0) & (lead <= 1))
            sure = F.when((top >= 4) & (lead >= 2), "high").when((top >= 2) & (lead >= 1), "medium").otherwise("low")
            by_project = project.isNotNull() & (s["projects"] >= 3) & (s["projects"] + 1 >= s["learnings"])
            by_learning = (s["learnings"] > 0) & (s["learnings"] >= s["domains"])
            by_domain = (s["domains"] > 0) | is_url
            section = F.when(by_project, "projects").when(by_learning, "learnings").when(by_domain, "domains").when(project.isNotNull(), "projects").otherwise("learnings")
            reason = (
                F.when(by_project, "project-id-and-project-keywords")
                .when(by_learning, "learning-keywords")
                .when(by_domain, F.when(is_url & (s["domains"] <= 1), "url-default").otherwise("domain-keywords"))
                .when(project.isNotNull(), "project-fallback")
                .otherwise("default-learning-fallback")
            )
            rows = F.transform(r, lambda c: F.struct(c["section"].alias("section"), (-c["less"]).alias("score")))
            first = X.let(section, lambda x: F.concat(F.filter(rows, lambda c: c["section"] == x), F.filter(rows, lambda c: c["section"] != x)))
            return F.struct(section.alias("section"), sure.alias("confidence"), (unclear | ~(by_project | by_learning | by_domain)).alias("ambiguous"), reason.alias("reason"), first.alias("candidates"))

        return X.let(ranked, chosen)

    return X.let(scores, of)


def mentioned_project(docs: DataFrame, id_col: str, text_col: str, projects: DataFrame) -> DataFrame:
    """(id, project): the longest project that a text names as a whole token, blanks, hyphens and underscores between its parts
    being alike.

    Projects meet texts by equality with their first run of letters and digits of any script: a text emits, from each place that no a-z or digit
    stands before, what such runs can be, and only those pairs are matched, so no text meets all projects but those without a letter or digit.
    A pattern is tried only where the text without blanks, hyphens and underscores holds the project's parts in a row, as every match does.
    """
    parts = F.filter(F.split(F.lower("project"), r"[-_\s]+"), lambda x: x != "")
    known = projects.select("project").distinct().withColumn("_parts", parts).filter(F.size("_parts") > 0)
    escaped = F.transform("_parts", lambda x: F.regexp_replace(x, r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?:\A|[^a-z0-9])"), F.array_join(escaped, r"[-_\s]*"), F.lit(r"(?:[^a-z0-9]|\z)"))
    known = known.select("project", F.regexp_extract(F.array_join("_parts", "-"), r"([\p{L}\p{N}]+)", 1).alias("_start"), pattern.alias("_form"), F.array_join("_parts", "").alias("_flat"))
    lengths = sorted(r[0] for r in known.select(F.length("_start")).distinct().collect())  # as many as names have letters
    runs = F.array_distinct(F.regexp_extract_all("_low", F.lit(rf"(?<![a-z0-9])(?=([\p{{L}}\p{{N}}]{{1,{max(lengths, default=0) or 1}}}))"), F.lit(1)))
    cuts = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    starts = X.let(runs, lambda ts: F.array_distinct(F.flatten(F.transform(cuts, lambda n: F.when(n == 0, F.array(F.lit(""))).otherwise(F.transform(ts, lambda t: F.substring(t, F.lit(1), n)))))))
    low = docs.select(id_col, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_low"))
    met = low.select(id_col, F.explode(starts).alias("_start")).join(known, "_start")
    # The candidates of a text, the longest first, come back to it in one row, so that its words move once.
    ranked = F.array_sort(F.collect_set(F.struct((-F.length("project")).alias("less"), "project", "_form", "_flat")))
    met = met.groupBy(id_col).agg(ranked.alias("_ways"))
    told = lambda text: F.filter("_ways", lambda w: F.contains(text, w["_flat"]) & F.rlike("_low", w["_form"]))
    ways = X.let(F.translate("_low", "-_ \t\n\x0b\f\r", ""), told)  # the text is brought into this form once, not for each way
    rows = low.join(met, id_col).select(id_col, F.explode(F.transform(F.slice(ways, 1, 1), lambda w: w["project"])).alias("project"))  # a filter would match again
    return rows.groupBy(id_col).agg(F.max_by("project", F.struct(F.length("project"), "project")).alias("project"))


def fence_state(body: Column) -> Column:
    """Struct (hazards, opened): headings inside code fences, by line number, and the line of a fence that stays open.

    The lines are folded once; the fold keeps the open fence and the hazards so far.
    """
    lines = F.split(F.regexp_replace(F.coalesce(body, F.lit("")), r"\r\n?", "\n"), "\n")
    state = F.struct(F.lit("").alias("sign"), F.lit(0).alias("size"), F.lit(0).alias("line"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("hazards"))

    def step(acc: Column, x: Column) -> Column:
        mark = F.regexp_extract(x, r"\A {0,3}(`{3,}|~{3,})", 1)
        rest = F.regexp_replace(x, r"\A {0,3}(`{3,}|~{3,})", "")
        at = acc["at"] + 1
        inside = acc["size"] > 0
        closes = inside & (mark != "") & (F.substring(mark, 1, 1) == acc["sign"]) & (F.length(mark) >= acc["size"]) & (F.trim(rest) == "")
        opens = ~inside & (mark != "") & ~(F.startswith(mark, F.lit("`")) & F.contains(rest, F.lit("`")))
        bad = inside & ~closes & x.rlike(r"\A##\s+\S")
        return F.struct(
            F.when(opens, F.substring(mark, 1, 1)).when(closes, "").otherwise(acc["sign"]).alias("sign"),
            F.when(opens, F.length(mark)).when(closes, 0).otherwise(acc["size"]).alias("size"),
            F.when(opens, at).when(closes, 0).otherwise(acc["line"]).alias("line"),
            at.alias("at"),
            F.when(bad, F.concat(acc["hazards"], F.array(at))).otherwise(acc["hazards"]).alias("hazards"),
        )

    return F.aggregate(lines, state, step, lambda acc: F.struct(acc["hazards"].alias("hazards"), F.when(acc["size"] > 0, acc["line"]).alias("opened")))


MANAGED = ("Summary", "Details", "Related")


def section_rows(body: Column) -> Column:
    """Array of struct (heading, content): the preamble under a null heading if there is one, then every level-two section."""
    text = F.concat(F.lit("\n"), X.trim(X.trim_carriage(F.coalesce(body, F.lit("")))))
    of = lambda part: F.when(
        part.rlike(r"\A##\s+[^\n]"), F.struct(F.trim(F.regexp_extract(part, r"\A##\s+([^\n]*)", 1)).alias("heading"), X.trim(F.regexp_replace(part, r"\A[^\n]*\n?", "")).alias("content"))
    ).otherwise(F.struct(F.lit(None).cast("string").alias("heading"), X.trim(part).alias("content")))
    rows = F.transform(F.split(text, r"\n(?=##\s+[^\n])"), of)
    return F.filter(rows, lambda r: r["heading"].isNotNull() | (r["content"] != ""))


def body_shape(pages: DataFrame) -> DataFrame:
    """(store, path, preamble, managed, preserved, duplicates, hazards, opened) and whether a page can be rewritten."""
    rows = pages.select("store", "path", section_rows(F.col("body")).alias("rows"), fence_state(F.col("body")).alias("fence"))
    heads = F.filter(F.transform("rows", lambda r: r["heading"]), lambda h: h.isNotNull())
    rows = rows.withColumn("heads", heads)
    twice = F.filter(F.array_distinct("heads"), lambda h: F.size(F.filter("heads", lambda x: x == h)) > 1)
    pre = F.get(F.filter("rows", lambda r: r["heading"].isNull()), F.lit(0))["content"]
    out = rows.select(
        "store",
        "path",
        F.coalesce(pre, F.lit("")).alias("preamble"),
        F.filter("heads", lambda h: h.isin(*MANAGED)).alias("managed"),
        F.filter("heads", lambda h: ~h.isin(*MANAGED)).alias("preserved"),
        twice.alias("duplicates"),
        F.col("fence.hazards").alias("hazards"),
        F.col("fence.opened").alias("opened"),
    )
    return out.withColumn("rewritable", (F.size("duplicates") == 0) & (F.size("hazards") == 0) & F.col("opened").isNull())


def render_sections(rows: Column) -> Column:
    """K5: the body of section rows, the preamble first and empty sections marked as such."""
    text = lambda r: F.when(r["heading"].isNull(), r["content"]).otherwise(F.concat(F.lit("## "), r["heading"], F.lit("\n"), F.when(r["content"] == "", "(empty)").otherwise(r["content"])))
    return F.array_join(F.transform(rows, text), "\n\n")


def render_page(fields: Column, rows: Column) -> Column:
    """K5: a page put together from its fields (``frontmatter.parse``) and section rows."""
    return F.concat(M.serialize(fields), F.lit("\n\n"), render_sections(rows), F.lit("\n"))


def ingest_block(meta: dict[str, Column], verdict: Column) -> Column:
    """What a source adds to a page: a dated heading, its marks (those that are there), and its text with lower headings."""
    marks = [("Source", "source_path"), ("Task", "task_id"), ("Status", "status"), ("Worker", "worker"), ("QA", "qa")]
    lines = [F.when(F.coalesce(meta[k], F.lit("")) != "", F.concat(F.lit(f"- {name}: `"), meta[k], F.lit("`"))) for name, k in marks if k in meta]
    body = X.demote_headings(X.strip_leading_title(meta["body"]))
    text = X.let(body, lambda b: F.when(b != "", b).otherwise(meta["summary"]))
    head = F.concat(F.lit("### "), meta["date"], F.lit(" · "), meta["title"])
    return X.trim(F.concat_ws("\n", head, F.lit(""), *lines, F.concat(F.lit("- QA Verdict: `"), verdict, F.lit("`")), F.lit(""), text))


def upsert_block(details: Column, block_id: Column, block: Column) -> Column:
    """Struct (content, action): the section with the marked block put in its place (updated), or added (created)."""
    start, end = (F.concat(F.lit("<!-- ingest:"), block_id, F.lit(f":{x} -->")) for x in ("start", "end"))
    whole = F.concat(start, F.lit("\n"), block, F.lit("\n"), end)
    plain = X.trim(F.coalesce(details, F.lit("")))
    form = F.concat(F.lit(r"(?s)\Q"), start, F.lit(r"\E.*?\Q"), end, F.lit(r"\E"))
    safe = F.replace(F.replace(whole, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    there = F.contains(plain, start) & F.contains(plain, end)
    content = F.when(there, X.trim(F.regexp_replace(plain, form, safe))).when((plain == "") | X.is_placeholder(plain), whole).otherwise(F.concat(plain, F.lit("\n\n"), whole))
    return F.struct(content.alias("content"), F.when(there, "updated").otherwise("created").alias("action"))


def match_task(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Results (path, ...) with the task (id, qa, signal, ...) whose ``result`` is their path; of several, the first by id."""
    first = tasks.filter("result is not null").groupBy(F.col("result").alias("path")).agg(F.min(F.struct("id", "qa", "signal")).alias("task"))
    return results.join(first, "path", "left")


def resolve_results(wanted: DataFrame, tasks: DataFrame, files: DataFrame, folders: list[str]) -> DataFrame:
    """(id, path): the result file of each task id: what its task names, else <folder>/<id>.result.md, whichever exists first."""
    named = wanted.join(tasks.select("id", F.col("result").alias("_named")).distinct(), "id", "left")
    ways = F.array(F.col("_named"), *[F.concat(F.lit(f"{folder}/"), "id", F.lit(".result.md")) for folder in folders])
    rows = named.select("id", F.posexplode(ways).alias("rank", "path"))
    rows = rows.join(files.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    return rows.groupBy("id").agg(F.min_by(F.when(F.col("_there"), F.col("path")), F.when(F.col("_there"), F.col("rank"))).alias("path"))


def guard_ingest(results: DataFrame, tasks: DataFrame, files: DataFrame, stamps: DataFrame) -> DataFrame:
    """Results (path, millis, received) with task_id and ``reason`` for skipping each; null for those to take.

    ``files`` has the paths that exist, ``stamps`` the keys of what was taken before.
    """
    blank = lambda c: X.trim(F.coalesce(c, F.lit(""))) == ""
    rows = match_task(results, tasks).join(files.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    rows = rows.withColumn("stamp", X.stamp_key(F.col("path"), F.col("millis"))).join(stamps.select("stamp").distinct().withColumn("_taken", F.lit(True)), "stamp", "left")
    reason = (
        F.when(blank(F.col("path")), "missing-result-path")
        .when(F.col("_there").isNull(), "missing-result-file")
        .when(F.col("task").isNull(), "missing-task-metadata")
        .when(blank(F.col("task.qa")), "task-has-no-qa")
        .when(~blank(F.col("received")) & ~blank(F.col("task.signal")) & (F.col("received") != F.col("task.signal")), "signal-mismatch")
        .when(F.col("_taken"), "already-ingested")
    )
    return rows.select(*results.columns, F.col("task.id").alias("task_id"), "stamp", reason.alias("reason"))


def ingest_pages(sources: DataFrame, pages: DataFrame, projects: DataFrame, date: str, overrides: DataFrame | None = None) -> DataFrame:
    """(path, section, action, content, refused): a page for each source (slug, title, text, source), new or with its block added.

    ``pages`` has (path, content). ``overrides`` (slug, section), null to skip a source, replace the routed section. A page
    whose body can't be rewritten without loss is refused and keeps its content. Of sources with one target, each adds
    its block in order of slug.
    """
    found = mentioned_project(sources, "slug", "text", projects)
    rows = sources.join(found, "slug", "left")
    is_url = X.trim(F.col("source")).rlike(r"(?i)\Ahttps?://")
    rows = rows.withColumn("route", route(keyword_scores(F.concat_ws("\n", "title", "text", "source", "slug"), F.col("project"), is_url), F.col("project"), is_url))
    rows = rows.withColumn("section", F.col("route.section"))
    if overrides is not None:
        rows = rows.join(overrides.select("slug", F.col("section").alias("_section"), F.lit(True).alias("_over")), "slug", "left")
        rows = rows.filter("_over is null or _section is not null").withColumn("section", F.coalesce("_section", "section"))
    name = F.when((F.col("section") == "projects") & F.col("project").isNotNull(), F.col("project")).otherwise(F.col("slug"))
    rows = rows.withColumn("path", F.concat("section", F.lit("/"), name, F.lit(".md")))
    meta = {"source_path": F.col("source"), "task_id": F.col("slug"), "date": F.lit(date), "title": F.col("title"), "body": F.col("text"), "summary": F.col("title")}
    rows = rows.select("path", "section", "slug", "title", ingest_block(meta, F.lit("passed")).alias("block"))
    added = rows.groupBy("path").agg(F.min("section").alias("section"), F.min_by("title", "slug").alias("title"), F.array_sort(F.collect_list(F.struct("slug", "block"))).alias("blocks"))
    both = added.join(pages.select("path", F.col("content").alias("old")), "path", "left").withColumn("_p", M.split_derived(F.col("old")))
    shape = body_shape(both.filter("old is not null").select(F.lit("").alias("store"), "path", F.col("_p.body").alias("body"))).select("path", "rewritable")
    both = both.join(shape, "path", "left").withColumn("rows", section_rows(F.col("_p.body")))
    details = F.get(F.filter("rows", lambda r: r["heading"] == "Details"), F.lit(0))["content"]
    put = lambda acc, b: upsert_block(acc, b["slug"], b["block"])["content"]
    new_details = F.aggregate("blocks", F.coalesce(details, F.lit("")), put)
    both = both.withColumn("_details", new_details)
    kept = F.filter("rows", lambda r: ~r["heading"].eqNullSafe("Details"))
    one = lambda h, c: F.array(F.struct(F.lit(h).alias("heading"), c.alias("content")))
    has = lambda h: F.exists("rows", lambda r: r["heading"].eqNullSafe(h))
    none = F.filter("rows", lambda r: F.lit(False))
    shown = F.concat(F.when(has("Summary"), none).otherwise(one("Summary", F.col("title"))), kept, one("Details", F.col("_details")), F.when(has("Related"), none).otherwise(one("Related", F.lit(""))))
    stamp = {"title": F.col("title"), "updated": F.lit(date)}
    page = M.upsert(F.concat(F.when(F.col("_p.has"), F.concat(F.lit("---\n"), F.col("_p.block"), F.lit("---\n\n"))).otherwise(""), render_sections(shown), F.lit("\n")), stamp)
    refused = F.col("old").isNotNull() & ~F.coalesce("rewritable", F.lit(True))
    return both.select("path", "section", F.when(F.col("old").isNull(), "created").otherwise("updated").alias("action"), F.when(refused, F.col("old")).otherwise(page).alias("content"), refused.alias("refused"))


def ledger_rows(done: DataFrame, operation: str, date: str) -> DataFrame:
    """K2: (date, line): the change-log line of each row (source, path, verdict); append them below the date's heading."""
    line = F.concat(F.lit(f"- {operation}: "), "source", F.lit(" → "), "path", F.when(F.coalesce("verdict", F.lit("")) != "", F.concat(F.lit(" (qa: "), "verdict", F.lit(")"))).otherwise(""))
    return done.select(F.lit(date).alias("date"), line.alias("line"))


def append_log(content: Column, heading: str, date: str, lines: Column) -> Column:
    """K2: the log with lines (joined by line feeds) at the end of the date's section, which is made if it is missing."""
    text = X.let(X.trim(X.trim_carriage(F.coalesce(content, F.lit("")))), lambda t: F.when(t == "", heading).otherwise(t))

    def put(t: Column) -> Column:
        form = rf"(?s)(\A|.*\n)(## {date}\n.*?)(?=\n+## \d{{4}}-\d{{2}}-\d{{2}}|\z)(.*)\z"
        inside = F.concat(F.regexp_extract(t, form, 1), F.regexp_extract(t, form, 2), F.lit("\n"), lines, F.regexp_extract(t, form, 3), F.lit("\n"))
        return F.when(F.concat(t, F.lit("\n")).rlike(rf"(?m)^## {date}$"), inside).otherwise(F.concat(t, F.lit(f"\n\n## {date}\n"), lines, F.lit("\n")))

    return X.let(text, put)
