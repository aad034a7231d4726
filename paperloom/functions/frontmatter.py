"""Frontmatter as columns: two reading dialects, writing, and replacing single fields. Built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trim

#: A key whose value is blank takes the list lines that follow it at once; any other value stands on the key's line.
_DERIVED = r"(?md)^([A-Za-z0-9_-]+):(?:[ \t]*$((?:\n[ \t]*-[ \t]*[^\s].*)*+)|[ \t]*(.*?)[ \t]*$)"
_CHECKED = r"(?md)^([^:\n]*):(?:[ \t]*$((?:\n[ \t]*-[ \t]*[^\s].*)*+)|[ \t]*(.*?)[ \t]*$)"


def unix_lines(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def split_derived(content: Column) -> Column:
    """struct (has, block, body) as pages are derived: both fences may have blanks around them, and both must be there."""
    form = r"(?sd)\A[ \t]*---[ \t]*\n((?:(?![ \t]*---[ \t]*(?:\n|\z))[^\n]*\n)*+)[ \t]*---[ \t]*(?:\n(.*))?\z"

    def of(text: Column) -> Column:
        has = text.rlike(form)
        return F.when(has, F.struct(F.lit(True).alias("has"), F.regexp_extract(text, form, 1).alias("block"), trim(F.regexp_extract(text, form, 2)).alias("body"))).otherwise(
            F.struct(F.lit(False).alias("has"), F.lit("").alias("block"), trim(text).alias("body"))
        )

    return let(unix_lines(content), of)


def split_checked(content: Column) -> Column:
    """struct (has, block, body) as pages are checked: the first line is exactly ---, and a missing end is the text's end."""

    def of(text: Column) -> Column:
        ended = r"(?s)\A---\n((?:.*?\n)??)---(?:\n(.*))?\z"
        part = lambda n: F.regexp_extract(text, ended, n)
        body = lambda x: F.regexp_replace(x, r"\A\n+", "")
        row = lambda has, block, rest: F.struct(F.lit(has).alias("has"), block.alias("block"), body(rest).alias("body"))
        return F.when(text.rlike(ended), row(True, part(1), part(2))).when(text.rlike(r"\A---(?:\n|\z)"), row(True, F.regexp_replace(text, r"\A---\n?", ""), F.lit(""))).otherwise(row(False, F.lit(""), text))

    return let(F.replace(F.coalesce(content, F.lit("")), F.lit("\r"), F.lit("")), of)


def _between(x: Column) -> Column:
    return F.substring(x, F.lit(2), F.greatest(F.length(x) - 2, F.lit(0)))


def _wrapped(x: Column, sign: str) -> Column:
    return F.startswith(x, F.lit(sign)) & F.endswith(x, F.lit(sign))


def _inline_items(value: Column) -> Column:
    """The items of [a, "b", 'c']; a double-quoted one is read as JSON where it is JSON."""
    items = F.filter(F.transform(F.split(_between(value), ","), lambda x: F.trim(x)), lambda x: x != "")
    read = lambda x: F.coalesce(F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0)), _between(x))
    return F.transform(items, lambda x: F.when((F.length(x) >= 2) & _wrapped(x, '"'), read(x)).when((F.length(x) >= 2) & _wrapped(x, "'"), _between(x)).otherwise(x))


def _bare(value: Column) -> Column:
    return F.when(_wrapped(value, '"') | _wrapped(value, "'"), _between(value)).otherwise(value)


def _last_of_each(rows: Column) -> Column:
    """Of rows with equal keys the last one, at the place of the first. Without equal keys, as is usual, nothing is searched."""
    keys = lambda rs: F.array_distinct(F.transform(rs, lambda r: r["key"]))
    return let(rows, lambda rs: F.when(F.size(keys(rs)) == F.size(rs), rs).otherwise(F.transform(keys(rs), lambda k: F.element_at(F.filter(rs, lambda r: r["key"] == k), -1))))


def _rows(block: Column, pattern: str) -> Column:
    """Array of struct (key, lines, value) of the fields, which one pass finds; each is then cut at its colon and its first line end."""

    def of(m: Column) -> Column:
        key, first = F.substring_index(m, ":", 1), F.substring_index(m, "\n", 1)
        value = F.btrim(F.substring(first, F.length(key) + 2, F.length(first)), F.lit(" \t"))
        return F.struct(key.alias("key"), F.substring(m, F.length(first) + 1, F.length(m)).alias("lines"), value.alias("value"))

    return F.transform(F.regexp_extract_all(block, F.lit(pattern), F.lit(0)), of)


def _block_items(lines: Column) -> Column:
    marked = F.filter(F.split(lines, "\n"), lambda x: x != "")
    return F.transform(marked, lambda x: F.regexp_extract(x, r"\A\s*-\s*(.*?)\s*\z", 1))


def parse(block: Column) -> Column:
    """Array of struct (key, text, items, listed) in the page's order; of equal keys, the last counts.

    A blank value is a list, of the list lines below it, and so is [..]; other values lose the quotes around them.
    """

    def of(r: Column) -> Column:
        inline = F.startswith(r["value"], F.lit("[")) & F.endswith(r["value"], F.lit("]"))
        items = F.when(r["value"] == "", F.transform(_block_items(r["lines"]), _bare)).when(inline, _inline_items(r["value"])).otherwise(F.array().cast("array<string>"))
        listed = (r["value"] == "") | inline
        return F.struct(r["key"].alias("key"), F.when(~listed, _bare(r["value"])).alias("text"), items.alias("items"), listed.alias("listed"))

    return F.transform(_last_of_each(_rows(block, _DERIVED)), of)


def parse_checked(block: Column) -> Column:
    """Array of struct (key, text, listed); the key is all before the first colon, list lines stay raw, text is as written."""
    rows = F.transform(_rows(block, _CHECKED), lambda r: F.struct(F.trim(r["key"]).alias("key"), r["lines"].alias("lines"), r["value"].alias("value")))
    return F.transform(_last_of_each(rows), lambda r: F.struct(r["key"].alias("key"), r["value"].alias("text"), (r["value"] == "").alias("listed")))


def field(fields: Column, key: str) -> Column:
    """The row of a key in the result of ``parse`` or ``parse_checked``; null without it."""
    return F.get(F.filter(fields, lambda r: r["key"] == key), F.lit(0))


def bare_text(raw: Column) -> Column:
    """A value of the checked dialect without the quotes around it."""
    return F.when((F.length(raw) >= 2) & (_wrapped(raw, '"') | _wrapped(raw, "'")), F.trim(_between(raw))).otherwise(raw)


def checked_text(fields: Column, key: str) -> Column:
    """A field of the checked dialect without quotes around it; empty if it is missing or a list."""
    return let(F.trim(F.coalesce(field(fields, key)["text"], F.lit(""))), bare_text)


def _item(x: Column) -> Column:
    text = F.trim(F.coalesce(x, F.lit("")))
    quoted = F.to_json(F.array(text))
    return F.when(text == "", '""').when(text.rlike(r"\A[A-Za-z0-9._/-]+\z"), text).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def inline_list(items: Column) -> Column:
    """[a, "b c"]: bare words as they are, other items as JSON strings."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, _item), ", "), F.lit("]"))


def serialize(fields: Column) -> Column:
    """The block of ``parse``'s rows, fences included; fields without a value and without a list are left out."""
    kept = F.filter(fields, lambda r: r["listed"] | r["text"].isNotNull())
    line = lambda r: F.concat(r["key"], F.lit(": "), F.when(r["listed"], inline_list(r["items"])).otherwise(r["text"]))
    return F.concat(F.lit("---\n"), F.array_join(F.transform(kept, line), "\n"), F.lit("\n---"))


def upsert(content: Column, fields: dict[str, Column]) -> Column:
    """The page with these fields set to rendered values (text, or ``inline_list``); all else stays as it is, the body to the byte.

    A field that is there is replaced in its place, with the list lines below it; others follow at the end of the block.
    A page without a block, or with one that has no end, gets a new one on top.
    """
    form = r"(?sd)\A[^\S\n]*---[^\S\n]*\n((?:(?![^\S\n]*---[^\S\n]*(?:\n|\z))[^\n]*\n)*+)[^\S\n]*---[^\S\n]*(?:\n(.*))?\z"
    new = {k: F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()}
    minted = F.concat(F.lit("---\n"), F.concat_ws("\n", *new.values()), F.lit("\n---\n\n"))

    def put(block: Column, key: str, line: Column) -> Column:
        safe = F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        inside = F.regexp_replace(block, F.lit(rf"(?sd)\A((?:.*?\n)??){key}:[^\n]*(?:\n[^\S\n]*-[^\S\n]+[^\n]*)*+"), F.concat(F.lit("$1"), safe))
        return F.when(block.rlike(rf"(?md)^{key}:"), inside).when(block == "", line).otherwise(F.concat(block, F.lit("\n"), line))

    def step(key: str, line: Column) -> Callable[[Column], Column]:
        return lambda block: put(block, key, line)

    def of(text: Column) -> Column:
        block = F.regexp_replace(F.regexp_extract(text, form, 1), r"\n\z", "")
        for key, line in new.items():
            block = let(block, step(key, line))
        return (
            F.when(text.rlike(form), F.concat(F.lit("---\n"), block, F.lit("\n---\n"), F.regexp_extract(text, form, 2)))
            .when(text.rlike(r"\A[^\S\n]*---[^\S\n]*(?:\n|\z)"), F.concat(minted, F.regexp_replace(text, r"\A---\n?", "")))
            .otherwise(F.concat(minted, F.regexp_replace(text, r"\A\n+", "")))
        )

    return let(F.replace(F.coalesce(content, F.lit("")), F.lit("\r\n"), F.lit("\n")), of)


def sources(fields: Column) -> Column:
    """Where a page comes from: its list of sources, else its source, else its source path."""
    clean = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")
    many, one, path = field(fields, "sources"), F.trim(field(fields, "source")["text"]), F.trim(field(fields, "sourcePath")["text"])
    none = F.array().cast("array<string>")
    return F.when(many["listed"] & (F.size(many["items"]) > 0), clean(many["items"])).when(one != "", F.array(one)).when(path != "", F.array(path)).otherwise(none)


def merge_tags(existing: Column, more: Column) -> Column:
    """Both lists in order, each tag once; blanks and nulls go."""
    none = F.array().cast("array<string>")
    both = F.transform(F.concat(F.coalesce(existing, none), F.coalesce(more, none)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(both, lambda x: x.isNotNull() & (x != "")))


def infer_tags(section: Column, project: Column, slug: Column) -> Column:
    """The section, the project, and the slug's parts of three letters or more."""
    parts = F.filter(F.transform(F.split(slug, "[-_]"), lambda x: F.lower(F.trim(x))), lambda x: F.length(x) >= 3)
    return F.array_distinct(F.array_compact(F.concat(F.array(section, project), parts)))
