"""Columns over page text and paths. All of them are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as page authors type them, no-break space and byte-order mark included.
BLANK = r"[\s\x{00A0}\x{FEFF}]"
_BLANKS = " \t\n\x0b\f\r\u00a0\ufeff"
#: A link's label may hold one level of brackets; an escaped bracket starts none. Loops are possessive, as others take a stack
#: frame a round and fail on long lines.
LINK = r"(?<!\\)!?\[(?!\])[^\[\]\n]*+(?:\[[^\]\n]*+\][^\[\]\n]*+)*+\]\(([^)\n]*)\)"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with the value computed once, however often ``of`` uses it, inside other lambdas too."""
    return F.transform(F.array(value), of)[0]


def trim(text: Column) -> Column:
    """The text without blanks at both ends, found from the ends: a pattern would try every run of blanks in a page."""
    return F.btrim(text, F.lit(_BLANKS))


def trim_carriage(text: Column) -> Column:
    """The text with line feeds as its only line ends."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def frontmatter_block(content: Column) -> Column:
    """The lines between the page's first --- and the next; empty without either."""
    return F.regexp_extract(content, r"(?s)\A---[ \t]*\n(.*?)(?<=\n)---[ \t]*(?:\n|\z)", 1)


def body(content: Column) -> Column:
    """What follows the frontmatter, trimmed."""
    return trim(F.regexp_replace(content, r"(?s)\A---[ \t]*\n.*?(?<=\n)---[ \t]*(?:\n|\z)", ""))


#: A line that opens or ends a code fence, of either kind and however far it is indented.
FENCE = r"[^\S\n]*(?:```|~~~)"


def strip_fences(text: Column) -> Column:
    """The text without fenced blocks; each fence line starts or ends a block in turn, and the text ends one that is open."""
    plain = F.replace(text, F.lit("\r"), F.lit(""))
    return F.regexp_replace(plain, rf"(?m)^{FENCE}[^\n]*(?:\n(?!{FENCE})[^\n]*)*+(?:\n{FENCE}[^\n]*)?", "")


def strip_code(text: Column) -> Column:
    """The text without fenced blocks and inline code."""
    return F.regexp_replace(strip_fences(text), r"`[^`\n]*`", "")


def link_targets(text: Column) -> Column:
    """The raw targets of the text's links, in order."""
    return F.regexp_extract_all(strip_code(text), F.lit(LINK), F.lit(1))


def clean_target(raw: Column) -> Column:
    """Without title and anchor, percent-decoded if that works."""
    bare = F.split(F.regexp_replace(F.trim(raw), r"\s+\".*\"\z", ""), "#")[0]
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def is_external(target: Column) -> Column:
    """an anchor of the page itself, or a URI with a scheme."""
    return target.rlike(r"\A(#|(?i)[a-z][a-z0-9+.-]*:)")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"\A(?:(.*)/)?[^/]*\z", 1)


def resolve(base: Column, target: Column) -> Column:
    """The target's path from a folder; null if it leaves the tree."""
    parts = F.split(F.concat_ws("/", F.when(base != "", base), target), "/")
    fold = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out")),
        lambda acc, x: F.struct(
            F.when(x.isin("", "."), acc["at"]).when(x == "..", F.slice(acc["at"], F.lit(1), F.greatest(F.size(acc["at"]) - 1, F.lit(0)))).otherwise(F.concat(acc["at"], F.array(x))).alias("at"),
            (acc["out"] | ((x == "..") & (F.size(acc["at"]) == 0))).alias("out"),
        ),
    )
    return F.when(~fold["out"], F.array_join(fold["at"], "/"))


#: Elements that go with what they hold, tags that become line ends, entities in the order in which they are read, and
#: what a text loses at both ends.
_UNREAD = ("script", "style", "noscript")
_LINE_TAGS = ("main", "article", "section", "p", "div", "li", "h[1-6]", "br", "tr", "td", "th", "blockquote")
_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_ENDS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def html_to_text(html: Column) -> Column:
    """P10: what a page says: some elements go, blocks become lines, other tags blanks; runs of blanks and of empty lines become one. Null is empty.

    A tag counts as one that becomes a line if its name starts with the name of one.
    """
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"\r\n?", "\n")
    for name in _UNREAD:
        text = F.regexp_replace(text, rf"(?is)<{name}\b.*?</{name}>", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{'|'.join(_LINE_TAGS)})[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for name, sign in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return F.regexp_replace(text, rf"\A{_ENDS}|{_ENDS}\z", "")


def slugify(text: Column) -> Column:
    """Lower case, other characters than letters and digits become single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def page_title(content: Column, path: Column) -> Column:
    """The frontmatter's title, else the first heading, else the file's stem."""
    given = F.regexp_extract(frontmatter_block(content), r"(?m)^title:[ \t]*(.*?)[ \t]*$", 1)
    heading = F.regexp_extract(body(content), r"(?m)^[ \t]*#\s+(.+?)[ \t]*$", 1)
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?\z", 1)
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(heading, F.lit("")), stem)


def section(text: Column, heading: str) -> Column:
    """What stands below a level-two heading of a body, trimmed; of equal headings the last one's; empty without it."""
    found = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(rf"(?s)\n##[ \t]+{heading}[ \t]*(?=\n|\z)(.*?)(?=\n##[ \t]+[^\n]|\z)"), F.lit(1))
    return F.when(F.contains(text, F.lit(heading)), trim(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")))).otherwise("")


def _first_three(lines: Column) -> Column:
    return F.array_join(F.slice(lines, 1, 3), " ")


def summary_section(content: Column, fallback: Column | None = None) -> Column:
    """The first three lines of the Summary section that are no list items, in one line.

    Without such lines, the body's first three lines that are neither headings nor list items, its title aside;
    without those, ``fallback``, else an empty text.
    """
    return let(body(content), lambda text: summary_of(text, section(text, "Summary"), fallback))


def summary_of(text: Column, summary: Column, fallback: Column | None = None) -> Column:
    """P4, of a body and its Summary section."""
    last = F.lit("") if fallback is None else fallback
    said = F.filter(content_lines(summary), lambda x: ~F.startswith(x, F.lit("- ")))
    prose = lambda: F.filter(content_lines(strip_leading_title(text)), lambda x: ~x.rlike(r"\A(?:###?|[-*])\s"))
    return let(said, lambda a: F.when(F.size(a) > 0, _first_three(a)).otherwise(let(prose(), lambda p: F.when(F.size(p) > 0, _first_three(p)).otherwise(last))))


def intro(text: Column) -> Column:
    """A body's first line that is no heading, no comment and not blank, its blanks squeezed; empty if there is none."""
    lines = F.filter(content_lines(text), lambda x: ~x.rlike(r"\A(?:#|<!--)"))
    return F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), r"\s+", " ")


def stem(path: Column) -> Column:
    """The file's name without .result.md or .md."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(path, "/", -1), r"\.result\.md\z", ""), r"\.md\z", "")


def humanize(slug: Column) -> Column:
    """Hyphens and underscores as blanks; Untitled for nothing."""
    words = trim(F.regexp_replace(F.coalesce(slug, F.lit("")), "[-_]+", " "))
    return F.when(words == "", "Untitled").otherwise(words)


def file_slug(text: Column) -> Column:
    """A name for files: lower case, without .result, runs of other characters than letters, digits, dots, underscores and
    hyphens as single hyphens; untitled for nothing."""
    low = F.regexp_replace(F.lower(trim(F.coalesce(text, F.lit("")))), r"\.result\z", "")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9._-]+", "-"), "-+", "-"), r"\A-|-\z", "")
    return F.when(bare == "", "untitled").otherwise(bare)


def path_parts(path: Column) -> Column:
    """P25: struct (dir, name, ext, depth): ext in lower case and without its dot, depth the number of folders above."""
    name = F.substring_index(path, "/", -1)
    ext = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return F.struct(directory(path).alias("dir"), name.alias("name"), ext.alias("ext"), (F.size(F.split(path, "/")) - 1).alias("depth"))


def blob_sha1(content: Column) -> Column:
    """The name of a blob: SHA-1 of its length and bytes; content is binary."""
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary"), F.lit(b"\x00"), content))


def stamp_key(path: Column, millis: Column) -> Column:
    """SHA-1 of path and time, which tells whether a version was taken before."""
    return F.sha1(F.concat(path, F.lit(":"), millis.cast("string")).cast("binary"))


def region(text: Column, name: str) -> Column:
    """What stands between the start and end markers of a generated region, trimmed; null without both."""
    form = rf"(?s)<!-- {name}:start -->\n?(.*?)\n?<!-- {name}:end -->"
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    return let(plain, lambda x: F.when(x.rlike(form), trim(F.regexp_extract(x, form, 1))))


def strip_region(text: Column, name: str) -> Column:
    """The text without the first region, markers included; as it is without both markers."""
    form = rf"(?s)\A(.*?)<!-- {name}:start -->.*?<!-- {name}:end -->"
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), form, "$1")


def replace_region(text: Column, name: str, inside: Column, heading: str) -> Column:
    """The text with ``inside`` between its first start and last end marker; without both, with a new region below ``heading``."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[\s\x{00A0}\x{FEFF}]+\z", "")
    return let(plain, lambda plain: _put_region(plain, name, inside, heading))


def _put_region(plain: Column, name: str, inside: Column, heading: str) -> Column:
    block = F.concat(F.lit(f"<!-- {name}:start -->\n"), trim(F.regexp_replace(inside, r"\r\n?", "\n")), F.lit(f"\n<!-- {name}:end -->"))
    form = rf"(?s)<!-- {name}:start -->.*<!-- {name}:end -->"
    safe = F.replace(F.replace(block, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    put = F.regexp_replace(plain, F.lit(form), safe)
    return F.concat(F.when(plain.rlike(form), put).otherwise(F.concat(plain, F.lit(f"\n\n## {heading}\n\n"), block)), F.lit("\n"))


def region_targets(inside: Column) -> Column:
    """The cleaned targets of the list lines of a region, sorted; labels may hold brackets."""
    found = F.regexp_extract_all(inside, F.lit(r"(?m)^\s*-\s+\[.+?\]\(([^)]+)\)(?=\s+—|\s*$)"), F.lit(1))
    return F.array_sort(F.filter(F.transform(found, clean_target), lambda x: x != ""))


def ancestors(path: Column) -> Column:
    """The folders above a path, the root (an empty string) first."""
    parts = F.split(directory(path), "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.concat(F.array(F.lit("")), F.filter(below, lambda d: d != ""))


def demote_headings(text: Column, by: int = 2) -> Column:
    """Every heading ``by`` levels lower, but no lower than six."""
    marks = lambda line: F.regexp_extract(line, r"\A(#{1,6})(?=\s+.)", 1)
    lower = lambda line: F.repeat(F.lit("#"), F.least(F.length(marks(line)) + by, F.lit(6)))
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.when(marks(x) != "", F.concat(lower(x), F.regexp_replace(x, r"\A#{1,6}", ""))).otherwise(x))
    return trim(F.array_join(lines, "\n"))


def strip_leading_title(text: Column) -> Column:
    """The text without a first line that is a level-one heading."""
    return trim(F.regexp_replace(trim(F.replace(text, F.lit("\r\n"), F.lit("\n"))), r"\A#\s+[^\n]*", ""))


def encode_target(path: Column) -> Column:
    """Per cent sign, brackets and blanks of a link target, percent-encoded."""
    for sign, code in (("%", "%25"), ("(", "%28"), (")", "%29"), (" ", "%20")):
        path = F.replace(path, F.lit(sign), F.lit(code))
    return path


def content_lines(text: Column) -> Column:
    """The trimmed lines of a text that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trim), lambda x: x != "")


def bullets(section: Column) -> Column:
    """The list items of a section, without their hyphen."""
    return F.transform(F.filter(content_lines(section), lambda x: F.startswith(x, F.lit("- "))), lambda x: trim(F.substring(x, 3, 2**31 - 1)))


def sanitize_description(text: Column, most: int = 240) -> Column:
    """P20: the first line that is not blank, without list marks and quotes around it; empty if there is none."""
    first = F.coalesce(F.try_element_at(content_lines(text), F.lit(1)), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(first, r"\A[>#\-*\s]+", ""), "\\A[\"'`]+|[\"'`]+\\z", "")
    return F.substring(trim(F.regexp_replace(bare, r"\s+", " ")), 1, most)


def sanitize_tokens(text: Column, most: int, chars: int) -> Column:
    """Up to ``most`` tokens between commas and line ends, cleaned; regardless of case the first spelling stays."""
    clean = lambda x: F.substring(trim(F.regexp_replace(trim(F.regexp_replace(F.regexp_replace(x, r"[\[\]\r]+", " "), r"\s+", " ")), "\\A[\"'`]+|[\"'`]+\\z", "")), 1, chars)
    tokens = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[\n,]"), clean), lambda x: x != "")
    lower = F.transform(tokens, F.lower)
    return F.slice(F.filter(tokens, lambda x, k: F.array_position(lower, F.lower(x)) == k + 1), 1, most)


def parse_pointer(content: Column) -> Column:
    """Struct (oid, size) of a large-file pointer of three exact lines and 1,024 bytes at most; else null."""
    form = r"\Aversion https://git-lfs\.github\.com/spec/v1\noid sha256:([0-9a-f]{64})\nsize (0|[1-9][0-9]{0,15})\n\z"
    size = F.regexp_extract(content, form, 2).try_cast("long")
    fits = (F.octet_length(content) <= 1024) & content.rlike(form) & (size < 2**53)
    return F.when(fits, F.struct(F.regexp_extract(content, form, 1).alias("oid"), size.alias("size")))


def render_pointer(oid: Column, size: Column) -> Column:
    """P27, the other way round."""
    return F.concat(F.lit("version https://git-lfs.github.com/spec/v1\noid sha256:"), oid, F.lit("\nsize "), size.cast("string"), F.lit("\n"))


def ledger_line(at: Column, fields: dict[str, Column]) -> Column:
    """A dated ledger line; fields without a value are left out."""
    parts = [F.when(trim(v.cast("string")) != "", F.concat(F.lit(f"{k}="), trim(v.cast("string")))) for k, v in fields.items()]
    return F.concat(F.lit("- "), at.cast("string"), F.lit(" | "), F.concat_ws(" | ", *parts))


def parse_ledger_line(line: Column) -> Column:
    """Struct (at, fields) of a ledger line; null for other lines."""
    parts = F.split(F.regexp_replace(line, r"\A- ", ""), r" \| ")
    pairs = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.contains(x, F.lit("=")))
    split = F.transform(pairs, lambda x, k: F.struct(F.substring_index(x, "=", 1).alias("k"), (-k).alias("at"), F.regexp_replace(x, r"\A[^=]*=", "").alias("v")))
    ranked = F.array_sort(split)  # equal keys together, the last of them first
    last = F.filter(ranked, lambda x, k: (k == 0) | ~F.get(ranked, k - 1)["k"].eqNullSafe(x["k"]))
    return F.when(F.startswith(line, F.lit("- ")), F.struct(parts[0].alias("at"), F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"]))).alias("fields")))


def is_placeholder(text: Column) -> Column:
    """nothing but a remark in round brackets."""
    return trim(text).rlike(r"(?s)\A\(.*\)\z")


def is_date(text: Column) -> Column:
    """a day that the calendar has, as yyyy-mm-dd; false for null."""
    day = trim(text)
    return F.coalesce(day.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_datetime(text: Column) -> Column:
    """a day, the letter T and a time, as a cast to a timestamp takes it; false for null."""
    moment = trim(text)
    return F.coalesce(moment.rlike(r"\d{4}-\d{2}-\d{2}T") & moment.try_cast("timestamp").isNotNull(), F.lit(False))


def is_integer(text: Column, least: int | None = None, exact: int | None = None) -> Column:
    """a whole number, not below ``least`` and equal to ``exact`` where given; false for null."""
    n = trim(text).try_cast("decimal(38, 6)")
    good = n == F.floor(n)
    if least is not None:
        good &= n >= least
    return F.coalesce(good if exact is None else good & (n == exact), F.lit(False))


def source_type(source: Column, is_file: Column) -> Column:
    """url, else file where ``is_file`` (a join with the known paths) is true, else text."""
    return F.when(trim(source).rlike(r"(?i)\Ahttps?://"), "url").when(is_file, "file").otherwise("text")


def short_error(text: Column, most: int = 400) -> Column:
    """The first line and the last one that names an error, if it is another."""
    lines = content_lines(text)
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    named = F.filter(lines, lambda x: x.rlike(r"(?i)error|fail|denied|refus|not supported|timed out"))
    last = F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit(""))
    return F.substring(F.when((last != "") & (last != first), F.concat(first, F.lit(" … "), last)).otherwise(first), 1, most)
