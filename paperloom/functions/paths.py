"""Paths as columns: patterns, Unicode keys, what can be checked out, and kinds of files."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The endings of files that are kept as large objects.
LARGE_EXTENSIONS = (
    *("png", "jpg", "jpeg", "gif", "webp", "heic", "psd", "aseprite", "sai", "bmp", "tif", "tiff", "exr"),
    *("blend", "blend1", "glb", "ply", "stl", "3mf", "model", "fbx", "vdb"),
    *("obj", "gltf", "step", "stp", "gcode", "bgcode"),
    *("mp4", "mov", "webm", "mkv", "avi"),
    *("mp3", "wav", "m4a", "ogg", "flac", "aif", "aiff"),
    *("pdf", "hwp", "docx", "xlsx", "pptx", "xls", "doc", "hwpx", "odp"),
    *("zip", "zst", "gz", "tgz", "7z", "tar", "aar"),
    *("ttf", "otf", "woff2"),
    *("npy", "npz", "sqlite"),
    *("wasm", "ipynb"),
)

#: Names of locks, temporary files and caches that nobody wants kept.
JUNK_PATTERNS = (
    ".fts/",
    "*.commit-lock",
    ".*.commit-lock",
    "*.tmp",
    "*.tmp.*",
    "*.tmp-*",
    "*.tmp-journal",
    ".~*",
    "*.gc-backup-*",
    ".DS_Store",
    "__pycache__/",
    "*.pyc",
)


def extension(path: Column) -> Column:
    """The ending of the file's name in lower case, without its dot; empty without one."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def is_large_path(path: Column) -> Column:
    """a path whose ending says that it holds a large object."""
    return extension(path).isin(*LARGE_EXTENSIONS)


def looks_binary(head: Column) -> Column:
    """a zero byte among the first 8,000; head is binary, null counts as text."""
    return F.coalesce(F.contains(F.substring(head, 1, 8000), F.lit(b"\x00")), F.lit(False))


_PIECE = re.compile(r"\*+|\?|\[[!^]?\]?[^\]]*\]|\\.|.", re.DOTALL)


def _glob(pattern: str) -> str:
    """A Java regular expression for a pattern: * and ? stay within a name, **/ and /** span folders."""
    out = []
    for m in _PIECE.finditer(pattern):
        piece, before, after = m[0], pattern[: m.start()], pattern[m.end() :]
        if piece[0] == "*":
            folders = piece == "**" and (not before or before.endswith("/"))
            out.append("(?:.*/)?\0" if folders and after.startswith("/") else ".*" if folders and before and not after else "[^/]*")
        elif piece == "?":
            out.append("[^/]")
        elif piece[0] == "[" and len(piece) > 2:
            negated = piece[1] in "!^"
            inner = piece[1 + negated : -1].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&&", "&\\&")
            out.append(f"[^/{inner}]" if negated else f"[{inner}]")
        else:
            out.append(re.escape(piece[-1]))
    return "".join(out).replace("\0/", "").replace("\0\\/", "")


@dataclass(frozen=True)
class Pattern:
    """A line of a pattern list: what it says, the names it is made of, whether they start at the root, and whether it means folders only."""

    line: str
    body: str
    rooted: bool
    folder: bool

    @classmethod
    def read(cls, lines: list[str] | tuple[str, ...]) -> list[Pattern]:
        """The patterns of a list, without blank lines and remarks; one that is negated is an error."""
        found = []
        for line in lines:
            said = re.fullmatch(r"(?P<root>/*)(?P<body>.*?)(?P<folder>/*)(?:(?<!\\)\s)*", line, re.DOTALL)
            if said["body"].startswith("#") and not said["root"] or not said["body"]:
                continue
            if line.startswith("!"):
                raise ValueError(f"a pattern can't be negated: {line}")
            found.append(cls(line, said["body"], bool(said["root"]) or "/" in said["body"], bool(said["folder"])))
        return found

    def below(self, folder: str) -> str:
        """The line that means the same files, seen from above ``folder``."""
        names = [*folder.split("/"), *([] if self.rooted else ["**"]), self.body]
        return "/".join([*filter(None, names), *([""] if self.folder else [])])


def match_patterns(path: Column, patterns: list[str] | tuple[str, ...], ignore_case: bool = False) -> Column:
    """the pattern that covers a path, null if none: of the shallowest folder or file that one covers, the first in the list.

    A pattern with a slash holds from the root, others for any name; one that ends with a slash covers folders only. Blank
    patterns and those that start with # are passed over; a pattern that starts with ! is an error.
    """
    found = [(p, ("(?i)" if ignore_case else "") + rf"\A{_glob(p.body)}\z") for p in Pattern.read(patterns)]
    if not found:
        return F.lit(None).cast("string")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")

    def covers(p: Column) -> Column:
        def at(n: Column) -> Column:
            prefix, name = F.array_join(F.slice(p, F.lit(1), n), "/"), F.element_at(p, n)
            fits = [(prefix if one.rooted else name).rlike(form) & (F.lit(not one.folder) | (n < F.size(p))) for one, form in found]
            return F.coalesce(*[F.when(fit, F.lit(one.line)) for fit, (one, _) in zip(fits, found, strict=True)])

        return F.get(F.array_compact(F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda n: F.when(n <= F.size(p), at(n)))), F.lit(0))

    return F.transform(F.array(parts), covers)[0]


def rebased_patterns(patterns: list[str] | tuple[str, ...], folder: str) -> list[str]:
    """the patterns of a tree below ``folder``, as ones of the whole repository."""
    return [p.below(folder) for p in Pattern.read(patterns)]


def unicode_keys(path: Column) -> Column:
    """Struct (nfc, case_key, unassigned): the composed form, the key under which names that differ in case or composition
    only are equal (decomposed, folded, decomposed again), and whether a character isn't assigned.

    By the tables of Python's ``unicodedata``. Null stays null in all three.
    """

    @F.pandas_udf(T.StructType.fromDDL("nfc string, case_key string, unassigned boolean"))
    def of(paths: pd.Series) -> pd.DataFrame:
        rows = []
        for p in paths:
            if p is None:
                rows.append((None, None, None))
            elif p.isascii():
                rows.append((p, p.lower(), False))
            else:
                folded = unicodedata.normalize("NFD", unicodedata.normalize("NFD", p).casefold())
                rows.append((unicodedata.normalize("NFC", p), folded, any(unicodedata.category(c) == "Cn" for c in p)))
        return pd.DataFrame(rows, columns=["nfc", "case_key", "unassigned"])

    return of(path)


#: Characters that some file systems pass over, and the largest name, path and link target in bytes.
IGNORABLE = r"[\x{200c}-\x{200f}\x{202a}-\x{202e}\x{206a}-\x{206f}\x{feff}]"
NAME_BYTES, PATH_BYTES, LINK_BYTES, LINK_CHECKOUT_BYTES = 255, 768, 4096, 1023


def checkout_problems(path: Column, keys: Column) -> Column:
    """what keeps a path from being checked out everywhere, as an array of codes. ``path`` is binary, ``keys`` are its ``unicode_keys``."""
    text = path.cast("string")
    parts = F.split(text, "/")
    as_read = lambda x: F.regexp_replace(x, IGNORABLE, "")
    found = F.array(
        F.when(keys["nfc"] != text, "not-nfc"),
        F.when(keys["unassigned"], "unassigned"),
        F.when(F.exists(parts, lambda x: as_read(x).rlike(r"(?i)\A(\.git[. ]*|git~1)\z")), "dot-git"),
        F.when(F.exists(parts, lambda x: x.isin("", ".", "..")), "bad-component"),
        F.when(F.exists(parts, lambda x: x == "..namedfork"), "named-fork"),
        F.when(F.exists(parts, lambda x: F.octet_length(x) > NAME_BYTES), "long-name"),
        F.when(F.octet_length(path) > PATH_BYTES, "long-path"),
    )
    return F.when(~F.is_valid_utf8(text), F.array(F.lit("not-utf8"))).otherwise(F.array_compact(found))


def is_modules_link(path: Column) -> Column:
    """A path whose last name reads as .gitmodules."""
    return F.regexp_replace(F.substring_index(path, "/", -1), IGNORABLE, "").rlike(r"(?i)\A\.gitmodules\z")


def crosses_secret_dir(path: Column) -> Column:
    """F8: a path through a folder of secrets or of copies kept after conflicts, at any depth and in any case."""
    return F.exists(F.split(path, "/"), lambda x: F.lower(x).isin("_credentials", "_sync-conflicts"))
