"""Secret scan with structural confirmation.

Three plain patterns give the base findings. Further candidates are reported only if their bytes hold up: PEM
blocks and base64 or hex runs must decode to DER with consistent nested lengths and the parts of a private key, SSH keys to a chain of
length-prefixed fields, and signed tokens to a JSON header that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: The label, header lines, and what they enclose.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----\s+((?:[A-Za-z0-9-]+: [^\n]*\n)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
#: A token starts where a run of its characters starts, so that a long run without dots is read once.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_BYTES = re.compile(r"[0-9A-Fa-f]{48,}")
#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "pem", "signed", "ssh", "der")


def der_ends(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> bool:
    """Whether the elements from ``at`` fill the bytes up to ``end`` exactly, nested ones too."""
    end = len(data) if end is None else end
    while at < end:
        if at + 2 > end:
            return False
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 128:
            n = size & 127
            if not 1 <= n <= 4 or at + n > end:
                return False
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end or tag in (0, 0xFF):
            return False
        if tag & 0x20 and depth < 16 and not der_ends(data, at, at + size, depth + 1):
            return False
        at += size
    return True


def der_children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """(tag, start, end) of the elements in a part of which ``der_ends`` holds."""
    found = []
    while at < end:
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 128:
            n = size & 127
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        found.append((tag, at, at + size))
        at += size
    return found


INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def is_der_key(data: bytes) -> bool:
    """A DER sequence that fills the bytes, as long as any key, with what private keys are made of.

    These are a version of 0 or 1, then an algorithm and octets, or octets, or five integers and more; or an algorithm and octets alone, if
    encrypted. Certificates, public keys and other sequences aren't keys.
    """
    if len(data) < 24 or data[0] != SEQUENCE or not der_ends(data):
        return False
    top = der_children(data, 0, len(data))
    if len(top) != 1:
        return False
    parts = der_children(data, *top[0][1:])
    tags = [tag for tag, _, _ in parts]
    algorithm = lambda k: tags[k] == SEQUENCE and [t for t, _, _ in der_children(data, *parts[k][1:])][:1] == [OID]
    if tags == [SEQUENCE, OCTETS]:
        return algorithm(0)
    if len(tags) < 2 or tags[0] != INTEGER or data[parts[0][1] : parts[0][2]] not in (b"\0", b"\1"):
        return False
    return tags[1] == OCTETS or set(tags) == {INTEGER} and len(tags) >= 6 or tags[1:3] == [SEQUENCE, OCTETS] and algorithm(1)


def ssh_fields(data: bytes, at: int, most: int | None = None) -> tuple[list[bytes], int]:
    """Length-prefixed fields from ``at`` (``most`` of them, or all that are whole) and where they end."""
    fields = []
    while at + 4 <= len(data) and (most is None or len(fields) < most):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            break
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return fields, at


SSH_MAGIC = b"openssh-key-v1\0"


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that start with a key type and end with the bytes, or an OpenSSH private key.

    The latter is cipher, derivation and its options, the number of keys, a public key for each, and the private part.
    """
    if data.startswith(SSH_MAGIC):
        head, at = ssh_fields(data, len(SSH_MAGIC), 3)
        if len(head) < 3 or at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        keys, at = ssh_fields(data, at + 4)
        return n >= 1 and len(keys) == n + 1 and at == len(data) and all(is_ssh_key(k) for k in keys[:-1])
    if len(data) < 8 or not data[4:10].startswith((b"ssh-", b"ecdsa-", b"sk-")):
        return False
    fields, at = ssh_fields(data, 0)
    return len(fields) >= 2 and at == len(data)


def from_base64(text: str) -> bytes:
    text = re.sub(r"\s|=", "", text).replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_signed_header(part: str) -> bool:
    try:
        header = json.loads(from_base64(part))
    except (ValueError, RecursionError):  # not JSON, or nested deeper than any header
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every finding, by start and then kind; code points, end exclusive."""
    text = text or ""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = from_base64(m[3])
            # An old encrypted key is whole blocks of a cipher, and its headers name that.
            if is_der_key(data) or is_ssh_key(data) or ("ENCRYPTED" in m[2] and "DEK-Info: " in m[2] and len(data) >= 24 and len(data) % 8 == 0):
                found.append(("pem", m.start(), m.end()))
    if "eyJ" in text:
        found += [("signed", m.start(), m.end()) for m in SIGNED.finditer(text) if is_signed_header(m[0].split(".")[0])]
    for m in ENCODED.finditer(text):
        data = from_base64(m[0])
        if is_ssh_key(data):
            found.append(("ssh", m.start(), m.end()))
        elif is_der_key(data):
            found.append(("der", m.start(), m.end()))
    for m in HEX_BYTES.finditer(text):
        if is_der_key(bytes.fromhex(m[0][: len(m[0]) // 2 * 2])):
            found.append(("der", m.start(), m.end()))
    return sorted(set(found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


FINDINGS = "array<struct<kind: string, start: int, `end`: int>>"


def scan_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Adds ``out``, the findings in each whole text, however long.

    A null text counts as empty; without findings the array is empty. Each row is read by itself, so repeated rows get equal
    findings and an empty table stays empty. The columns of ``docs`` stay; if one is called ``out``, the new one gets an underscore more.
    """

    @F.pandas_udf(FINDINGS)
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(x)] for x in texts])

    return docs.withColumn(free_name(docs, out), of(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows with each finding in the text replaced by ``mark``; overlapping findings become one. Null stays null."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        def clean(x: str | None) -> str | None:
            if x is None:
                return None
            parts, at = [], 0
            for _, a, b in find_secrets(x):
                if a >= at:
                    parts += [x[at:a], mark]
                at = max(at, b)
            return "".join([*parts, x[at:]])

        return pd.Series([clean(x) for x in texts])

    return docs.withColumn(text_col, of(F.col(text_col)))
