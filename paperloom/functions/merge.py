"""Three-way merge of texts by lines, for one row at a time."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher


def _aligned(a: list[str], b: list[str]) -> dict[int, int]:
    """Places of a that stay in b. What the texts share at both ends is aligned without a search, as ledgers mostly grow at their end."""
    most = min(len(a), len(b))
    head = next((k for k in range(most) if a[k] != b[k]), most)
    tail = next((k for k in range(most - head) if a[-1 - k] != b[-1 - k]), most - head)
    found = {k: k for k in range(head)} | {len(a) - 1 - k: len(b) - 1 - k for k in range(tail)}
    blocks = SequenceMatcher(None, a[head : len(a) - tail], b[head : len(b) - tail], autojunk=False).get_matching_blocks()
    return found | {head + m.a + k: head + m.b + k for m in blocks for k in range(m.size)}


def _chunks(base: list[str], ours: list[str], theirs: list[str]) -> Iterator[tuple[list[str], list[str], list[str]]]:
    """The texts cut at the lines of the base that both sides keep; such a line is a chunk of its own."""
    in_ours, in_theirs = _aligned(base, ours), _aligned(base, theirs)
    b = o = t = 0
    for k in sorted(in_ours.keys() & in_theirs.keys()):
        yield base[b:k], ours[o : in_ours[k]], theirs[t : in_theirs[k]]
        yield [base[k]], [base[k]], [base[k]]
        b, o, t = k + 1, in_ours[k] + 1, in_theirs[k] + 1
    yield base[b:], ours[o:], theirs[t:]


def _both(ours: list[str], theirs: list[str]) -> list[str]:
    """Lines in common once, between them ours and then theirs."""
    out, o, t = [], 0, 0
    for k, m in sorted(_aligned(ours, theirs).items()):
        out += [*ours[o:k], *theirs[t:m], ours[k]]
        o, t = k + 1, m + 1
    return [*out, *ours[o:], *theirs[t:]]


def merged_text(base: str, ours: str, theirs: str) -> str:
    """The texts' merge; where both sides changed a place in different ways, the lines of both."""
    out: list[str] = []
    for b, o, t in _chunks(*(x.splitlines(keepends=False) for x in (base, ours, theirs))):
        out += t if o == b else o if t == b or o == t else _both(o, t)
    ended = any(x.endswith("\n") for x in (ours, theirs))
    return "\n".join(out) + ("\n" if ended and out else "")
