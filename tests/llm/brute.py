"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile("[^ \x09-\x0d]+")
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def shingles(text: str | None, size: int) -> set:
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def near_groups(docs: list[tuple[int, str | None]] | dict[int, str | None], size: int, percent: int = 80) -> dict[int, int]:
    """id -> smallest id reachable; rows with one id are one node."""
    rows = [(i, shingles(t, size)) for i, t in (docs.items() if isinstance(docs, dict) else docs)]
    rows.sort(key=lambda r: len(r[1]))
    parent = {i: i for i, _ in rows}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for n, (a, x) in enumerate(rows):
        for b, y in rows[n + 1 :]:
            if len(x) * 100 < percent * len(y):
                break
            common = len(x & y)
            if x and 100 * common >= percent * (len(x) + len(y) - common):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in parent}


def repeats(texts: list[str | None], length: int) -> list[np.ndarray]:
    """Which bytes of each text go."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def repeat_row(text: str | None, gone: np.ndarray) -> tuple[int, int, int, str]:
    data = (text or "").encode()
    spans = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum())
    return len(data), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest()


def secrets(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, name) of the base rules."""
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def redact(text: str, mark: str, rules) -> str:
    found = sorted((m.start(), m.end()) for r in rules for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least)
    out, at = "", 0
    for a, b in found:
        if a >= at:
            out += text[at:a] + mark
        at = max(at, b)
    return out + text[at:]
