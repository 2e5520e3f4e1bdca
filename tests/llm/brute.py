"""Plain Python answers for small tables. Documents are (id, text) in ascending id, null ids first."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)"""
)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(docs):
    return sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))


def removed(docs, size):
    """(id, n_words, n_removed, kept text)"""
    seen, out = set(), []
    for key, text in ordered(docs):
        own = PLAIN.findall(text or "")
        gone = [False] * len(own)
        for k in range(len(own) - size + 1):
            window = tuple(own[k : k + size])
            if window in seen:
                gone[k : k + size] = [True] * size
            seen.add(window)
        kept = " ".join(x for x, g in zip(own, gone, strict=True) if not g)
        out.append((key, len(own), sum(gone), kept))
    return out


def components(docs, size, percent):
    """(id, n_shingles, component); rows with an id."""
    sets = []
    for key, text in docs:
        own = PLAIN.findall((text or "").translate(LOWER))
        grams = {tuple(own[k : k + size]) for k in range(max(1, len(own) - size + 1))}
        sets.append((key, grams if own else set()))
    root = {key: key for key, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [(key, len(x), find(key)) for key, x in sets]


def hits(docs, items, window):
    """(id, n_words, n_hit, sorted item ids)"""
    windows = {}
    for item, text in items:
        own = LETTERS.findall((text or "").translate(LOWER))
        for k in range(max(1, len(own) - window + 1)) if own else ():
            windows.setdefault(tuple(own[k : k + window]), set()).add(str(item))
    out = []
    for key, text in docs:
        own = LETTERS.findall((text or "").translate(LOWER))
        covered, found = set(), set()
        for phrase, names in windows.items():
            for k in range(len(own) - len(phrase) + 1):
                if tuple(own[k : k + len(phrase)]) == phrase:
                    covered.update(range(k, k + len(phrase)))
                    found |= names
        out.append((key, len(own), len(covered), sorted(found)))
    return out


def secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    for rank, (pattern, least) in enumerate(((r"AKIA[A-Z0-9]+", 18), (r"[0-9a-f]+", 16)), 1):
        found += [
            (m.start(), rank, m.end())
            for m in re.finditer(pattern, text)
            if len(m[0]) >= least
        ]
    kinds = ("assign", "access", "hex")
    return [f"{kinds[r]}:{s}:{e}" for s, r, e in sorted(found)]


def host_and_path(url):
    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return host.translate(LOWER), path


def rule(url, rules):
    host, path = host_and_path(url)
    fit = [
        r
        for r in rules
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fit, key=lambda r: len(r.name), default=None)


def multiset(rows):
    return Counter(map(repr, rows))
