"""The rules of the corpus operators, stated plainly for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate(UPPER)


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def substring_dedup(rows, size=50):
    """rows: (id, text). Per row: n_words, n_removed, sha256 of the kept text."""
    first = {}
    for i, text in rows:
        w = plain_words(text)
        for p in range(len(w) - size + 1 if i is not None else 0):
            key = tuple(w[p : p + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = plain_words(text)
        gone = set()
        for p in range(len(w) - size + 1 if i is not None else 0):
            if first[tuple(w[p : p + size])] < i:
                gone.update(range(p, p + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def decontaminate(rows, items, span=10):
    wins = defaultdict(set)
    for i, text in items:
        w = item_words(text)
        n = min(span, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[p : p + n])].add(i)
    lengths = {len(k) for k in wins}
    out = []
    for i, text in rows:
        w = item_words(text)
        hit, found = set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in wins:
                    hit.update(range(p, p + n))
                    found |= {str(x) for x in wins[k] if x is not None}
        out.append((i, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return out


def shingles(text, k):
    w = plain_words(lower(text))
    return {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(rows, k, num, den):
    """Per row: number of shingles and the smallest id reachable by links."""
    sets = [shingles(t, k) for _, t in rows]
    roots = union(len(rows), [
        (a, b) for a in range(len(rows)) for b in range(a)
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])])
    least = {}
    for r, (i, _) in zip(roots, rows):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), least.get(r)) for (i, _), s, r in zip(rows, sets, roots)]


def union(n, pairs):
    """The smallest member of the component of each of n vertices."""
    parent = list(range(n))

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(v) for v in range(n)]
