"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall((text or "").encode())


def kept_runs(removed):
    return sum(r and (i == 0 or not removed[i - 1]) for i, r in enumerate(removed))


def substrings(rows, width=200):
    """rows: (id, text) -> list of (id, n_bytes, n_removed, n_spans, sha)."""
    data = [(d, (t or "").encode()) for d, t in rows]
    count = collections.Counter(b[i:i + width] for _, b in data for i in range(len(b) - width + 1))
    out = []
    for d, b in data:
        removed = [False] * len(b)
        for i in range(len(b) - width + 1):
            if count[b[i:i + width]] > 1:
                removed[i:i + width] = [True] * width
        kept = bytes(c for c, r in zip(b, removed) if not r)
        out.append((d, len(b), sum(removed), kept_runs(removed), hashlib.sha256(kept).hexdigest()))
    return out


def phrases(rows, width=20):
    first = {}
    data = [(d, words_of(t)) for d, t in rows]
    for d, w in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i:i + width]), (d, i))
    out = []
    for d, w in data:
        removed = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] != (d, i):
                removed[i:i + width] = [True] * width
        kept = b" ".join(x for x, r in zip(w, removed) if not r)
        out.append((d, len(w), sum(removed), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, k):
    w = [x.lower() for x in words_of(text)]  # bytes: A-Z only
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near(rows, k=5, percent=80):
    """(id, n_shingles, component) of rows with unique ids."""
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inverted[x].append(d)
    for d, s in sets.items():
        for e, n in collections.Counter(e for x in s for e in inverted[x] if e > d).items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return [(d, len(s), root(d)) for d, s in sets.items()]


def edit_search(item, text):
    """Smallest edit distance of item to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        prev, row[0] = row[0], i
        for j, e in enumerate(text, 1):
            prev, row[j] = row[j], min(prev + (c != e), row[j] + 1, row[j - 1] + 1)
    return min(row)
