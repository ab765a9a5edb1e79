"""Plain versions of the operators' rules, for comparison on small inputs."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(grams)
    covered = set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            covered.update(range(i, i + 8))
    n, r = len(words), len(covered)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": r,
        "base_failed": n < 20 or 100 * r > 30 * n,
    }


def shingles(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near(docs, n, percent):
    """[(doc_id, text)] to {doc_id: (n_shingles, component)} by comparing all pairs."""
    sets = {d: shingles(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}
