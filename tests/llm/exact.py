"""Exact near-duplicate components on the driver, for tests."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(docs, percent):
    """{id: (set size, component, kept)}, by a prefix filter over all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    by = {}
    for i in sorted(sets):
        by.setdefault(sets[i], i)
    freq = Counter(x for s, i in by.items() for x in s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    seen = defaultdict(list)
    for s, i in sorted(by.items(), key=lambda x: len(x[0])):
        others = set()
        for x in sorted(s, key=lambda x: (freq[x], x))[: len(s) - (-(-percent * len(s) // 100)) + 1]:
            others.update(seen[x])
            seen[x].append(i)
        for j in others:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                join(i, j)
    for i, s in sets.items():
        if s:
            join(i, by[s])
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
