"""Brute-force versions of the corpus operators, in plain Python."""

import hashlib
import re
from collections import defaultdict

import xxhash


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words10(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def decontamination(docs, items, size=10):
    """(n_words, n_hit, n_items, sha256) of each (doc_id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        w = words10(text)
        k = min(size, len(w))
        if k:
            for i in range(len(w) - k + 1):
                windows[tuple(w[i:i + k])].add(item)
    lengths = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words10(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(w[i:i + k])]
        listed = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return out


def simhash(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def shingles(text, size=5):
    """Set of the runs of ``size`` words."""
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near(a, b, least=0.8):
    return a == b or len(a & b) >= least * len(a | b)


def components(ids, linked):
    """Smallest member reachable, for each of ``ids``; ``linked(i, j)`` on positions."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(x, low.get(find(i), x))
    return [low[find(i)] for i in range(len(ids))]


def targets(sizes, weights=(5, 2, 1), most=3):
    """Target of each source by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in names}
        capped |= over
