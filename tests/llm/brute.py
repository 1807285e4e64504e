"""Plain versions of the operators' contracts over rows in memory."""

import hashlib
import re

SPACE = re.compile("[\x20\x09-\x0d]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def space_words(text):
    return [w for w in SPACE.split(lower_ascii(text)) if w]


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def near_duplicates(docs, k, percent):
    sets = {}
    for doc_id, text in docs:
        w = space_words(text)
        n = min(k, len(w))
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    links = set()
    for d, s in sets.items():
        met = {}
        for x in s:
            for e in holders[x]:
                if e > d:
                    met[e] = met.get(e, 0) + 1
        for e, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                links.add((d, e))
    found = smallest_reachable(sets, links)
    return {d: (len(s), found[d], found[d] == d) for d, s in sets.items()}


TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contamination(docs, items, size):
    windows = {}
    for item, text in items:
        w = TERM.findall(lower_ascii(text))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = TERM.findall(lower_ascii(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (phrase := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[phrase]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return out
