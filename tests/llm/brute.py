"""Plain, slow versions of the operators, for small inputs."""

import re
from collections import defaultdict


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lowered)


def shingles(text, size=5):
    w = words(text)
    if not w:
        return set()
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def jaccard_components(docs, percent=75):
    """{id: (n_shingles, component)} by comparing all documents that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    component = smallest_reachable(sets, links)
    return {i: (len(s), component[i]) for i, s in sets.items()}


def kept_bytes(docs, window=100):
    """{id: (removed spans, kept bytes)} by a table of all windows in order of (id, start)."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - window + 1):
            w = data[a : a + window]
            if w in seen:
                gone[a : a + window] = b"\1" * window
            seen.add(w)
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out[i] = (spans, bytes(b for b, g in zip(data, gone) if not g))
    return out


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base_secrets(text):
    """(kind, start, stop) of the fixed patterns, by start and kind."""
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]
