"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def quality(text):
    text = text or ""
    w = words(text)
    n = len(w)
    triples = [tuple(w[i : i + 3]) for i in range(n - 2)]
    count = Counter(triples)
    hit = {i + j for i, t in enumerate(triples) if count[t] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, k):
    w = [x for x in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def jaccard_groups(docs, k, num, den):
    sets = {d: shingle_set(t, k) for d, t in docs}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    common = Counter()
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                common[a, b] += 1
    links = [(a, b) for (a, b), c in common.items() if den * c >= num * (len(sets[a]) + len(sets[b]) - c)]
    return {d: len(s) for d, s in sets.items()}, components(sets, links)


def vector_groups(rows, threshold):
    """rows: (id, list or None); vectors of one length link with each other."""
    good = defaultdict(list)
    for i, v in rows:
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[len(v)].append((i, np.array(v, np.float64)))
    links = []
    n = Counter()
    for same in good.values():
        x = np.stack([v / np.linalg.norm(v) for _, v in same])
        a, b = np.nonzero(x @ x.T >= threshold)
        for i, j in zip(a.tolist(), b.tolist()):
            if i != j:
                n[same[i][0]] += 1
                links.append((same[i][0], same[j][0]))
    return n, components([i for i, _ in rows], links)


def substring(docs, window):
    """{doc: (n_words, n_removed, kept words)}"""
    first = {}
    for d, t in sorted(docs):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    return out, sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in out))


def crc(b: bytes) -> int:
    return zlib.crc32(b)
