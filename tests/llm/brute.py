"""Plain single-machine versions of the contracts, to compare with."""

import collections
import hashlib
import re
import zlib


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n if doc_id is not None else None


def shingles(t, size):
    w = words(lower(t))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def components(docs, size=4, percent=80):
    """doc_id -> (n_shingles, smallest doc_id reachable), for texts by doc_id."""
    sets = {i: shingles(t, size) for i, t in docs.items()}
    up = {i: i for i in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(docs, length=50):
    """doc_id -> (bytes, removed, spans, digest of the rest)."""
    first, out = {}, {}
    for i in sorted(docs):
        raw = (docs[i] or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if first.setdefault(w, i) < i:
                gone[k : k + length] = b"\1" * length
        left = bytes(x for x, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(left).hexdigest())
    return out


def measures(t):
    w = words(t)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {j for k in range(len(w) - 2) if c[w[k], w[k + 1], w[k + 2]] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(cover))


def contamination(text, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = collections.defaultdict(set)
    for k, t in items:
        w = cut(t)
        for a in range(len(w) - min(window, len(w)) + 1 if w else 0):
            grams[tuple(w[a : a + window])].add(str(k))
    w, hit, found = cut(text), set(), set()
    for n in {len(g) for g in grams}:
        for a in range(len(w) - n + 1):
            if tuple(w[a : a + n]) in grams:
                found |= grams[tuple(w[a : a + n])]
                hit |= set(range(a, a + n))
    return (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
