"""Plain versions of the corpus operators, one text at a time, to test against."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

A_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text, k=4):
    w = space_words((text or "").translate(A_Z))
    runs = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    counts = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(runs))


def shingles(text, k=5):
    w = space_words((text or "").translate(A_Z))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def components(rows, k=4, distance=4):
    """{doc_id: (hex fingerprint, component)}"""
    prints = {d: fingerprint(t, k) for d, t in rows}
    u = np.array(sorted(set(prints.values())), np.uint64)
    parent = list(range(len(u)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= distance) + i + 1:
            parent[root(int(j))] = root(i)
    at = {int(x): i for i, x in enumerate(u)}
    least = {}
    for d, f in prints.items():
        r = root(at[f])
        least[r] = min(least.get(r, d), d)
    return {d: (f"{f:016x}", least[root(at[f])]) for d, f in prints.items()}


def repeated_words(rows, k=50):
    """{doc_id: (n_words, n_removed, sha256)}"""
    words = {d: space_words(t) for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][i : i + k]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def benchmark_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_Z).encode())


def contamination(rows, items, k=10):
    """{doc_id: (n_words, n_hit, n_items, sha256, contaminated)}"""
    windows = {}
    for i, t in items:
        w = benchmark_words(t)
        for s in range(max(1, len(w) - k + 1)):
            if w:
                windows.setdefault(tuple(w[s : s + k]), set()).add(i)
    sizes = sorted({len(w) for w in windows})
    out = {}
    for d, t in rows:
        w = benchmark_words(t)
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= got
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def near(text, item, k, slop):
    """Whether all words of a window of the item stand, in any order, in a stretch of slop more words."""
    w, v = benchmark_words(text), benchmark_words(item)
    for s in range(max(1, len(v) - k + 1)) if v else ():
        window = v[s : s + k]
        if any(set(window) <= set(w[b : b + len(window) + slop]) for b in range(len(w))):
            return True
    return False


SECRETS = {
    "assign": (re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def secrets(rows):
    """{doc_id: (n_assign, n_access, n_hex, sha256)}"""
    out = {}
    for d, t in rows:
        spans = [(m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(SECRETS.items()) for m in p.finditer(t or "") if ok(m)]
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        out[d] = (*(sum(s[2] == k for s in spans) for k in SECRETS), hashlib.sha256(base.encode()).hexdigest())
    return out


def token_digest(rows, encode, end_id=2):
    """{doc_id: (start, n, crc)}"""
    at, out = 0, {}
    for d, t in sorted(rows):
        ids = [*encode(t or ""), end_id]
        out[d] = (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def nearest(vectors, n=10):
    """{query: [(score, vec_id)]}; vectors: {vec_id: list or None}"""
    ok = {}
    for v, x in vectors.items():
        if x is not None and all(y is not None for y in x):
            a = np.asarray(x, float)
            if np.isfinite(a).all() and a.any():
                ok[v] = a
    ids = np.array(sorted(ok))
    m = np.array([ok[i] for i in ids])
    out = {}
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((m - ok[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:n]
        out[int(q)] = [(float(d[i]), int(ids[i])) for i in order]
    return out
