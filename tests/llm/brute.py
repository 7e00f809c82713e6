"""The same results the plain way, on small tables."""

import re
from collections import Counter
from hashlib import sha256

import numpy as np


def tokens(text):
    return (text or "").encode().lower().split()


def shingles(text, k=5):
    w = tokens(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def least_reachable(ids, linked):
    """The least id that links reach, for each place; `linked` gives pairs of places."""
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in linked:
        up[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return [None if ids[i] is None else least[find(i)] for i in range(len(ids))]


def near(rows, percent):
    """[(id, n_shingles, component_id)] of rows (id, text)."""
    s = [shingles(t) for _, t in rows]
    ids = [i for i, _ in rows]
    pairs = [(a, b) for a in range(len(s)) for b in range(a) if s[a] and s[b] and ids[a] is not None and ids[b] is not None and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    return [(i, len(x), c) for i, x, c in zip(ids, s, least_reachable(ids, pairs), strict=True)]


def repeats(rows, length=200):
    """[(id, n_bytes, n_removed, n_spans, sha)] of rows (id, text)."""
    body = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(b[k : k + length] for _, b in body for k in range(len(b) - length + 1))
    out = []
    for i, b in body:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if n[b[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0, sha256(kept).hexdigest()))
    return out


def secrets(text):
    text = text or ""
    out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def cosines(rows, least):
    """[(id, n_links, component_id)] of rows (id, vector)."""
    fine = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ids = [i for i, _ in rows]
    v = [np.array(x, np.float32).astype(float) if i is not None and fine(x) else None for i, x in rows]
    v = [None if x is None else x / np.sqrt((x * x).sum()) for x in v]
    pairs = [(a, b) for a in range(len(v)) for b in range(a) if v[a] is not None and v[b] is not None and len(v[a]) == len(v[b]) and v[a] @ v[b] >= least]
    n = Counter(x for p in pairs for x in p)
    return [(i, n[k], c) for k, (i, c) in enumerate(zip(ids, least_reachable(ids, pairs), strict=True))]
