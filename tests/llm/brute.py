"""Plain versions of the text operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def jaccard(rows, n, num, den):
    sets = {}
    for d, t in rows:
        w = words((t or "").translate(LOW))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    inverse = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            inverse[g].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d, s in sets.items():
        for o, k in Counter(o for g in s for o in inverse[g] if o < d).items():
            if den * k >= num * (len(s) + len(sets[o]) - k):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def word_dedup(rows, window=50):
    first, out = {}, {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def suffix_dedup(rows, length=400):
    count, out = Counter(), {}
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    for d, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out[d] = (len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def surrogates(texts, pii, key):
    """Draws entity by entity: of those that want one surrogate the least keeps
    it, the earlier draw first; none may be an entity that occurs."""
    said = [[m for m in pii.mentions(t) if m[0] != "initial"] if t else [] for t in texts]
    draw = {m[:2]: 0 for ms in said for m in ms}
    while True:
        new = {e: pii.surrogate(key, *e, k) for e, k in draw.items()}
        first = {}
        for e in draw:
            w = (e[0], new[e])
            first[w] = min(first.get(w, (draw[e], e[1])), (draw[e], e[1]))
        bad = [e for e in draw if first[e[0], new[e]][1] != e[1] or (e[0], new[e]) in draw]
        if not bad:
            break
        for e in bad:
            draw[e] += 1
    out = []
    for t, ms in zip(texts, said):
        for kind, entity, a, b in reversed(ms):
            t = t[:a] + pii.shaped(kind, t[a:b], new[kind, entity]) + t[b:]
        out.append(t)
    return dict(enumerate(out))
