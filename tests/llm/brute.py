"""Plain versions of the operators, one row at a time, that the tests hold the real ones against."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(rb"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def simhash(text, n):
    words = SPACED.findall(low(text))
    grams = [b" ".join(words[k:k + n]) for k in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(rows, n, bits):
    """rows: (doc_id, text) -> {index of row: (hex, component)}."""
    fp = [simhash(t, n) for _, t in rows]
    own = list(range(len(rows)))

    def root(k):
        while own[k] != k:
            k = own[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= bits:
                own[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(f"{fp[k]:016x}", least.get(root(k))) for k in range(len(rows))]


def decontaminate(docs, items, n=10):
    wins = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            wins[tuple(w[k:k + n])].add(i)
    out = []
    for i, t in docs:
        w = ALNUM.findall(low(t))
        hit, ids = set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k:k + size])) in wins:
                    hit |= {*range(k, k + size)}
                    ids |= wins[g]
        ids.discard(None)
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), bool(hit)))
    return out


def repeats(docs, n=13):
    words = [[w.decode() for w in SPACED.findall((t or "").encode())] for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - n + 1) if i is not None else ():
            g = tuple(w[k:k + n])
            least[g] = min(least.get(g, i), i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = {p for k in range(len(w) - n + 1) if i is not None and least[tuple(w[k:k + n])] < i for p in range(k, k + n)}
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def boilerplate(docs, sites):
    bare = lambda x: x.strip(" \t\r\x0b\x0c")
    on = defaultdict(set)
    for _, t, s in docs:
        for x in (t or "").split("\n") if t is not None and s is not None else ():
            on[bare(x)].add(s)
    bad = {x for x, s in on.items() if len(s) >= sites and x}
    out = []
    for i, t, _ in docs:
        xs = [] if t is None else t.split("\n")
        rest = [x for x in xs if bare(x) not in bad]
        cut = any(map(bare, rest))
        out.append((i, len(xs), len(xs) - len(rest) if cut else 0, "\n".join(rest) if cut else t))
    return out


def licenses(text, rules, confidence):
    words = [w.decode() for w in ALNUM.findall(low(text))]
    norm = " " + "".join(w + " " for w in words)
    found = []
    for order, (label, priority, keys, rx) in enumerate(rules):
        if any(k in words for k in keys):
            for m in re.finditer(f"(?<= )(?:{rx})(?= )", norm):
                start = norm[:m.start()].count(" ") - 1
                found.append((start, start + m[0].count(" ") + 1, priority, order, label))
    kept = []
    for d in found:
        inside = [e for e in found if e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and (e[:3] != d[:3] or e[3] < d[3])]
        if not inside:
            kept.append(d)
    base, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        hits = [k for k in range(len(words) - len(p) + 1) if words[k:k + len(p)] == p]
        base += hits
        labels |= {label} if hits else set()
    every = sorted(labels | {d[4] for d in kept})
    score = max((confidence[d[2]] for d in kept), default=0.0)
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(labels)), ",".join(every), score


def hamming_ball(seed, count, flips):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    return [int(base) ^ sum({1 << int(b) for b in rng.integers(0, 64, flips)}) for _ in range(count)]
