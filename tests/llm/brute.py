"""Plain Python forms of the contracts, and texts that try the edges."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import regex

LOWER = {i: i + 32 for i in range(65, 91)}
EDGES = [None, "", " ", "\n\n", "...", "a", "ÀÉÎ õü", "word " * 3000, "x" * 20_000, "𝒳 😀 ‮ \u0000 end", "İstanbul ß ŉ"]


def frame(spark, texts, first=1, extra=True):
    """Documents from texts, ids from ``first`` on; a null id, a repeated row, and columns with names that operators use."""
    rows = [(first + i, t) for i, t in enumerate(texts)] + [(None, "a row without an id"), (first, texts[0])]
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    rows = [(d, t, "en", "n", 1.0, -1, "q") for d, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, score double, node long, hits string")


def shingles(text, size):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(docs, size, percent):
    """doc_id -> (n_shingles, component_id)."""
    sets = {d: shingles(t, size) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict = {}
    for d, s in sets.items():
        for t in s:
            holders.setdefault(t, []).append(d)
    for d, s in sets.items():
        for other, common in Counter(o for t in s for o in holders[t] if o < d).items():
            if 100 * common >= percent * (len(s) + len(sets[other]) - common):
                a, b = find(d), find(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contaminated(docs, items, window=13):
    windows: dict = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    sizes, out = {len(k) for k in windows}, []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if some := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= some
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def repeats(docs, length=200):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(x[i : i + length] for _, x in raw for i in range(len(x) - length + 1))
    out = []
    for d, x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(x)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest()))
    return out


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def personal_spans(text):
    """(kind, start, end, value) of every base span, by kind and start."""
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and luhn(d)
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end(), m.group()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def personal(text):
    spans = personal_spans(text)
    counts = Counter(s[0] for s in spans)
    return (*(counts[k] for k in KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans).encode()).hexdigest())


def key(row):
    return tuple((x is not None, x) if not isinstance(x, bool) else (True, int(x)) for x in row)


def disclosed(docs, prior=0.5, generalise=0.7, remove=0.9, alpha=0.05):
    """Per row (doc_id, text): lists of generalised and removed places, by plain counting over all rows."""
    term = regex.compile(r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*+")
    spans = {row: personal_spans(row[1]) for row in set(docs)}
    words_of = lambda t: {m[0].lower() for m in term.finditer(t or "")}
    n = len(docs)
    n_t = Counter(w for _, t in docs for w in words_of(t))
    holders: dict = {}
    for row, found in spans.items():
        for kind, value in {(k, v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)) for k, _, _, v in found}:
            holders.setdefault((kind, value), set()).add(row)
    classes = {frozenset(rows) for rows in holders.values()}
    pairs = {(c, w): sum(w in words_of(t) for _, t in c) for c in classes for w in {w for _, t in c for w in words_of(t)}}
    needed = 2 * math.log(max(len(pairs), 1) / alpha)

    def ratio(both, one, other):
        cells = [(both, one * other), (one - both, one * (n - other)), (other - both, (n - one) * other), (n - one - other + both, (n - one) * (n - other))]
        return 2 * sum(o * math.log(o * n / e) for o, e in cells if o > 0) if both * n > one * other else 0.0

    share: dict = {}
    for (c, w), both in pairs.items():
        if len(c) < n and ratio(both, len(c), max(n_t[w], both)) >= needed:
            p = max(n_t[w], both) / n
            s = math.log((both + prior * p) / (len(c) + prior) / p) / math.log(n / len(c))
            if s >= generalise:
                for row in c:
                    share[row, w] = max(s, share.get((row, w), 0))
    out = {}
    for row, found in spans.items():
        places = [(m.start(), m.end(), share[row, m[0].lower()]) for m in term.finditer(row[1] or "") if (row, m[0].lower()) in share]
        places = [p for p in places if not any(a < p[1] and p[0] < b for _, a, b, _ in found)]
        out[row] = ([p[:2] for p in places if p[2] < remove], [p[:2] for p in places if p[2] >= remove])
    return out
