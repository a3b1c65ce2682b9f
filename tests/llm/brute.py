"""Plain versions of the corpus operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(text):
    return text.translate(str.maketrans(UPPER, LOWER))


def line_dedup(docs):
    """{row: (n_lines, n_dropped, kept_sha256)} of [(doc_id, text)]."""
    def key(x):
        return low(x.strip(" \t\n\x0b\x0c\r"))

    first = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 10:
                first[key(x)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or len(key(x)) < 10 or d == min(first[key(x)])]
        out.append((d, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return out


def substring_dedup(docs, span=13):
    """A row without a doc_id neither removes nor loses words."""
    owner = {}
    for d, t in docs:
        if d is None:
            continue
        w = WORD.findall(t or "")
        for i in range(len(w) - span + 1):
            g = tuple(w[i : i + span])
            owner[g] = min(owner.get(g, d), d)
    out = []
    for d, t in docs:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - span + 1):
            if d is not None and owner[tuple(w[i : i + span])] < d:
                gone.update(range(i, i + span))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def shingle_set(t):
    w = WORD.findall(low(t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_dedup(docs):
    sets = {d: shingle_set(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(sets[d]), find(d), d == find(d)) for d in ids]


def quality(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)


def secret_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)
