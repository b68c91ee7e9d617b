"""Slow, plain versions of the text operators."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def shingles(text, size):
    w = words((text or "").translate(LOWER))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def duplicates(rows, size):
    """rows (doc_id, text) -> {doc_id: (n_shingles, component)}"""
    sets = {k: shingles(t, size) for k, t in rows}
    parent = {k: k for k in sets}

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    where = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            where[x].append(k)
    both = Counter((a, b) for v in where.values() for i, a in enumerate(v) for b in v[i + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(s), top(k)) for k, s in sets.items()}


def contamination(docs, items, width=13, part=20, distance=5):
    """docs (id, text), items (id, text) -> list of (id, n_words, n_hit, n_items, sha, n_near, contaminated)"""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for k, t in items:
        w = split(t)
        for i in range(max(0, len(w) - width) + 1 if w else 0):
            windows[tuple(w[i : i + width])].add("" if k is None else str(k))
    sizes, out = {len(x) for x in windows}, []
    often = Counter(x for _, t in docs for x in split(t))
    rare = {x: sorted(range(len(x)), key=lambda i: (often[x[i]], i))[:2] for x in windows if all(often[y] for y in x)}
    for k, t in docs:
        w, hit, found = split(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= ids
        places = defaultdict(list)
        for i, x in enumerate(w):
            places[x].append(i)
        near = 0
        for x, at in rare.items():
            starts = [np.array([i - o for i in places.get(x[o], ())]) for o in at]
            if len(starts) == 1:
                near += len(starts[0]) > 0
            elif len(starts[0]) and len(starts[1]):
                near += any(np.abs(starts[1] - i).min() <= distance for i in starts[0])
        out.append((k, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), near, bool(hit) and part * len(hit) >= len(w)))
    return out


def secrets(text):
    """(n_assign, n_access, n_hex, base spans)"""
    text = text or ""
    key = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found = [
        [(m.start(), m.end()) for m in re.finditer(key, text, re.ASCII) if len(m[2]) >= 6],
        [(m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        [(m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24],
    ]
    every = sorted((a, k, b) for k, spans in enumerate(found) for a, b in spans)
    return (*map(len, found), ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in every))


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def url(u):
    """(host, path, rule, verdict of the rule)"""
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    fits = []
    for verdict, rule in RULES:
        at, _, start = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def best_fit(lengths, size):
    """How many sequences best-fit decreasing opens."""
    import bisect

    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        if i == len(rooms):
            n += 1
            room = size - x
        else:
            room = rooms.pop(i) - x
        bisect.insort(rooms, room)
    return n


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5
