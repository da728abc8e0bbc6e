"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text, lower=True):
    return WORD.findall(lowered(text) if lower else text or "")


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n=5):
    """doc_id -> (set size, smallest reachable id)."""
    sets = {}
    for d, t in rows:
        s = shingles(t, n)
        if d not in sets or len(s) > len(sets[d]):
            sets[d] = s
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    shared = Counter()
    for ids in where.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                shared[min(a, b), max(a, b)] += 1
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), c in shared.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ("assign", "access", "hex")
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def span_digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def quality_counts(text):
    text = text or ""
    w = words(text, lower=False)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(inside)
