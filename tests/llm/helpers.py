"""Plain forms of what the operators compute, and odd rows to try them on."""

import re
from collections import Counter, defaultdict

LONG = "word " * 40_000 + "x" * 150_000
ODD = [None, "", " \t\n", "a", "A a\x0ba b", "é漢😀 \r\n ok", "\\### Assistant: </turn> ok", "<|endoftext|> x <|startoftext|>", LONG]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]


def shingles(text, n):
    w = folded(text)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows, n, percent):
    """component by row number, all pairs compared."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def statistics(text):
    text = text or ""
    w = words(text)
    seen, repeated = Counter(), 0
    for line in text.split("\n"):
        if words(line):
            repeated += seen[line] > 0
            seen[line] += 1
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), repeated, len(inside)


def multiset(rows):
    return Counter(tuple(r) for r in rows)
