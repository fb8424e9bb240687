"""Plain versions of the operators, on lists of ``(id, text)``."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, width):
    words = [WORD.findall(text or "") for _, text in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), kept))
    return out


def line_dedup(rows, min_docs):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    docs = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            docs[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if not key(line) or len(docs[key(line)]) < min_docs]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def fingerprint(text):
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def near_groups(rows, budget=3):
    prints = [fingerprint(text) for _, text in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                group[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = root(i)
            least[r] = min(least.get(r, doc), doc)
    return [(doc, f"{prints[i]:016x}", least.get(root(i))) for i, (doc, _) in enumerate(rows)]


def tiling(text, item, min_match):
    """Greedy string tiling by trying all pairs of positions."""
    a, b = (re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(t)) for t in (text, item))
    least = min(min_match, len(b))
    in_a, in_b, total = set(), set(), 0
    while least:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in in_a and j + k not in in_b:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            break
        k, i, j = best
        in_a.update(range(i, i + k))
        in_b.update(range(j, j + k))
        total += k
    return total, len(b)
