"""Plain versions of the operators for small inputs."""

import hashlib
import re

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return [w.decode() for w in WORD.findall((text or "").encode())]


def terms(text):
    return [w.decode() for w in TERM.findall((text or "").encode().translate(LOWER))]


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text, shingle=3):
    w = [x.lower() if x.isascii() else x.encode().translate(LOWER).decode() for x in words(text)]
    if not w:
        return 0
    parts = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def repeats(docs, k=13):
    """[(key, text)] -> {position: (key, n_words, n_removed, kept)}; null keys are largest."""
    big = float("inf")
    first = {}
    for key, text in docs:
        w = words(text)
        for i in range(len(w) - k + 1):
            g = tuple(w[i:i + k])
            first[g] = min(first.get(g, big), big if key is None else key)
    out = []
    for key, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < (big if key is None else key):
                gone.update(range(i, i + k))
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contamination(docs, items, length=13, share=20):
    windows = {}
    for item, text in items:
        w = terms(text)
        for i in range(max(1, len(w) - length + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + length]), set()).add(None if item is None else str(item))
    sizes = {len(g) for g in windows}
    out = []
    for key, text in docs:
        w, hit, names = terms(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                g = tuple(w[i:i + n])
                if g in windows:
                    hit.update(range(i, i + n))
                    names |= windows[g] - {None}
        out.append((key, len(w), len(hit), tuple(sorted(names)), len(hit) > 0 and share * len(hit) >= len(w)))
    return out


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
