"""Simple-8b word-aligned coding of token ids, in blocks.

A 64-bit word holds a 4-bit selector in its top bits and 60 bits of payload:
``COUNT[s]`` values of ``WIDTH[s]`` bits, first value in the lowest bits (the
fixed selector table of the code).  Values of 60 bits or more don't fit any
selector; they are written as 0 and kept whole in a list of escapes (position,
value).  Every block of ``BLOCK`` values starts on a word of its own, so blocks
decode independently and all words of one selector at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
# fixed values: values a word and bits a value, by selector
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def _bits(v: np.ndarray) -> np.ndarray:
    """Bits of each value: the binary exponent, taken by 32-bit halves to be exact."""
    if not len(v) or v.max() < 1 << 53:
        return np.frexp(v.astype(np.float64))[1].astype(np.int8)
    high, low = v >> np.uint64(32), v & np.uint64((1 << 32) - 1)
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1],
                    np.frexp(low.astype(np.float64))[1]).astype(np.int8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """-> words (uint64), word offset of every block (one more than blocks), and the
    positions and values of the escapes.  All blocks advance together, a word a step."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    blocks = -(-n // BLOCK)
    escape = np.flatnonzero(v >> np.uint64(60))
    escaped = v[escape]
    if len(escape):
        v = v.copy()
        v[escape] = 0
    end = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    bits = _bits(v)
    pad = np.zeros(n + 240, np.uint64)
    pad[:n] = v
    choice = np.full(n, 15, np.int8)
    # run of n values that fit: doubled runs, then two overlapping ones
    for s in range(14, -1, -1):  # the smallest selector that fits is set last
        c = int(COUNT[s])
        if c > n:
            continue
        ok, have = bits <= WIDTH[s], 1
        while have < c and len(ok):
            step = min(have, c - have)
            ok = ok[:-step] & ok[step:]
            have += step
        if not ok.any():
            break  # narrower values in longer runs don't occur either
        choice[:n - c + 1][ok] = s
    at = np.arange(blocks, dtype=np.int64) * BLOCK
    live = np.arange(blocks)
    starts, owners, chosen = [], [], []
    while len(live):
        pos, stop = at[live], end[live]
        s = choice[pos].astype(np.int64)
        while True:  # a word may not run over the end of its block
            over = pos + COUNT[s] > stop
            if not over.any():
                break
            s[over] += 1
        starts.append(pos)
        owners.append(live)
        chosen.append(s)
        at[live] = pos + COUNT[s]
        live = live[at[live] < end[live]]
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), escape, escaped
    pos, own, sel = (np.concatenate(x) for x in (starts, owners, chosen))
    order = np.argsort(pos, kind="stable")
    pos, own, sel = pos[order], own[order], sel[order]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        rows = np.flatnonzero(sel == s)
        if len(rows):
            p = pos[rows]
            acc = pad[p].copy()
            for k in range(1, int(COUNT[s])):
                acc |= pad[p + k] << np.uint64(k * int(WIDTH[s]))
            words[rows] |= acc
    offsets = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=blocks))))
    return words, offsets, escape, escaped


def decode(words: np.ndarray, escape: np.ndarray | None = None,
           escaped: np.ndarray | None = None) -> np.ndarray:
    """Values of any run of whole blocks (escape positions relative to its start)."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNT[sel]
    start = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(int(start[-1]), np.uint64)
    for s in range(2, 16):
        rows = np.flatnonzero(sel == s)
        if len(rows):
            mask = np.uint64((1 << int(WIDTH[s])) - 1)
            w, p = words[rows], start[rows]
            for k in range(int(COUNT[s])):
                out[p + k] = (w >> np.uint64(k * int(WIDTH[s]))) & mask
    if escape is not None and len(escape):
        out[escape] = escaped
    return out
