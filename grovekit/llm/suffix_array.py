"""Suffix array by induced sorting, and the permuted common-prefix array, over small integer strings."""

from __future__ import annotations

import numpy as np


#: Alphabets up to this size are induced a bucket at a time, larger ones a suffix at a time.
WIDE = 512


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour. The last symbol is the least and occurs once."""
    n = len(s)
    step = np.sign(np.diff(s))
    # a tie takes the type of the next position that differs
    where = np.where(step != 0, np.arange(n - 1), n)
    where = np.minimum.accumulate(where[::-1])[::-1]
    t = np.empty(n, bool)
    t[-1] = True
    inside = where < n
    t[:-1] = False
    t[:-1][inside] = step[where[inside]] > 0
    return t


def suffix_array(s: np.ndarray, size: int) -> np.ndarray:
    """Positions of s in the order of their suffixes; s ends with the symbol 0, which occurs nowhere else; symbols < size."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = suffix_types(s)
    marks = np.flatnonzero(small[1:] & ~small[:-1]) + 1  # leftmost smaller positions
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    if size <= WIDE:
        induce = lambda m: _induce_by_bucket(s, small, m, size)
    else:
        args = s.tolist(), small.tolist(), (ends - counts).tolist(), (ends - 1).tolist()
        induce = lambda m: np.array(_induce(*args[:2], m.tolist(), *args[2:]), np.int64)

    order = induce(marks)
    # name the substrings between marks in their sorted order; equal neighbours share a name
    is_mark = np.zeros(n, bool)
    is_mark[marks] = True
    by_substring = order[is_mark[order]]
    following = np.full(n, n - 1, np.int64)
    following[marks[:-1]] = marks[1:]
    raw = s.astype(np.int32).tobytes()
    differs = [1] * len(by_substring)
    last = b""
    for i, (a, b) in enumerate(zip((by_substring * 4).tolist(), (following[by_substring] * 4 + 4).tolist(), strict=True)):
        piece = raw[a:b]
        differs[i] = int(piece != last)
        last = piece
    names = np.cumsum(differs) - 1
    if names[-1] + 1 < len(marks):
        named = np.empty(n, np.int64)
        named[by_substring] = names
        inner = suffix_array(named[marks], int(names[-1]) + 1)
        by_suffix = marks[inner]
    else:
        by_suffix = by_substring
    return induce(by_suffix)


def _induce_by_bucket(s: np.ndarray, small: np.ndarray, marks: np.ndarray, size: int) -> np.ndarray:
    """_induce() a bucket at a time: all suffixes that stand in a bucket send their left neighbours on at once. A bucket
    that sends to itself takes further turns, as many as its symbol's longest run."""

    def split(p: np.ndarray, into: list[list[np.ndarray]]) -> None:
        if len(p):
            c = s[p]
            o = np.argsort(c, kind="stable")
            p, c = p[o], c[o]
            cuts = (np.flatnonzero(c[1:] != c[:-1]) + 1).tolist()
            for a, z in zip([0, *cuts], [*cuts, len(p)], strict=True):
                into[int(c[a])].append(p[a:z])

    def send(a: np.ndarray, to_small: bool, into: list[list[np.ndarray]]) -> None:
        p = a[a > 0] - 1
        split(p[small[p] == to_small], into)

    def drain(bucket: list[np.ndarray], to_small: bool, into: list[list[np.ndarray]]) -> np.ndarray:
        done = []
        while bucket:
            a = np.concatenate(bucket)
            bucket.clear()
            done.append(a)
            send(a, to_small, into)
        return np.concatenate(done) if done else np.empty(0, np.int64)

    starts: list[list[np.ndarray]] = [[] for _ in range(size)]
    split(marks, starts)
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(size)]
    placed = []
    for c in range(size):
        placed.append(drain(larger[c], False, larger))
        for m in starts[c]:
            send(m, False, larger)
    out = []
    smaller[0].append(np.array([len(s) - 1]))
    for c in range(size - 1, -1, -1):
        out.append(drain(smaller[c], True, smaller)[::-1])
        out.append(placed[c])
        send(placed[c][::-1], True, smaller)
    return np.concatenate(out[::-1])


def _induce(symbols: list[int], is_small: list[bool], marks: list[int], heads: list[int], tails: list[int]) -> list[int]:
    """Places marks at their buckets' ends in the order given, then larger suffixes from the left, smaller from the right."""
    out = [-1] * len(symbols)
    free = tails.copy()
    for p in reversed(marks):
        c = symbols[p]
        out[free[c]] = p
        free[c] -= 1
    free = heads.copy()
    for p in out:  # the list grows ahead of the reader
        if p > 0 and not is_small[p - 1]:
            c = symbols[p - 1]
            out[free[c]] = p - 1
            free[c] += 1
    free = tails.copy()
    for i in range(len(out) - 1, -1, -1):
        p = out[i]
        if p > 0 and is_small[p - 1]:
            c = symbols[p - 1]
            out[free[c]] = p - 1
            free[c] -= 1
    return out


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each rank the length of the prefix shared with the rank before, by way of the array permuted into text order.

    In text order a length is one less than that of the position before, unless the symbols before the two suffixes
    differ. Only such positions are compared, several symbols at a time; the others follow from them.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    inner = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    own[inner] = s[inner - 1] != s[before[inner] - 1]
    padded = np.concatenate((s, np.zeros(3, s.dtype))).astype(np.uint64)
    four = padded[:n] | padded[1 : n + 1] << np.uint64(16) | padded[2 : n + 2] << np.uint64(32) | padded[3 : n + 3] << np.uint64(48)
    at = np.flatnonzero(own & (before >= 0))
    length = np.zeros(n, np.int64)
    i, j = at.copy(), before[at]
    while len(at):  # the last symbol occurs once, so no comparison runs past the end
        x = four[i] ^ four[j]
        same = x == 0
        rest, y = at[~same], x[~same]
        length[rest] += ((y & np.uint64(0xFFFF)) == 0).astype(np.int64) + ((y & np.uint64(0xFFFFFFFF)) == 0) + ((y & np.uint64(0xFFFFFFFFFFFF)) == 0)
        at, i, j = at[same], i[same] + 4, j[same] + 4
        length[at] += 4
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    permuted = length[last] - (np.arange(n) - last)
    return permuted[sa]
