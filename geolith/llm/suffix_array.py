"""Suffix arrays by induced sorting (Nong, Zhang and Chan, 2009) in numpy, a bucket at a time.

Suffixes are classified as S or L; substrings between leftmost S suffixes are sorted by one induction, named, and their string
of names is sorted recursively; a second induction orders all suffixes. An induction visits the buckets of first characters in
order, and each bucket moves its predecessors on in one stable radix pass, so the work is linear in the text. Strings of names
have more buckets than a pass per bucket pays for; there the recursion ends in rank doubling, up to the depth that matters.
"""

from __future__ import annotations

import numpy as np

#: A string of names recurses by induction while it has this many characters per bucket.
WORTH = 256


def _classes(t: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last character is the sentinel, smaller than all."""
    n = len(t)
    differs = np.append(t[1:] != t[:-1], True)
    at = np.where(differs, np.arange(n), n - 1)
    nxt = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal characters ends
    s = np.ones(n, bool)
    before = nxt < n - 1
    s[before] = t[nxt[before]] < t[nxt[before] + 1]
    return s


def _split(p: np.ndarray, c: np.ndarray, into: list) -> None:
    """Append the positions p to the lists of their characters c, in order."""
    if not len(p):
        return
    order = np.argsort(c, kind="stable")
    p, c = p[order], c[order]
    cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(c)], strict=True):
        into[c[a]].append(p[a:b])


_NONE = np.zeros(0, np.int32)


def _join(parts: list) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else _NONE


def _induce(t: np.ndarray, k: int, seeds: np.ndarray) -> tuple[list, list]:
    """L and S parts of each bucket from the seeds (leftmost S positions, ordered within buckets); S parts come in falling order."""
    lows: list = [[] for _ in range(k)]
    highs: list = [[] for _ in range(k)]
    planted: list = [[] for _ in range(k)]
    _split(seeds, t[seeds], planted)
    larger: list = [_NONE] * k
    for c in range(k):
        part = wave = _join(lows[c])
        if len(wave):
            all_waves = [wave]
            while len(wave):
                wave = wave[wave > 0] - 1
                wave = wave[t[wave] == c]
                all_waves.append(wave)
            part = _join(all_waves)
        larger[c] = part
        source = _join([part, *planted[c]])
        if len(source):
            p = source[source > 0] - 1
            ch = t[p]
            up = ch > c
            _split(p[up], ch[up], lows)
    smaller: list = [_NONE] * k
    highs[t[-1]].append(np.array([len(t) - 1], np.int32))
    for c in range(k - 1, -1, -1):
        part = wave = _join(highs[c])
        if len(wave):
            all_waves = [wave]
            while len(wave):
                wave = wave[wave > 0] - 1
                wave = wave[t[wave] == c]
                all_waves.append(wave)
            part = _join(all_waves)
        smaller[c] = part
        source = _join([part, larger[c][::-1]])
        if len(source):
            p = source[source > 0] - 1
            ch = t[p]
            down = ch < c
            _split(p[down], ch[down], highs)
    return larger, smaller


def _name(t: np.ndarray, ordered: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Names of the leftmost positions in text order: equal substrings (to the next leftmost position) get equal names."""
    size = np.zeros(len(t), np.int32)
    size[leftmost[:-1]] = np.diff(leftmost) + 1
    size[leftmost[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    live = np.flatnonzero(size[a] == size[b])
    step = 0
    new = np.ones(len(ordered), bool)
    while len(live):
        over = size[a[live]] <= step
        new[live[over] + 1] = False
        live = live[~over]
        live = live[t[a[live] + step] == t[b[live] + step]]
        step += 1
    names = np.zeros(len(t), np.int32)
    names[ordered] = np.cumsum(new) - 1
    return names[leftmost]


def _double(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of names by their first ``depth`` names, by doubling."""
    rank = names.astype(np.int64)
    n, step = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while step < depth:
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key)
        met = key[order]
        fresh = np.append(0, np.cumsum(met[1:] != met[:-1]))
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        step *= 2
    return order


def suffix_array(t: np.ndarray, k: int, depth: int) -> np.ndarray:
    """Suffixes of t (characters under k, the last one 0 and there only) in order of their first ``depth`` characters or more."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    s = _classes(t)
    leftmost = np.flatnonzero(s[1:] & ~s[:-1]).astype(np.int32) + 1
    larger, smaller = _induce(t, k, leftmost)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    ordered = _join([x for c in range(k) for x in (smaller[c][::-1],)])
    ordered = ordered[is_leftmost[ordered]]
    names = _name(t, ordered, leftmost)
    kinds = int(names.max()) + 1
    if kinds < len(leftmost):
        if kinds * WORTH <= len(leftmost):
            below = suffix_array(names.astype(np.uint16 if kinds < 1 << 16 else np.int32), kinds, depth)
        else:
            below = _double(names, depth // 2 + 2)
        ordered = leftmost[below]
    larger, smaller = _induce(t, k, ordered)
    return _join([x for c in range(k) for x in (larger[c], smaller[c][::-1])])


def permuted_prefixes(t: np.ndarray, order: np.ndarray, heads: np.ndarray, most: int) -> np.ndarray:
    """For each position the common prefix (up to ``most`` or more) with the suffix before it in order; 0 for the first.

    In text order, a position whose predecessor in the array is one on from that of the position before has a prefix one
    shorter. Only the others, and the given heads, are compared character by character.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    chained = np.zeros(n, bool)
    chained[1:] = (phi[1:] == phi[:-1] + 1) & (phi[:-1] >= 0)
    before = np.flatnonzero(chained) - 1
    chained[before + 1] &= t[before] == t[phi[before]]
    chained[heads] = False
    start = np.flatnonzero(~chained)
    found = np.zeros(len(start), np.int64)
    live = np.flatnonzero(phi[start] >= 0)
    x, y = start[live], phi[start[live]]
    for step in range(most):
        ok = (x + step < n) & (y + step < n)
        ok[ok] = t[x[ok] + step] == t[y[ok] + step]
        found[live[~ok]] = step
        live, x, y = live[ok], x[ok], y[ok]
        if not len(live):
            break
    found[live] = most
    at = np.cumsum(~chained) - 1
    return np.maximum(found[at] - (np.arange(n) - start[at]), 0)
