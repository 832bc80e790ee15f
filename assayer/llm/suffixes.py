"""Suffix arrays by two-stage sorting, and the adjacent common prefixes."""

from __future__ import annotations

import numpy as np

_PAD = 0xFF


def _eights(t: np.ndarray) -> np.ndarray:
    """The eight symbols from each position as one big-endian number, padded with zeros at the end."""
    t = np.concatenate((t, np.zeros(8, np.uint8)))
    return np.lib.stride_tricks.as_strided(t[: len(t) - 8 + 1].view(), (len(t) - 8, 8), (1, 1))


def _pack(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(">u8").ravel().astype(np.uint64)


def _refine(rank: np.ndarray, members: np.ndarray, key: np.ndarray) -> None:
    """Orders tied ``members`` by (rank, key) and gives new ranks: the place of each group's first in the whole order."""
    if int(key.max()) < 1 << 32:
        order = np.argsort(rank[members].astype(np.uint64) << np.uint64(32) | key)
    elif len(members) == len(rank) and not rank.any():
        order = np.argsort(key)
    else:
        order = np.lexsort((key, rank[members]))
    m, r, k = members[order], rank[members][order], key[order]
    new = np.ones(len(m), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    first = np.ones(len(m), bool)
    first[1:] = r[1:] != r[:-1]
    place = np.arange(len(m))
    begin = np.maximum.accumulate(np.where(first, place, 0))
    group = np.maximum.accumulate(np.where(new, place, 0))
    rank[m] = r + group - begin


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``symbols`` (uint8, 1 to 254; a smallest end is thought behind them).

    A suffix is small (S) if it is smaller than its successor, else large (L). Only S suffixes behind an L one are sorted
    directly: their stretches up to the next such are named in order, then ranks are doubled along the chain. One bucket
    scan upwards induces the L suffixes from them, one downwards the rest of S.
    """
    t = np.concatenate((symbols, np.zeros(1, np.uint8)))
    n = len(t)
    if n == 1:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(t[:-1] != t[1:])
    at = change[np.searchsorted(change, np.arange(n - 1))]
    small = np.ones(n, bool)
    small[:-1] = t[at] < t[at + 1]
    direct = np.flatnonzero(small[1:] & ~small[:-1]) + 1  # ends with the end mark, n - 1
    order = direct[np.argsort(_sort_direct(t, direct), kind="stable")]

    heads: list[list[np.ndarray]] = [[] for _ in range(256)]
    edges = np.searchsorted(t[order], np.arange(257))
    large: list[np.ndarray] = []

    def spread(entries: np.ndarray, into: list[list[np.ndarray]], own: int, kind: bool) -> np.ndarray:
        """Predecessors of ``entries`` of the wanted kind go to their buckets in order; those of the own bucket come back."""
        before = entries[entries > 0] - 1
        before = before[small[before] == kind]
        c = t[before]
        same = before[c == own]
        if len(same) < len(before):
            other, c = before[c != own], c[c != own]
            put = np.argsort(c, kind="stable")
            other, c = other[put], c[put]
            cut = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            for lo, hi in zip(cut, np.append(cut[1:], len(c)), strict=True):
                into[c[lo]].append(other[lo:hi])
        return same

    for c in range(256):
        todo, mine = (np.concatenate(heads[c]) if heads[c] else order[:0]), []
        while len(todo):
            mine.append(todo)
            todo = spread(todo, heads, c, False)
        large.append(np.concatenate(mine) if mine else order[:0])
        spread(order[edges[c] : edges[c + 1]], heads, c, False)
    tails: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    for c in range(255, -1, -1):
        todo, mine = (np.concatenate(tails[c]) if tails[c] else order[:0]), []
        while len(todo):
            mine.append(todo)
            todo = spread(todo, tails, c, True)
        if c == 0:
            continue
        down = np.concatenate(mine) if mine else order[:0]
        spread(large[c][::-1], tails, c, True)
        out += [down[::-1], large[c]]
    # buckets came downwards: S part (reversed) stands behind the L part
    return np.concatenate(out[::-1])


def _sort_direct(t: np.ndarray, direct: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at ``direct`` positions, unique."""
    m = len(direct)
    size = np.diff(np.append(direct, direct[-1] + 1)) + 1  # with the first symbol of the next stretch
    size[-1] = 1
    eights = _eights(t)
    rank = np.zeros(m, np.int64)
    members, depth = np.arange(m), 0
    lane = np.arange(8)
    while len(members):
        rows = eights[np.minimum(direct[members] + depth, len(t) - 1)].copy()
        left = size[members] - depth
        short = left < 8
        if short.any():  # behind its end a stretch is larger than any symbol: there the longer one has a large suffix
            part = rows[short]
            part[lane >= left[short][:, None]] = _PAD
            rows[short] = part
        _refine(rank, members, _pack(rows))
        depth += 8
        tie = _tied(rank)
        longest = np.zeros(m, np.int64)
        np.maximum.at(longest, rank[tie], size[tie])
        members = tie[longest[rank[tie]] > depth]  # with those of their group that have ended
    step = 1
    while len(tie := _tied(rank)):
        nxt = tie + step
        _refine(rank, tie, np.where(nxt < m, rank[np.minimum(nxt, m - 1)] + 1, 0).astype(np.uint64))
        step *= 2
    return rank


def common_prefixes(symbols: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """plcp by position: symbols that the suffix shares with the one before it in ``sa``.

    Where the symbols before both are equal, the value is one less than the position before has; only the other,
    irreducible ones are compared."""
    n = len(symbols)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    before = np.arange(n) - 1
    reducible = (phi > 0) & (before >= 0)
    reducible[reducible] = symbols[before[reducible]] == symbols[phi[reducible] - 1]
    plcp = np.zeros(n, np.int64)
    live = np.flatnonzero(~reducible & (phi >= 0))
    eights = _eights(symbols)
    padded = np.int64(n)
    while len(live):
        a, b = live + plcp[live], phi[live] + plcp[live]
        ok = np.maximum(a, b) < padded
        live, a, b = live[ok], a[ok], b[ok]
        if not len(live):
            break
        same = eights[a] == eights[b]
        run = np.where(same.all(axis=1), 8, np.argmin(same, axis=1))
        run = np.minimum(run, padded - np.maximum(a, b))
        plcp[live] += run
        live = live[run == 8]
    base = np.where(reducible, -1, np.arange(n))
    base = np.maximum.accumulate(base)
    base = np.maximum(base, 0)
    return np.maximum(plcp[base] - (np.arange(n) - base), 0) * (phi >= 0)
