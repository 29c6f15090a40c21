"""Suffix arrays of many short strings at once, by linear grouping construction.

A suffix's group is its longest Lyndon prefix.  Groups are processed from the
highest down: each member points to the nearest earlier suffix of a lower
group, and what is pointed to moves into a higher group just above its old one,
the higher the more members point to it.  When all groups are done, suffixes
are emitted in order: each emitted suffix places, group by group, those whose
Lyndon prefix ends where it begins.  Nothing is renamed or sorted again.

The construction is sequential in one string, so strings go side by side: each
round takes the next group (or the next rank) of every string with numpy.
"""

from __future__ import annotations

import numpy as np


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges ``[first, first + size)``, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)


def _lower(mem: np.ndarray, own: np.ndarray, base: np.ndarray, group: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """For each member of a group the nearest earlier position with a lower group (before ``base``: none); pointers of higher groups are known."""
    at = mem - 1
    todo = np.flatnonzero(at >= base)
    todo = todo[group[at[todo]] > own[todo]]
    while len(todo):
        at[todo] = lower[at[todo]]
        todo = todo[at[todo] >= base[todo]]
        todo = todo[group[at[todo]] > own[todo]]
    # A run of members hangs on what its first one hangs on.
    lower[mem] = at
    todo = np.flatnonzero(at >= base)
    todo = todo[group[at[todo]] == own[todo]]
    while len(todo):
        at[todo] = lower[at[todo]]
        lower[mem[todo]] = at[todo]
        todo = todo[at[todo] >= base[todo]]
        todo = todo[group[at[todo]] == own[todo]]
    return at


def lyndon_groups(symbols: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(group, lower)`` by position: the first slot of the suffix's group, and the nearest earlier suffix of a lower group."""
    total = len(symbols)
    string = np.repeat(np.arange(len(base), dtype=np.int64), size)
    key = string * (int(symbols.max(initial=0)) + 1) + symbols
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    width = np.diff(np.r_[first, total])
    slot, group, lower = np.empty(total, np.int32), np.empty(total, np.int32), np.full(total, -1, np.int32)
    slot[order] = np.arange(total, dtype=np.int32)
    group[order] = np.repeat(first, width)
    count, moves = np.zeros(total, np.int32), np.zeros(total, bool)
    count[first] = width
    start, end = base.copy(), base + size - 1
    while len(end):
        low = group[order[end]].astype(np.int64)
        n = end - low + 1
        mem = order[_ragged(low, n)]
        at = _lower(mem, np.repeat(low, n), np.repeat(start, n), group, lower)
        hit, times = np.unique(at[at >= np.repeat(start, n)], return_counts=True)
        if len(hit):
            old = group[hit]
            by = np.lexsort((times, old))
            hit, times, old = hit[by], times[by], old[by]
            head = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
            k = np.diff(np.r_[head, len(hit)])
            begin = old[head] + count[old[head]] - k
            to = _ragged(begin.astype(np.int64), k)
            moves[hit] = True
            there = order[to]
            there = there[~moves[there]]
            free = slot[hit]
            free = free[free < np.repeat(begin, k)]
            order[free], slot[there] = there, free
            order[to], slot[hit] = hit, to
            moves[hit] = False
            part = np.flatnonzero(np.r_[True, (old[1:] != old[:-1]) | (times[1:] != times[:-1])])
            count[old[head]] -= k.astype(np.int32)
            width = np.diff(np.r_[part, len(hit)])
            count[to[part]] = width
            group[hit] = np.repeat(to[part], width)
        end = low - 1
        more = end >= start
        start, end = start[more], end[more]
    return group, lower


def suffix_arrays(symbols: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Suffixes of each string in order, string after string; string ``s`` is ``symbols[base[s] : base[s] + size[s]]`` and ends with a symbol lower than all others in it."""
    base, size = np.asarray(base, np.int64), np.asarray(size, np.int64)
    out = np.empty(len(symbols), np.int32)
    if not len(symbols):
        return out
    group, lower = lyndon_groups(np.asarray(symbols), base, size)
    placed, next_free = np.zeros(len(symbols), bool), np.arange(len(symbols), dtype=np.int32)
    out[base] = base + size - 1
    placed[base + size - 1] = True
    by_size = np.argsort(-size, kind="stable")
    start, size = base[by_size], size[by_size]
    for k in range(int(size[0])):
        start = start[: np.searchsorted(-size[: len(start)], -k)]
        at = out[start + k] - 1
        here = start
        while True:
            go = at >= here
            go[go] = ~placed[at[go]]
            at, here = at[go], here[go]
            if not len(at):
                break
            g = group[at]
            out[next_free[g]] = at
            next_free[g] += 1
            placed[at] = True
            at = lower[at]
    return out
