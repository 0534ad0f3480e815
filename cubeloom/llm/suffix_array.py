"""Suffix sorting by linear grouping.

First suffixes stand in groups by their first symbol. Groups are taken in descending order; when one is taken its
suffixes' Lyndon prefixes are known in full. Each suffix of it finds its previous smaller one: the nearest position to
the left whose group is lower, reached along the pointers of the groups already taken. A position that k suffixes of
the group point to gets a prefix longer by k copies of the group's, so it moves, by ascending k, into a new group right
after its old one. In the second phase the suffix array is filled from the left: each entry's left neighbour and, from
there, the chain of previous smaller positions take the next free places of their groups, without renaming.

suffix_array does this for one text, step by step; suffix_arrays for many short texts side by side, a group of each at
a time, in numpy.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: bytes | list[int]) -> list[int]:
    """Starts of all suffixes of text in ascending order (a suffix sorts before those it is a prefix of)."""
    n = len(text)
    if n < 2:
        return list(range(n))
    heads: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        heads.setdefault(c, []).append(i)
    order: list[int] = []  # suffixes group by group
    group = [0] * n  # of a suffix: where its group starts in `order`
    place = [0] * n
    end: dict[int, int] = {}  # of a group that is not taken: its end
    for c in sorted(heads):
        first = len(order)
        order += heads[c]
        for i in heads[c]:
            group[i] = first
        end[first] = len(order)
    for k, i in enumerate(order):
        place[i] = k
    previous = [-1] * n
    top = n
    while top > 0:
        first = group[order[top - 1]]
        members = order[first:top]
        if len(members) == 1:  # the common case, without tables
            i = members[0]
            p = i - 1
            while p >= 0 and group[p] > first:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                g = group[p]
                last = end[g] - 1
                if last > g:
                    q, k = order[last], place[p]
                    order[k], order[last] = q, p
                    place[q], place[p] = k, last
                    end[g] = last
                    group[p] = last
                    end[last] = last + 1
            top = first
            continue
        members.sort()
        count: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > first:
                p = previous[p]
            if p >= 0 and group[p] == first:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        order[first:top] = members
        by_count: dict[int, list[int]] = {}
        for p, k in count.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):  # the most pointed to go last
            moved: dict[int, list[int]] = {}
            for p in by_count[k]:
                moved.setdefault(group[p], []).append(p)
            for g, parents in moved.items():
                last = end[g]
                for p in parents:
                    last -= 1
                    q, at = order[last], place[p]
                    order[at], order[last] = q, p
                    place[q], place[p] = at, last
                if last > g:
                    end[last] = end[g]
                    end[g] = last
                    for p in parents:
                        group[p] = last
        top = first
    free = list(range(n))  # of a group: its next free place
    out = [-1] * n
    placed = bytearray(n)
    for k in range(-1, n):  # the empty suffix is the least
        j = out[k] - 1 if k >= 0 else n - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return out


_MOST = 1 << 20  # symbols side by side
_FEW = 80  # texts: a step of so many side by side takes as long as they take one by one


def suffix_arrays(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """symbols: texts one after the other, of `lengths`. The suffix arrays of the texts, one after the other; entries count
    from the start of symbols. Texts go side by side but for the longest, which go one by one."""
    lengths = np.asarray(lengths, dtype=np.int64)
    start = np.cumsum(lengths) - lengths
    out = np.empty(len(symbols), np.int64)
    order = np.argsort(lengths, kind="stable")
    few = max(0, len(order) - _FEW)  # the longest texts, too few to share steps
    total = np.cumsum(lengths[order[:few]])
    at = 0
    while at < few:
        stop = max(at + 1, int(np.searchsorted(total, total[at] - lengths[order[at]] + _MOST, side="right")))
        those = order[at:stop]
        n = lengths[those]
        place = np.repeat(start[those] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[place] = place[_together(symbols[place], n)]
        at = stop
    for k in order[few:].tolist():
        a, z = start[k], start[k] + lengths[k]
        out[a:z] = np.array(suffix_array(symbols[a:z].tolist()), dtype=np.int64) + a
    return out


def _together(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """suffix_arrays of non-empty texts, all in step. A slot before each text stands for its left end."""
    size = int((lengths + 1).sum())
    text = np.repeat(np.arange(len(lengths)), lengths)
    slot = np.arange(len(symbols)) + text + 1
    left = np.cumsum(lengths + 1) - (lengths + 1)
    by_symbol = np.lexsort((symbols, text))
    new = np.append(True, (np.diff(text[by_symbol]) != 0) | (np.diff(symbols[by_symbol]) != 0))
    heads = slot[new]
    sizes = np.diff(np.append(np.flatnonzero(new), len(slot)))
    order, place, previous = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    group, end, marked = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
    order[slot], place[slot[by_symbol]] = slot[by_symbol], slot
    group[slot[by_symbol]], end[heads] = np.repeat(heads, sizes), heads + sizes

    bottom, top = left + 1, left + 1 + lengths
    while len(top):
        last = order[top - 1]
        first = group[last]
        count = top - first
        if int(count.max()) == 1:
            members, head = last, first
        else:
            ends = np.cumsum(count)
            head = np.repeat(first, count)
            members = order[head + np.arange(int(ends[-1])) - np.repeat(ends - count, count)]
        p = members - 1
        up = np.flatnonzero(group[p] > head)
        while len(up):  # the nearest to the left that is not in a higher group
            p[up] = previous[p[up]]
            up = up[group[p[up]] > head[up]]
        previous[members] = p
        up = np.flatnonzero(group[p] == head)
        while len(up):  # past members of its own group, by doubling
            p[up] = previous[p[up]]
            previous[members[up]] = p[up]
            up = up[group[p[up]] == head[up]]
        p = np.sort(p[group[p] >= 0])
        if len(p):
            edge = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            parent, copies = p[edge], np.diff(np.append(edge, len(p)))
            g = group[parent]
            by = np.lexsort((copies, g))
            parent, copies, g = parent[by], copies[by], g[by]
            edge = np.append(True, g[1:] != g[:-1])
            runs = np.append(True, edge[1:] | (copies[1:] != copies[:-1]))
            at = np.flatnonzero(edge)
            n = np.diff(np.append(at, len(g)))
            low = np.repeat(end[g[at]] - n, n)  # the parents go to the end of their group
            to = low + np.arange(len(g)) - np.repeat(at, n)
            was = place[parent]
            vacant = was[was < low]
            marked[parent] = True
            there = order[to]
            there = there[~marked[there]]
            marked[parent] = False
            order[vacant], place[there] = there, vacant
            order[to], place[parent] = parent, to
            at = np.flatnonzero(runs)
            n = np.diff(np.append(at, len(g)))
            group[parent] = np.repeat(to[at], n)
            end[g] = low
            end[to[at]] = to[at] + n
        more = first > bottom
        if more.all():
            top = first
        else:
            top, bottom = first[more], bottom[more]

    free, out = np.arange(size), np.zeros(size, np.int64)
    placed = np.zeros(size, bool)
    placed[left] = True
    j, k, stop = left + lengths, left.copy(), left + lengths
    while len(j):
        idle = placed[j]
        if idle.any():
            on = np.flatnonzero(idle)
            k[on] += 1
            if (k[on] > stop[on]).any():
                more = k <= stop
                j, k, stop, idle = j[more], k[more], stop[more], idle[more]
                on = np.flatnonzero(idle)
            j[on] = out[k[on]] - 1
        go = np.flatnonzero(~placed[j])
        if len(go):
            now = j[go]
            g = group[now]
            at = free[g]
            out[at] = now
            free[g] = at + 1
            placed[now] = True
            j[go] = previous[now]
    return out[slot] - text - 1
