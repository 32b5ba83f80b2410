"""Suffix sorting by Lyndon-prefix groups, many texts at a time.

The method is the public two-phase grouping construction (Baier, "Linear-time Suffix Sorting", CPM 2016).  Phase 1
takes a text's suffix groups in descending order; each member points at the nearest earlier suffix of a lower group
(its previous-smaller pointer), and the suffixes pointed at leave their groups for new ones right behind, by how
often they were pointed at.  Every group then holds the suffixes with one Lyndon prefix.  Phase 2 walks the order as
it grows: what stands before an emitted suffix takes the first free place of its group, and so do the suffixes along
its pointers.  No step renames symbols and nothing recurses.

Groups of one text depend on each other, those of different texts don't.  So the texts of a batch advance in step:
one round takes the current group of every text, with numpy over all their members.  The cost of a round is spread
over the batch; the number of rounds is that of the longest text, so callers batch texts of similar length.
"""

from __future__ import annotations

import numpy as np

SENTINEL, SEPARATOR, FIRST_BYTE = 0, 1, 2


def _spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged rows: (row of each element, its place in the row)."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _groups(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: (group, pointer) of every suffix; a group is named by its first place in the order."""
    n = len(symbols)
    text = np.repeat(np.arange(len(starts)), ends - starts)
    rank = text * (int(symbols.max()) + 1) + symbols
    order = np.argsort(rank, kind="stable").astype(np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    ranked = rank[order]
    head = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    size = np.zeros(n, np.int64)
    size[head] = np.diff(np.append(head, n))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(head, size[head])
    pointer = np.full(n, -1, np.int64)
    moved = np.zeros(n, bool)
    live, bound, first = np.arange(len(starts)), ends.copy(), starts
    while len(live):
        top = bound[live]
        low = group[order[top - 1]]
        row, offset = _spread(top - low)
        own, edge = low[row], first[live][row]
        members = order[own + offset]
        at = members - 1
        pointer[members] = at
        open_ = np.flatnonzero((at >= edge) & (group[at] >= own))
        while len(open_):
            # A higher group's pointers are final; those of this group are under way, and following them doubles the reach.
            at[open_] = pointer[at[open_]]
            pointer[members[open_]] = at[open_]
            here = at[open_]
            open_ = open_[(here >= edge[open_]) & (group[here] >= own[open_])]
        bound[live] = low
        live = live[low > first[live]]
        hit = np.sort(at[at >= edge])
        if not len(hit):
            continue
        new = np.append(True, hit[1:] != hit[:-1])
        count = np.diff(np.append(np.flatnonzero(new), len(hit)))
        hit = hit[new]
        old = group[hit]
        by = np.argsort(old * (int(count.max()) + 1) + count, kind="stable")
        hit, count, old = hit[by], count[by], old[by]
        new = np.append(True, old[1:] != old[:-1])
        heads = np.flatnonzero(new)
        taken = np.diff(np.append(heads, len(hit)))
        names = old[heads]
        keep = size[names] - taken
        seat, nth = _spread(taken)
        limit = (names + keep)[seat]
        slot, was = limit + nth, place[hit]
        moved[hit] = True
        guests = order[slot]
        guests, holes = guests[~moved[guests]], was[was < limit]
        order[holes], place[guests] = guests, holes
        order[slot], place[hit] = hit, slot
        moved[hit] = False
        new[1:] |= count[1:] != count[:-1]
        run = np.flatnonzero(new)
        lengths = np.diff(np.append(run, len(hit)))
        size[names] = keep
        size[slot[run]] = lengths
        group[hit] = np.repeat(slot[run], lengths)
    return group, pointer


def suffix_order(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffixes of each text in order, text after text.

    ``symbols``: the texts one after the other, each ended by SENTINEL, which no text holds elsewhere; ``starts``:
    where each begins.
    """
    symbols, starts = symbols.astype(np.int64), starts.astype(np.int64)
    n, ends = len(symbols), np.append(starts[1:], len(symbols))
    if not n:
        return np.zeros(0, np.int64)
    group, pointer = _groups(symbols, starts, ends)
    free = np.arange(n)
    out = np.full(n, -1, np.int64)
    done = np.zeros(n, bool)
    out[starts] = ends - 1
    done[ends - 1] = True
    free[starts] += 1
    step, edge, stop = starts.copy(), starts.copy(), ends.copy()
    at = out[step] - 1
    while len(step):
        stuck = (at < edge) | done[at]
        step = step + stuck
        alive = step < stop
        if not alive.all():
            step, edge, stop, at, stuck = step[alive], edge[alive], stop[alive], at[alive], stuck[alive]
            if not len(step):
                break
        at = np.where(stuck, out[step] - 1, at)
        ready = np.flatnonzero((at >= edge) & ~done[at])
        if len(ready):
            taken = at[ready]
            name = group[taken]
            out[free[name]] = taken
            free[name] += 1
            done[taken] = True
            at[ready] = pointer[taken]
    return out
