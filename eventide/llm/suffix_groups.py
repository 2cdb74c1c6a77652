"""Suffix arrays by linear grouping, for many small texts at once.

Phase one sorts the suffixes into groups by their Lyndon prefix. It starts from groups by first symbol and takes the groups in
descending order. For each suffix of the group in hand, the *previous smaller* pointer leads to the nearest
suffix to the left that stands in a lower group; pointers of suffixes in higher groups are known and shorten the walk. A suffix to
which ``k`` pointers of the group lead has a Lyndon prefix that continues with ``k`` copies of the group's prefix: it moves up
into a new group of its count, just above the rest of its old group.

Phase two emits the order of each group in ascending order of groups: a suffix ``u^k y`` of the group with prefix ``u`` goes by ``k``
and by the rank of ``y``, which stands in a lower group and has its rank already. Nothing is renamed or sorted recursively.

Texts are independent, so step ``t`` takes the ``t``-th group of every text in one set of array operations. A step touches only the
members of the groups in hand and the suffixes they point to.
"""

from __future__ import annotations

import numpy as np

#: Symbols below the bytes: the end of a text, once per text, and the mark between its pieces.
END, MARK, FIRST = 0, 1, 2


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _run_starts(*keys: np.ndarray) -> np.ndarray:
    """For each place the first place of its run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _grouped(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in the order of their groups, each suffix's group (the place where it starts), its Lyndon prefix's length."""
    n = len(symbols)
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = texts * 512 + symbols
    order = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = np.full(n + 1, -1)  # the last entry stands before all texts
    starts = _run_starts(key[order])
    group[order] = starts
    size = np.bincount(starts, minlength=n)
    length = np.ones(n, np.int64)
    previous = np.full(n, -1)
    moved = np.zeros(n, bool)
    low, top = offsets[:-1].copy(), offsets[1:].copy()
    while len(low):
        start = group[order[top - 1]]
        sizes = top - start
        own = order[_ranges(start, sizes)]
        own_group, own_low = np.repeat(start, sizes), np.repeat(low, sizes)
        left = own - 1
        above = np.flatnonzero(group[left] > own_group)
        while len(above):
            left[above] = previous[left[above]]
            above = above[group[left[above]] > own_group[above]]
        previous[own] = left
        same = np.flatnonzero(group[left] == own_group)
        while len(same):
            left[same] = previous[left[same]]
            previous[own[same]] = left[same]
            same = same[group[left[same]] == own_group[same]]
        inside = left >= own_low
        if inside.any():
            _move_up(left[inside], length[own[inside]], order, place, group, size, length, moved)
        go = start > low
        low, top = low[go], start[go]
    return order, group, length


def _move_up(targets, prefix, order, place, group, size, length, moved) -> None:
    """Split the suffixes that are pointed to off their groups, by the number of pointers."""
    up, first, count = np.unique(targets, return_index=True, return_counts=True)
    by = np.lexsort((count, group[up]))
    up, count, add = up[by], count[by], (count * prefix[first])[by]
    old = group[up]
    old_run = _run_starts(old)
    here = np.arange(len(up))
    heads = np.flatnonzero(old_run == here)
    quantity = np.diff(np.append(heads, len(up)))
    tail = np.repeat(old[heads] + size[old[heads]] - quantity, quantity)
    target = tail + here - old_run
    # Whoever stands in the tail without moving changes places with those that move from below it.
    moved[up] = True
    standing = order[target]
    stay = standing[~moved[standing]]
    moved[up] = False
    gaps = place[up][place[up] < tail]
    order[gaps], place[stay] = stay, gaps
    order[target], place[up] = up, target
    new_run = _run_starts(old, count)
    new_group = tail + new_run - old_run
    size[old[heads]] -= quantity
    new_heads = np.flatnonzero(new_run == here)
    size[new_group[new_heads]] = np.diff(np.append(new_heads, len(up)))
    group[up] = new_group
    length[up] += add


def suffix_order(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The suffix arrays of the texts ``symbols[offsets[t]:offsets[t + 1]]``, one after the other, as places in ``symbols``.

    Every text ends with its only ``END``.
    """
    order, group, length = _grouped(symbols.astype(np.int64), offsets.astype(np.int64))
    n = len(order)
    rest = np.append(np.arange(n) + length, n)
    hops = np.ones(n + 1, np.int64)
    on = np.flatnonzero(group[rest[:n]] == group[:n])
    while len(on):
        to = rest[on]
        hops[on] += hops[to]
        rest[on] = rest[to]
        on = on[group[rest[on]] == group[on]]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.arange(n)
    rank[n] = -1
    in_order = group[order]
    heads = np.flatnonzero(_run_starts(in_order) == np.arange(n))
    sizes = np.diff(np.append(heads, n))
    heads, sizes = heads[sizes > 1], sizes[sizes > 1]
    text = np.searchsorted(offsets, heads, side="right")
    turn = np.arange(len(heads)) - _run_starts(text) if len(heads) else heads
    by_turn = np.argsort(turn, kind="stable")
    ends = np.cumsum(np.bincount(turn)) if len(turn) else []
    begin = 0
    for end in ends:
        now = by_turn[begin:end]
        begin = end
        spots = _ranges(heads[now], sizes[now])
        own = order[spots]
        own = own[np.lexsort((rank[rest[own]], hops[own], group[own]))]
        order[spots] = own
        rank[own] = spots
    return order


def repeats(data: np.ndarray, order: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """For each place in ``order`` whether its suffix shares its first ``width`` bytes with the one before it.

    ``valid`` marks the starts after which ``width`` bytes of one piece follow. Words of eight bytes are compared from the front.
    """
    x = np.concatenate([data, np.zeros(width + 8, np.uint8)]).astype(np.uint64)
    for step, shift in ((1, 8), (2, 16), (4, 32)):
        x = (x[:-step] << np.uint64(shift)) | x[step:]
    pairs = np.flatnonzero(valid[order[1:]] & valid[order[:-1]]) + 1
    for at in [*range(0, width - 8, 8), width - 8]:
        pairs = pairs[x[order[pairs] + at] == x[order[pairs - 1] + at]]
    equal = np.zeros(len(order), bool)
    equal[pairs] = True
    return equal
