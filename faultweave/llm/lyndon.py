"""Suffix array by grouping on Lyndon prefixes, in linear time."""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of text in ascending order.

    First all suffixes are grouped by their first byte. Groups are taken from the greatest down.
    For each suffix of a group the pointer to its previous smaller one is found: the nearest place
    before it whose group is smaller. A place that k suffixes of the group point to begins with
    its own group's prefix followed k times by this group's, so it moves to a new group right
    after its own, beyond those with fewer. In the end a group holds the suffixes of one longest
    Lyndon prefix.

    Then groups are filled from the front, starting from the end of the text: the place before a
    suffix just put, and along the pointers all before it that aren't put yet, are next in their
    groups. No names are made anew and nothing recurses.
    """
    n = len(text) + 1  # with an end smaller than every byte
    group, size, order, place = _by_first_byte(text, n)
    smaller = [-1] * n  # the pointer of each suffix that was in a group already taken
    hop = [-1] * n  # as smaller, with ways shortened
    high = n
    while high > 1:
        low = group[order[high - 1]]
        members = sorted(order[low:high])
        pointed = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = hop[p]
            smaller[s] = hop[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            _move(pointed, group, size, order, place)
        high = low
    return _filled(n, group, smaller)[1:]


def _by_first_byte(text: bytes, n: int) -> tuple[list, dict, list, list]:
    order = sorted(range(n - 1), key=text.__getitem__)
    order.insert(0, n - 1)
    place = [0] * n
    group = [0] * n
    size = {0: 1}
    low = 1
    for i in range(1, n):
        s = order[i]
        place[s] = i
        if i > 1 and text[s] != text[order[i - 1]]:
            size[low] = i - low
            low = i
        group[s] = low
    if n > 1:
        size[low] = n - low
    return group, size, order, place


def _move(pointed: dict, group: list, size: dict, order: list, place: list) -> None:
    """Split the places pointed to off their groups, by how often; a group's name is where it
    begins in order."""
    by_count = {}
    for p, k in pointed.items():
        by_count.setdefault(k, {}).setdefault(group[p], []).append(p)
    for k in sorted(by_count, reverse=True):
        for g, moved in by_count[k].items():
            stay = size[g] - len(moved)
            if not stay:
                continue
            new = g + stay
            end = g + size[g]
            for p in moved:  # to the end of the group's range
                end -= 1
                at, other = place[p], order[end]
                order[at], order[end] = other, p
                place[other], place[p] = at, end
            for p in moved:
                group[p] = new
            size[g], size[new] = stay, len(moved)


def _filled(n: int, group: list, smaller: list) -> list[int]:
    out = [-1] * n
    out[0] = n - 1
    next_in = list(range(n))
    put = [False] * n
    put[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not put[s]:
            g = group[s]
            out[next_in[g]] = s
            next_in[g] += 1
            put[s] = True
            s = smaller[s]
    return out
