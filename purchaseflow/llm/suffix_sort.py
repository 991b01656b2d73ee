"""Suffix sorting by linear grouping construction (Baier, CPM 2016), without renaming or recursion."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """The suffix array of ``text``, whose last item is its only least one.

    First, groups of suffixes that begin with the same Lyndon prefix are taken from the largest down. For each suffix
    of a group the pointer to the nearest earlier suffix of a lower group is found; that suffix's prefix grows by this
    group's, as often as the group stands there in a row, so such suffixes leave for the top of their old group as new
    groups. Then the order is emitted: each suffix, in order, puts those that it is the next smaller one of at the
    front of what is left of their groups. A group is named by its first place in the order; its list may still hold
    suffixes that have left.
    """
    n = len(text)
    members: list[list[int] | None] = [None] * n
    group, size = [0] * n, [0] * n
    at, last, held = 0, None, None
    for i, s in enumerate(sorted(range(n), key=text.__getitem__)):
        c = text[s]
        if c != last:
            last, at, held = c, i, []
            members[i] = held
        held.append(s)
        group[s] = at
        size[at] += 1
    smaller = [-1] * n
    for begin in range(n - 1, 0, -1):
        count = size[begin]
        if not count:
            continue
        held = members[begin]
        if len(held) > count:
            held = [s for s in held if group[s] == begin]
        if count == 1:
            s = held[0]
            p = s - 1
            while p >= 0 and group[p] > begin:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                g = group[p]
                left = size[g] - 1
                if left:
                    size[g] = left
                    group[p] = new = g + left
                    size[new] = 1
                    members[new] = [p]
            continue
        first, follows = [], {}
        for s in held:
            p = s - 1
            while p >= 0 and group[p] > begin:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                if group[p] == begin:
                    follows[p] = s
                else:
                    first.append(p)
        if follows:
            in_a_row: dict[int, list[int]] = {}
            starts = [s for s in held if smaller[s] < 0 or group[smaller[s]] != begin]
            for s in starts:
                q, times, t = smaller[s], 1, follows.get(s)
                while t is not None:
                    smaller[t] = q
                    times += 1
                    t = follows.get(t)
                if q >= 0:
                    in_a_row.setdefault(times, []).append(q)
            classes = [in_a_row[c] for c in sorted(in_a_row, reverse=True)]
        else:
            classes = [first]
        for these in classes:
            moved: dict[int, list[int]] = {}
            for q in these:
                g = group[q]
                if g in moved:
                    moved[g].append(q)
                else:
                    moved[g] = [q]
            for g, those in moved.items():
                left = size[g] - len(those)
                if left:
                    size[g] = left
                    new = g + left
                    size[new] = len(those)
                    members[new] = those
                    for q in those:
                        group[q] = new
    free = list(range(n))
    done = bytearray(n)
    order = [0] * n
    order[0] = n - 1
    done[n - 1] = 1
    for s in order:
        p = s - 1
        while p >= 0 and not done[p]:
            g = group[p]
            order[free[g]] = p
            free[g] += 1
            done[p] = 1
            p = smaller[p]
    return order
