"""Suffix sorting by linear grouping.

Suffixes are first grouped by their Lyndon prefixes: groups are processed in
descending order, and a processed group refines the groups of its members'
previous smaller suffixes by how many members point at each.  Then one pass in
ascending order emits every suffix at the front of its group.  No suffix is
renamed or sorted again.
"""

from __future__ import annotations

from collections import defaultdict


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in order.  Symbols are any ints; a shorter suffix that
    is a prefix of another comes first."""
    n = len(text) + 1
    by_symbol: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(text):
        by_symbol[c].append(i)
    # Group 0 is the end of the text; ``below`` links each group to the next lower one.
    members = [[n - 1], *(by_symbol[c] for c in sorted(by_symbol))]
    below = list(range(-1, len(members) - 1))
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    above_of: dict[int, int] = {}  # group -> group right above it, kept only where groups split
    done = bytearray(n)
    previous, jump = [-1] * n, list(range(-1, n - 1))
    top = len(members) - 1
    for g in range(top):
        above_of[g] = g + 1
    g, order = top, []
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        if own:
            order.append((g, len(own)))
            for i in own:
                done[i] = 1
            own.sort()
            times: dict[int, int] = {}
            for i in own:
                j = jump[i]
                if j >= 0 and done[j]:
                    path = [i]
                    while j >= 0 and done[j]:
                        path.append(j)
                        j = jump[j]
                    for p in path:
                        jump[p] = j
                previous[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            if times:
                split: dict[tuple[int, int], list[int]] = {}
                for p, k in times.items():
                    key = (k, group[p])
                    if key in split:
                        split[key].append(p)
                    else:
                        split[key] = [p]
                # Most members first: each new group goes right above what is left of its old one.
                for (_, old), ps in split.items() if len(split) == 1 else sorted(split.items(), key=lambda x: -x[0][0]):
                    new = len(members)
                    members.append(ps)
                    higher = above_of[old]
                    below.append(old)
                    below[higher] = new
                    above_of[new], above_of[old] = higher, new
                    for p in ps:
                        group[p] = new
        g = below[g]
    start, at = {}, 0
    for g, size in reversed(order):
        start[g] = at
        at += size
    out = [-1] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    start[group[n - 1]] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = previous[j]
    return out[1:]
