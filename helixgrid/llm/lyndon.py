"""Suffix arrays by linear grouping, after Baier's algorithm and its later previous-smaller-suffix form.

Phase 1 groups suffixes by their Lyndon prefix (the longest Lyndon word they
start with). Groups are taken in descending order; every member finds its
previous smaller suffix by following pointers over what is already done, and
that parent's known prefix grows by the group's word, so the parent moves to a
new group right after its old one, further on the more members it took.
Numbers are held in arrays of four bytes each, about 40 bytes a character in all.
Phase 2 walks the order as it forms: suffix s settles every p whose next
smaller suffix is s, each in the next free place of its own group. Nothing is
renamed and nothing recurs.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> array:
    """The start positions of the suffixes of text (small non-negative integers) in ascending order."""
    n = len(text)
    if n >= 1 << 31:
        raise ValueError("the text must be shorter than 2^31")
    buckets: dict[int, array] = {}
    for i, c in enumerate(text):
        own = buckets.get(c)
        if own is None:
            own = buckets[c] = array("i")
        own.append(i)
    order = sorted(buckets)
    # Groups form a linked list in ascending order; group 0 is its head.
    members: list[array] = [array("i")]
    after, before = array("i", [0]), array("i", [0])
    group = array("i", bytes(4 * n))
    last = 0
    for c in order:
        g = len(members)
        members.append(buckets[c])
        for i in buckets[c]:
            group[i] = g
        after[last] = g
        after.append(0)
        before.append(last)
        last = g
    done = bytearray(n)
    parent = array("i", [-1]) * (n + 1)
    g = last
    while g:
        own = array("i", sorted(i for i in members[g] if group[i] == g))
        members[g] = own
        took: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = parent[j]
            parent[i] = j
            done[i] = 1
            # Equal words in a row share a parent; the pointer of the earlier one has been followed already.
        for i in own:
            p = parent[i]
            if p >= 0:
                took[p] = took.get(p, 0) + 1
        if took:
            split: dict[tuple[int, int], array] = {}
            for p, k in took.items():
                key = (group[p], -k)
                if key in split:
                    split[key].append(p)
                else:
                    split[key] = array("i", [p])
            for old, k in sorted(split):
                new = len(members)
                moved = split[old, k]
                members.append(moved)
                for p in moved:
                    group[p] = new
                nxt = after[old]
                after[old] = new
                before.append(old)
                after.append(nxt)
                if nxt:
                    before[nxt] = new
        g = before[g]
    free = array("i", bytes(4 * len(members)))
    at, g = 0, after[0]
    while g:
        free[g] = at
        at += len(members[g])
        g = after[g]
    out = array("i", bytes(4 * n))
    s, r = n, 0
    while True:
        p, stop = s - 1, parent[s]
        while p != stop:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            p = parent[p]
        if r == n:
            return out
        s = out[r]
        r += 1


def repeated_windows(strings: list[bytes], width: int) -> list[list[int]]:
    """For each string, the starts of its windows of `width` bytes that start anywhere else in the strings."""
    text = array("H")
    starts: list[int] = []
    for s in strings:
        starts.append(len(text))
        text.extend(b + 1 for b in s)
        text.append(0)
    raw = b"\0".join(strings) + b"\0"
    end = bytearray(len(text))
    for i, s in zip(starts, strings, strict=True):
        for j in range(i, i + len(s) - width + 1):
            end[j] = 1
    found: list[list[int]] = [[] for _ in strings]
    hit = bytearray(len(text))
    before = -1
    for p in suffix_array(text):
        if end[p]:
            if before >= 0 and raw[before : before + width] == raw[p : p + width]:
                hit[before] = hit[p] = 1
            before = p
    owner = 0
    for p in (i for i, x in enumerate(hit) if x):
        while owner + 1 < len(starts) and starts[owner + 1] <= p:
            owner += 1
        found[owner].append(p - starts[owner])
    return found
