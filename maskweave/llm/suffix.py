"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The steps are those of SA-IS: suffixes are classed as larger or smaller than
their right neighbour, the leftmost-smaller (LMS) substrings are sorted and
named, the string of names is sorted by recursion, and the order of the LMS
suffixes gives that of all.

*Bytes.* LMS substrings are sorted by inducing from unsorted ones, and the array
is induced from the sorted LMS suffixes. Inducing reads the array from one end,
one entry after another; here it goes a bucket (first character) at a time: what a
bucket induces into itself follows from the runs of equal characters in front of
its entries, and what it induces into others from its finished entries, so each
step is an array operation and all of them together are linear in the text.

*Names.* A string of names has too many buckets for that. Its LMS substrings are
sorted a character at a time, those only that are still alike; its suffixes take
their places from the LMS suffix that comes next, which settles any two that are
alike until there, with ranks doubled on the way to it. The recursion goes on until
all names differ, at every size.

A name met once settles the place of its suffix. The string that is sorted by
recursion holds the names met twice or more, and after each run of them the name
that ends it: two suffixes that begin alike differ there at the latest.
"""
from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The end is smaller than all."""
    differs = np.flatnonzero(t[:-1] != t[1:])
    small = np.zeros(len(t), bool)
    if len(differs):  # a run of equal characters goes by its last one
        small[: differs[-1] + 1] = np.repeat(t[differs] < t[differs + 1], np.diff(differs, prepend=-1))
    return small


def _ranks_in_groups(sorted_keys: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each run of equal keys."""
    new = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return np.arange(len(sorted_keys)) - np.repeat(new, np.diff(np.append(new, len(sorted_keys))))


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes sorted as far as ``lms`` is; ``lms`` must be sorted by first character at least within itself."""
    n = len(t)
    sizes = np.bincount(t, minlength=k)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    n_large = np.bincount(t[~small], minlength=k)
    mid = heads + n_large  # where a bucket's smaller suffixes begin
    sa = np.full(n, -1, np.int32)
    chars = t[lms]
    order = np.argsort(chars, kind="stable")
    grouped = chars[order].astype(np.int64)
    if len(lms):
        held = np.bincount(grouped, minlength=k)
        sa[tails[grouped] - held[grouped] + _ranks_in_groups(grouped)] = lms[order]
    fill = heads.copy()
    change = t[1:] != t[:-1]
    begins = np.flatnonzero(np.concatenate([[True], change]))
    before = (np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))).astype(np.int32)  # equal characters in front
    # what an entry induces into other buckets; the last place stands for no entry (-1)
    larger, smaller, equal = (np.zeros(n + 1, bool) for _ in range(3))
    larger[1:n], smaller[1:n], equal[1:n] = change & ~small[:-1], change & small[:-1], ~change

    def with_runs(at: np.ndarray) -> np.ndarray:
        """A bucket's entries as read: those there, then what they induce into it, and so on along their runs."""
        first = at[equal[at]]
        if not len(first):
            return at
        held = before[first]
        rounds = _ranks_in_groups(np.repeat(np.arange(len(first)), held)) + 1
        return np.concatenate([at, (np.repeat(first, held) - rounds)[_by_bucket(rounds)]])

    def put(at: np.ndarray, which: np.ndarray, step: int) -> None:
        j = at[which[at]] - 1
        if not len(j):
            return
        ch = t[j]
        o = np.argsort(ch, kind="stable")
        ch = ch[o]
        new = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
        into, held = ch[new], np.diff(np.append(new, len(ch)))
        sa[np.repeat(fill[into] - (step < 0) - step * new, held) + step * np.arange(len(j))] = j[o]
        fill[into] += step * held

    sa[fill[t[n - 1]]] = n - 1  # the end induces the last suffix
    fill[t[n - 1]] += 1
    used = np.flatnonzero(sizes)
    for c in used:
        sa[heads[c] : mid[c]] = with_runs(sa[heads[c] : fill[c]])
        put(sa[heads[c] : tails[c]], larger, 1)
    # only the larger suffixes count from here on
    fill = tails.copy()
    for c in used[::-1]:
        sa[mid[c] : tails[c]] = with_runs(sa[fill[c] : tails[c]][::-1])[::-1]
        put(sa[heads[c] : tails[c]][::-1], smaller, -1)
    return sa


def _name(t: np.ndarray, lms: np.ndarray, in_order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, equal for equal ones, and their number."""
    n = len(t)
    length = np.full(n + 1, 0, np.int64)
    length[lms] = np.diff(np.append(lms, n - 1)) + 1
    a, b = in_order[:-1].astype(np.int64), in_order[1:].astype(np.int64)
    last = lms[-1]  # it ends at the end, which no other does
    same = (length[a] == length[b]) & (a != last) & (b != last)
    same[same] = _equal(t, a[same], b[same], length[a[same]])
    number = np.concatenate([[0], np.cumsum(~same)])
    names = np.empty(n, np.int64)
    names[in_order] = number
    return names[lms], int(number[-1]) + 1


def _equal(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the substrings of these lengths at a and b are equal; of bytes, eight at a time."""
    out = np.ones(len(a), bool)
    active, at = np.arange(len(a)), 0
    wide = t.dtype == np.uint8
    if wide:
        eight = np.ndarray((len(t) + 8,), "<u8", np.concatenate([t, np.zeros(16, np.uint8)]).tobytes(), 0, (1,))
        masks = np.array([(1 << 8 * min(i, 8)) - 1 for i in range(9)], np.uint64)
    while len(active):
        x, y = a[active] + at, b[active] + at
        same = (eight[x] ^ eight[y]) & masks[np.minimum(length[active] - at, 8)] == 0 if wide else t[x] == t[y]
        out[active[~same]] = False
        at += 8 if wide else 1
        active = active[same & (length[active] > at)]
    return out


def _by_bucket(t: np.ndarray) -> np.ndarray:
    """Places in the order of their characters, as they come; by radix where 16 bits hold them."""
    return np.argsort(t.astype(np.uint16) if int(t.max()) < 1 << 16 else t, kind="stable")


def _refined(order: np.ndarray, rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Sort the places ``tied`` of ``order`` by (rank, key) and split their ranks; the places still tied."""
    at = order[tied]
    both = rank[at] * (int(key.max()) + 1) + key
    o = np.argsort(both)
    at, both = at[o], both[o]
    order[tied] = at
    split = np.concatenate([[True], both[1:] != both[:-1]])
    rank[at] = np.maximum.accumulate(np.where(split, tied, 0))
    return tied[~(split & np.concatenate([split[1:], [True]]))]


def _names_of_names(classed: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings of a string of (name, class), and their number."""
    m, n = len(lms), len(classed)
    ended = np.append(classed + 1, 0)  # the end is smaller than all
    length = np.diff(np.append(lms, n))
    order, rank, tied = np.arange(m), np.zeros(m, np.int64), np.arange(m)
    step = 0
    while len(tied):
        tied = _refined(order, rank, tied, ended[lms[order[tied]] + step])
        tied = tied[length[order[tied]] > step]  # alike up to here, they end here together
        step += 1
    in_order = rank[order]
    number = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
    names = np.empty(m, np.int64)
    names[order] = number
    return names, int(number[-1]) + 1


def _between(classed: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes of a string of (name, class) sorted, from its sorted LMS suffixes.

    Suffixes alike up to an LMS suffix reach one at the same place, as their
    classes are alike too; its place among those of its bucket decides."""
    n = len(classed)
    order = _by_bucket(classed)
    key = classed[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    settled = np.full(n, -1, np.int64)
    if len(lms):
        grouped = lms[_by_bucket(classed[lms])]
        settled[grouped] = rank[grouped] + _ranks_in_groups(classed[grouped])
    tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
    h = 1
    while len(tied):
        far = order[tied] + h
        inside = np.minimum(far, n - 1)
        known = np.where(settled[inside] >= 0, settled[inside], rank[inside]) + 1
        tied = _refined(order, rank, tied, np.where(far < n, known, 0))
        h *= 2
    return order


def _order_of_names(names: np.ndarray, number: int) -> np.ndarray:
    """The suffixes of a string of names, sorted."""
    order = _by_bucket(names)
    again = np.bincount(names, minlength=number)[names] > 1
    if not again.any():
        return order
    kept = np.flatnonzero(again | np.concatenate([[False], again[:-1]]))
    t = names[kept]
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    classed = 2 * t + small
    if len(lms) > 1:
        lms = lms[_order_of_names(*_names_of_names(classed, lms))]
    inner = kept[_between(classed, lms)]
    order[again[order]] = inner[again[inner]]
    return order


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of a string of bytes."""
    n, k = len(t), 256
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sa = _induce(t, small, lms, k)
    if len(lms) < 2:
        return sa
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    return _induce(t, small, lms[_order_of_names(*_name(t, lms, sa[is_lms[sa]]))], k)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position its common prefix with the suffix before it in the array, and that suffix (-1: none).

    Only irreducible values (the characters in front differ) are compared; a
    position after another has one less than that one otherwise (Karkkainen,
    Manzini and Puglisi, 2009). ``t`` holds bytes."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    front = np.where(before > 0, t[np.maximum(before - 1, 0)].astype(np.int64), -1)
    irreducible = (at == 0) | (before <= 0) | (front != np.concatenate([[-2], t[:-1].astype(np.int64)]))
    i = np.flatnonzero(irreducible & (before >= 0))
    j = before[i]
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    eight = np.ndarray((n + 8,), "<u8", padded.tobytes(), 0, (1,))
    room = n - np.maximum(i, j)
    length = np.zeros(len(i), np.int64)
    active = np.flatnonzero(room > 0)
    while len(active):
        x = eight[i[active] + length[active]] ^ eight[j[active] + length[active]]
        whole = x == 0
        part = active[~whole]
        y = x[~whole]
        for b in range(1, 8):
            length[part] += (y & np.uint64((1 << 8 * b) - 1)) == 0
        length[active[whole]] += 8
        active = active[whole]
        active = active[length[active] < room[active]]
    out = np.zeros(n, np.int64)
    out[i] = np.minimum(length, room)
    anchor = np.maximum.accumulate(np.where(irreducible, at, 0))
    return np.where(irreducible, out, np.maximum(0, out[anchor] - (at - anchor))), before
