"""Suffix arrays by induced sorting, and common prefixes in text order.

Suffixes are classified, leftmost-smaller substrings sorted and named, the
string of their names sorted by the same function, and the rest induced. Where
buckets are large, the steps of induction are array operations: all suffixes
that a bucket's present entries induce are placed at once, in a stable order by
their first symbol, until the bucket brings no new ones. Strings of names have
many small buckets; there the walk goes entry by entry. Both are linear.
"""

from __future__ import annotations

import numpy as np

#: Entries of a bucket, on average, from which it is walked by array operations.
LARGE_BUCKET = 256


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Suffix array from the leftmost-smaller suffixes ``lms`` in their order; ``small``: S-type positions."""
    n, sigma = len(s), len(counts)
    ends = np.cumsum(counts)
    starts = ends - counts
    large_count = np.bincount(s[~small], minlength=sigma)
    sa = np.empty(n, np.int32)
    lms_counts = np.bincount(s[lms], minlength=sigma)
    lms_ends = np.cumsum(lms_counts)

    def place(pred: np.ndarray, edge: np.ndarray, step: int) -> None:
        symbols = s[pred]
        order = np.argsort(symbols, kind="stable")
        sorted_symbols = symbols[order]
        found = np.bincount(symbols, minlength=sigma)
        rank = np.arange(len(pred)) - (np.cumsum(found) - found)[sorted_symbols]
        if step > 0:
            sa[edge[sorted_symbols] + rank] = pred[order]
            edge += found
        else:
            sa[edge[sorted_symbols] - 1 - rank] = pred[order]
            edge -= found

    used = np.flatnonzero(counts).tolist()
    head = starts.copy()
    place(np.array([n - 1]), head, 1)  # the end of the string induces its last suffix
    for c in used:
        at = starts[c]
        while at < head[c]:
            now = sa[at : head[c]]
            at = head[c]
            pred = now[now > 0] - 1
            pred = pred[~small[pred]]
            if len(pred):
                place(pred, head, 1)
        if lms_counts[c]:
            place(lms[lms_ends[c] - lms_counts[c] : lms_ends[c]] - 1, head, 1)
    tail = ends.copy()
    for c in reversed(used):
        at = ends[c]
        while at > tail[c]:
            now = sa[tail[c] : at][::-1]
            at = tail[c]
            pred = now[now > 0] - 1
            pred = pred[small[pred]]
            if len(pred):
                place(pred, tail, -1)
        if large_count[c]:
            now = sa[starts[c] : starts[c] + large_count[c]][::-1]
            pred = now[now > 0] - 1
            pred = pred[small[pred]]
            if len(pred):
                place(pred, tail, -1)
    return sa


def _names(s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Names of the leftmost-smaller substrings, in text order: they rise with the substrings, and only equal ones share a name.

    A substring ends with the first symbol of the next one; one that goes on
    where another ends is the smaller of the two, as it still falls there. The
    last one runs to the end of the string. As many symbols as fit a word are
    compared at once, and only ties go on.
    """
    n, m = len(s), len(lms)
    text = np.append(s.astype(np.int64) + 1, 0)
    length = np.append(np.diff(lms) + 1, n - lms[-1] + 1)
    bits = (sigma + 1).bit_length()
    width = 63 // bits
    rank, open_, done = np.zeros(m, np.int64), np.arange(m), 0
    while len(open_):
        at, left = lms[open_].astype(np.int64) + done, length[open_] - done
        key = np.zeros(len(open_), np.int64)
        for k in range(width):
            key = key << bits | np.where(k < left, text[np.minimum(at + k, n)], sigma + 1)
        order = np.argsort(key, kind="stable") if done == 0 else np.lexsort((key, rank[open_]))
        key, group = key[order], rank[open_][order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
        heads = np.flatnonzero(fresh)
        # A group's rank is the number of substrings before it.
        base = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        offset = np.arange(len(order)) - np.repeat(base, np.diff(np.append(base, len(order))))
        sizes = np.diff(np.append(heads, len(order)))
        rank[open_[order]] = group + np.repeat(offset[heads], sizes)
        done += width
        tied = open_[order[np.repeat(sizes, sizes) > 1]]
        open_ = tied[length[tied] > done]
    return np.unique(rank, return_inverse=True)[1]


def _induce_singly(s: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The same as ``_induce``, entry by entry."""
    n = len(s)
    ends = np.cumsum(counts)
    head, tail = (ends - counts).tolist(), ends.tolist()
    before = np.append(-1, s[:-1])
    # The bucket of the suffix that an entry induces in either walk; -1: none. Empty places hold 0, which induces none.
    large_before = np.where(np.append(True, small[:-1]), -1, before).tolist()
    small_before = np.where(np.append(False, small[:-1]), before, -1).tolist()
    sa = [0] * n
    for i, c in zip(lms[::-1].tolist(), s[lms[::-1]].tolist()):
        tail[c] -= 1
        sa[tail[c]] = i
    c = int(s[n - 1])  # the end of the string induces its last suffix
    sa[head[c]] = n - 1
    head[c] += 1
    for i in sa:
        c = large_before[i]
        if c >= 0:
            at = head[c]
            sa[at] = i - 1
            head[c] = at + 1
    tail = ends.tolist()
    for at in range(n - 1, -1, -1):
        i = sa[at]
        c = small_before[i]
        if c >= 0:
            to = tail[c] - 1
            sa[to] = i - 1
            tail[c] = to
    return np.array(sa, np.int32)


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """The suffixes of ``s`` (symbols 0 to sigma - 1) in order; a suffix is smaller than its continuations."""
    s = np.asarray(s)
    n = len(s)
    if n < 2:
        return np.arange(n)
    rising = s[:-1] < s[1:]
    flat = s[:-1] == s[1:]
    # A run of equal symbols has the type of what follows it; the last suffix is large.
    turn = np.minimum.accumulate(np.where(flat, n - 1, np.arange(n - 1)).astype(np.int32)[::-1])[::-1]
    small = np.append(np.append(rising, False)[turn], False)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    counts = np.bincount(s, minlength=sigma)
    induce = _induce if n >= LARGE_BUCKET * sigma else _induce_singly
    if len(lms) > 1:
        names = _names(s, lms, sigma)
        most = int(names.max()) + 1
        order = np.argsort(names) if most == len(lms) else suffix_array(names, most)
        lms = lms[order]
    return induce(s, small, lms, counts)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int, anew: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(before, plcp) in text order: the suffix before each in the array (-1: none), and their common prefix.

    Only where the symbols before both differ are symbols compared; elsewhere
    the prefix is one less than its left neighbour's. No more than ``most``
    symbols are compared, from each position in ``anew`` again: a prefix is
    right as far as it ends within ``most`` symbols of such a position.
    """
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    text = np.append(s.astype(np.int32), np.int32(-1))  # text[-1], before position 0 and at the end, differs from all symbols
    own = np.arange(n, dtype=np.int32)
    irreducible = (before < 1) | (own < 1) | (text[own - 1] != text[before - 1])
    if anew is not None:
        irreducible[anew] = True
    at = np.flatnonzero(irreducible & (before >= 0))
    plcp = np.zeros(n, np.int32)
    alive, length = at, 0
    while len(alive) and length < most:
        a, b = alive + length, before[alive] + length
        ok = (a < n) & (b < n)
        ok[ok] = text[a[ok]] == text[b[ok]]
        alive = alive[ok]
        length += 1
        plcp[alive] = length
    start = np.maximum.accumulate(np.where(irreducible, own, 0))
    return before, np.where(irreducible, plcp, np.maximum(plcp[start] - (own - start), 0))
