"""Suffix arrays by linear grouping, and equal windows of strings that share a core.

Suffixes are grouped by their Lyndon prefixes. The groups are taken in descending order; each member's pointer to its
previous smaller suffix names the one whose prefix its own now extends, and those that are extended move into groups of
their own above the one they leave. Then the suffixes are put out in ascending order: each one that is placed places
those that it follows, in the next free places of their groups. Symbols are named once; nothing is renamed later.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_order(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes in ascending order. symbols are numbered from 0 without gaps, and the last alone is 0."""
    n = len(symbols)
    if n < 2:
        return list(range(n))
    top = max(symbols)
    members: list[list[int]] = [[] for _ in range(top + 1)]
    for i, s in enumerate(symbols):
        members[s].append(i)
    size = [len(m) for m in members]
    below, above = list(range(-1, top)), list(range(1, top + 2))
    above[top] = -1
    group, previous, done, begin = list(symbols), [-1] * n, bytearray(n), [0] * (top + 1)

    def raise_from(left: int, moved: list[int]) -> None:
        """Moves members of a group into a new one directly above it."""
        new, up = len(members), above[left]
        members.append(moved)
        size.append(len(moved))
        size[left] -= len(moved)
        begin.append(0)
        below.append(left)
        above.append(up)
        above[left] = new
        if up >= 0:
            below[up] = new
        for p in moved:
            group[p] = new

    g, free = top, n
    while g >= 0:
        free -= size[g]
        begin[g] = free
        if size[g] == 1:
            i = next(i for i in members[g] if group[i] == g) if len(members[g]) > 1 else members[g][0]
            done[i] = 1
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0 and size[group[p]] > 1:  # a group that all leave stays what it is
                raise_from(group[p], [p])
        elif size[g]:
            own = [i for i in members[g] if group[i] == g]
            own.sort()
            for i in own:
                done[i] = 1
            times: dict[int, int] = {}
            for i in own:
                p = i - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                previous[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            longer: dict[tuple[int, int], list[int]] = {}
            for p, c in times.items():
                longer.setdefault((group[p], c), []).append(p)
            # The more often a prefix is extended, the higher its group: the highest goes in first, the others below it.
            for (left, _), moved in sorted(longer.items(), reverse=True) if len(longer) > 1 else longer.items():
                if size[left] > len(moved):
                    raise_from(left, moved)
        g = below[g]
    order, placed = [n - 1] * n, bytearray(n)
    placed[n - 1] = 1
    for r in range(n):
        j = order[r] - 1
        while j >= 0 and not placed[j]:
            h = group[j]
            order[begin[h]] = j
            begin[h] += 1
            placed[j] = 1
            j = previous[j]
    return order


#: Bytes of a symbol. Strings are compared as big-endian words, whose order is that of the bytes.
WORD_BYTES = 16


def _named(words: np.ndarray) -> np.ndarray:
    """Ranks, from 0, of words given as two columns of unsigned 64-bit numbers."""
    halves = [np.unique(words[:, i], return_inverse=True)[1].astype(np.int64) for i in (0, 1)]
    return np.unique((halves[0] << 32) | halves[1], return_inverse=True)[1]


def string_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings' ascending order from one suffix array over all of them, and the bytes that each shares with the one before it.

    Shorter strings count as if zero bytes followed: what is shared with those is for the caller to bound by the lengths.
    """
    lengths = np.array([len(s) for s in strings], np.int64)
    counts = -(-lengths // WORD_BYTES)
    width = max(1, int(counts.max(initial=0)))
    padded = np.frombuffer(b"".join(s.ljust(width * WORD_BYTES, b"\0") for s in strings), np.uint8).reshape(len(strings), width * WORD_BYTES)
    used = np.arange(width)[None, :] < counts[:, None]
    symbols = np.ones((len(strings), width + 1), np.int64)  # 1 ends a string
    words = padded.view(">u8").astype(np.uint64).reshape(len(strings), width, 2)
    if used.any():
        symbols[:, :width][used] = _named(words[used]) + 2
    kept = np.concatenate([used, np.ones((len(strings), 1), bool)], axis=1)
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    flat = np.concatenate([symbols[kept], [0]])
    which = np.full(len(flat), -1, np.int64)
    which[starts[:-1]] = np.arange(len(strings))
    order = which[np.array(suffix_order(flat.tolist()), np.int64)]
    order = order[order >= 0]
    return order, shared_with_previous(padded, order)


def shared_with_previous(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the row before it in order; -1 for the first."""
    out = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        differ = rows[order[1:]] != rows[order[:-1]]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def equal_windows(key: np.ndarray, core: np.ndarray, low: np.ndarray, high: np.ndarray, left: list[bytes], right: list[bytes], window: int) -> np.ndarray:
    """Which windows of pieces are equal to a window of an earlier piece of the same key: a row for each piece, a column for each offset.

    A piece is a stretch of text: `core` bytes that all pieces of its key share, `left` (read backwards) before and `right`
    after them. Its window q begins q bytes before the core, for q from low to high. Pieces of a key are given in text order.
    """
    n = len(key)
    out = np.zeros((n, int(high.max(initial=-1)) + 1), bool)
    if not n:
        return out
    ranks, shared = [], []
    for strings in (left, right):
        order, lcp = string_order(strings)
        # Within a key, what two neighbours share is the least of what lies between them in the whole order.
        by_key = np.argsort(key[order], kind="stable")
        own = order[by_key]
        before = _least_between(lcp, by_key)
        before[np.concatenate([[True], key[own[1:]] != key[own[:-1]]])] = -1
        ranks.append(own)
        shared.append(before)
    need = window - core
    for q in range(out.shape[1]):
        some = np.flatnonzero((low <= q) & (q <= high))
        if not len(some):
            continue
        classes = []
        for own, before, least in ((ranks[0], shared[0], np.full(n, q)), (ranks[1], shared[1], need - q)):
            c = np.empty(n, np.int64)
            c[own] = np.cumsum(before < least[own])
            classes.append(c[some])
        both = classes[0] * (n + 1) + classes[1]
        _, first = np.unique(both, return_index=True)
        again = np.ones(len(some), bool)
        again[first] = False
        out[some[again], q] = True
    return out


def _least_between(lcp: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For places (ascending within runs), the least lcp after the place before up to each; of a run's first, any value."""
    out = lcp[places].copy()
    ends = np.concatenate([[0], places[:-1]])
    far = np.flatnonzero((places - ends > 1) & (places > ends))
    if len(far):
        levels = [lcp]  # sparse table of minima
        while 2 ** len(levels) <= len(lcp):
            half = 2 ** (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        span = places[far] - ends[far]
        level = np.frexp(span)[1] - 1
        table = np.full((len(levels), len(lcp)), np.iinfo(np.int64).max)
        for i, row in enumerate(levels):
            table[i, : len(row)] = row
        out[far] = np.minimum(table[level, ends[far] + 1], table[level, places[far] + 1 - 2**level])
    return out
