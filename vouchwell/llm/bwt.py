"""Repeats of a minimum length by breadth-first interval expansion on a Burrows-Wheeler transform.

The text is a few megabytes at most: callers split the corpus so that equal strings meet. Starting
from the interval of the empty string, each round extends all intervals one symbol backwards; an
interval whose right neighbour has no common-prefix value yet gives it the round's number, so the
values come in increasing order. After ``length`` rounds the positions still without a value are
those that share at least ``length`` symbols with the suffix before them.
"""

from __future__ import annotations

import numpy as np

_SYMBOLS = 257  # 0 ends a string, bytes follow


def rotation_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of ``text`` sorted by their first ``depth`` symbols at least (ties in any order):
    prefix doubling, seven symbols packed in the first key. A rotation's rank is the first place of
    its group; places whose group is down to one rotation are not sorted again."""
    n = len(text)
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = key * 512 + np.roll(text, -i)
    order = np.argsort(key)
    key = key[order]
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    step = 7
    while True:
        head = np.append(True, key[1:] != key[:-1])
        first = place[np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))]
        rank[order[place]] = first
        tied = ~head
        tied[:-1] |= ~head[1:]
        place = place[tied]
        if step >= depth or not len(place):
            return order
        who = order[place]
        key = rank[who] * n + rank[(who + step) % n]
        by = np.argsort(key)
        order[place] = who[by]
        key = key[by]
        step *= 2


def long_prefixes(bwt: np.ndarray, length: int) -> np.ndarray:
    """Which rows share ``length`` symbols or more with the row before (row 0: never)."""
    n = len(bwt)
    by_symbol = np.argsort(bwt.astype(np.uint16), kind="stable")  # by radix
    step_back = np.empty(n, np.int64)
    step_back[by_symbol] = np.arange(n)
    places = bwt[by_symbol].astype(np.int64) * (n + 1) + by_symbol  # sorted; a search in it counts a symbol's rows
    symbols = np.unique(bwt).astype(np.int64)
    open_ = np.ones(n + 1, bool)
    open_[[0, n]] = False
    left, right = np.array([0]), np.array([n])
    for _ in range(length):
        size = right - left
        wide = size > len(symbols)
        one = np.flatnonzero(size == 1)
        lefts, rights = [step_back[left[one]]], [step_back[left[one]] + 1]
        some = np.flatnonzero(~wide & (size > 1))
        if len(some):
            sizes = size[some]
            whose = np.repeat(np.arange(len(some)), sizes)
            row = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(left[some], sizes)
            kind = whose * 512 + bwt[row]
            order = np.argsort(kind, kind="stable")
            kind, row = kind[order], row[order]
            first = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
            at = step_back[row[first]]
            lefts.append(at)
            rights.append(at + np.diff(np.append(first, len(kind))))
        if wide.any():
            base = np.repeat(symbols * (n + 1), wide.sum())
            a = np.searchsorted(places, base + np.tile(left[wide], len(symbols)))
            b = np.searchsorted(places, base + np.tile(right[wide], len(symbols)))
            lefts.append(a[b > a])
            rights.append(b[b > a])
        left, right = np.concatenate(lefts), np.concatenate(rights)
        fresh = open_[right]
        left, right = left[fresh], right[fresh]
        open_[right] = False
        if not len(left):
            break
    return open_[:n]


def repeated_starts(spans: list[bytes], starts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each span, the offsets below its number in ``starts`` whose ``length``-byte string also
    starts at another such offset, of this span or any other."""
    if not spans:
        return []
    sizes = np.array([len(s) + 1 for s in spans])
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\0".join(spans) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
    text[begin + sizes - 1] = 0
    order = rotation_order(text, length)
    bwt = text[order - 1]
    allowed = np.zeros(len(text) + 1, np.int64)
    np.add.at(allowed, begin, 1)
    np.add.at(allowed, begin + starts, -1)
    allowed = np.cumsum(allowed)[:-1] > 0
    same = long_prefixes(bwt, length)
    # rows without a value join the row before; a run of such rows is one repeated string
    rows = np.cumsum(~same) - 1
    count = np.bincount(rows, weights=allowed[order])
    hit = np.zeros(len(text), bool)
    hit[order] = allowed[order] & (count[rows] >= 2)
    return [np.flatnonzero(hit[b : b + s]) for b, s in zip(begin, starts)]
