"""How like a quote is to a text: the longest run that both hold, and the share of their characters
that stand in the same order.

A character that makes up more than a hundredth of a text of 200 characters or more is frequent, and
runs are looked for without frequent ones; a run found is then drawn out by whatever characters agree
on either side. Of equally long runs the first in the quote counts, and of these the first in the text.
"""

from __future__ import annotations

import numpy as np

# Which characters are frequent.
LONG_TEXT = 200
FREQUENT_SHARE = 100


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Indexed:
    """A text with the places of its characters, for any number of quotes."""

    def __init__(self, text: str):
        self.codes = _codes(text)
        n = len(self.codes)
        order = np.argsort(self.codes, kind="stable")
        kinds, first, count = np.unique(self.codes[order], return_index=True, return_counts=True)
        rare = count <= n // FREQUENT_SHARE + 1 if n >= LONG_TEXT else np.ones(len(kinds), bool)
        self.places = {int(c): order[f : f + k] for c, f, k, r in zip(kinds, first, count, rare) if r}
        self._length = np.zeros(n + 1, np.int32)  # of the run that ends at a place, for the row before

    def longest_run(self, quote: np.ndarray, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int]:
        """Place in the quote, place in the text and length of the longest run within the ranges.

        One row per character of the quote: the run that ends at a place of the text is one longer
        than the one that ended just before it in the row above."""
        best, end_a, end_b = 0, a0, b0
        length, above = self._length, np.zeros(0, np.int64)
        for i in range(a0, a1):
            at = self.places.get(int(quote[i]), above[:0])
            if len(at):
                at = at[np.searchsorted(at, b0) : np.searchsorted(at, b1)]
            here = np.where(at > b0, length[at - 1], 0) + 1 if len(at) else above[:0]
            length[above] = 0
            length[at] = here
            above = at
            if len(here) and here.max() > best:
                best = int(here.max())
                end_a, end_b = i + 1, int(at[here.argmax()]) + 1
        length[above] = 0
        start_a, start_b = end_a - best, end_b - best
        while start_a > a0 and start_b > b0 and quote[start_a - 1] == self.codes[start_b - 1]:
            start_a, start_b = start_a - 1, start_b - 1
        while end_a < a1 and end_b < b1 and quote[end_a] == self.codes[end_b]:
            end_a, end_b = end_a + 1, end_b + 1
        return start_a, start_b, end_a - start_a


def longest_run(quote: str, text: Indexed) -> tuple[int, int]:
    """Place in the text and length of the longest run that the quote shares with it."""
    _, place, length = text.longest_run(_codes(quote), 0, len(quote), 0, len(text.codes))
    return place, length


def likeness(quote: str, text: str) -> float:
    """Twice the characters in common runs, by the length of both; the runs are the longest one and,
    on either side of it, the longest again."""
    if not quote and not text:
        return 1.0
    a, b = _codes(quote), Indexed(text)
    shared, left = 0, [(0, len(a), 0, len(b.codes))]
    while left:
        a0, a1, b0, b1 = left.pop()
        at, to, n = b.longest_run(a, a0, a1, b0, b1)
        if n:
            shared += n
            if a0 < at and b0 < to:
                left.append((a0, at, b0, to))
            if at + n < a1 and to + n < b1:
                left.append((at + n, a1, to + n, b1))
    return 2.0 * shared / (len(a) + len(b.codes))
