"""Suffixes of a block in order: difference-cover ranks, one bucket of suffixes at a time.

Buckets are made so that suffixes that may share their first ``length`` bytes are in one bucket and their
positions agree modulo the period of the cover. They are sorted by their first ``PERIOD`` bytes; longer ties
are settled by the rank of the next position of the cover sample, whose ranks are worked out beforehand
by doubling. So a suffix is never compared further than ``PERIOD`` bytes, whatever the length of the tie.
"""

from __future__ import annotations

import numpy as np

PERIOD = 32


def difference_cover(period: int) -> np.ndarray:
    """Residues whose differences give every number modulo ``period``: 0 to a - 1 and the multiples of a."""
    a = int(np.ceil(np.sqrt(period)))
    return np.unique(np.concatenate((np.arange(a), np.arange(a, period, a))) % period)


COVER = difference_cover(PERIOD)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: Steps from a residue to the next one of the cover. For positions of one residue it is their common offset.
TO_COVER = np.array([next(d for d in range(PERIOD) if _IN_COVER[(r + d) % PERIOD]) for r in range(PERIOD)])


def _words(text: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The ``PERIOD`` bytes from every position as big-endian 64-bit words, the first word last (for lexsort)."""
    out = []
    for w in range(PERIOD // 8):
        word = np.zeros(len(at), dtype=np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | text[at + (8 * w + k)]
        out.append(word)
    return out[::-1]


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks (from 1, equal for equal keys) of rows; the last key counts most."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.cumsum(new) + 1
    return ranks


def cover_ranks(text: np.ndarray, start: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """For every position of the text in the cover sample the rank of what follows it, to ``depth`` bytes and no
    further than the end of its slice; 0 elsewhere. ``text`` has ``PERIOD`` spare bytes at its end."""
    inside = np.zeros(len(text) + 1, dtype=np.int8)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    inside = np.cumsum(inside)[:-1] > 0
    at = np.flatnonzero(inside & _IN_COVER[np.arange(len(text)) % PERIOD])
    stop = end[np.searchsorted(start, at, side="right") - 1]
    words = _words(text, at)
    # Bytes beyond the slice are blanked, and its end counts before any byte.
    rest = np.minimum(stop - at, PERIOD)
    for w, word in enumerate(words):
        keep = np.clip(rest - 8 * (PERIOD // 8 - 1 - w), 0, 8)
        word &= np.where(keep == 0, np.uint64(0), ~np.uint64(0) << (np.uint64(8) * (8 - np.maximum(keep, 1)).astype(np.uint64)))
    ranks = np.zeros(len(text) + PERIOD, dtype=np.int64)
    ranks[at] = _dense([rest, *words])
    span = PERIOD
    while span < depth:
        following = np.where(at + span < stop, ranks[np.minimum(at + span, len(text))], 0)
        ranks[at] = _dense([following, ranks[at]])
        span *= 2
    return ranks


def repeated_suffixes(text: np.ndarray, start: np.ndarray, end: np.ndarray, bucket: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of suffixes whose first ``length`` bytes are equal.

    ``at``: their positions, ``bucket``: their buckets (positions of a bucket agree modulo ``PERIOD``), ``start`` and
    ``end``: the slices of the text, ascending. Returns the order of the suffixes and, along it, whether
    a suffix opens a new class.
    """
    ranks = cover_ranks(text, start, end, length)
    words = _words(text, at)
    tie = ranks[at + TO_COVER[at % PERIOD]]
    order = np.lexsort([tie, *words, bucket])
    a, b = at[order[:-1]], at[order[1:]]
    same = np.flatnonzero(bucket[order[:-1]] == bucket[order[1:]])
    for w in words:
        s = w[order]
        same = same[s[same] == s[same + 1]]
    equal = np.zeros(len(order), dtype=bool)
    for part in np.array_split(same, max(1, len(same) // 20_000)):  # neighbours are compared in full
        reach = np.arange(PERIOD, length)
        equal[part + 1] = (text[a[part][:, None] + reach] == text[b[part][:, None] + reach]).all(axis=1)
    return order, ~equal
