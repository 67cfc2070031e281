"""64-bit hashes of all words of a batch of texts, in array operations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, SEGMENT + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start positions (in the texts joined by one blank) and hashes of all words.

    Words are runs without ASCII blanks. Work goes in segments that end at a blank, so a very long
    text needs no more memory than its words' hashes.
    """
    joined = b"\n".join(texts) + b"\n"
    starts, hashes = [], []
    at = 0
    while at < len(joined):
        stop = len(joined) if len(joined) - at <= SEGMENT else joined.rfind(b"\n", at, at + SEGMENT) + 1
        if stop <= at:
            stop = joined.rfind(b" ", at, at + SEGMENT) + 1
        if stop <= at:
            stop = joined.find(b"\n", at) + 1
        data = np.frombuffer(joined, dtype=np.uint8, count=stop - at, offset=at)
        up, down = powers(len(data) + 1)
        blank = _BLANK[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
        first, end = edge[::2], edge[1::2]  # every segment ends with a blank
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_CODES[data] * up[:len(data)], out=total[1:])
        starts.append(first + at)
        hashes.append(mixed((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64)))
        at = stop
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def bounds_by_text(texts: Sequence[bytes], starts: np.ndarray) -> np.ndarray:
    """For n texts n + 1 indices into ``starts``: words of text i are [i], [i + 1]."""
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.searchsorted(starts, ends)


def byte_codes() -> np.ndarray:
    """A fixed 64-bit number for every byte value."""
    return _CODES
