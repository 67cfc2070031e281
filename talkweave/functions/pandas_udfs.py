"""The few computations without a built-in form, as Arrow-batched functions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel row updates."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hits = row & masks.get(ch, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


def bounded_ratio(a: str, b: str, threshold: float) -> float:
    """Gestalt ratio, or 0.0 when an upper bound already proves it below the threshold.

    Matched characters never exceed the longest common subsequence, so the bound is exact.
    """
    total = len(a) + len(b)
    if total == 0:
        return 1.0
    if 2.0 * min(len(a), len(b)) / total < threshold or 2.0 * _common_subsequence(a, b) / total < threshold:
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


_BUCKETS = 64  # that characters are counted in
_WORDS = 4  # of 64 characters each that the rows of a subsequence table take
_PAIRS = 8192  # that go through the table at once


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Characters of each text as numbers (rows, padded by the number of characters), lengths, and that number."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    found, flat = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_inverse=True)
    out = np.full((len(texts), max(int(sizes.max(initial=0)), 1)), len(found), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes, len(found)


def _subsequences(codes: np.ndarray, sizes: np.ndarray, n_codes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of texts ``a`` and ``b`` (rows of ``codes``) of at most 64 * ``_WORDS`` characters."""
    words = -(-int(sizes[a].max()) // 64)
    masks = np.zeros((words, len(sizes) * (n_codes + 1)), dtype=np.uint64)
    for i in np.unique(a).tolist():
        at = np.arange(sizes[i])
        np.bitwise_or.at(masks, (at // 64, i * (n_codes + 1) + codes[i, :sizes[i]]), np.uint64(1) << (at % 64).astype(np.uint64))
    out = np.zeros(len(a), dtype=np.int64)
    order = np.argsort(sizes[b], kind="stable")  # so that partners of one length go together
    for start in range(0, len(order), _PAIRS):
        some = order[start:start + _PAIRS]
        row, other = a[some] * (n_codes + 1), codes[b[some]].T.copy()
        state = [np.full(len(some), np.uint64(2**64 - 1)) for _ in range(words)]
        for k in range(int(sizes[b[some]].max())):
            at, carry = row + other[k], None
            for w in range(words):
                mask, v = masks[w].take(at), state[w]
                hits = v & mask
                total = v + hits
                over = total < hits
                if carry is not None:
                    total = total + carry
                    over |= total < carry
                carry = over.astype(np.uint64)
                state[w] = total | (v ^ hits)
        out[some] = 64 * words - sum(np.bitwise_count(v).astype(np.int64) for v in state)
    return out


def block_pairs(left: list[str], right: list[str] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose bounds leave the ratio at or above ``threshold`` possible; without ``right`` each pair of ``left`` once.

    Lengths bound the ratio, then the characters that both texts have, then their longest common subsequence.
    """
    codes, sizes, n_codes = _codes(left + (right or []))
    counts = np.zeros((len(sizes), _BUCKETS), dtype=np.int32)
    in_text = codes < n_codes
    np.add.at(counts, (np.nonzero(in_text)[0], codes[in_text] % _BUCKETS), 1)
    counts = np.minimum(counts, 65535).astype(np.uint16) if sizes.max(initial=0) < 65536 else counts
    first, a, b = len(left) if right is not None else 0, [], []
    for i in range(len(left)):
        near = np.arange(i + 1 if right is None else first, len(sizes))
        total = sizes[i] + sizes[near]
        near = near[(2.0 * np.minimum(sizes[i], sizes[near]) / np.maximum(total, 1) >= threshold) | (total == 0)]
        shared = np.minimum(counts[i], counts[near]).sum(axis=1, dtype=np.int64)
        total = sizes[i] + sizes[near]
        near = near[(2.0 * shared / np.maximum(total, 1) >= threshold) | (total == 0)]
        a.append(np.full(len(near), i))
        b.append(near)
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b))
    table = (np.maximum(sizes[a], sizes[b]) <= 64 * _WORDS) & (sizes[a] + sizes[b] > 0)
    possible = np.ones(len(a), dtype=bool)
    if table.any():
        possible[table] = 2.0 * _subsequences(codes, sizes, n_codes, a[table], b[table]) / (sizes[a[table]] + sizes[b[table]]) >= threshold
    return a[possible], b[possible] - first


def ratios(pairs: list[tuple[str, str]], threshold: float) -> list[float]:
    """Ratios of pairs, 0.0 where a bound proves it below the threshold; pairs of one right side should come together."""
    matcher, last, out = SequenceMatcher(), None, []
    for a, b in pairs:
        if len(a) > 64 * _WORDS or len(b) > 64 * _WORDS or not (a or b):
            out.append(bounded_ratio(a, b, threshold))
            continue
        if b != last:
            matcher.set_seq2(b)
            last = b
        matcher.set_seq1(a)
        out.append(matcher.ratio())
    return out


def gestalt_ratio(threshold: float = 0.0):
    @F.pandas_udf(T.DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([bounded_ratio(a, b, threshold) for a, b in zip(left, right)], dtype="float64")

    return ratio


class _Outline(HTMLParser):
    """Collects block elements with the container they sit in."""

    dropped = frozenset(("script", "style", "nav", "footer", "header", "aside"))
    blocks = frozenset(("h1", "h2", "h3", "h4", "p", "li", "pre", "code", "title"))
    void = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
    closes_paragraph = frozenset(
        ("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul").split())
    scopes = frozenset(("ul", "ol", "div", "article", "main", "body", "section", "td", "blockquote"))
    hint = re.compile("content|article|doc", re.I)

    def __init__(self) -> None:
        super().__init__()
        self.stack: list[tuple[str, int, list[str], bool]] = []  # tag, block slot, containers opened, opens dropped part
        self.rows: list[list] = []  # tag, text pieces, containers, inside dropped part
        self.counts = {"article": 0, "main": 0, "hint": 0, "body": 0}
        self.live = {"article": [], "main": [], "hint": [], "body": []}
        self.hidden = 0

    def _close_one(self) -> str:
        tag, slot, kinds, drops = self.stack.pop()
        for kind in kinds:
            self.live[kind].pop()
        self.hidden -= drops
        return tag

    def _end_open(self, tag: str) -> None:
        """End an open element of this name, unless it lies outside the current scope."""
        for frame in reversed(self.stack):
            if frame[0] == tag:
                while self._close_one() != tag:
                    pass
                return
            if frame[0] in self.scopes:
                return

    def handle_starttag(self, tag, attrs):
        if tag in self.void:
            return
        # a block ends an unclosed paragraph, an item ends the item before it
        if tag in self.closes_paragraph:
            self._end_open("p")
        if tag == "li":
            self._end_open("li")
        kinds = []
        if tag in ("article", "main", "body"):
            kinds.append(tag)
        if self.hint.search(dict(attrs).get("class") or ""):
            kinds.append("hint")
        for kind in kinds:
            self.live[kind].append(self.counts[kind])
            self.counts[kind] += 1
        drops = tag in self.dropped
        self.hidden += drops
        slot = -1
        if tag in self.blocks:
            slot = len(self.rows)
            inside = {k: set(v) for k, v in self.live.items()}
            self.rows.append([tag, [], inside, bool(self.hidden)])
        self.stack.append((tag, slot, kinds, drops))

    def handle_endtag(self, tag):
        if any(frame[0] == tag for frame in self.stack):
            while self._close_one() != tag:
                pass

    def handle_data(self, data):
        text = data.strip()
        if text:
            for frame in self.stack:
                if frame[1] >= 0:
                    self.rows[frame[1]][1].append(text)


MARKS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "li": "- "}


def page_outline(html: str | None) -> tuple[str, str, list[str]]:
    """Raw title, Markdown body of the main container, and second-level headings."""
    doc = _Outline()
    doc.feed(html or "")
    doc.close()
    title = next((" ".join(parts) for tag, parts, _, _ in doc.rows if tag == "title"), "")
    headings = [" ".join(parts) for tag, parts, _, _ in doc.rows if tag == "h2" and parts]
    chosen = next((k for k in ("article", "main", "hint") if doc.counts[k]), "body")
    out = []
    for tag, parts, inside, hidden in doc.rows:
        if tag == "title" or hidden or not parts or (doc.counts[chosen] and 0 not in inside[chosen]):
            continue
        text = "\n".join(parts)
        out.append(f"```\n{text}\n```" if tag in ("pre", "code") and "\n" in text else MARKS.get(tag, "") + text)
    return title, "\n\n".join(out), headings


PAGE_TEXT_SCHEMA = "url string, raw_title string, raw_body string, headings array<string>"


def parse_page_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``mapInPandas`` body: (url, html) to the raw outline of each page."""
    for batch in batches:
        parsed = [page_outline(h) for h in batch["html"]]
        yield pd.DataFrame(
            {
                "url": batch["url"],
                "raw_title": [p[0] for p in parsed],
                "raw_body": [p[1] for p in parsed],
                "headings": [p[2] for p in parsed],
            }
        )
