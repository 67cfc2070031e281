"""Text to token ids inside tasks, with a bounded memory of words that were seen."""

from __future__ import annotations

import os
import re
from operator import attrgetter

import numpy as np
import regex

# The split of the byte-level vocabulary, and the characters on which every
# version of the Unicode tables agrees, so that this split is the tokenizer's own.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
AGREED = regex.compile("[\t\n\r\x20-\x7e¡-ɏ‐-‧‰-⁞€]*+")
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-ɏ‐-‧‰-⁞€]")  # tells the same, in a third of the time
_MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")  # one of them behind a word is a word of its own
_ID = attrgetter("id")

# A byte's character in the vocabulary: itself where it prints, else the next one from 256 on.
_PRINTS = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
_BYTES = {b: chr(b) for b in _PRINTS} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTS))}

_ENCODERS: dict[str, "Encoder"] = {}


class _Known(dict):
    """Ids by unit; a unit is worked out when it is new, and remembered from its second sight on while
    there is room, since most units never come again."""

    def __init__(self, work, limit: int) -> None:
        super().__init__()
        self.work, self.limit = work, limit
        self.sighted = bytearray(1 << 22)

    def __missing__(self, unit: str) -> bytes:
        ids = self.work(unit)
        if len(self) < self.limit:
            slot = hash(unit) & 0x3FFFFF
            if self.sighted[slot]:
                self[unit] = ids
            else:
                self.sighted[slot] = 1
        return ids


class Encoder:
    """Ids of whole texts by the ``tokenizers`` library.

    A byte-level vocabulary never merges across its words, so what stands between two single spaces is
    encoded by the library's model once and looked up afterwards; at most ``units`` are remembered. Texts
    in which a space is followed by another blank are split word by word, and texts with characters
    outside ``AGREED`` go to the library as they are.
    """

    def __init__(self, path: str, units: int = 690_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        pre = self.tokenizer.pre_tokenizer
        self.by_word = (isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
                        and self.tokenizer.normalizer is None)
        if self.by_word:
            self.tokenizer.model._resize_cache(0)
        self.model = self.tokenizer.model
        self.bytes_of = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values(), default=-1) + 1)]
        self.words = _Known(self._word, units // 10)
        self.spaced = _Known(self._after_space, units)

    def _model(self, characters: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, map(_ID, self.model.tokenize(characters))))

    def _word(self, word: str) -> bytes:
        return self._model(word.encode("utf-8").decode("latin-1").translate(_BYTES))

    def _after_space(self, unit: str) -> bytes:
        if not unit.isalpha():
            if unit and unit[-1] in _MARKS and unit[:-1].isalpha():
                return self.spaced[unit[:-1]] + self.words[unit[-1]]
            return self._words(" " + unit)
        return self._model(_BYTES[32] + unit) if unit.isascii() else self._word(" " + unit)

    def _words(self, text: str) -> bytes:
        return b"".join([self.spaced[w[1:]] if w[0] == " " and w[1:].isalpha() else self.words[w] for w in SPLIT.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not self.by_word or _OTHER.search(text) is not None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if "  " in text or " \n" in text or " \t" in text or " \r" in text:
            return self._words(text)
        first, *rest = text.split(" ")
        return self._words(first) + b"".join(map(self.spaced.__getitem__, rest))

    def ends_sentence(self) -> np.ndarray:
        """For every id whether its string ends a sentence or a line."""
        vocabulary = self.tokenizer.get_vocab()
        flags = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            flags[i] = token.endswith((".", "!", "?", "Ċ"))  # Ċ stands for a line feed
        return flags


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
