"""Byte-level BPE through the tokenizers library, with words looked up before they are encoded."""

from __future__ import annotations

import os
import re

import numpy as np
import regex

from crownlake.llm.common import claim, keeps

#: Fixed value: how byte-level tokenizers of this family part a text before the merges.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LETTERS, _NUMBERS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
#: PARTS over Latin-1 characters.
LATIN = re.compile(rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
#: Bytes that stand for themselves in a byte-level vocabulary; the others are written as characters from 256 on, in order.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHER = [b for b in range(256) if b not in _PLAIN]
WRITTEN = {b: chr(256 + i) for i, b in enumerate(_OTHER)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Kept(dict):
    """A dict that makes missing values. Once it holds more than `most`, the next one starts over it,
    and takes what is still in use from it."""

    def __init__(self, make, before: dict | None = None):
        super().__init__()
        self.make, self.before = make, before or {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def aged(self, most: int) -> Kept:
        if len(self) <= most:
            return self
        self.before = {}
        return Kept(self.make, self)


class WordEncoder:
    """Gives the same ids as one encode() of each whole text.

    Byte-level BPE merges inside the parts of PARTS only, so each part goes to the tokenizer's
    model once and is kept while it is in use. Latin-1 texts are parted by LATIN, which finds the
    same parts there. A text with a special token's string is encoded as a whole.
    """

    def __init__(self, path: str, parts: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), parts
        self.model = self.tokenizer.model
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.id_bytes = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = Kept(self._part)

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():
            written = part.replace(" ", WRITTEN[32])
        else:
            written = part.encode().decode("latin-1").translate(WRITTEN)
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(written)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian bytes of self.dtype; null and empty texts have none."""
        self.parts = self.parts.aged(self.most)
        get, out = self.parts.__getitem__, []
        for t in texts:
            if not t:
                out.append(b"")
            elif any(x in t for x in self.special):
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype).tobytes())
            else:
                try:
                    t.encode("latin-1")
                    parts = LATIN.findall(t)
                except UnicodeEncodeError:
                    parts = PARTS.findall(t)
                out.append(b"".join(map(get, parts)))
        return out


_encoders: dict[str, WordEncoder] = {}
keeps("bpe", _encoders.clear)


def encoder(path: str) -> WordEncoder:
    """One encoder for a path and a Python worker, kept from task to task."""
    claim("bpe")
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
