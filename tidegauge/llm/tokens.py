"""Whole-text encoding with the tokenizers library through an exact cache of space-delimited chunks.

The byte-level pattern starts a new pre-token at every single space that is followed by a character that is no
white space. Cutting a text right before those spaces therefore changes no id, and each distinct chunk needs to be
encoded by the library once per worker only. Chunks beside runs of white space stay glued together.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import public_tokenizers
import regex

from .common import KEPT

_RUN = re.compile(r" (?:\s|\Z)")
_LOADED: dict[str, ChunkEncoder] = KEPT.setdefault("tokens", {})


def _chunks(text: str) -> list[str]:
    """The chunks of a text; every one but the first has lost the space in front of it."""
    parts = text.split(" ")
    if not _RUN.search(text):
        return parts
    out = parts[:1]
    for part in parts[1:]:
        if not part or part[0].isspace():
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def _byte_alphabet() -> dict[int, str]:
    """Byte -> its printable sign in the byte-level alphabet: printable Latin-1 stands for itself, the rest follows 255."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """pre-token -> its ids as bytes, from the library's model. Cleared at ``limit`` entries, so memory is bounded."""

    def __init__(self, tokenize, dtype: np.dtype, limit: int):
        super().__init__()
        self.tokenize, self.dtype, self.limit, self.signs = tokenize, dtype, limit, _byte_alphabet()

    def compute(self, word: str) -> bytes:
        return array(self.dtype.char, [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.signs))]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.compute(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids


class _Chunks(dict):
    """chunk -> its ids as bytes. A chunk of letters is one pre-token; others are cut by the published pattern."""

    def __init__(self, encoder: ChunkEncoder, prefix: str, limit: int):
        super().__init__()
        self.encoder, self.prefix, self.limit = encoder, prefix, limit

    def __missing__(self, chunk: str) -> bytes:
        whole, e = self.prefix + chunk, self.encoder
        letters = chunk.isalpha()
        if letters and (chunk.isascii() or _PLAIN(chunk)):
            ids = e.words.compute(whole)
        elif not letters and _PLAIN(chunk):
            ids = b"".join([e.rest[w[1:]] if self.prefix and w[0] == " " and w[1:].isalpha() else e.words[w] for w in _PATTERN.findall(whole)])
        else:
            ids = e.encode(whole)
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = ids
        return ids


#: Texts for which the pattern surely means the same here and in the library, whatever their Unicode versions.
_PLAIN = regex.compile(r"[\t-\r -~\u00a0-\u024f\u2010-\u2027\u20ac]*").fullmatch
_PATTERN = regex.compile(public_tokenizers.PATTERN)


class ChunkEncoder:
    """Ids of texts as little-endian bytes: 16 bits an id if the vocabulary allows, else 32 (``dtype``).

    The file must be a byte-level BPE without a normaliser whose pre-tokens follow the published pattern, as is checked.
    Added tokens are found by the library itself: a chunk that holds one of them goes to it whole.
    """

    def __init__(self, path: str, limit: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if "ByteLevel(add_prefix_space=False" not in repr(self.tokenizer.pre_tokenizer) or self.tokenizer.normalizer:
            raise ValueError(f"not a plain byte-level tokenizer: {path}")
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(" " in t for t in self.added):
            raise ValueError("added tokens with spaces are not supported")
        self.words = _Words(self.tokenizer.model.tokenize, self.dtype, 100_000)
        self.head = _Chunks(self, "", 50_000)
        self.rest = _Chunks(self, " ", limit)

    def encode(self, text: str) -> bytes:
        """By the library alone."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return self.encode(text)
        parts = _chunks(text)
        parts[0] = self.head[parts[0]]
        parts[1:] = map(self.rest.__getitem__, parts[1:])
        return b"".join(parts)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return [self._one(t) for t in texts]


def encoder(path: str, limit: int = 900_000) -> ChunkEncoder:
    """One encoder for each worker process and file; ``limit`` bounds the chunks that it keeps."""
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    _LOADED[path].rest.limit = limit
    return _LOADED[path]
