"""Ids of tokenizers whose merges never cross white space, word by word with a bounded memo.

The vocabulary's own library encodes each distinct word of a batch; the ids of a text are those of its words in order.
That equals the library's ids of the whole text because its pattern drops white space and splits there first (tested).

The memo has two generations of at most LIMIT words and LIMIT_BYTES of words and ids each. When the young one is full it becomes the
old one; a word met again moves over with its ids, so frequent words are encoded once and the rest is forgotten.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import islice

import numpy as np
import public_tokenizers

from . import common

LIMIT, LIMIT_BYTES = 300_000, 24 << 20

_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
# The vocabulary's split pattern for such words, and byte-level BPE's stand-ins for the bytes that do not print.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall
_BYTE_LEVEL = {b: 256 + n for n, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


class WordMemo:
    """Numbers the words of texts; `words` and `ids` hold each number's word and ids (bytes of uint32)."""

    _own: dict[str, "WordMemo"] = {}

    def __init__(self, vocabulary: str, limit: int = LIMIT, limit_bytes: int = LIMIT_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.limit_bytes = Tokenizer.from_file(public_tokenizers.path(vocabulary)), limit, limit_bytes
        self.index, self.ids, self.words, self.size, self.old = common.WordIndex(), [], [], 0, {}

    @classmethod
    def shared(cls, vocabulary: str) -> "WordMemo":
        """One memo a worker for all its tasks: within the bounds above, some 110 MB."""
        if vocabulary not in cls._own:
            cls._own[vocabulary] = cls(vocabulary)
        return cls._own[vocabulary]

    @classmethod
    def forget(cls) -> None:
        """Gives the worker's memos back, in passes that need none: workers live on from stage to stage."""
        if cls._own:
            cls._own.clear()
            common.freed()

    def _age(self) -> None:
        self.old = dict(zip(self.words, self.ids))
        self.index, self.ids, self.words, self.size = common.WordIndex(), [], [], 0

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids, as the whole tokenizer gives them. Words of printable ASCII and Latin-1 letters need none of
        its normaliser's Unicode steps, so they are lower-cased and split here and go to its model; the others go through it all."""
        out: list = [None] * len(words)
        rest, model, old = [], self.tokenizer.model, self.old
        for i, w in enumerate(words):
            if w in old:
                out[i] = old[w]
                continue
            text = w.decode("utf-8", "replace")
            if "<|" in text or not _PLAIN(text):
                rest.append((i, text))
                continue
            ids: list[int] = []
            for piece in _PIECES(text.lower()):
                ids += [t.id for t in model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LEVEL))]
            out[i] = array("I", ids).tobytes()
        found = self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False) if rest else []
        for (i, _), e in zip(rest, found):
            out[i] = np.array(e.ids, np.uint32).tobytes()
        return out

    def encode(self, texts: list[bytes]):
        """Each text's ids as uint32."""
        for first, last in common.slices(texts):
            for at in self.numbered(texts[first:last]):
                yield self.ids_of(at)

    def numbered(self, texts: list[bytes]) -> list[list[int]]:
        """The words of each text as places in `words` and `ids`, which hold until the next call (a full memo starts anew)."""
        if len(self.index) > self.limit or self.size > self.limit_bytes:
            self._age()
        index, known = self.index, len(self.ids)
        out = [index.of(t.split()) for t in texts]
        if len(index) > known:
            new = list(islice(reversed(index), len(index) - known))[::-1]
            ids = self._learn(new)
            self.words += new
            self.ids += ids
            self.size += sum(map(len, new)) + sum(map(len, ids))
        return out

    def ids_of(self, places: list[int]) -> np.ndarray:
        ids = self.ids
        return np.frombuffer(b"".join([ids[i] for i in places]), np.uint32)
