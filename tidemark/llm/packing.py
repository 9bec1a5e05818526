"""Harmonic packing of token sequences.

A document's ids are cut into pieces: whole sequences of `capacity` first, then the remainder by its binary digits down
to SMALL ids, then one tail. The cutting, which the contract leaves free, is where the low padding comes from. A piece of length L belongs to the reciprocal-capacity class k = capacity // L, that is
capacity/(k+1) < L <= capacity/k, and a bin of class k takes exactly k pieces. The power-of-two classes fill their bins
without a gap; a tail class k >= capacity/SMALL leaves less than 1/(k+1) of its bin. Each task fills its bins on its own
and shares nothing with others, so there is no shuffle; what its classes have left at the end goes, largest first, into
common bins. A task holds at most k - 1 waiting pieces a class, whatever its input.

Null text counts as empty (the end id alone). Texts of any length are encoded whole, one at a time where they are long. Repeated rows and ids are packed one by one. Extra columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common
from .wordpieces import WordMemo

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SMALL = 64
END_ID = 1


def cut(n: int, capacity: int, small: int = SMALL):
    """(start, length) of the pieces of n ids."""
    at = 0
    while n - at >= capacity:
        yield at, capacity
        at += capacity
    size = capacity
    while n - at >= small and size >= small:
        if n - at >= size:
            yield at, size
            at += size
        size //= 2
    if at < n:
        yield at, n - at


class Bins:
    """The bins that one worker fills."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.waiting: dict[int, list] = {}
        self.out: list[tuple] = []

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, start, length, crc, total in pieces:
            self.out.append((doc, start, length, crc, total, self.next_id, offset))
            offset += length
        self.next_id += 1

    def add(self, piece: tuple) -> None:
        k = self.capacity // piece[2]
        if k == 1:
            return self._close([piece])
        held = self.waiting.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self._close(held)
            self.waiting[k] = []

    def finish(self) -> None:
        """What is left, largest first. In that order powers of two leave no gap, so at most the last bin is short."""
        bin_, room = [], self.capacity
        for piece in sorted((p for held in self.waiting.values() for p in held), key=lambda p: -p[2]):
            if piece[2] > room:
                self._close(bin_)
                bin_, room = [], self.capacity
            bin_.append(piece)
            room -= piece[2]
        if bin_:
            self._close(bin_)
        self.waiting = {}

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 7
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 2048) -> DataFrame:
    """A row per piece; see the module."""

    def run(batches):
        bins = Bins(capacity, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)
        memo = WordMemo.shared(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), common.texts_of(batch.column(1))
            for doc, encoded in zip(ids, memo.encode(texts)):
                tokens = np.append(encoded, np.uint32(END_ID))
                raw, total = tokens.astype("<u4").tobytes(), len(tokens)
                for start, length in cut(total, capacity):
                    bins.add((doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), total))
                if len(bins.out) > 20_000:
                    yield _table(bins.take())
        bins.finish()
        yield _table(bins.take())
        common.freed()

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"))
