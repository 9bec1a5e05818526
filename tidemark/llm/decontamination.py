"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of letters and digits, lower-cased; shingles have five words (an item of fewer words is one shingle). For each
item length m, every window of m words of a text (the whole text if it is shorter) has a 64-bit SimHash of its shingles. Only windows that
hold at least one shingle of the benchmark are fingerprinted: the others have similarity 0 with every item. The index
splits fingerprints into four blocks of 16 bits; within RADIUS of an item some block is within RADIUS // 4, so the four tables
of such block values give every item within RADIUS. Each candidate is verified by exact weighted Jaccard similarity of shingle
multisets, a shingle weighing ln(1 + items / items that hold it) (those unknown to the benchmark as if one did).

Fingerprints weigh all shingles of a window alike, the similarity does not, so the radius is set wide: on the test tables it finds
all matches that a search without it finds (README; tests ask for nine in ten on edited items).

The benchmark is the query set; it is taken in blocks of ITEM_BLOCK items, each broadcast with its tables (64 MB at most) and the
counts of all items' shingles (16 bytes a distinct shingle of the benchmark), and each scans all texts whole, long ones in blocks of
windows. One row per document row and item reached: best similarity and its first window. Null and empty texts and items match nothing, and
null ids are kept as they are. Repeated ids are scanned one by one and joined into one row for each id and item. Extra columns are not read.
An empty table of either kind gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K, LEAST, RADIUS, ITEM_BLOCK = 5, 0.8, 19, 2048
BLOCK, MATRIX_BYTES = 1 << 15, 8 << 20
SCHEMA = "doc_id long, item_id long, similarity double, start long, n_words long"


def votes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of a shingle's 64 bits."""
    return np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint of each row of vote sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def _shingles(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's shingles and number of words."""
    words, bounds = common.word_hashes(texts, marks=True)
    with np.errstate(over="ignore"):
        return common.shingle_hashes(words, bounds, K), np.diff(bounds)


def holders_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """The texts' distinct shingles, the number of texts that hold each, and the number of texts with words."""
    shingles, sizes = _shingles(texts)
    known, holders = np.unique(np.concatenate([np.unique(x) for x in shingles] or [np.zeros(0, np.uint64)]), return_counts=True)
    return known, holders, int((sizes > 0).sum())


def _merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, int]:
    known, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return known, np.bincount(at, weights=np.concatenate((a[1], b[1])), minlength=len(known)).astype(np.int64), a[2] + b[2]


class Index:
    def __init__(self, item_ids: list[int | None], texts: list[bytes], benchmark: tuple | None = None):
        """Items to find; benchmark: holders_of all items, where these are only a block of them."""
        shingles, sizes = _shingles(texts)
        some = sorted((i for i in range(len(texts)) if sizes[i]), key=lambda i: (sizes[i], i))
        self.item_ids = [item_ids[i] for i in some]
        self.sizes = sizes[some].astype(np.int64)
        bags = [np.unique(shingles[i], return_counts=True) for i in some]
        self.known, holders, items = benchmark or holders_of(texts)
        self.unknown = float(np.log1p(items))
        self.weight = np.log1p(items / holders)
        self.bags = [(np.searchsorted(self.known, u), n) for u, n in bags]
        self.own = np.zeros(len(self.known) + 1, bool)  # by place; the last is of place -1
        for at, _ in self.bags:
            self.own[at] = True
        self.mass = np.array([(self.weight[at] * n).sum() for at, n in self.bags])
        self.coarse = np.zeros(1 << 20, bool)
        self.coarse[self.known & np.uint64((1 << 20) - 1)] = True
        self.short = sorted({int(s) for s in self.sizes if s < K})
        self.long = sorted({int(s) for s in self.sizes if s >= K})
        self.prints = packed(np.array([votes(shingles[i]).sum(0, dtype=np.int32) for i in some]).reshape(-1, 64))
        # items in order of size, so that those of a size are neighbouring bits of a row
        values = np.arange(1 << 16, dtype=np.uint64)[:, None]
        self.tables = np.zeros((4, 1 << 16, -(-len(some) // 8)), np.uint8)
        for b in range(4):
            block = (self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)
            for at in range(0, len(block), 8):
                self.tables[b, :, at // 8] = np.packbits(np.bitwise_count(values ^ block[at : at + 8]) <= RADIUS // 4, axis=1)[:, 0]

    def places(self, shingles: np.ndarray) -> np.ndarray:
        """Place of each shingle in known, or -1."""
        out = np.full(len(shingles), -1, np.int64)
        maybe = np.flatnonzero(self.coarse[shingles & np.uint64((1 << 20) - 1)])
        if len(maybe) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
            fits = self.known[at] == shingles[maybe]
            out[maybe[fits]] = at[fits]
        return out

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS, items of this size."""
        a, b = np.searchsorted(self.sizes, [size, size + 1])
        low, high = a // 8, -(-b // 8)
        found, most = [], max(1, MATRIX_BYTES // max(1, 8 * (high - low)))
        for first in range(0, len(prints), most):
            part = prints[first : first + most]
            near = np.zeros((len(part), high - low), np.uint8)
            for k in range(4):
                near |= self.tables[k, (part >> np.uint64(16 * k)) & np.uint64(0xFFFF), low:high]
            w, i = np.nonzero(np.unpackbits(near, axis=1)[:, a - 8 * low : b - 8 * low])
            fits = np.bitwise_count(part[w] ^ self.prints[i + a]) <= RADIUS
            found.append((w[fits] + first, i[fits] + a))
        return np.concatenate([f[0] for f in found] or [[]]).astype(np.int64), np.concatenate([f[1] for f in found] or [[]]).astype(np.int64)

    def similarity(self, item: int, places: np.ndarray, shingles: np.ndarray) -> float:
        """Weighted Jaccard of the item and a window's shingles, as multisets."""
        inside = places >= 0
        _, other = np.unique(shingles[~inside], return_counts=True)
        met, found = np.unique(places[inside], return_counts=True)
        at, n = self.bags[item]
        both, i, j = np.intersect1d(at, met, assume_unique=True, return_indices=True)
        shared = (self.weight[both] * np.minimum(n[i], found[j])).sum()
        whole = (self.weight[met] * found).sum() + self.unknown * other.sum() + self.mass[item] - shared
        return round(float(shared / whole), 9) if whole > 0 else 0.0

    def search(self, words: np.ndarray, shingles: np.ndarray, places: np.ndarray):
        """(item, similarity, start, words) of each item that a text reaches. A long text is taken in blocks of BLOCK windows."""
        best: dict[int, tuple] = {}
        n, hits = len(words), np.flatnonzero(self.own[places])
        if not len(hits):
            return best
        starts = {}
        for size in self.long:
            m = min(size, n) - K + 1  # shingles in a window
            if m < 1:
                continue
            steps = np.zeros(len(shingles) + 1, np.int32)  # windows that hold a hit: one or more ranges cover their start
            np.add.at(steps, np.maximum(0, hits - m + 1), 1)
            np.add.at(steps, np.minimum(hits, len(shingles) - m) + 1, -1)
            starts[size] = (m, np.flatnonzero(np.cumsum(steps)[:-1] > 0))
        for low in range(0, len(shingles), BLOCK):
            own = {size: at[np.searchsorted(at, low) : np.searchsorted(at, low + BLOCK)] for size, (_, at) in starts.items()}
            reach = max((int(at[-1]) + starts[size][0] for size, at in own.items() if len(at)), default=0)
            if not reach:
                continue
            sums = np.zeros((reach - low + 1, 64), np.int32)
            np.cumsum(votes(shingles[low:reach]), axis=0, dtype=np.int32, out=sums[1:])
            for size, at in own.items():
                m = starts[size][0]
                prints = packed(sums[at - low + m] - sums[at - low]) if len(at) else np.zeros(0, np.uint64)
                for w, item in zip(*self.candidates(prints, size)):
                    s = int(at[w])
                    found = self.similarity(int(item), places[s : s + m], shingles[s : s + m])
                    if found >= LEAST and (item not in best or found > best[item][1]):
                        best[item] = (int(item), found, s, m + K - 1)
        return best

    def scan(self, texts: list[bytes]):
        """(text, item, similarity, start, words) of all matches."""
        with np.errstate(over="ignore"):
            for first, last in common.slices(texts):
                words, bounds = common.word_hashes(texts[first:last], marks=True)
                per_text = common.shingle_hashes(words, bounds, K)
                sizes = np.array([len(s) for s in per_text])
                flat = self.places(np.concatenate(per_text)) if len(per_text) else np.zeros(0, np.int64)
                ends = np.cumsum(sizes)
                for i in np.unique(np.searchsorted(ends, np.flatnonzero(self.own[flat]), side="right")).tolist():
                    at = ends[i] - sizes[i]
                    if bounds[i + 1] - bounds[i] >= K:
                        for item, s, start, n in self.search(words[bounds[i] : bounds[i + 1]], per_text[i], flat[at : ends[i]]).values():
                            yield first + i, item, s, start, n
                for size in self.short:  # items of fewer than K words: the same words in a row
                    for i in range(last - first):
                        own = words[bounds[i] : bounds[i + 1]]
                        if len(own) < size:
                            continue
                        rolled = np.concatenate(common.shingle_hashes(np.lib.stride_tricks.sliding_window_view(own, size).ravel(), np.arange(0, (len(own) - size + 1) * size + 1, size), K))
                        at = self.places(rolled)
                        for item in np.flatnonzero(self.sizes == size).tolist():
                            where = np.flatnonzero(at == self.bags[item][0][0])
                            if len(where):
                                yield first + i, item, 1.0, int(where[0]), size


def find(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> DataFrame:
    """doc_id, item_id, similarity, start, n_words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    blocks = max(1, -(-items.count() // item_block))
    block = lambda b: items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow()
    out = whole = None
    if blocks > 1:
        for b in range(blocks):
            more = holders_of(common.texts_of(block(b).column("text")))
            whole = more if whole is None else _merged(whole, more)
    for b in range(blocks):
        own = block(b)
        index = docs.sparkSession.sparkContext.broadcast(Index(own.column("item_id").to_pylist(), common.texts_of(own.column("text")), whole))
        common.freed()

        def run(batches, index=index):
            for batch in batches:
                ids, found = batch.column(0).to_pylist(), list(index.value.scan(common.texts_of(batch.column(1))))
                cols = [[ids[f[0]] for f in found], [index.value.item_ids[f[1]] for f in found], [f[2] for f in found], [f[3] for f in found], [f[4] for f in found]]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "similarity", "start", "n_words"])
            common.freed()

        part = texts.mapInArrow(run, SCHEMA)
        if blocks > 1:  # one block's tables at a time
            part = common.staged(part, "matches")
            index.destroy()
        out = part if out is None else out.unionByName(part)
    best = F.max_by(F.struct("similarity", "start", "n_words"), F.struct(F.col("similarity"), -F.col("start"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
