"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order up to ORDER, its statistics frozen after training. A byte's probability in a
context is count / (total + distinct) where the context has seen it; otherwise the escape distinct / (total + distinct) times
the next shorter context's probability, over the bytes not excluded by the longer one (method C with exclusion, down to the uniform
order -1). A text's code length is the exact sum of its bytes' -log2 probabilities; the language of the shortest code wins, ties by name.

Contexts of two bytes and more are in a language's tree if it saw them LEAST times (more often where an order's costs would exceed
COSTS numbers over all languages; trees.least tells). Costs are laid out for lookups of whole batches: orders 0 and 1 as one table, and for each
longer order a hash table of the contexts' bytes that any language has seen, with the costs that all languages resolve them to. A byte that is in
no table of an order adds what its context costs to escape and goes to the next shorter one.

Training reads at most SAMPLE_DOCS whole documents a language, some 16 MB, chosen by a hash of id and text among labelled rows outside the
held-out fold; prediction covers every row and reads its text alone, whatever its length, in pieces of about a megabyte. `und`
with score 0 where the text is null or has no letter, or where nothing was learned. Repeated rows and null ids are scored like others;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE_DOCS = 2000
ORDER, LEAST, COSTS = 4, 2, 3_000_000
EVIDENCE_BYTES = 200
LEAD = b"\0" * ORDER

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Places:
    """Places of distinct keys, found for whole arrays: open addressing with linear probes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._slots(keys)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            lost = self.table[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._slots(keys)
        out = self.table[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.table[at]
            out[open_] = found
            more = (found >= 0) & (self.keys[found] != keys[open_])
            open_, at = open_[more], at[more]
        return out


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of n."""
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights=n, minlength=len(u))


class Trees:
    """Frozen statistics of all languages as costs in bits."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """counts: for each language strings of ORDER + 1 bytes as integers (first byte highest), 0 before a text's start, and how often each came."""
        self.langs = langs
        folded = {}
        for lang, (keys, n) in counts.items():
            b = _FOLD[((keys[:, None] >> (8 * np.arange(ORDER, -1, -1))) & 255).astype(np.uint8)].astype(np.int64)
            folded[lang] = ((b << (8 * np.arange(ORDER, -1, -1))).sum(1), n)
        grams = lambda lang, k: _merged(folded[lang][0] & ((1 << 8 * (k + 1)) - 1), folded[lang][1])
        flat = np.full((1, 256), 1 / 256)
        dense = []
        for lang in langs:
            zero = self._level(*grams(lang, 0), 1, flat)
            dense.append(self._level(*grams(lang, 1), 256, np.repeat(zero, 256, 0)).ravel())
        self.dense = -np.log2(np.stack(dense, 1)).astype(np.float32)
        self.least, self.orders = {}, []
        for k in range(2, ORDER + 1):
            self._add_order(k, [grams(lang, k) for lang in langs])

    @staticmethod
    def _level(keys: np.ndarray, n: np.ndarray, contexts: int, shorter: np.ndarray) -> np.ndarray:
        """Probabilities (contexts, 256) from counts of context * 256 + byte and the shorter contexts' probabilities."""
        count = np.zeros(contexts * 256)
        count[keys] = n
        count = count.reshape(contexts, 256)
        seen = count > 0
        total, distinct = count.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        left = np.maximum(1 - np.where(seen, shorter, 0).sum(1, keepdims=True), 1e-9)
        escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
        return np.where(seen, count / np.maximum(total + distinct, 1), escape * shorter / np.where(total > 0, left, 1.0))

    def _add_order(self, k: int, grams: list[tuple[np.ndarray, np.ndarray]]) -> None:
        totals = [np.bincount(np.unique(keys >> 8, return_inverse=True)[1], weights=n) for keys, n in grams]
        totals = [t[np.unique(keys >> 8, return_inverse=True)[1]] for t, (keys, n) in zip(totals, grams)]
        least, most = LEAST, COSTS // len(self.langs)
        while len(np.unique(np.concatenate([keys[t >= least] for t, (keys, n) in zip(totals, grams)]))) > most:
            least += max(1, least // 2)
        kept = [(keys[t >= least], n[t >= least]) for t, (keys, n) in zip(totals, grams)]
        keys = np.unique(np.concatenate([x[0] for x in kept]))
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        shorter = self.costs(keys & ((1 << 8 * k) - 1), k - 1).astype(np.float64)
        cost, escape = shorter.copy(), np.zeros((len(contexts), len(self.langs)))
        for j, (own, n) in enumerate(kept):
            count = np.zeros(len(keys))
            count[np.searchsorted(keys, own)] = n
            seen = count > 0
            total, distinct = np.bincount(of, weights=count, minlength=len(contexts)), np.bincount(of, weights=seen, minlength=len(contexts))
            left = np.maximum(1 - np.bincount(of, weights=np.where(seen, np.exp2(-shorter[:, j]), 0), minlength=len(contexts)), 1e-9)
            has = total > 0
            escape[has, j] = -np.log2(distinct[has] / (total[has] + distinct[has]) / left[has])
            cost[:, j] = np.where(seen, -np.log2(np.maximum(count, 1) / (total + distinct + ~has)[of]), shorter[:, j] + escape[of, j])
        self.least[k] = least
        self.orders.append((Places(keys), cost.astype(np.float32), Places(contexts), escape.astype(np.float32)))

    def costs(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Bits under each language of strings of k + 1 bytes: of the last one after the others."""
        if k < 2:
            return self.dense[keys & 0xFFFF]
        grams, cost, contexts, escape = self.orders[k - 2]
        at = grams.of(keys)
        lost = np.flatnonzero(at < 0)
        out = cost[at]
        if len(lost):
            rest = keys[lost]
            more = self.costs(rest & ((1 << 8 * k) - 1), k - 1)
            of = contexts.of(rest >> 8)
            met = np.flatnonzero(of >= 0)
            more[met] += escape[of[met]]
            out[lost] = more
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for first, last in common.slices(texts):
            if last - first == 1:  # one text, perhaps a long one
                out[first] = self._bits_of(texts[first])
                continue
            part = texts[first:last]
            bits = self.costs(self._keys(LEAD + LEAD.join(part)), ORDER)
            lengths = np.array([len(t) for t in part])
            ends = np.cumsum(lengths + ORDER) - ORDER
            full = lengths > 0
            if full.any():
                cuts = np.stack((ends - lengths, ends), 1)[full].ravel()
                sums = np.add.reduceat(np.concatenate((bits, np.zeros((1, bits.shape[1]), bits.dtype))), cuts, axis=0, dtype=np.float64)[::2]
                out[np.flatnonzero(full) + first] = sums
        return out

    @staticmethod
    def _keys(raw: bytes) -> np.ndarray:
        """The strings of ORDER + 1 bytes of raw, as integers."""
        s = _FOLD[np.frombuffer(raw, np.uint8)].astype(np.int64)
        n = len(s) - ORDER
        key = s[:n].copy()
        for j in range(1, ORDER + 1):
            key <<= 8
            key |= s[j : n + j]
        return key

    def _bits_of(self, text: bytes) -> np.ndarray:
        total, step = np.zeros(len(self.langs)), common.SLICE_BYTES
        for at in range(0, len(text), step):
            lead = (LEAD + text[max(0, at - ORDER) : at])[-ORDER:]
            total += self.costs(self._keys(lead + text[at : at + step]), ORDER).sum(0, dtype=np.float64)
        return total


def _grams(places: dict[str, int]):
    def run(batches):
        for batch in batches:
            parts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), common.texts_of(batch.column(1))):
                parts.setdefault(lang, []).append(text)
            for lang, texts in parts.items():
                keys, n = np.unique(Trees._keys(LEAD + LEAD.join(texts)), return_counts=True)
                real = keys & 255 != 0
                columns = [pa.array(np.full(int(real.sum()), places[lang], np.int32)), pa.array(keys[real]), pa.array(n[real].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])
        common.freed()

    return run


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, fold: int = 0) -> Trees | None:
    """Trees of the languages in docs' labelled rows outside the held-out fold."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out(fold)).select("doc_id", "lang", "text")
    langs = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())  # the labels
    if not langs:
        return None
    sample = common.drawn(labelled, sample_docs, 17, "lang").select("lang", "text")
    schema = "lang int, gram long, n long"
    found = sample.mapInArrow(_grams({x: i for i, x in enumerate(langs)}), schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    lang, gram, n = (found.column(c).to_numpy() for c in ("lang", "gram", "n"))
    own = {x: lang == i for i, x in enumerate(langs)}
    langs = [x for x in langs if own[x].any()]
    trees = Trees(langs, {x: (gram[own[x]], n[own[x]].astype(np.float64)) for x in langs}) if langs else None
    del found, lang, gram, n, own
    common.freed()
    return trees


def _posterior(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Share of the best language, code lengths counted as those of EVIDENCE_BYTES bytes where a text has more."""
    excess = (bits - bits.min(1, keepdims=True)) * np.minimum(1, EVIDENCE_BYTES / size)[:, None]
    return 1 / np.exp2(-excess).sum(1)


def keep_known(docs: DataFrame, trees: Trees | None, least: float) -> DataFrame:
    """The rows of docs that identify would name with a score of at least this; all rows where nothing was learned."""
    if trees is None:
        return docs
    frozen = docs.sparkSession.sparkContext.broadcast(trees)

    def decider():
        t = frozen.value

        def decide(texts):
            lettered = np.array([any(map(str.isalpha, x.decode("utf-8", "replace"))) for x in texts], bool)
            return lettered & (_posterior(t.code_lengths(texts), np.maximum([len(x) for x in texts], 1)) >= least)

        return decide

    return common.kept_rows(docs, decider)


def identify(docs: DataFrame, trees: Trees | None, fold: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of each row of docs."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), common.held_out(fold).alias("held_out"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), F.col("text"),
    )
    schema = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"
    if trees is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    frozen = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        t = frozen.value
        for batch in batches:
            texts = common.texts_of(batch.column(3))
            bits = t.code_lengths(texts)
            size = np.maximum([len(x) for x in texts], 1)
            best, score = bits.argmin(1), _posterior(bits, size)
            fine = np.array(batch.column(2).to_pylist(), bool)
            pred = [t.langs[b] if ok else "und" for b, ok in zip(best, fine)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(np.where(fine, score, 0.0)), pa.array(bits.min(1) / size)],
                names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
            )
        common.freed()

    return rows.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return identify(docs, train(docs))
