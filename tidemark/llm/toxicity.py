"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word's input joins two vectors: an embedding of the word (words that training saw often; all others share one) and the
mean embedding of its hashed byte trigrams. Both directions read windows of WINDOW words that overlap by
WINDOW - STRIDE; attention pools the states of a window, a logistic unit scores it, and a text's score is the largest of
all its windows. Every word of a text is in some window.

Training sees the labels alone of a text, so each step scores all windows of its texts and learns from the highest of each
(the three highest of clean ones). It reads at most SAMPLE[0] toxic and SAMPLE[1] clean labelled texts outside the
held-out fold, chosen by a hash of id and text. All weights start at random; no word has a score of its own. Scores read the text alone.

Null and empty texts get the score of an empty window. Without labelled rows of both kinds every score is 0. Repeated
rows are scored like others; a label that is repeated teaches once; extra columns are not read. A text of any length is scored whole.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, STRIDE = 32, 26
SAMPLE = (1200, 1800)
HIDDEN, EMBED, TRIGRAMS = 8, 8, 4096
MEMO = 100_000
EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_+=/\\"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def words_once(texts: list[bytes]) -> list[list[bytes]]:
    """The words of each text, equal ones as one object: a sample has far fewer different words than words."""
    one = {}.setdefault
    return [[one(w, w) for w in words_of(t)] for t in texts]


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte trigrams of each word between marks (one before, two after it), and where each word's begin. A word's are
    the same whatever stands beside it."""
    buf = np.frombuffer(b"\x02" + b"\x03\x03\x02".join(words) + b"\x03\x03", np.uint8).astype(np.uint32)
    h = (buf[:-2] * np.uint32(2246822519)) ^ (buf[1:-1] * np.uint32(2654435761)) ^ (buf[2:] * np.uint32(40503))
    h ^= h >> np.uint32(15)
    ids = ((h * np.uint32(2654435761)) >> np.uint32(20)) % np.uint32(TRIGRAMS)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    inside = np.ones(len(ids), bool)
    ends = np.cumsum(sizes + 2)[:-1]
    inside[ends - 1] = inside[ends - 2] = False  # those that reach into the next word
    return ids[inside], np.concatenate(([0], np.cumsum(sizes)[:-1]))


def spans(n: int) -> list[int]:
    """First words of the windows of n words, n > WINDOW: each STRIDE words, the last one at the end."""
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, vocabulary: dict[bytes, int], seed: int = 11):
        r = np.random.default_rng(seed)
        d, h = 2 * EMBED, HIDDEN
        self.vocabulary = vocabulary
        f = lambda *s, scale=0.3: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "word": f(len(vocabulary) + 1, EMBED, scale=0.05), "char": f(TRIGRAMS, EMBED, scale=0.05), "wx": f(2, d, 3 * h),
            "bx": np.zeros((2, 1, 3 * h), np.float32), "u": f(2, h, 3 * h), "bu": np.zeros((2, 1, 3 * h), np.float32),
            "wa": f(2 * h, h), "va": f(h), "wo": f(2 * h), "bo": np.full(1, -2.0, np.float32),
        }

    # -- forward over projected inputs

    def recur(self, rows: np.ndarray, grid: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States (windows, WINDOW, 2 h). grid: each window's places in rows (2, n, 3 h); the second direction reads backwards."""
        p, h = self.p, HIDDEN
        n, steps = grid.shape
        inputs = np.empty((steps, 2, n, 3 * h), np.float32)
        inputs[:, 0] = rows[0].take(grid.T, axis=0)
        inputs[:, 1] = rows[1].take(grid.T[::-1], axis=0)
        state = np.zeros((2, n, h), np.float32)
        out = np.empty((n, steps, 2 * h), np.float32)
        for t in range(steps):
            back = steps - 1 - t
            x = inputs[t]
            g = state @ p["u"] + p["bu"]
            rz = _sigmoid(x[..., : 2 * h] + g[..., : 2 * h])
            new = np.tanh(x[..., 2 * h :] + rz[..., :h] * g[..., 2 * h :])
            after = new + rz[..., h:] * (state - new)
            if mask is not None:
                m = np.stack((mask[:, t], mask[:, back]))[..., None]
                after = np.where(m, after, state)
            if keep is not None:
                keep.append((state, g, rz, new))
            state = after
            out[:, t, :h], out[:, back, h:] = state[0], state[1]
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray | None):
        p = self.p
        act = np.tanh(states @ p["wa"])
        e = act @ p["va"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        a = np.exp(e - e.max(1, keepdims=True))
        if mask is not None:
            a = a * mask
        a /= np.maximum(a.sum(1, keepdims=True), 1e-9)
        pooled = (a[:, None, :] @ states)[:, 0]
        return pooled @ p["wo"] + p["bo"][0], (act, a, pooled)

    def project(self, word_ids: np.ndarray, char_means: np.ndarray) -> np.ndarray:
        """(2, n, 3 h): what each word adds to the gates."""
        x = np.concatenate((self.p["word"][word_ids], char_means), 1)
        return x[None] @ self.p["wx"] + self.p["bx"]

    def char_means(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros((0, EMBED), np.float32)
        at, begins = trigrams(words)
        sizes = np.diff(np.append(begins, len(at)))
        return np.add.reduceat(self.p["char"][at], begins, axis=0) / sizes[:, None].astype(np.float32)

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words], np.int64)


class Scorer:
    """Scores texts, with a memo of bounded size for the words' projections."""

    def __init__(self, net: Network, limit: int = MEMO):
        self.net, self.limit, self.at = net, limit, common.WordIndex()
        self.rows = np.zeros((2, 1024, 3 * HIDDEN), np.float32)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.at) > self.limit:
            self.at = common.WordIndex()
        first = len(self.at)
        ids = np.array(self.at.of(words), np.int64)
        if new := list(islice(reversed(self.at), len(self.at) - first))[::-1]:
            while self.rows.shape[1] < first + len(new):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)), 1)
            bare = [w.strip(EDGES) for w in new]
            self.rows[:, first : first + len(new)] = self.net.project(self.net.word_ids(bare), self.net.char_means(bare))
        return ids

    def _windows(self, ids: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(ids), 1024):
            m = None if mask is None else mask[i : i + 1024]
            out.append(self.net.pool(self.net.recur(self.rows, ids[i : i + 1024], m), m)[0])
        return np.concatenate(out)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        a, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > common.SLICE_BYTES // 2 or i == len(texts) - 1:
                out[a : i + 1] = self._logits(texts[a : i + 1])
                a, size = i + 1, 0
        return out

    def _logits(self, texts: list[bytes]) -> np.ndarray:
        split = [words_of(t) for t in texts]
        ids = self._ids([w for s in split for w in s])
        best, at = np.full(len(texts), -np.inf), 0
        starts, owner, short = [], [], []
        for k, s in enumerate(split):
            if len(s) > WINDOW:
                found = spans(len(s))
                starts += [at + x for x in found]
                owner += [k] * len(found)
            else:
                short.append((k, at, len(s)))
            at += len(s)
        if starts:
            np.maximum.at(best, np.array(owner), self._windows(ids[np.array(starts)[:, None] + np.arange(WINDOW)], None))
        if short:
            mask = np.zeros((len(short), WINDOW), bool)
            grid = np.zeros((len(short), WINDOW), np.int64)
            for j, (_, first, n) in enumerate(short):
                mask[j, :n], grid[j, :n] = True, ids[first : first + n]
            if not len(self.at):
                self._ids([b""])
            best[[k for k, _, _ in short]] = self._windows(grid, mask)
        return best


# ---- training ----------------------------------------------------------------------------------------------------


def fit(texts: list[bytes], labels: np.ndarray, steps: int = 260, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Network | None:
    if not 0 < labels.sum() < len(labels):
        return None
    common.one_blas_thread()
    split = words_once(texts)
    often = Counter(w for words in split for w in {w.strip(EDGES) for w in words})
    net = Network({w: i + 1 for i, w in enumerate(sorted(w for w, n in often.items() if n >= 8))})
    r, p = np.random.default_rng(seed), net.p
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    while step < steps:
        order = r.permutation(len(texts))
        for i in range(0, len(order), batch):
            rows, y = _hardest(net, [split[j] for j in order[i : i + batch]], labels[order[i : i + batch]])
            grads = _gradients(net, rows, y, r)
            step += 1
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def _hardest(net: Network, split: list[list[bytes]], labels: np.ndarray) -> tuple[list[list[bytes]], np.ndarray]:
    windows = [[s[a : a + WINDOW] for a in (spans(len(s)) if len(s) > WINDOW else [0])] for s in split]
    flat = [w for ws in windows for w in ws]
    scores = Scorer(net)._logits([b" ".join(w) for w in flat])
    rows, y, at = [], [], 0
    for ws, label in zip(windows, labels.tolist()):
        best = np.argsort(-scores[at : at + len(ws)], kind="stable")[: 1 if label else 3]
        rows += [ws[b] for b in best]
        y += [label] * len(best)
        at += len(ws)
    return rows, np.array(y, np.float32)


def _gradients(net: Network, rows: list[list[bytes]], y: np.ndarray, r) -> dict[str, np.ndarray]:
    p, h = net.p, HIDDEN
    n = len(rows)
    mask = np.zeros((n, WINDOW), bool)
    index: dict[bytes, int] = {}
    for row in rows:
        for w in row:
            index.setdefault(w.strip(EDGES), len(index))
    vocab = list(index) or [b""]
    grid = np.zeros((n, WINDOW), np.int64)
    for i, row in enumerate(rows):
        mask[i, : len(row)] = True
        grid[i, : len(row)] = [index[w.strip(EDGES)] for w in row]
    ids = np.where(r.random(len(vocab)) < 0.1, 0, net.word_ids(vocab))  # so that unknown words learn too
    tri, begins = trigrams(vocab)
    sizes = np.diff(np.append(begins, len(tri)))
    x = np.concatenate((p["word"][ids], np.add.reduceat(p["char"][tri], begins, axis=0) / sizes[:, None]), 1).astype(np.float32)
    projected = x[None] @ p["wx"] + p["bx"]
    keep: list = []
    states = net.recur(projected, grid, mask, keep)
    logit, (act, a, pooled) = net.pool(states, mask)
    dlogit = (_sigmoid(logit) - y) / n
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["wo"], g["bo"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
    dpooled = dlogit[:, None] * p["wo"]
    da = (states @ dpooled[:, :, None])[..., 0]
    dstates = a[..., None] * dpooled[:, None, :]
    de = a * (da - (a * da).sum(1, keepdims=True))
    g["va"] = np.einsum("nt,nth->h", de, act)
    dact = de[..., None] * p["va"] * (1 - act * act)
    g["wa"] = np.einsum("nth,ntk->hk", states, dact)
    dstates += dact @ p["wa"].T
    dinputs, dh = np.zeros((2, n, WINDOW, 3 * h), np.float32), np.zeros((2, n, h), np.float32)
    for t in range(WINDOW - 1, -1, -1):
        back = WINDOW - 1 - t
        state, gate, rz, new = keep[t]
        m = np.stack((mask[:, t], mask[:, back]))[..., None]
        dh = dh + np.stack((dstates[:, t, :h], dstates[:, back, h:]))
        live = dh * m
        rr, z = rz[..., :h], rz[..., h:]
        dnew = live * (1 - z) * (1 - new * new)
        dz = live * (state - new) * z * (1 - z)
        dr = dnew * gate[..., 2 * h :] * rr * (1 - rr)
        dx = np.concatenate((dr, dz, dnew), -1)
        dg = np.concatenate((dr, dz, dnew * rr), -1)
        dinputs[0, :, t], dinputs[1, :, back] = dx[0], dx[1]
        g["u"] += state.transpose(0, 2, 1) @ dg
        g["bu"] += dg.sum(1, keepdims=True)
        dh = np.where(m, live * z + dg @ p["u"].transpose(0, 2, 1), dh)
    per_word = np.zeros((2, len(vocab), 3 * h), np.float32)
    for k in (0, 1):
        np.add.at(per_word[k], grid[mask], dinputs[k][mask])
    g["wx"], g["bx"] = x.T[None] @ per_word, per_word.sum(1, keepdims=True)
    dx = (per_word @ p["wx"].transpose(0, 2, 1)).sum(0)
    np.add.at(g["word"], ids, dx[:, :EMBED])
    np.add.at(g["char"], tri, np.repeat(dx[:, EMBED:] / sizes[:, None], sizes, axis=0))
    return g


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, fold: int = 0) -> Network | None:
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out(fold))
    marks = marks.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
    most = {"1": sample[0], "0": sample[1]}
    # the drawn labels are bounded by the sample's size, so they are broadcast whatever the table's size
    few = F.broadcast(common.drawn(marks.withColumn("text", F.lit(None).cast("string")), most, 23, "toxic").drop("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id").select("doc_id", "toxic", "text")
    rows = common.drawn(rows, most, 23, "toxic").orderBy("doc_id", "toxic", "text").toArrow()  # an id may name many documents
    texts, toxic = common.texts_of(rows.column("text")), rows.column("toxic").to_numpy().astype(np.int64)
    del rows
    net = fit(texts, toxic)
    del texts
    common.freed()
    return net


def score(docs: DataFrame, net: Network | None, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.held_out(fold).alias("held_out"), "text")
    if net is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    frozen = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        common.one_blas_thread()
        scorer = Scorer(frozen.value)
        for batch in batches:
            s = 1 / (1 + np.exp(-scorer.logits(common.texts_of(batch.column(2))).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        del scorer
        common.freed()

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows of docs that score would predict 0."""
    if net is None:
        return docs
    frozen = docs.sparkSession.sparkContext.broadcast(net)

    def decider():
        common.one_blas_thread()
        scorer = Scorer(frozen.value)
        return lambda texts: scorer.logits(texts) < 0

    return common.kept_rows(docs, decider)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return score(docs, train(docs, common.read(spark, sf_dir, "labels")))
