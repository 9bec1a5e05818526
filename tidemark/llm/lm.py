"""Language-model scores: a causal self-attention model over subword ids, trained here in numpy, beside a smoothed unigram base.

The texts are read once: a table has their ids, and the words of the training fold counted by each task.

Model. A text's words (A-Z lower-cased) become subword ids of a public vocabulary, then one end id. One attention layer reads
windows of WINDOW ids; they overlap by WINDOW - STRIDE, and each id is scored once, in the first window that holds it, with
at least WINDOW - STRIDE ids before it (or the text's start). The output is factored: a softmax over classes of ids (the most frequent ids
alone, the others grouped by k-means on their neighbours), then the id's share of its class. Windows of many texts run as one
batch under one causal mask. Counts of ids and of their neighbours, hence classes and shares, are sums over the whole training
fold. Training starts on the driver with at most SAMPLE_DOCS of its texts, some 16 MB of ids, seen EPOCHS times at most; a pass over all of its texts on the executors
follows, each task from the same start over its own texts, and their results are averaged. So scores depend slightly on how
the input is split.

Base. Word counts of the whole training fold are a table made by map-side combined sums. Words at least as frequent as a floor,
at most TOP of them, are broadcast; the rest of each text's words are joined to the table, pre-aggregated by row.

Null text is empty: one end token. Repeated rows and null ids are scored one by one, texts of any length whole. Extra columns are not read. Without training texts c, N and V
are 0 and the model scores by its initial weights.
"""

from __future__ import annotations

import copy
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordpieces import WordMemo

VOCABULARY, IDS = "word_bpe_49k.json", 49408
END, START = IDS, IDS + 1
WINDOW, STRIDE, DIM = 32, 24, 16
ALONE, GROUPS = 64, 64
SAMPLE_DOCS, TOP, FOLD = 2500, 200_000, 1
STEPS, EPOCHS = 4500, 6
HEAD = WINDOW - STRIDE
BATCH, COMMON, RATE = 96, 192, 0.003
ROWS = 512  # whose logits stay in the processor's cache
END_BYTES = np.uint16(END).tobytes()
TIED = ("at", "qkv", "o", "out", "b")


class Model:
    def __init__(self, classes: np.ndarray, share: np.ndarray, seed: int = 3):
        """classes: of each id and the end; share: log of its part of its class."""
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.classes, self.share = classes.astype(np.int32), share.astype(np.float32)
        c = int(classes.max()) + 1
        self.p = {"e": f(IDS + 2, DIM, scale=0.1), "at": f(WINDOW, DIM, scale=0.05), "qkv": f(DIM, 3 * DIM, scale=0.25), "o": f(DIM, DIM, scale=0.2), "out": f(DIM, c, scale=0.1), "b": np.zeros(c, np.float32)}
        self.mask = np.tril(np.ones((WINDOW, WINDOW), np.float32))

    def _folded(self) -> tuple[np.ndarray, np.ndarray]:
        """What turns a state into its query against states, and a mean of states into their output: products of weights."""
        w = self.p["qkv"]
        return w[:, :DIM] @ w[:, DIM : 2 * DIM].T * w.dtype.type(DIM**-0.5), w[:, 2 * DIM :] @ self.p["o"]

    def hidden(self, grid: np.ndarray, keep: list | None = None, since: int = 0) -> np.ndarray:
        """States after attention of the places from since on, (windows, WINDOW - since, DIM)."""
        p, n = self.p, len(grid)
        ask, give = self._folded()
        wide = np.ones((n, WINDOW, DIM + 1), p["at"].dtype)  # the ones sum the weights
        x = np.add(p["e"].take(grid, axis=0), p["at"], out=wide[..., :DIM])
        turned = np.ones((n, DIM + 1, WINDOW), x.dtype)
        turned[:, :DIM] = x.transpose(0, 2, 1)
        x = np.ascontiguousarray(x[:, since:])
        u = (x.reshape(-1, DIM) @ ask).reshape(x.shape)
        both = np.empty((n, WINDOW - since if keep is None else 2 * WINDOW, WINDOW), x.dtype)  # gradients have room beside the weights
        a = np.matmul(u, turned[:, :DIM], out=both[:, : WINDOW - since])
        np.clip(a, -30, 30, out=a)
        np.exp(a, out=a)
        a *= self.mask[since:]
        o = a @ wide
        z = o[..., DIM:]
        o = o[..., :DIM] / z
        h = (o.reshape(-1, DIM) @ give).reshape(x.shape)
        h += x
        np.tanh(h, out=h)
        if keep is not None:
            keep += [x, wide, turned, u, both, z, o, ask, give]
        return h

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text's ids (the end is the last of them)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate(texts).astype(np.int64)
        inputs = np.empty_like(flat)
        inputs[1:] = flat[:-1]
        begins = np.cumsum(sizes) - sizes
        inputs[begins] = START
        windows = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
        starts = np.concatenate([np.arange(w) * STRIDE for w in windows])
        first, left = starts + np.repeat(begins, windows), np.repeat(sizes, windows) - starts
        values = np.empty(len(flat))
        out, b, factor = self.p["out"], self.p["b"], np.exp(self.p["b"])
        room, row = np.empty((ROWS, len(b)), out.dtype), np.arange(ROWS) * len(b)
        for some, since in ((np.flatnonzero(starts == 0), 0), (np.flatnonzero(starts), HEAD)):
            span = np.arange(WINDOW)
            for i in range(0, len(some), BATCH):  # small enough for the processor's cache
                part = some[i : i + BATCH]
                place = first[part, None] + span
                h = self.hidden(inputs.take(place, mode="clip"), since=since)
                wanted = np.flatnonzero(span[since:] < left[part, None])
                h, at = h.reshape(-1, DIM).take(wanted, axis=0), place[:, since:].ravel().take(wanted)
                ids = flat.take(at)
                own = self.classes.take(ids)
                found, z = b.take(own), np.empty(len(at), out.dtype)
                for j in range(0, len(at), ROWS):
                    to = slice(j, j + ROWS)
                    logits = np.matmul(h[to], out, out=room[: len(h[to])])
                    found[to] += logits.ravel().take(row[: len(logits)] + own[to])
                    np.exp(logits, out=logits)
                    np.matmul(logits, factor, out=z[to])
                values[at] = found - np.log(z) + self.share.take(ids)
        return np.add.reduceat(values, begins) / np.log(10)

    def gradients(self, grid: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, dict]:
        """(probability of each target, gradients of the mean negative log of them); of the embeddings the inputs with a row each."""
        p, keep = self.p, []
        h = self.hidden(grid, keep)
        x, wide, turned, u, both, z, o, ask, give = keep
        flat, kind = h.reshape(-1, DIM), h.dtype.type
        y = self.classes.take(target.ravel())
        # exponents without the biases, whose factors go into small products; normalised by rows of the states
        factor = np.exp(np.clip(p["b"], -60, 60))
        large = np.abs(p["out"]).sum(0).max() > 60
        back = np.ascontiguousarray(p["out"].T) * factor[:, None]
        found, d, out, bias = np.empty(len(y), h.dtype), np.empty_like(flat), np.zeros_like(p["out"].T), np.zeros_like(p["b"])
        room, row = np.empty((min(ROWS, len(y)), len(factor)), h.dtype), np.arange(ROWS) * len(factor)
        for i in range(0, len(y), ROWS):
            own, part = y[i : i + ROWS], flat[i : i + ROWS]
            s = np.matmul(part, p["out"], out=room[: len(own)])
            if large:
                np.minimum(s, 60, out=s)
            np.exp(s, out=s)
            total, at, of_own = s @ factor, row[: len(own)] + own, factor.take(own)
            met, cells = s.ravel().take(at), s.ravel()
            found[i : i + ROWS] = met * of_own / total
            cells[at] = met - total / of_own
            weight = 1 / (total * kind(target.size))
            out += s.T @ (part * weight[:, None])
            bias += weight @ s
            np.multiply(s @ back, weight[:, None], out=d[i : i + ROWS])
        g = {"out": out.T * factor, "b": bias * factor}
        d *= 1 - flat * flat
        # through the weighted means of states, then the weights: both has them and, beside them, the gradients of their exponents
        means = o.reshape(-1, DIM)
        back = (d @ give.T).reshape(x.shape)
        sent = np.empty_like(wide)
        np.divide(back, z, out=sent[..., :DIM])
        np.negative(np.einsum("nij,nij->ni", sent[..., :DIM], o), out=sent[..., DIM])
        a, da = both[:, :WINDOW], both[:, WINDOW:]
        np.matmul(sent, turned, out=da)
        da *= a
        du = (da @ wide[..., :DIM]).reshape(-1, DIM)
        dx = both.transpose(0, 2, 1) @ np.concatenate((sent[..., :DIM], u), axis=1)
        dx += (du @ ask.T + d).reshape(x.shape)
        w, o = p["qkv"], p["o"]
        of_ask, of_give = (x.reshape(-1, DIM).T @ du) * kind(DIM**-0.5), means.T @ d
        g["qkv"] = np.concatenate((of_ask @ w[:, DIM : 2 * DIM], of_ask.T @ w[:, :DIM], of_give @ o.T), axis=1)
        g["o"] = w[:, 2 * DIM :].T @ of_give
        g["at"] = dx.sum(0)
        g["e"] = (grid.ravel(), dx.reshape(-1, DIM))
        return found, g


def neighbour_keys(flat: np.ndarray, rest: np.ndarray, place: np.ndarray) -> np.ndarray:
    """id * 2 COMMON + column for each pair of an id of rest and a common id before or after it; flat is whole texts with their ends."""
    before, keys = np.concatenate(([END], flat[:-1])), []
    for a, b, shift in ((flat, before, 0), (flat[:-1], flat[1:], COMMON)):
        fits = rest[a] & (place[b] >= 0)
        keys.append(a[fits] * (2 * COMMON) + place[b[fits]] + shift)
    return np.concatenate(keys)


def classes_of(counts: np.ndarray, near_of, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Class of each id and the end, and the log of its share there, from counts of training ids; near_of(rest, place) has
    the ids of rest that were met beside common ids and a row for each: square roots of the parts of its neighbours."""
    r = np.random.default_rng(seed)
    order = np.argsort(-counts, kind="stable")
    top = [END, *[i for i in order[:ALONE].tolist() if i != END]]
    classes = np.full(IDS + 1, -1)
    classes[top] = np.arange(len(top))
    place = np.full(IDS + 1, -1)
    place[order[:COMMON]] = np.arange(COMMON)
    mask = (classes < 0) & (counts >= 3)
    rest = np.flatnonzero(mask)
    near = np.zeros((len(rest), 2 * COMMON), np.float32)
    met, vectors = near_of(mask, place)
    near[np.searchsorted(rest, met)] = vectors
    groups = np.zeros(len(rest), np.int64)
    if len(rest) > GROUPS:
        weight = np.sqrt(counts[rest])
        centre = near[r.choice(len(rest), GROUPS, replace=False, p=weight / weight.sum())]
        for _ in range(12):
            groups = (near @ centre.T - 0.5 * (centre * centre).sum(1)).argmax(1)
            for k in np.unique(groups):
                own = groups == k
                centre[k] = (near[own] * weight[own, None]).sum(0) / weight[own].sum()
    classes[rest] = len(top) + groups
    seen_to = classes.max() + 1
    classes[classes < 0] = seen_to  # what training hardly saw
    smoothed = counts + 0.5
    mass = np.bincount(classes, weights=smoothed)
    return classes, np.log(smoothed / mass[classes])


class Descent:
    """Adaptive steps of a model, whose parameters besides the embeddings become parts of one array."""

    def __init__(self, model: Model):
        self.model, self.n, p = model, 0, model.p
        self.tied = np.concatenate([p[k].ravel() for k in TIED])
        at = 0
        for k in TIED:
            p[k] = self.tied[at : at + p[k].size].reshape(p[k].shape)
            at += p[k].size
        self.m, self.v = np.zeros_like(self.tied), np.zeros_like(self.tied)
        self.moments = np.zeros((len(p["e"]), 2, DIM), p["e"].dtype)

    def step(self, grid: np.ndarray, target: np.ndarray, now: float) -> None:
        p, m, v = self.model.p, self.m, self.v
        self.n += 1
        _, g = self.model.gradients(grid, target)
        rows, change = g.pop("e")
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # ids fit, and short numbers sort by digits
        rows = rows.take(order)
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        ids, summed = rows.take(first), np.add.reduceat(change.take(order, axis=0), first, axis=0)
        own = self.moments.take(ids, axis=0)
        own[:, 0] += 0.1 * (summed - own[:, 0])
        own[:, 1] += 0.05 * (summed * summed - own[:, 1])
        self.moments[ids] = own
        p["e"][ids] -= now * own[:, 0] / (np.sqrt(own[:, 1]) + 1e-5)
        x = np.concatenate([g[k].ravel() for k in TIED])
        m += 0.1 * (x - m)
        v += 0.02 * (x * x - v)
        self.tied -= now * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.98**self.n)) + 1e-6)


def _bounded(model: Model) -> Model:
    p = model.p
    p["out"], p["b"] = np.clip(p["out"], -4, 4), np.clip(p["b"], -20, 20)  # states lie in [-1, 1], so no exponent overflows
    return model


def _inputs(flat: np.ndarray) -> np.ndarray:
    return np.concatenate(([START], np.where(flat[:-1] == END, START, flat[:-1])))


def fit(texts: list[np.ndarray], steps: int = STEPS, batch: int = 64, rate: float = 0.01, seed: int = 9, classes: tuple | None = None, counts: np.ndarray | None = None) -> Model:
    """A model trained on texts; classes with shares and counts of ids are those of the texts unless given."""
    common.one_blas_thread()
    flat = np.concatenate([np.append(t, END) for t in texts] or [np.array([END])]).astype(np.int64)
    if classes is None:
        counts = np.bincount(flat, minlength=IDS + 1).astype(np.float64)

        def near_of(rest, place):
            key, n = np.unique(neighbour_keys(flat, rest, place), return_counts=True)
            return _vectors(key // (2 * COMMON), key % (2 * COMMON), n)

        classes = classes_of(counts, near_of)
    model = Model(*classes)
    of_class = np.bincount(model.classes, weights=counts, minlength=len(model.p["b"]))
    model.p["b"] = np.log((of_class + 0.5) / (of_class + 0.5).sum()).astype(np.float32)
    inputs = _inputs(flat)
    if len(flat) <= WINDOW:
        return model
    r, descent = np.random.default_rng(seed), Descent(model)
    for step in range(1, steps + 1):
        at = r.integers(0, len(flat) - WINDOW, batch)[:, None] + np.arange(WINDOW)
        descent.step(inputs[at], flat[at], rate * min(1.0, 2.0 - 2.0 * step / steps + 0.02))
    return _bounded(model)


def _vectors(ids: np.ndarray, columns: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    met, row = np.unique(ids, return_inverse=True)
    near = np.zeros((len(met), 2 * COMMON), np.float32)
    near[row, columns] = n
    return met, np.sqrt(near / np.maximum(near.sum(1, keepdims=True), 1))


# ---- what training gathers from the whole fold -------------------------------------------------------------------


#: given: the text is not null. Passes over the ids leave the texts unread.
CODED = "rid long, doc_id long, held_out boolean, given boolean, text string, ids binary, word binary, c long"
_KINDS = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.binary(), pa.binary(), pa.int64())


def _mixed(n: int, schema: str, kinds, cols: dict) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)


def _encoded(batches):
    """Rows (rid, doc_id, held_out, text) with their ids, and rows (word, c): the words of training rows with their counts so far."""
    memo, counts, words = WordMemo.shared(VOCABULARY), np.zeros(0, np.int64), None

    def table():
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield _mixed(len(part), CODED, _KINDS, {"word": pa.array([words[j] for j in part.tolist()], pa.binary()), "c": pa.array(counts[part])})

    for batch in batches:
        texts = [t.lower() for t in common.texts_of(batch.column(3))]
        held = batch.column(2).to_numpy(zero_copy_only=False)
        for a, b in common.slices(texts):
            places = memo.numbered(texts[a:b])
            if words is not memo.words:  # the memo has started anew: what was counted goes out
                yield from table()
                counts, words = np.zeros(0, np.int64), memo.words
            run = [i for place, out in zip(places, held[a:b]) if not out for i in place]
            more = np.bincount(np.array(run, np.int64), minlength=len(words))
            more[: len(counts)] += counts
            counts = more
            ids = [memo.ids_of(x).astype(np.uint16).tobytes() + END_BYTES for x in places]
            head = {c: batch.column(i).slice(a, b - a) for i, c in enumerate(("rid", "doc_id", "held_out", "text"))}
            yield _mixed(b - a, CODED, _KINDS, head | {"ids": pa.array(ids, pa.binary()), "given": head["text"].is_valid()})
    yield from table()
    common.freed()


def encoded(docs: DataFrame, fold: int = FOLD) -> DataFrame:
    """The one reading of the texts, as a table: their ids, and the words of the training fold (pre-aggregated)."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), common.held_out(fold).alias("held_out"), "text")
    return common.staged(rows.mapInArrow(_encoded, CODED), "ids")


def _flat(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).astype(np.int64)


def _id_counter(batches):
    WordMemo.forget()
    counts = np.zeros(IDS + 1, np.int64)
    for batch in batches:
        counts += np.bincount(_flat(batch.column(0)), minlength=IDS + 1)
    ids = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts[ids])], names=["id", "n"])
    common.freed()


def id_counts(coded: DataFrame) -> np.ndarray:
    """Counts of each id and the end over all texts."""
    out = np.zeros(IDS + 1)
    for i, n in coded.select("ids").mapInArrow(_id_counter, "id long, n long").groupBy("id").agg(F.sum("n")).collect():  # at most IDS + 1 rows
        out[i] = n
    return out


def near_vectors(coded: DataFrame, rest: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbours of the ids of rest over all texts, as classes_of wants them: summed and scaled on the executors."""

    def count(batches):
        WordMemo.forget()
        sums = np.zeros((IDS + 1) * 2 * COMMON, np.int32)
        for batch in batches:
            key, n = np.unique(neighbour_keys(_flat(batch.column(0)), rest, place), return_counts=True)
            sums[key] += n.astype(np.int32)
        keys = np.flatnonzero(sums)
        for i in range(0, len(keys), 200_000):
            part = keys[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part].astype(np.int64))], names=["key", "n"])
        del sums, keys
        common.freed()

    def scale(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in rows])
            met, near = _vectors(ids, np.array([y["column"] for x in rows for y in x], np.int64), np.array([y["n"] for x in rows for y in x]))
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array([x.tobytes() for x in near.astype(np.float16)], pa.binary())], names=["id", "near"])

    sums = coded.select("ids").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    column = F.struct((F.col("key") % (2 * COMMON)).alias("column"), "n")
    rows = sums.groupBy(F.expr(f"key div {2 * COMMON}").alias("id")).agg(F.collect_list(column).alias("near")).mapInArrow(scale, "id long, "
        "near binary").collect()  # at most IDS
    met = np.array([x[0] for x in rows], np.int64)
    return met, np.array([np.frombuffer(x[1], np.float16) for x in rows], np.float32).reshape(len(rows), 2 * COMMON)


def _tied(p: dict) -> np.ndarray:
    """Parameters besides the embeddings, as rows of DIM."""
    flat = np.concatenate([p[k].ravel() for k in TIED])
    return np.append(flat, np.zeros(-len(flat) % DIM, np.float32)).reshape(-1, DIM)


def trained_on_all(model: Model, coded: DataFrame, batch: int = 64, rate: float = RATE, seed: int = 11) -> Model:
    """The model after one pass over every training text: each task starts from it and trains on the windows of its own
    texts; the results are averaged, an id's embedding by how often each task met it, the rest by windows."""
    frozen = coded.sparkSession.sparkContext.broadcast(model)
    names = [f"x{i}" for i in range(DIM)]

    def run(batches):
        WordMemo.forget()
        common.one_blas_thread()
        own = copy.deepcopy(frozen.value)
        descent, r, left, seen = Descent(own), np.random.default_rng(seed), np.zeros(0, np.int64), np.zeros(IDS + 2, np.int64)

        def learn(flat):
            inputs, flat = _inputs(flat).reshape(-1, WINDOW), flat.reshape(-1, WINDOW)
            seen[:] += np.bincount(inputs.ravel(), minlength=len(seen))
            at = r.permutation(len(flat))
            for i in range(0, len(at), batch):
                place = at[i : i + batch]
                descent.step(inputs.take(place, axis=0), flat.take(place, axis=0), rate)

        for part in batches:
            flat = np.concatenate((left, _flat(part.column(0))))
            cut = len(flat) - len(flat) % WINDOW
            if cut:
                learn(flat[:cut])
            left = flat[cut:]
        if len(left):  # filled up with ends of empty texts
            learn(np.append(left, np.full(WINDOW - len(left), END)))
        if not descent.n:
            return
        met, tied = np.flatnonzero(seen), _tied(own.p)
        rows = np.concatenate((own.p["e"][met], tied)).astype(np.float64)
        weight = np.append(seen[met], np.full(len(tied), seen.sum()))
        del descent, own
        keys = np.append(met, IDS + 2 + np.arange(len(tied)))
        columns = [pa.array(keys), pa.array(weight), *[pa.array(rows[:, i] * weight) for i in range(DIM)]]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "weight", *names])
        common.freed()

    schema = "key long, weight long, " + ", ".join(f"{n} double" for n in names)
    sums = coded.select("ids").mapInArrow(run, schema).groupBy("key").agg(F.sum("weight").alias("weight"), *[F.sum(n).alias(n) for n in names])
    rows = sums.select("key", *[(F.col(n) / F.col("weight")).cast("float").alias(n) for n in names]).toArrow()  # the model's size
    frozen.destroy()
    if rows.num_rows:
        keys, values, p = rows.column("key").to_numpy(), np.stack([rows.column(n).to_numpy() for n in names], 1), model.p
        p["e"][keys[keys < IDS + 2]] = values[keys < IDS + 2]
        tied = _tied(p)
        tied[keys[keys >= IDS + 2] - IDS - 2] = values[keys >= IDS + 2]
        flat, at = tied.ravel(), 0
        for k in TIED:
            p[k] = flat[at : at + p[k].size].reshape(p[k].shape).copy()
            at += p[k].size
    return _bounded(model)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, fold: int = FOLD) -> Model:
    mixed = encoded(docs, fold)
    model = trained(mixed, sample_docs)
    common.dropped(mixed)
    return model


def trained(mixed: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of the training rows of encoded()."""
    coded = mixed.filter("given and not held_out").select("doc_id", "ids")
    counts = id_counts(coded)
    classes = classes_of(counts, lambda rest, place: near_vectors(coded, rest, place))
    few = common.drawn(coded.withColumnRenamed("ids", "text"), sample_docs, 29).orderBy("doc_id", "text").toArrow()
    texts = [np.frombuffer(x, np.uint16)[:-1] for x in few.column("text").to_pylist()]
    steps = min(STEPS, 1 + EPOCHS * sum(len(x) + 1 for x in texts) // (64 * WINDOW))  # a small sample is not learned by heart
    start = fit(texts, steps, classes=classes, counts=counts)
    del few, texts
    common.freed()
    return trained_on_all(start, coded)


# ---- the base ----------------------------------------------------------------------------------------------------


def word_counts(mixed: DataFrame) -> tuple[DataFrame, int, int, int]:
    """The training fold's words with their counts (a table), all tokens and distinct tokens, ends included, and its texts."""
    counts = common.staged(mixed.filter("word is not null").groupBy("word").agg(F.sum("c").alias("c")), "words")
    texts = mixed.filter("ids is not null and not held_out").count()
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return counts, words + texts, distinct + (texts > 0), texts


def frequent_words(counts: DataFrame, top: int = TOP) -> list[tuple[bytes, int]]:
    """Words at least as frequent as a floor that at most top of them reach: a bounded list."""
    level = F.floor(F.log2("c") * 8).alias("level")
    rows = sorted(counts.groupBy(level).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), key=lambda x: -x["level"])
    total, floor = 0, None
    for x in rows:  # a few hundred levels
        total += x["n"]
        if total > top:
            break
        floor = x["least"]
    if floor is None:
        return []
    found = counts.filter(F.col("c") >= floor).toArrow()
    return list(zip(found.column("word").to_pylist(), found.column("c").to_pylist()))


SCHEMA = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, tf long"


def score(docs: DataFrame, fold: int = FOLD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    mixed = encoded(docs, fold)
    model = trained(mixed, sample_docs)
    counts, total, distinct, n_train = word_counts(mixed)
    often = frequent_words(counts)
    mass = total + 0.5 * (distinct + 1)
    base_of = lambda c: np.log10((np.asarray(c, np.float64) + 0.5) / mass)
    frozen = docs.sparkSession.sparkContext.broadcast((model, [w for w, _ in often], base_of([c for _, c in often]), float(base_of(n_train)), n_train > 0))

    def run(batches):
        WordMemo.forget()
        common.one_blas_thread()
        net, words, terms, end_term, end_known = frozen.value
        number = common.WordIndex(zip(words, range(len(words))))
        value_of = np.append(terms, np.nan)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64())
        for batch in batches:
            texts, ids = [t.lower() for t in common.texts_of(batch.column(3))], batch.column(4).to_pylist()
            for a, b in common.slices(texts):
                places = [number.of(t.split()) for t in texts[a:b]]
                sizes = np.array([len(x) for x in places])
                owner, flat = np.repeat(np.arange(b - a), sizes), np.fromiter((i for x in places for i in x), np.int64, sizes.sum())
                value = value_of[np.minimum(flat, len(words))]
                rare = np.isnan(value)
                base = np.bincount(owner[~rare], weights=value[~rare], minlength=b - a) + end_term
                near = np.bincount(owner[~rare], minlength=b - a) + int(end_known)
                scores = net.scores([np.frombuffer(x, np.uint16) for x in ids[a:b]])
                head = {c: batch.column(i).slice(a, b - a) for i, c in enumerate(("rid", "doc_id", "held_out"))}
                yield _mixed(b - a, SCHEMA, kinds, head | {"n_tokens": pa.array(sizes + 1), "n_known": pa.array(near), "base": pa.array(base), "score": pa.array(scores)})
                pairs, tf = np.unique(owner[rare] * len(number) + flat[rare], return_counts=True)
                rids = head["rid"].to_numpy(zero_copy_only=False)[pairs // max(1, len(number))] if len(pairs) else np.zeros(0, np.int64)
                more = list(islice(number, len(words), None))
                spelled = [more[w - len(words)] for w in (pairs % max(1, len(number))).tolist()]
                yield _mixed(len(pairs), SCHEMA, kinds, {"rid": pa.array(rids), "word": pa.array(spelled, pa.binary()), "tf": pa.array(tf)})
                for w in more:  # only the frequent words stay
                    del number[w]
        common.freed()

    rows = mixed.filter("ids is not null").select("rid", "doc_id", "held_out", "text", "ids")
    scored = common.staged(rows.mapInArrow(run, SCHEMA), "scored")
    common.dropped(mixed)
    rare = scored.filter("word is not null").select("rid", "word", "tf").join(counts, "word", "left")
    term = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(float(mass))) * F.col("tf")
    rest = rare.groupBy("rid").agg(F.sum(term).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"))
    out = scored.filter("word is null").drop("word", "tf").join(rest, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read(spark, sf_dir, "documents"))
