"""Methods against plain versions of themselves: context trees, determinants, networks, attention."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, decontamination, language_id, lm, quality, toxicity

from .conftest import SCHEMA, edited, prose


# ---- language: prediction by partial matching with dictionaries ----


class PlainPPM:
    def __init__(self, texts, least):
        self.least, self.n = least, defaultdict(Counter)
        for t in texts:
            b = b"\0" * language_id.ORDER + self.low(t)
            for i in range(language_id.ORDER, len(b)):
                if b[i]:
                    for k in range(language_id.ORDER + 1):
                        self.n[b[i - k : i]][b[i]] += 1

    @staticmethod
    def low(t):
        return bytes(x + 32 if 65 <= x <= 90 else x for x in t)

    def p(self, context, x):
        if context is None:
            return 1 / 256
        c = self.n.get(context)
        shorter = context[1:] if context else None
        if c is None or (len(context) > 1 and sum(c.values()) < self.least[len(context)]):
            return self.p(shorter, x)
        total, distinct = sum(c.values()), len(c)
        if x in c:
            return c[x] / (total + distinct)
        left = 1 - sum(self.p(shorter, s) for s in c)
        return distinct / (total + distinct) * self.p(shorter, x) / max(left, 1e-9)

    def bits(self, t):
        b = b"\0" * language_id.ORDER + self.low(t)
        return -sum(math.log2(self.p(b[i - language_id.ORDER : i], b[i])) for i in range(language_id.ORDER, len(b)))


@pytest.mark.parametrize("costs", [3_000_000, 900])
def test_code_lengths_equal_plain_trees(monkeypatch, costs):
    monkeypatch.setattr(language_id, "COSTS", costs)  # the smaller one makes rare contexts collapse
    r = random.Random(3)
    texts = {"a": [prose(r, 60).encode() for _ in range(4)], "b": [prose(r, 60, ["le", "ou", "\u00e9", "x "]).encode() for _ in range(4)]}
    counts = {}
    for lang, own in texts.items():
        keys, n = np.unique(language_id.Trees._keys(language_id.LEAD + language_id.LEAD.join(own)), return_counts=True)
        real = keys & 255 != 0
        counts[lang] = (keys[real], n[real].astype(float))
    trees = language_id.Trees(["a", "b"], counts)
    assert (costs == 900) == any(x > 2 for x in trees.least.values())
    probes = [prose(r, 12).encode(), "Le ou \u00e9x THE q9".encode(), b"", b"zzz", b"a" * 40]
    got = trees.code_lengths(probes)
    for j, lang in enumerate(("a", "b")):
        plain = PlainPPM(texts[lang], trees.least)
        assert [plain.bits(t) for t in probes] == pytest.approx(got[:, j].tolist(), rel=1e-4, abs=1e-3)
    whole = b"the of " * 400_000  # 2.8 MB: taken in pieces
    assert np.allclose(trees.code_lengths([whole])[0], trees.costs(trees._keys(language_id.LEAD + whole), language_id.ORDER).sum(0, dtype=float))


def test_places_find_every_key():
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 1 << 40, 5000))
    found, at = language_id.Places(keys), r.permutation(len(keys))
    assert (found.of(keys[at]) == at).all()
    others = np.setdiff1d(r.integers(0, 1 << 40, 5000), keys)
    assert (found.of(others) == -1).all() and (language_id.Places(keys[:0]).of(others) == -1).all()


# ---- quality: the minimum covariance determinant ----


def numpy_mcd(x, tries=120):
    """The smallest determinant over random starts, concentrated on the h nearest rows until it stops falling."""
    n, p = x.shape
    h, prior, r, best = (n + p + 1) // 2, np.diag(quality.PRIOR), np.random.default_rng(1), (np.inf, None)
    for _ in range(tries):
        own = r.choice(n, p + 1, replace=False)
        before = np.inf
        for _ in range(60):
            m, c = x[own].mean(0), np.cov(x[own].T, bias=True) + prior
            det = np.linalg.det(c)
            if len(own) == h and det >= before * (1 - 1e-9):
                break
            before = det if len(own) == h else np.inf
            d = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
            own = np.argsort(d, kind="stable")[:h]
        if before < best[0]:
            best = (before, m, np.cov(x[own].T, bias=True))
    return best


def contaminated(seed, n=400, share=0.35):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 4)) @ np.array([[1, 0.5, 0, 0], [0, 0.6, 0.2, 0], [0, 0, 0.5, 0.1], [0, 0, 0, 0.8]]) + [2, 1, 0, 3]
    bad = int(n * share)
    x[:bad] = g.normal(size=(bad, 4)) * 1.5 + [14, -12, 13, -11]
    return x, bad


def test_determinants_reach_numpys(spark):
    groups = {"a": contaminated(0), "b": contaminated(5, 301, 0.45), "c": (np.random.default_rng(9).normal(size=(60, 4)) * [1, 0, 0, 2], 0)}
    frame = spark.createDataFrame([(k, *map(float, v)) for k, (x, _) in groups.items() for v in x], "grp string, x0 double, x1 double, x2 double, x3 double")
    found = quality.determinants(frame).groupBy("grp").agg(F.min("det").alias("det"), F.count("*").alias("n"), F.max("open").alias("open")).collect()
    assert {r.grp for r in found} == set(groups) and all(r.n == 3 and not r.open for r in found)
    for r in found:
        assert r.det <= numpy_mcd(groups[r.grp][0])[0] * 1.1
    fit = quality.estimates(frame)
    far = frame.join(fit, "grp").withColumn("d", quality._distance()).collect()
    for k, (x, bad) in groups.items():
        det, m, c = numpy_mcd(x)
        d = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(quality.consistency(quality.HALF) * c + np.diag(quality.PRIOR)), x - m)
        inner = x[d <= quality.INNER]
        m, c = inner.mean(0), quality.consistency(quality.INNER) * np.cov(inner.T, bias=True) + np.diag(quality.PRIOR)
        want = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
        got = {(r.x0, r.x1): r.d for r in far if r.grp == k}
        mine = np.array([got[float(v[0]), float(v[1])] for v in x])
        assert ((mine > quality.CUTOFF) == (want > quality.CUTOFF)).all() and (mine[:bad] > quality.CUTOFF).all()
        assert np.median(np.abs(mine[bad:] / want[bad:] - 1)) < 0.1


def test_consistency_of_normal_rows():
    x = np.random.default_rng(0).normal(size=(400_000, 4))
    d = (x * x).sum(1)
    assert np.median(d) == pytest.approx(quality.HALF, rel=0.01)
    assert quality.consistency(quality.HALF) * x[d <= quality.HALF].var() == pytest.approx(1, rel=0.01)


# ---- toxicity: a forward pass word by word ----


def plain_toxicity(net, text):
    p, h, w = net.p, toxicity.HIDDEN, toxicity.WINDOW
    sig = lambda x: 1 / (1 + np.exp(-x))

    def vector(word):
        bare = word.strip(toxicity.EDGES)
        return np.concatenate((p["word"][net.vocabulary.get(bare, 0)], net.char_means([bare])[0]))

    def direction(k, xs):
        state, out = np.zeros(h), []
        for x in xs:
            a, g = x @ p["wx"][k] + p["bx"][k, 0], state @ p["u"][k] + p["bu"][k, 0]
            r, z = sig(a[:h] + g[:h]), sig(a[h : 2 * h] + g[h : 2 * h])
            new = np.tanh(a[2 * h :] + r * g[2 * h :])
            state = (1 - z) * new + z * state
            out.append(state)
        return out

    words = text.lower().split()
    firsts = [0] if len(words) <= w else sorted({*range(0, len(words) - w, toxicity.STRIDE), len(words) - w})
    best = -np.inf
    for a in firsts:
        xs = [vector(x) for x in words[a : a + w]]
        states = np.array([np.concatenate(s) for s in zip(direction(0, xs), direction(1, xs[::-1])[::-1])]).reshape(-1, 2 * h)
        if len(states):
            e = np.tanh(states @ p["wa"]) @ p["va"]
            weight = np.exp(e - e.max())
            pooled = weight @ states / weight.sum()
        else:
            pooled = np.zeros(2 * h)
        best = max(best, pooled @ p["wo"] + p["bo"][0])
    return best


def test_toxicity_equals_a_plain_forward_pass():
    r = random.Random(2)
    net = toxicity.Network({w.encode(): i + 1 for i, w in enumerate(["the", "of", "vile"])})
    g = np.random.default_rng(4)
    net.p = {k: (v + g.normal(size=v.shape) * 0.2).astype(np.float32) for k, v in net.p.items()}
    texts = [b"", b"vile", b"The (of) vile!", prose(r, 31).encode(), prose(r, 32).encode(), prose(r, 33).encode(), prose(r, 150).encode()]
    assert toxicity.Scorer(net).logits(texts).tolist() == pytest.approx([plain_toxicity(net, t) for t in texts], abs=2e-4)
    few = toxicity.Scorer(net, limit=3)  # a memo that starts anew for every slice
    assert few.logits(texts[::-1]).tolist() == pytest.approx([plain_toxicity(net, t) for t in texts[::-1]], abs=2e-4)


def test_trigram_means_of_a_word():
    def h(a, b, c):
        x = (b * 2654435761 & 0xFFFFFFFF) ^ (c * 40503 & 0xFFFFFFFF) ^ (a * 2246822519 & 0xFFFFFFFF)
        x ^= x >> 15
        return ((x * 2654435761 & 0xFFFFFFFF) >> 20) % toxicity.TRIGRAMS

    net = toxicity.Network({})
    for words in ([b"ab", b"", b"c"], [b"c", b"ab", b""]):
        for word, got in zip(words, net.char_means(words)):
            raw = b"\x02" + word + b"\x03\x03"
            want = np.mean([net.p["char"][h(*raw[i : i + 3])] for i in range(len(raw) - 2)], 0)
            assert np.allclose(got, want, atol=1e-6)


# ---- language model: attention one position at a time, and gradients ----


def plain_lm(m, ids):
    """log10 probability of ids, each from the states of the ids before it in its window."""
    p, d = m.p, lm.DIM
    inputs, total = [lm.START, *ids[:-1]], 0.0
    for i, target in enumerate(ids):
        a = 0 if i < lm.WINDOW else -(-(i + 1 - lm.WINDOW) // lm.STRIDE) * lm.STRIDE
        xs = [p["e"][x] + p["at"][j] for j, x in enumerate(inputs[a : i + 1])]
        q, ks, vs = xs[-1] @ p["qkv"][:, :d], [x @ p["qkv"][:, d : 2 * d] for x in xs], [x @ p["qkv"][:, 2 * d :] for x in xs]
        w = np.exp([float(q @ k) / math.sqrt(d) for k in ks])
        o = sum(x * v for x, v in zip(w / w.sum(), vs))
        z = np.tanh(xs[-1] + o @ p["o"]) @ p["out"] + p["b"]
        total += z[m.classes[target]] - np.log(np.exp(z).sum()) + m.share[target]
    return total / math.log(10)


def test_lm_equals_plain_attention():
    r = np.random.default_rng(0)
    ids = r.integers(0, 50, 300)
    m = lm.fit([ids], steps=30)
    texts = [np.append(ids[:k], lm.END) for k in (0, 1, 31, 32, 33, 100)]
    assert m.scores(texts).tolist() == pytest.approx([plain_lm(m, t.tolist()) for t in texts], rel=1e-3)


def test_lm_scoring_asks_only_for_places_not_yet_scored(monkeypatch):
    r = np.random.default_rng(3)
    m = lm.fit([r.integers(0, 50, 300)], steps=30)
    grid, whole, made = r.integers(0, 50, (5, lm.WINDOW)), lm.Model.hidden, []

    def spy(self, *args, **kwargs):
        made.append(whole(self, *args, **kwargs))
        return made[-1]

    monkeypatch.setattr(lm.Model, "hidden", spy)
    text = np.append(r.integers(0, 50, lm.WINDOW + 4 * lm.STRIDE - 1), lm.END)
    m.scores([text, text[-1:], text[-lm.WINDOW :]])
    assert sum(h.shape[0] * h.shape[1] for h in made) == len(text) + 2 * lm.WINDOW
    assert np.allclose(whole(m, grid, since=lm.HEAD), whole(m, grid)[:, lm.HEAD :], atol=1e-6)


def test_lm_gradients():
    r = np.random.default_rng(1)
    m = lm.fit([r.integers(0, 40, 400)], steps=5)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    grid, target = r.integers(0, 40, (3, lm.WINDOW)), r.integers(0, 40, (3, lm.WINDOW))
    loss = lambda: -np.log(m.gradients(grid, target)[0]).mean()
    g = m.gradients(grid, target)[1]
    rows, change = g.pop("e")
    g["e"] = np.zeros_like(m.p["e"])
    np.add.at(g["e"], rows, change)
    for k in ("e", "at", "qkv", "o", "out", "b"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, h = m.p[k][at], 1e-4
        m.p[k][at] = old + h
        up = loss()
        m.p[k][at] = old - h
        down = loss()
        m.p[k][at] = old
        assert (up - down) / (2 * h) == pytest.approx(g[k][at], rel=0.02, abs=1e-7), k


def test_lm_gradients_of_blocks_of_rows():
    r = np.random.default_rng(2)
    m = lm.fit([r.integers(0, 400, 3000)], steps=3)
    n = 5 * lm.ROWS // lm.WINDOW // 2  # two blocks and a half
    grid, target = r.integers(0, 400, (n, lm.WINDOW)), r.integers(0, 400, (n, lm.WINDOW))
    found, g = m.gradients(grid, target)
    each = [m.gradients(grid[i : i + 1], target[i : i + 1]) for i in range(n)]
    assert found == pytest.approx(np.concatenate([f for f, _ in each]), rel=1e-4)
    for k in ("at", "qkv", "o", "out", "b"):
        assert g[k] == pytest.approx(sum(x[k] for _, x in each) / n, rel=1e-3, abs=1e-6), k
    assert g["e"][1] == pytest.approx(np.concatenate([x["e"][1] for _, x in each]) / n, rel=1e-3, abs=1e-7)


def test_lm_holds_logits_of_a_block_of_rows_only():
    r = np.random.default_rng(2)
    m = lm.fit([r.integers(0, 400, 3000)], steps=3)
    grid = r.integers(0, 400, (256, lm.WINDOW))
    m.gradients(grid, grid)
    tracemalloc.start()
    m.gradients(grid, grid)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 11.5e6, peak  # the logits of all rows alone are 4.3 MB


# ---- draws, fingerprints, hashes ----


def test_draws_hold_their_counts(spark):
    rows = [(None, f"text {i}", "a") for i in range(400)] + [(7, f"other {i}", "b") for i in range(300)] + [(8, "same", "c")] * 200 + [(9, None, None)] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = Counter(r.lang for r in common.drawn(frame, 20, 1, "lang").collect())
    assert got["a"] == 20 and got["b"] == 20 and got["c"] <= 20 and got[None] <= 20
    again = sorted(map(tuple, common.drawn(frame.repartition(3), 20, 1, "lang").filter("lang = 'a'").collect()), key=str)
    assert again == sorted(map(tuple, common.drawn(frame, 20, 1, "lang").filter("lang = 'a'").collect()), key=str)
    assert common.drawn(frame, {"a": 5}, 1, "lang").count() == 5 and common.drawn(frame, 10, 1).count() == 10
    assert common.drawn(frame.filter("lang = 'a'"), 100, 1, most_bytes=640).count() < 100 and common.drawn(frame.limit(0), 9, 1).count() == 0


def test_training_takes_few_texts_whatever_the_ids(spark):
    r = random.Random(1)
    rows = [(None, prose(r, 30), "en" if i % 2 else "fr", None, None) for i in range(120)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert common.drawn(frame.select("doc_id", "text", "lang"), 10, 17, "lang").count() == 20
    assert language_id.identify(frame, language_id.train(frame, 10)).count() == 120
    one = spark.createDataFrame([(5, prose(r, 30)) for _ in range(60)] + [(i, prose(r, 30) + " vile" * 9) for i in range(100, 160)], "doc_id long, text string")
    marks = spark.createDataFrame([(5, 0)] * 3 + [(i, 1) for i in range(100, 160)] + [(None, 1)], "doc_id long, toxic int")
    net = toxicity.train(one, marks, (12, 12))
    assert net is not None and toxicity.score(one, net).count() == 120


def test_fingerprints_find_nine_in_ten(monkeypatch):
    r = random.Random(11)
    items = [prose(r, r.randint(14, 60)) for _ in range(120)]
    docs = [prose(r, 20) + " " + edited(r, t, k % 3) + " " + prose(r, 20) for k, t in enumerate(items)]
    found = {}
    for radius in (decontamination.RADIUS, 64):
        monkeypatch.setattr(decontamination, "RADIUS", radius)
        index = decontamination.Index(list(range(len(items))), [t.encode() for t in items])
        found[radius] = {(d, i) for d, i, *_ in index.scan([t.encode() for t in docs])}
    assert len(found[64]) >= 40 and len(found[19] & found[64]) >= 0.9 * len(found[64]) and found[19] <= found[64]


def test_long_texts_hash_as_short_ones_do():
    r = random.Random(2)
    text = (prose(r, 3000) + " \u00e9!x\n").encode() * 160  # some 3 MB
    assert len(text) > 2 * common.SLICE_BYTES
    for marks in (False, True):
        whole, bounds = common.word_hashes([text], marks)
        plain, _ = common._word_hashes([text], marks)
        assert (whole == plain).all() and bounds.tolist() == [0, len(plain)]
    assert len(list(common.slices([b"a", text, b"b", b"c"]))) == 3
    index = decontamination.Index([1], [" ".join(prose(r, 40).split()).encode()])
    assert index.scan([text]) is not None and zlib.crc32(b"") == 0
