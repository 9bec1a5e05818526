import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, decontamination, jaccard_join, licenses, quality

from .conftest import SCHEMA, edited, prose


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_classes(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min(members[find(i)])) for i in range(len(rows))]


@pytest.mark.parametrize("k, t", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_classes_equal_brute_force(docs, corpus, k, t):
    got = jaccard_join.join(docs, k, t).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_classes([r[:2] for r in corpus], k, t.numerator, t.denominator))


def test_hot_group_of_loose_near_copies(spark):
    r = random.Random(1)
    base = prose(r, 120)
    rows = [(i, edited(r, base, r.randint(0, 3)), None, None, None) for i in range(150)]
    got = jaccard_join.join(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_classes([x[:2] for x in rows], 3, 9, 10))


def brute_links(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    linked = lambda a, b: bool(a and b) and den * len(a & b) >= num * len(a | b)
    return sorted((rows[i][0], sum(linked(a, b) for j, b in enumerate(sets) if j != i)) for i, a in enumerate(sets))


@pytest.mark.parametrize("k, t", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_numbers_of_links_equal_brute_force(docs, corpus, k, t):
    got = jaccard_join.join(docs, k, t).select("doc_id", "n_links").collect()
    assert sorted(map(tuple, got)) == brute_links([r[:2] for r in corpus], k, t.numerator, t.denominator)


def test_links_between_followers_of_one_and_of_two_leaders_are_counted(spark, monkeypatch):
    r = random.Random(4)
    base, passage = prose(r, 120), prose(r, 40)
    rows = [(i, edited(r, base, r.randint(0, 3))) for i in range(120)] + [(200 + i, edited(r, base + " " + passage[:30], r.randint(0, 2))) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_links(rows, 3, 9, 10)
    small = jaccard_join.link_counts
    monkeypatch.setattr(jaccard_join, "link_counts", lambda *a: small(*a, block=16))  # groups of several blocks
    got = jaccard_join.join(frame)
    assert sorted(map(tuple, got.select("doc_id", "n_links").collect())) == want and len({n for _, n in want}) > 10


def test_empty_and_null_ids(spark, none):
    assert jaccard_join.join(none).count() == 0
    t = prose(random.Random(2), 50)
    got = jaccard_join.join(spark.createDataFrame([(None, t, None, None, None), (7, t, None, None, None), (9, t + " x", None, None, None)], SCHEMA)).collect()
    assert {r.component_id for r in got} == {7} and len(got) == 3


def test_list_pairs_lose_nothing():
    r = np.random.default_rng(0)
    for _ in range(30):
        m = 40
        n = np.sort(r.integers(8, 14, m))
        pos = np.concatenate([np.sort(r.integers(0, 5, (n == v).sum())) for v in np.unique(n)])
        leaders, tied = r.integers(0, 12, m), np.zeros(m, np.int64)
        tied[:] = np.bincount(leaders, minlength=12)[leaders] > 1
        got = {(int(a), int(b)) for p in jaccard_join.list_pairs(leaders, n, pos, tied, np.zeros(m, np.int64), 9, 10) for a, b in zip(p[0], p[1])}
        for i in range(m):
            for j in range(i):
                x, y = int(n[j]), int(n[i])
                need = -(-9 * (x + y) // 19)
                if leaders[i] != leaders[j] and 9 * y <= 10 * x and pos[i] - pos[j] <= y - need and pos[j] - pos[i] <= x - need:
                    assert (min(leaders[i], leaders[j]), max(leaders[i], leaders[j])) in got


def test_components_of_paths_and_rings(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_word_hashes_follow_the_contract():
    texts = ["The the\u00a0x \x0b tHe\n", "", "a b", "  "]
    h, bounds = common.word_hashes([t.encode() for t in texts])
    assert np.diff(bounds).tolist() == [len(t.encode().split()) for t in texts] and h[0] == h[2] != h[1]


# ---- decontamination ----


def brute_similarity(item, window, weight, unknown):
    a, b = Counter(item), Counter(window)
    w = lambda s: weight.get(s, unknown)
    return sum(w(s) * min(a[s], b[s]) for s in a) / sum(w(s) * max(a[s], b[s]) for s in {*a, *b})


def test_decontamination_equals_brute_force(spark, none):
    import math
    import re

    r = random.Random(3)
    items = [prose(r, n) for n in (3, 14, 20, 33, 33, 59)] + ["", None]
    docs, k = [], 5
    for i in range(40):
        t = prose(r, 150)
        if i % 2 == 0:
            p = items[r.randrange(6)]
            p = p.upper() if i % 4 else edited(r, p, 1) if i % 8 else p
            t = t[:200] + " " + p + " " + t[200:]
        docs.append(t)
    docs += [None, "", items[3], " ".join(items[3].split()[:30])]
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    cut = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []
    bags = {i: cut(words(t)) for i, t in enumerate(items) if words(t)}
    df = Counter(s for b in bags.values() for s in set(b))
    weight, unknown = {s: math.log1p(len(bags) / n) for s, n in df.items()}, math.log1p(len(bags))
    want = {}
    for d, t in enumerate(docs):
        w = words(t)
        for i, b in bags.items():
            m = len(words(items[i]))
            for s in range(max(1, len(w) - m + 1)):
                win = w[s : s + m]
                if win and (len(win) >= k or m < k) and (m >= k or len(win) == m):
                    sim = brute_similarity(b, cut(win), weight, unknown)
                    if sim >= 0.8 - 1e-12 and sim > want.get((d, i), 0):
                        want[d, i] = sim
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(docs)], SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.find(frame, bench).collect()}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-6 for x in want) and len(want) >= 15
    assert {(r.doc_id, r.item_id): r.similarity for r in decontamination.find(frame, bench, item_block=3).collect()}.keys() == want.keys()
    assert decontamination.find(none, bench).count() == 0 and decontamination.find(frame, bench.limit(0)).count() == 0


# ---- licences and quality ----


def test_licenses_near_and_far(spark, none):
    notice = licenses.TEMPLATES["GPL-3.0"]
    rows = [(1, "x\n" + notice + "\ny"), (2, notice.upper().replace(",", " ;")), (3, notice.replace("This work", "The file")), (4, "licensed under nothing"), (5, None), (6, ""), (7, licenses.TEMPLATES["MIT-permission"].replace(" to any", "\nto any")), (1, notice)]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = {(r.doc_id, r.license): (r.dice, r.n_parts) for r in licenses.scan(frame).collect()}
    assert got[1, "GPL-3.0"] == (1.0, 2 + 1) and got[2, "GPL-3.0"][0] == 1.0 and 0.8 <= got[3, "GPL-3.0"][0] < 1 and got[7, "MIT-permission"][0] == 1.0
    assert {k[0] for k in got} == {1, 2, 3, 7} and licenses.scan(none).count() == 0


def brute_stats(t):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_and_edges(spark, docs, corpus, none):
    extra = [(900, "a b c a b c a b", "en", "s", None), (901, "# x\n# x\n \n\u00e9\u00e9 $\x0b|", "en", "s", None)]
    frame = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, SCHEMA))
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.statistics(frame).collect())
    assert got == sorted((x[0], *brute_stats(x[1])) for x in [*corpus, *extra])
    judged = quality.judge(frame)
    assert judged.count() == len(corpus) + 2
    assert judged.filter("base_failed and kept").count() == 0
    assert judged.filter("base_failed <> (n_words < 50 or 100 * n_repeat_words > 50 * n_words)").count() == 0
    assert quality.judge(none).count() == 0


def test_outliers_go_and_clean_texts_stay(spark):
    r = random.Random(8)
    rows = [(i, prose(r, r.randint(60, 400)), "en", "s%d" % (i % 2), None) for i in range(200)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in prose(r, 120).split()), "en", "s0", None) for i in range(10)]
    got = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(10))


def test_distance_equals_numpy(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(400, 4)) * [1, 2, 0.5, 1]
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "grp string, x0 double, x1 double, x2 double, x3 double")
    fit = quality._fit(rows)
    got = np.sort([r.d for r in rows.join(fit, "grp").select(quality._distance().alias("d")).collect()])
    c = np.cov(x.T, bias=True) + np.diag(quality.PRIOR)
    d = x - x.mean(0)
    assert np.allclose(got, np.sort(np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d)))
    assert F is not None
