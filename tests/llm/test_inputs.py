"""Nulls in any column, repeated rows, clashing extra columns, empty tables and very long texts, for every operator; and the
pipeline against plain versions of its stages."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, common, decontamination, jaccard_join, language_id, licenses, lm, packing, quality, token_counts, toxicity

from .conftest import SCHEMA, edited, prose
from .test_methods import PlainPPM, plain_toxicity
from .test_sets_and_windows import brute_classes, brute_similarity, brute_stats

NAMES = "gone n digest word text_ ids rid lid spot grp lang_pred part pairs w c size bin start weight _place _group _rank want of plain dice".split()


def clashing(frame):
    return frame.withColumns({x: F.lit("clash") for x in NAMES})


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls everywhere, empty texts, ties, repeated rows and ids, under extra columns with the operators' own names."""
    r = random.Random(4)
    rows = [(i, prose(r, r.choice([1, 4, 60, 90])), "en" if i % 3 else "fr", "s", 1) for i in range(40)]
    rows += [(None, prose(r, 60), None, None, None), (None, None, "en", None, 2), (50, None, None, "s", None), (51, "", "en", "s", 0), (52, " \n\t", "en", "", 0), (3, prose(r, 70), "en", "s", 1)]
    rows += [rows[5]] * 3 + [rows[40]] * 2
    return rows, clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))


def results(spark, frame, tmp):
    """Each operator's result on documents."""
    labels = clashing(spark.createDataFrame([(i, 1, int(i % 2)) for i in range(40)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int"))
    bench = clashing(spark.createDataFrame([(1, "the of an er on ti re"), (None, "one two three four five six"), (2, None), (3, "")], "item_id long, text string"))
    net = toxicity.train(frame, labels)
    yield "jaccard_join", jaccard_join.join(frame), True
    yield "token_counts", token_counts.count_tokens(frame, f"{tmp}/cache"), True
    yield "language_id", language_id.identify(frame, language_id.train(frame)), True
    yield "quality", quality.judge(frame), True
    yield "lm", lm.score(frame, sample_docs=20), True
    yield "decontamination", decontamination.find(frame, bench), False
    yield "toxicity", toxicity.score(frame, net), True
    yield "licenses", licenses.scan(frame), False
    yield "packing", packing.pack(frame), False


def test_odd_rows_have_defined_results(spark, odd, tmp_path):
    rows, frame = odd
    ids = Counter(x[0] for x in rows)
    for name, out, whole in results(spark, frame, tmp_path):
        got = Counter(x.doc_id for x in out.collect())
        if whole:
            assert got == ids, name
        else:
            assert set(got) <= set(ids), name
    pieces = packing.pack(frame).collect()
    assert {x.doc_id for x in pieces} == set(ids)
    assert Counter(x.doc_id for x in pieces if x.start == 0) == ids


def test_empty_tables(spark, none, tmp_path):
    for name, out, _ in results(spark, clashing(none), tmp_path):
        assert out.count() == 0 and len(out.columns) > 2, name
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_many_rows_without_an_id(spark, tmp_path):
    r = random.Random(7)
    rows = [(None, prose(r, 30), "en", None, None) for _ in range(60)] + [(None, "same text", "en", None, None)] * 60
    frame = spark.createDataFrame(rows, SCHEMA)
    got = token_counts.count_tokens(frame, str(tmp_path / "c")).groupBy("n_bytes").count().collect()
    assert sum(x["count"] for x in got) == 120 and spark.read.parquet(str(tmp_path / "c")).count() == 61
    assert jaccard_join.join(frame).filter("n_copies = 60").count() == 60


def test_conversations_with_nulls_and_copies(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (4, 1, "assistant", "b"), (4, 1, "assistant", "b"), (4, 0, None, "c"), (4, None, "user", None)]
    frame = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {x.conv_id: x for x in chat.read_back(chat.format_turns(frame)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[4].turns_sha256 == sha("user\n\n\nc\nassistant\nb\nassistant\nb\n") and got[4].loss_sha256 == sha("bb")
    assert got[None].n_turns == 2 and got[None].turns_sha256 == sha("\n\nuser\na\n")


# ---- a text of ten megabytes ----


@pytest.fixture(scope="module")
def long(spark):
    """One such text, with a benchmark passage, a toxic word and a licence notice at its end."""
    r = random.Random(3)
    words = [prose(r, 1) for _ in range(3000)]
    item = prose(r, 24)
    body = "\n".join(" ".join(r.choice(words) for _ in range(200)) for _ in range(8200))
    text = body + "\n" + item + "\n" + "vile " * 6 + "\n" + licenses.TEMPLATES["GPL-3.0"]
    assert len(text) > 10_000_000
    rows = [(0, text, "en", "s", None)] + [(i, prose(r, 80), "en" if i % 2 else "fr", "s", None) for i in range(1, 60)]
    return text, item, spark.createDataFrame(rows, SCHEMA).repartition(2).persist()


def test_long_text_sets_counts_and_statistics(spark, long, tmp_path):
    import sentencepiece

    text, _, frame = long
    w = text.encode().lower().split()
    assert jaccard_join.join(frame).filter("doc_id = 0").first().n_shingles == len({(a, b, c) for a, b, c in zip(w, w[1:], w[2:])})
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert token_counts.count_tokens(frame, str(tmp_path / "c")).filter("doc_id = 0").first().n_tokens == len(sp.encode(text))
    s = quality.statistics(frame).filter("doc_id = 0").first()
    assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute_stats(text)


def test_long_text_models(spark, long):
    text, _, frame = long
    found = language_id.identify(frame, language_id.train(frame)).filter("doc_id = 0").first()
    assert found.lang_pred in ("en", "fr") and found.score > 0
    r = random.Random(1)
    texts = [prose(r, 40) for _ in range(60)]
    net = toxicity.fit([(t + " vile" * (i % 2) * 4).encode() for i, t in enumerate(texts)], np.arange(60) % 2)
    score = {x.doc_id: x.score for x in toxicity.score(frame, net).collect()}
    assert score[0] > 0.5 > np.median(list(score.values()))  # by its last window
    scored = lm.score(frame, sample_docs=20).filter("doc_id = 0").first()
    assert scored.n_tokens == len(text.split()) + 1 and np.isfinite(scored.score) and scored.score < 0


def test_long_text_windows_notices_and_pieces(spark, long):
    from tokenizers import Tokenizer

    text, item, frame = long
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    hit = decontamination.find(frame, bench).collect()
    assert [(x.doc_id, x.item_id, x.similarity) for x in hit] == [(0, 9, 1.0)]
    assert {(x.doc_id, x.license) for x in licenses.scan(frame).collect()} == {(0, "GPL-3.0")}
    pieces = packing.pack(frame).filter("doc_id = 0").orderBy("start").collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = sum(len(e.ids) for e in t.encode_batch(text.split("\n"), add_special_tokens=False)) + 1
    assert sum(p.length for p in pieces) == n == pieces[0].doc_tokens
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(turns)).first().loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


# ---- the pipeline ----


def plain_hits(docs, items):
    """Ids of documents with a window whose weighted similarity to an item is 0.8 or more, from all windows."""
    import math
    import re

    k = decontamination.K
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    cut = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []
    bags = {i: cut(words(t)) for i, t in items if words(t)}
    df = Counter(s for b in bags.values() for s in set(b))
    weight, unknown = {s: math.log1p(len(bags) / n) for s, n in df.items()}, math.log1p(len(bags))
    out = set()
    for d, t in docs:
        w = words(t)
        for i, b in bags.items():
            m = len(b) + k - 1
            if any(win and brute_similarity(b, cut(win), weight, unknown) >= 0.8 for win in (w[s : s + m] for s in range(max(1, len(w) - m + 1)))):
                out.add(d)
    return out


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    r = random.Random(21)
    items = [(i, prose(r, 22)) for i in range(3)]
    rows, marks = [], []
    for i in range(70):
        w = prose(r, r.randint(20, 50)).split() if i % 2 else prose(r, r.randint(20, 50), ["le", "ou", "ai", "eux", "é"]).split()
        if i % 5 == 0:
            w[3:3] = ["vile", "wretch", "vile"]
        rows.append((i, " ".join(w), "en" if i % 2 else "fr", None, 1))
        marks.append((i, 1, int(i % 5 == 0)))
    base = prose(r, 80)
    rows += [(100 + j, edited(r, base, j % 3), "en", "x", None) for j in range(6)] + [(200, prose(r, 20) + " " + items[1][1], None, None, None), (201, "12 34 !", "en", None, 1), (202, None, None, None, None), (203, prose(r, 2600), "en", None, 1), rows[1]]
    d = str(tmp_path)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.lit(1)).repartition(3)
    frame.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), sorted((x[0], x[1]) for x in rows)
    text = lambda t: (t or "").encode()

    net = toxicity.train(now, spark.read.parquet(f"{d}/labels.parquet"))
    plain = {"toxicity": [x for x in kept if plain_toxicity(net, text(x[1])) < 0]}
    assert len(plain["toxicity"]) < len(kept)

    langs = {x[0]: x[2] for x in rows}
    learned = [(langs[i], t) for i, t in plain["toxicity"] if langs[i] and t is not None and zlib.crc32(str(i).encode()) % 5]
    trees = language_id.train(spark.createDataFrame([x for x in rows if (x[0], x[1]) in plain["toxicity"]], SCHEMA))
    plains = [PlainPPM([text(t) for g, t in learned if g == lang], trees.least) for lang in trees.langs]

    def certain(t):
        if not any(map(str.isalpha, t or "")):
            return False
        bits = np.array([p.bits(text(t)) for p in plains])
        return 1 / np.exp2(-(bits - bits.min()) * min(1, language_id.EVIDENCE_BYTES / len(text(t)))).sum() >= 0.5

    plain["language_id"] = [x for x in plain["toxicity"] if certain(x[1])]
    roots = {i: c for i, _, c in brute_classes(plain["language_id"], 5, 4, 5)}
    plain["ngram_jaccard_join"] = [x for x in plain["language_id"] if roots[x[0]] == x[0]]
    bad = plain_hits(plain["ngram_jaccard_join"], items)
    plain["decontamination"] = [x for x in plain["ngram_jaccard_join"] if x[0] not in bad]
    assert len({len(x) for x in plain.values()}) == 4

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now.columns
        now = common.staged(stage(spark, now, d), f"test-{name}")
        assert now.columns == before and sorted((x.doc_id, x.text) for x in now.select("doc_id", "text").collect()) == sorted(plain[name]), name
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in plain["decontamination"])
    pieces = corpus_pipeline.run(spark, d).collect()
    assert Counter((x.doc_id, x.doc_tokens) for x in pieces if x.start == 0) == want
    assert sum(x.length for x in pieces) == sum(n * c for (_, n), c in want.items())
    sequences: dict = {}
    for x in pieces:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]] and sum(n for _, n in s) <= 2048


def test_pipeline_on_empty_and_unlabelled_tables(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(2)
    for name, rows in (("none", []), ("plain", [(i, prose(r, 30), None, None, None) for i in range(12)])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        assert {x.doc_id for x in corpus_pipeline.run(spark, d).collect()} == {x[0] for x in rows}  # without labels nothing is rejected
