import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, language_id, lm, packing, token_counts, toxicity
from tidemark.llm.wordpieces import WordMemo

from .conftest import SCHEMA, prose

FR = ["le", "ou", "ai", "eux", "ment", "que", "tion", "vi", "en", "\u00e9", "\u00e8"]


def test_word_ids_equal_the_library(corpus):
    m = WordMemo("word_bpe_49k.json")
    texts = [x[1] or "" for x in corpus] + ["it's I'LL 'S a'b' \u00e9 \u00c9 \u1e9e \u03a3\u03b1\u03c2 \ufb01 e\u0301x <|endoftext|>x \u3000y \u00c0\u00d7\u00aa 12a3 ...--", "#$%&' a'tb"]
    for t, ids in zip(texts, m.encode([t.encode() for t in texts])):
        assert ids.tolist() == m.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_covers_every_id_once(docs, corpus, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs.coalesce(2)).collect()
    ids = [np.array(t.encode(x[1] or "", add_special_tokens=False).ids + [1], "<u4") for x in corpus]
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.length > 0 and r.offset + r.length <= 2048
    for x, own in zip(corpus, ids):
        pieces = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[x[0]]})
        assert [p[0] for p in pieces] == [0, *np.cumsum([p[1] for p in pieces])[:-1]] and sum(p[1] for p in pieces) == len(own) == pieces[0][3]
        assert all(zlib.crc32(own[a : a + n].tobytes()) == c for a, n, c, _ in pieces)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]]
    assert sum(1 for s in seqs.values() if sum(n for _, n in s) < 1900) <= 4
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000, 2047, 2048, 2049, 9999])
def test_cuts(n):
    p = list(packing.cut(n, 2048))
    assert sum(x for _, x in p) == n and p[0][0] == 0 and all(a + x == b for (a, x), (b, _) in zip(p, p[1:]))


def test_token_counts_and_cache(docs, corpus, none, spark, tmp_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    path = str(tmp_path / "cache")
    got = sorted(map(tuple, token_counts.count_tokens(docs, path).collect()))
    want = [(x[0], len((x[1] or "").encode()), len(sp.encode(x[1] or "")), len(sp.encode(x[1] or "")) > 4096) for x in corpus]
    assert got == sorted(want)
    first = spark.read.parquet(path).count()
    assert first == len({x[1] or "" for x in corpus})
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("new text")))
    assert token_counts.count_tokens(more, path).count() == len(corpus) + 1
    assert spark.read.parquet(path).count() == first + 1  # only the miss was encoded
    assert token_counts.count_tokens(none, str(tmp_path / "c2")).count() == 0


HARD = ["", " ", "a [INST] b", "\\[INST]", "\\\\</s>", "</s>", "[/INST]", "x\\", "<<SYS>> <</SYS>>\n", "[TEXT] [ROLE] [/ROLE]", "[INST", "</s", "\n", "[INST][INST]", "\\[INST\\]", "[I[INST]NST]"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "", "tool", "[TEXT]", "\\</s>"])
def test_turns_round_trip(role):
    r = random.Random(0)
    for t in HARD + ["".join(r.choice([*chat.CONTROLS, "\\", " ", "a"]) for _ in range(12)) for _ in range(200)]:
        assert [x[:2] for x in chat.parse(chat.render(role, t))] == [(role, t)]


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", "a"), (2, None, None, None), (2, 5, "assistant", None), (3, 0, "user", "x"), (3, 0, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(9))
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb </s>\n") and got[1].loss_sha256 == sha("b </s>") and got[1].loss_chars == 6
    assert got[2].turns_sha256 == sha("\n\nassistant\n\n") and got[2].loss_chars == 0 and got[3].n_turns == 2
    whole = "".join(r.rendered for r in chat.format_turns(frame).filter("conv_id = 1").orderBy("place").collect())
    assert [x[:2] for x in chat.parse(whole)] == [("user", "a"), ("assistant", "b </s>")] and len(whole) == got[1].formatted_chars


def fold(i, m=5):
    return zlib.crc32(str(i).encode()) % m


def test_language_held_out_accuracy_and_edges(spark, none):
    r = random.Random(4)
    rows = [(i, prose(r, r.randint(8, 80)) if i % 2 else prose(r, r.randint(8, 80), FR), "en" if i % 2 else "fr", None, None) for i in range(300)]
    rows += [(1000, None, "en", None, None), (1001, "12 34 !?", None, None, None), (1002, "", None, None, None), (1003, "\u00e9", None, None, None), (None, "the of the", None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    trees = language_id.train(frame)
    got = {x.doc_id: x for x in language_id.identify(frame, trees).collect()}
    held = [x for x in rows[:300] if fold(x[0]) == 0]
    assert sum(got[x[0]].lang_pred == x[2] for x in held) / len(held) > 0.97 and all(got[x[0]].held_out for x in held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in ("en", "fr") and len(got) == 305
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in language_id.identify(frame, language_id.train(none)).collect()} == {"und"}
    assert language_id.identify(none, trees).count() == 0
    # after any context the bytes' probabilities sum to one, and a text's bits equal a plain sum
    for context in (b"the ", b"ofth", b"zzzz", "\u00e8 le".encode()[-4:], b"\0\0\0a"):
        keys = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256) if not 65 <= x <= 90], np.int64)
        assert (np.exp2(-trees.costs(keys, language_id.ORDER).astype(float)).sum(0) <= 1 + 1e-4).all()
    one, two = trees.code_lengths([b"the of"]), trees.code_lengths([b"x", b"", b"the of"])
    assert np.allclose(one[0], two[2]) and (two[1] == 0).all()


def test_toxicity_learns_and_scores_any_text(spark, none):
    r = random.Random(6)
    bad, rows, marks = ["vile", "wretch", "scab"], [], []
    for i in range(500):
        w = prose(r, r.randint(20, 150)).split()
        if i % 4 == 0:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), None, None, None))
        marks.append((i, int(i % 4 == 0)))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, "vile " * 3, None, None, None), (903, prose(r, 3000), None, None, None)]
    frame, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, toxic int")
    net = toxicity.train(frame, labels)
    got = {x.doc_id: x for x in toxicity.score(frame, net).collect()}
    held = [i for i, _ in marks if fold(i) == 0]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.95
    assert len(got) == 504 and got[900].score == pytest.approx(got[901].score) and got[903].predicted == 0
    assert toxicity.keep_clean(frame, net).count() == sum(x.predicted == 0 for x in got.values())
    assert toxicity.train(frame, labels.filter("toxic = 0")) is None and {x.score for x in toxicity.score(frame, None).collect()} == {0.0}
    assert toxicity.score(none, net).count() == 0


def test_toxicity_gradients():
    words = [b"a", b"bb", b"ccc"]
    net = toxicity.Network({w: i + 1 for i, w in enumerate(words)})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows, y = [[b"a", b"bb"] * 4, [b"ccc"] * 3], np.array([1.0, 0.0])

    class Still:
        def random(self, n):
            return np.ones(n)

    g = toxicity._gradients(net, rows, y, Still())

    def loss():
        keep = toxicity.Scorer(net)
        z = keep._logits([b" ".join(x) for x in rows])
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    for k in ("wx", "u", "bu", "wa", "va", "wo", "word"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, h = net.p[k][at], 1e-2
        net.p[k][at] = old + h
        up = loss()
        net.p[k][at] = old - h
        down = loss()
        net.p[k][at] = old
        assert (up - down) / (2 * h) == pytest.approx(g[k][at], rel=0.05, abs=1e-5), k


def test_lm_base_and_model(spark, docs, corpus, none):
    from collections import Counter

    got = lm.score(docs, sample_docs=80).collect()
    train = [(x[1] or "").encode().lower().split() for x in corpus if fold(x[0]) != 1]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()) + len(train), len(c) + 1
    c[None] = len(train)
    want = []
    for x in corpus:
        t = [*(x[1] or "").encode().lower().split(), None]
        want.append((x[0], fold(x[0]) == 1, len(t), sum(c[w] > 0 for w in t), round(float(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)), 6)))
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted(want)
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert lm.score(none).count() == 0


def test_lm_windows_score_each_id_once():
    r = np.random.default_rng(0)
    ids = r.integers(0, 50, 400)
    m = lm.fit([ids], steps=20)
    texts = [np.append(ids[:k], lm.END) for k in (0, 1, 31, 32, 33, 100, 399)]
    for t, s in zip(texts, m.scores(texts)):
        inputs, total = np.concatenate(([lm.START], t[:-1])), 0.0
        for i in range(len(t)):  # one id at a time, in the first window that holds it
            a = 0 if i < lm.WINDOW else -(-(i + 1 - lm.WINDOW) // lm.STRIDE) * lm.STRIDE
            grid = np.zeros((1, lm.WINDOW), np.int64)
            part = inputs[a : a + lm.WINDOW]
            grid[0, : len(part)] = part
            z = m.hidden(grid)[0, i - a] @ m.p["out"] + m.p["b"]
            total += z[m.classes[t[i]]] - np.log(np.exp(z).sum()) + m.share[t[i]]
        assert s == pytest.approx(total / np.log(10), rel=1e-4)
    # probabilities of all ids sum to one
    z = m.hidden(np.zeros((1, lm.WINDOW), np.int64))[0, 0] @ m.p["out"] + m.p["b"]
    q = np.exp(z - np.log(np.exp(z).sum()))[m.classes] * np.exp(m.share)
    assert q.sum() == pytest.approx(1, rel=1e-3)


def test_passes_over_ids_give_the_word_memo_back():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1]), pa.array([False]), pa.array(["the cat sat"])], names=["rid", "doc_id", "held_out", "text"])
    rows = list(lm._encoded(iter([batch])))
    assert lm.VOCABULARY in WordMemo._own
    ids = pa.RecordBatch.from_arrays([rows[0].column(5)], names=["ids"])
    (counts,) = lm._id_counter(iter([ids]))
    assert sum(counts.column(1).to_pylist()) == len(np.frombuffer(rows[0].column(5)[0].as_py(), np.uint16)) and not WordMemo._own


def test_toxicity_holds_equal_words_of_its_sample_once():
    split = toxicity.words_once([b"a long-enough word", b"A LONG-ENOUGH word word", b""])
    assert split == [[b"a", b"long-enough", b"word"], [b"a", b"long-enough", b"word", b"word"], []]
    assert len({id(w) for words in split for w in words}) == 3
