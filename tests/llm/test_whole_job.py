import random

import pytest


def test_lm_model_keeps_its_size_and_context():
    import inspect

    from tidemark.llm import lm

    assert lm.WINDOW - lm.STRIDE == 8 and (lm.ALONE, lm.GROUPS) == (64, 64)
    assert inspect.signature(lm.fit).parameters["steps"].default == 4500


def test_lm_learns_from_every_training_text(spark):
    import zlib

    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.llm import lm

    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != lm.FOLD]
    rows = [(i, "the cat sat on a mat. " * 12 + "a zebra ran. " * (i % 7)) for i in ids] + [(7000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {}

    def spy(model, coded, *more):
        kept["start"] = {k: v.copy() for k, v in model.p.items()}
        kept["texts"] = coded.count()
        return whole(model, coded, *more)

    whole, lm.trained_on_all = lm.trained_on_all, spy
    try:
        few = lm.train(docs, sample_docs=2)
    finally:
        lm.trained_on_all = whole
    every = lm.fit([next(lm.WordMemo.shared(lm.VOCABULARY).encode([t.encode().lower()])) for _, t in rows[:-1]], steps=0)
    assert kept["texts"] == len(ids)
    assert (few.classes == every.classes).all() and np.allclose(few.share, every.share)  # classes and shares of the whole fold, not of 2 texts
    assert all(np.abs(few.p[k] - kept["start"][k]).max() > 1e-4 for k in few.p)
    held = [np.append(next(lm.WordMemo.shared(lm.VOCABULARY).encode([b"the cat sat on a mat. a zebra ran."])), lm.END)]
    assert few.scores(held)[0] > every.scores(held)[0]
    assert F is not None


def test_licenses_inside_lines(spark):
    from tidemark.llm import licenses

    filler = "some words that have nothing to do with it "
    texts = {
        1: "Our code is released under the MIT License.",
        2: "Copyright 2024 Acme Inc. Licensed under the Apache License, Version 2.0.",
        3: filler * 5 + licenses.TEMPLATES["ISC"].replace(" any ", "\nsome ") + " " + filler * 40,
        4: filler * 3 + "Released under the BSD License " + filler,
        5: "MIT License",
        6: filler + licenses.TEMPLATES["CC-BY-4.0"] + "\n" + licenses.TEMPLATES["CC-BY-4.0"],
        7: "a " + licenses.TEMPLATES["Apache-2.0-notice"] + " b " + licenses.TEMPLATES["MIT"],
    }

    def brute(text):
        w = licenses.re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
        found = {}
        for k, v in licenses.TEMPLATES.items():
            b, m = set(licenses.template_bigrams(v)), len(licenses.re.findall("[a-z0-9]+", v.lower()))
            for i in range(len(w) - m + 1):
                own = set(licenses.template_bigrams(" ".join(w[i : i + m])))
                found[k] = max(found.get(k, 0), 2 * len(own & b) / (len(own) + len(b)))
        return {k: d for k, d in found.items() if d >= licenses.LEAST}

    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in licenses.scan(frame).collect()}
    want = {(i, k): d for i, t in texts.items() for k, d in brute(t).items()}
    assert {(1, "MIT"), (2, "Apache-2.0"), (3, "ISC"), (6, "CC-BY-4.0"), (7, "Apache-2.0"), (7, "Apache-2.0-notice"), (7, "MIT")} <= set(want)
    assert {k: r.dice for k, r in got.items()} == {k: pytest.approx(d, abs=1e-6) for k, d in want.items()}
    assert got[1, "MIT"].n_parts == 0 and got[6, "CC-BY-4.0"].n_parts == 1


def test_similarities_do_not_depend_on_blocks(spark):
    from tidemark.llm import decontamination

    from .conftest import edited, prose

    r = random.Random(9)
    head = prose(r, 12)
    items = [head + " " + prose(r, 20) for _ in range(8)] + [prose(r, 3), "", None]
    docs = [(i, prose(r, 30) + " " + edited(r, items[i % 9], i % 2) + " " + head) for i in range(27)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole, parts = (sorted(map(tuple, decontamination.find(frame, bench, item_block=n).collect())) for n in (100, 2))
    assert parts == whole and len({x[1] for x in whole}) == 9 and any(x[2] < 1 for x in whole)
