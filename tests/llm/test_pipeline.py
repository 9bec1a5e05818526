import random
import re
from pathlib import Path

import corpus_pipeline
from tidemark.llm import common, decontamination, jaccard_join, language_id, packing, toxicity

from .conftest import SCHEMA, edited, prose


def test_stages_one_by_one(spark, tmp_path):
    r = random.Random(9)
    items = [prose(r, 30) for _ in range(4)]
    rows, marks = [], []
    for i in range(240):
        w = prose(r, r.randint(20, 120)).split()
        if i % 6 == 0:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["vile", "wretch"]))
        rows.append((i, " ".join(w), "en", None, len(w)))
        marks.append((i, 1, int(i % 6 == 0)))
    base = prose(r, 200)
    rows += [(500 + k, edited(r, base, k % 3), "en", None, 1) for k in range(6)] + [(600, "12 34", None, None, 1), (601, None, "en", None, 0), (602, prose(r, 50) + " " + items[2], "en", None, 1), (None, prose(r, 30), "en", None, 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "language_id", "ngram_jaccard_join", "decontamination", "packing"]
    ids = lambda f: sorted((x.doc_id is None, x.doc_id or 0) for x in f.select("doc_id").collect())
    keep = lambda f, gone: [k for k in ids(f) if k[0] or k[1] not in gone]

    one = stages["toxicity"](spark, docs, d)
    bad = {x.doc_id for x in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))).filter("predicted = 1").collect()}
    assert one.columns == docs.columns and ids(one) == keep(docs, bad)
    assert sum(i % 6 == 0 for i in bad if i is not None and i < 240) >= 36 and sum(1 for i in bad if i is not None and i % 6 and i < 240) <= 2
    two = stages["language_id"](spark, docs, d)
    named = {x.doc_id: x for x in language_id.identify(docs, language_id.train(docs)).collect()}
    assert ids(two) == keep(docs, {i for i, x in named.items() if x.lang_pred == "und" or x.score < 0.5}) and {600, 601} & {x.doc_id for x in two.collect()} == set()
    three = stages["ngram_jaccard_join"](spark, docs, d)
    from fractions import Fraction

    classes = jaccard_join.join(docs, 5, Fraction(4, 5)).collect()
    assert ids(three) == keep(docs, {x.doc_id for x in classes if x.doc_id is not None and x.doc_id != x.component_id})
    four = stages["decontamination"](spark, docs, d)
    hit = {x.doc_id for x in decontamination.find(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert 602 in hit and ids(four) == keep(docs, hit) and four.columns == docs.columns
    assert stages["packing"](spark, docs, d).columns == packing.pack(docs).columns
    out = corpus_pipeline.run(spark, d)
    assert 200 <= out.select("doc_id").distinct().count() <= 215


def test_cleaning_gives_back_what_the_drivers_jvm_freed_outside_its_heap(spark):
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) >> 10
    common.cleaned(spark)
    made = [jvm.java.util.zip.Deflater() for _ in range(400)]
    for x in made:
        x.setInput(bytearray(100_000))
        x.deflate(bytearray(100_000))
    for i, x in enumerate(made):
        if i % 10:  # the others keep the allocator from shrinking at its end
            x.end()
    before = held()
    common.cleaned(spark)
    assert held() < before - 20
    for x in made:
        x.end()
