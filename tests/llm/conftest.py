import random

import pytest

SYL = ["the", "of", "an", "er", "on", "ti", "re", "st", "nd", "ha", "ou", "ea", "th", "in"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, syl=SYL):
    out = []
    for i in range(n):
        w = "".join(r.choice(syl) for _ in range(r.randint(1, 4)))
        out.append(w.capitalize() + "." if i % 9 == 8 else w)
    return " ".join(out)


def edited(r, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[r.randrange(len(w))] = "zz" + str(r.randrange(999))
    return " ".join(w)


@pytest.fixture(scope="session")
def corpus():
    """Documents with copies, near copies in chains, a shared passage, nulls, empties, ties and a repeated row."""
    r = random.Random(5)
    rows = []
    passage = prose(r, 60)
    for i in range(60):
        rows.append(prose(r, r.choice([1, 2, 5, 40, 120, 300])) + (("\n" + passage) if i % 6 == 0 else ""))
    base = prose(r, 260)
    rows += [base] * 5 + [edited(r, base, k) for k in (1, 1, 2, 3, 4, 5, 6, 8)]
    chain = prose(r, 200)
    for _ in range(8):
        rows.append(chain)
        chain = edited(r, chain, 2)
    rows += [None, "", "   \n\t", "one", "one", "one two", "ONE two", prose(r, 6000)]
    out = [(i, t, "en" if i % 3 else "fr", "s0" if i % 2 else None, None) for i, t in enumerate(rows)]
    return out + [out[70]]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(corpus, SCHEMA)
    return frame.withColumns({"n": F.lit("clash"), "digest": F.lit(1), "word": F.lit(2)})  # extra columns with the operators' own names


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
