import datetime as dt
import random
from collections import Counter

import pytest

from tidemark.plans import catalogue


def brute_croston(ys, alpha=0.1):
    size = gap = None
    since = 1
    for y in ys:
        if y > 0:
            size, gap = (y, since) if size is None else (alpha * y + (1 - alpha) * size, alpha * since + (1 - alpha) * gap)
            since = 1
        else:
            since += 1
    return size / gap if size else 0.0


def brute_tsb(ys, alpha=0.1, beta=0.1):
    hits = [y for y in ys if y > 0]
    p, size = len(hits) / len(ys), sum(hits) / max(1, len(hits))
    for y in ys:
        p = beta * (y > 0) + (1 - beta) * p
        size = alpha * y + (1 - alpha) * size if y > 0 else size
    return p * size


def test_intermittent_queries_score_every_user(spark, tmp_path):
    r, first = random.Random(0), dt.datetime(2024, 1, 1)
    rows = [(i, first + dt.timedelta(hours=r.randrange(20 * 24)), r.choice([3, 19, 20, 700]), r.choice(["click", "view"]), 1.0) for i in range(150)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    seen = Counter((f"{e}/{u}", ts.date()) for _, ts, u, e, _ in rows)
    days = sorted({d for _, d in seen})
    span = [days[0] + dt.timedelta(days=i) for i in range((days[-1] - days[0]).days + 1)]
    series = {k: [float(seen[k, d]) for d in span] for k in {k for k, _ in seen}}
    assert len(series) == 8
    for name, brute in (("croston", brute_croston), ("tsb", brute_tsb)):
        want = {k: pytest.approx(brute(v), abs=1e-6) for k, v in series.items()}
        assert {x.unique_id: x.yhat for x in catalogue.queries()[f"{name}_users"](spark, str(tmp_path)).collect()} == want
        got = catalogue.queries()[f"model_{name}"](spark, str(tmp_path)).collect()
        assert {x.unique_id for x in got} == set(series) and len(got) == 6 * len(series)
        assert all(abs(x.yhat - brute(series[x.unique_id])) < 2e-3 for x in got)
