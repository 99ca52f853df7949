"""Rate limits and numbers per line against plain folds."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from lumenfold.operators import guard, rate

START = datetime(2024, 1, 1)


def stream(n=600, seed=3):
    """Half of the events are one user's."""
    rng = random.Random(seed)
    rows, at = [], [0] * 4
    for i in range(n):
        u = 0 if i % 2 else rng.randrange(1, 4)
        at[u] += rng.choice([0, 0, 1, 2, 5, 9, 40])
        rows.append((i, u, START + timedelta(seconds=at[u])))
    return rows


def plain(rows, capacity, refill):
    out, state = {}, {}
    for i, u, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        s = int((t - START).total_seconds())
        level, last = state.get(u, (capacity * refill, s))
        level = min(capacity * refill, level + s - last)
        ok = level >= refill
        state[u] = (level - refill * ok, s)
        out[i] = (u, ok, state[u][0])
    return out


@pytest.mark.parametrize(("capacity", "refill", "parts"), [(3, 7, 1), (3, 7, 9), (1, 30, 40), (20, 3, 25)])
def test_token_bucket_equals_a_plain_fold(spark, capacity, refill, parts):
    rows = stream()
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    found = rate.token_bucket(events, capacity, refill, parts)
    assert {r.event_id: (r.user_id, r.allowed, r.credits) for r in found.collect()} == plain(rows, capacity, refill)


def test_level_map_is_the_fold_of_each_level():
    rng = random.Random(0)
    for _ in range(40):
        cost, full = rng.randint(1, 9), rng.randint(9, 60)
        s = np.cumsum([rng.choice([0, 1, 3, 30]) for _ in range(rng.randint(1, 120))])
        starts, values = rate.level_map(s, cost, full)
        got = [int(values[np.searchsorted(starts, k, "right") - 1]) for k in range(full + 1)]
        assert got == [rate.folded(s, k, None, cost, full)[1][-1] for k in range(full + 1)]


def test_frame_counts(spark):
    rows = stream(300)
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    want = {i: sum(1 for _, v, x in rows if v == u and t - timedelta(seconds=20) <= x <= t) for i, u, t in rows}
    assert {r.event_id: r.n for r in rate.frame_counts(events, 20).collect()} == want
    with pytest.raises(ValueError, match="levels"):
        rate.token_bucket(events, 1 << 20, 2)


def test_numbers_of_many_lines(spark):
    rng = random.Random(5)
    texts = ["\n".join(" ".join(str(rng.choice([rng.randrange(40), rng.randrange(400) / 8, 10**17 + rng.randrange(90)])) for _ in range(rng.randrange(4))) for _ in range(30)) for _ in range(12)]
    texts += ["no numbers", "", None, "7", "1 1\n1.0", "5\n5.5\n6.01", "\n".join(f"{i} 3" for i in range(20_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.line): (r.n_numbers, r.n_missing) for r in guard.missing_numbers(docs).collect()}
    near = {(r.doc_id, r.line): (r.n_numbers, r.n_unmatched) for r in guard.unmatched_numbers(docs, 0.5).collect()}
    import re

    for d, t in enumerate(texts[:-1]):
        lines = [list(dict.fromkeys(re.findall(guard.NUMBER, x))) for x in (t or "").split("\n")]
        for i, own in enumerate(lines):
            others = [v for k, x in enumerate(lines) if k != i for v in x]
            values, far = {float(v) for v in own}, [float(v) for v in others]
            assert got.get((d, i + 1)) == ((len(own), sum(v not in others for v in own)) if own else None)
            assert near.get((d, i + 1)) == ((len(values), sum(all(abs(v - u) > 0.5 for u in far) for v in values)) if own else None)
    assert got[len(texts) - 1, 11] == (2, 1) and near[len(texts) - 1, 11] == (2, 1) and near[len(texts) - 1, 4] == (1, 0)
