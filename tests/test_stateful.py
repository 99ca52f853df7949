"""Keyed stream state on literal rows: expiry by timers, eviction, snapshots as of a batch."""

import random
from datetime import datetime, timedelta

from lumenfold.streaming import operators as S
from lumenfold.streaming import stateful as K

START = datetime(2024, 1, 1)


def test_idle_users_are_forgotten_and_snapshots_stay(spark, tmp_path):
    source, state = f"{tmp_path}/in", f"file://{tmp_path}/state"

    def put(rows):
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.mode("append").parquet(source)
        stream = S.session_state(S.event_stream(spark, source), keep_ms=3_600_000, delay="1 second")
        S.drained(stream, "update", state)
        return K.batches_of(spark, f"{state}/checkpoint")[1]

    first = put([(1, START, 1, "a"), (2, START, 2, "a")])
    put([(3, START + timedelta(days=2), 2, "b")])
    users = lambda *batch: {r.user_id: r.n for r in K.state_of(spark, f"{state}/checkpoint", "session", *batch).collect()}
    assert users(first) == {1: 1, 2: 1} and users() == {2: 2}


def test_the_cache_evicts_the_least_recent(spark, tmp_path):
    axis = lambda i: [float(i == k) for k in range(4)]
    asked = [(1, 0, 0), (2, 1, 1), (3, 0, 2), (4, 2, 3), (5, 1, 4), (6, 0, 5), (7, 0, 8 * 24 * 60)]  # event, vector, minute
    rows = [(e, START + timedelta(minutes=m), 9, v, axis(v)) for e, v, m in asked]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = S.drained(K.semantic_cache(S.event_stream(spark, f"{tmp_path}/in"), 0.9, capacity=2), "append", f"file://{tmp_path}/state")
    got = {r.event_id: (r.hit, r.response_id, r.score) for r in out.collect()}
    # 3 finds vector 0 again; 4 then drives out vector 1, so 5 misses and drives out 0; a week later all is gone.
    assert {e: x[0] for e, x in got.items()} == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: False}
    assert got[3] == (True, 0, 1.0)


def test_users_share_the_keys_of_the_cache(spark, tmp_path):
    """40 users over three micro-batches, on three keys; each hit as a plain loop finds it."""
    draw = random.Random(7)
    vectors = [[draw.gauss(0, 1) for _ in range(4)] for _ in range(9)]
    asked = [(e, START + timedelta(hours=draw.randrange(900)), draw.randrange(40), draw.randrange(9)) for e in range(900)]
    asked.sort(key=lambda x: (x[1], x[0]))
    source, state = f"{tmp_path}/in", f"file://{tmp_path}/state"
    for part in (asked[:300], asked[300:600], asked[600:]):
        rows = [(*r, vectors[r[3]]) for r in part]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, vec_id long, embedding array<double>").coalesce(1).write.mode("append").parquet(source)
        out = S.drained(K.semantic_cache(S.event_stream(spark, source), 0.5, capacity=3, buckets=3), "append", state)
    held, want = {}, {}
    for e, ts, user, vec in asked:
        own = held.setdefault(user, {})
        live = {k: round(sum(x * y for x, y in zip(vectors[k], vectors[vec], strict=True)), 6) for k, t in own.items() if ts - t < timedelta(days=7)}
        best = min(((-s, k) for k, s in live.items() if s >= 0.5), default=None)
        want[e] = None if best is None else best[1]
        own.pop(vec, None)
        own[vec] = ts
        if len(own) > 3:
            del own[next(iter(own))]
    assert {r.event_id: r.response_id for r in out.collect()} == want
    kept = spark.read.format("statestore").option("path", f"{state}/checkpoint").option("stateVarName", "entries").load()
    assert kept.select("key").distinct().count() <= 3
    # The watermark is an hour behind the last request; who has asked within a week of it is kept, everyone else was cleared.
    last = {user: ts for _, ts, user, _ in asked}
    bar = asked[-1][1] - timedelta(hours=1)
    assert {r.user_id for r in kept.select("user_map_key.*").collect()} == {u for u, ts in last.items() if ts + timedelta(days=7) >= bar}


def test_a_user_of_many_requests_and_missing_vectors(spark, tmp_path):
    """More requests than one matrix product takes; a request without a vector neither hits nor answers."""
    rows = [(e, START + timedelta(minutes=e), 5, e % 3, None if e % 3 == 2 else [1.0, float(e % 3)]) for e in range(700)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/in")
    out = S.drained(K.semantic_cache(S.event_stream(spark, f"{tmp_path}/in"), 0.5), "append", f"file://{tmp_path}/state")
    got = {r.event_id: (r.response_id, r.score) for r in out.collect()}
    # Vector 0 is (1, 0) and vector 1 (1, 1): 0 scores 1 against both, so that the smaller id answers; 1 scores 2 against itself.
    want = {0: (None, None), 1: (0, 1.0), 2: (None, None)} | {e: [(0, 1.0), (1, 2.0), (None, None)][e % 3] for e in range(3, 700)}
    assert got == want


def test_users_share_the_keys_of_late_rows(spark, tmp_path):
    """30 users over three micro-batches on two keys, and in frames of 50 rows: each user's own watermark counts."""
    draw = random.Random(8)
    rows = [(e, START + timedelta(minutes=draw.randrange(3000) + 1000 * (e // 400)), draw.randrange(30)) for e in range(1200)]
    source, state = f"{tmp_path}/in", f"file://{tmp_path}/state"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        for n in range(3):
            spark.createDataFrame(rows[400 * n : 400 * n + 400], "event_id long, ts timestamp, user_id long").coalesce(1).write.mode("append").parquet(source)
            on_time, late = K.keep_late(K.marked_late(S.event_stream(spark, source), 3_600_000, buckets=2), state)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, top = {}, {}
    for n in range(3):
        part = rows[400 * n : 400 * n + 400]
        for e, ts, user in part:
            want[e] = (ts, max((top[user] - timedelta(hours=1) - ts) // timedelta(microseconds=1), 0) if user in top else 0)
        for _, ts, user in part:
            top[user] = max(ts, top.get(user, ts))
    assert {r.event_id: (r.ts, r.behind_us) for r in on_time.unionByName(late).collect()} == want
    assert {r.event_id for r in late.collect()} == {e for e, (_, us) in want.items() if us > 0} != set()
    kept = spark.read.format("statestore").option("path", f"{state}/checkpoint").option("stateVarName", "seen").load()
    assert kept.select("key").distinct().count() <= 2 and kept.count() == 30


def test_users_share_the_keys_of_session_state(spark, tmp_path):
    """25 users over two micro-batches on two keys, in frames of 40 rows and with many equal times, of which the largest id
    counts; the second batch once from the checkpoint and once from a snapshot. Some users come only in one of them."""
    draw = random.Random(10)
    rows = [(e, START + timedelta(hours=draw.randrange(12) + 6 * (e // 500)), draw.randrange(20) + 5 * (e // 500), draw.choice("abc")) for e in range(1000)]
    source, other, state, again = f"{tmp_path}/in", f"{tmp_path}/other", f"file://{tmp_path}/state", f"file://{tmp_path}/again"

    def put(part, *folders):
        for f in folders:
            spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.mode("append").parquet(f)

    def want(part):
        last = {user: max((ts, e, kind) for e, ts, u, kind in part if u == user) for user in {r[2] for r in part}}
        return {(user, sum(r[2] == user for r in part), ts, kind, e) for user, (ts, e, kind) in last.items()}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        put(rows[:500], source)
        S.drained(S.session_state(S.event_stream(spark, source), buckets=2), "update", state)
        stopped = K.batches_of(spark, f"{state}/checkpoint")[1]
        put(rows[500:], source, other)
        out = S.drained(S.session_state(S.event_stream(spark, source), buckets=2), "update", state)
        before = K.sessions_of(spark, f"{state}/checkpoint", stopped)
        S.drained(S.session_state(S.event_stream(spark, other), snapshot=before, buckets=2), "update", again)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in before.collect()} == want(rows[:500])
    after = {tuple(r) for r in K.sessions_of(spark, f"{state}/checkpoint").collect()}
    assert after == {tuple(r) for r in K.sessions_of(spark, f"{again}/checkpoint").collect()} == want(rows)
    assert {tuple(r) for r in out.collect()} >= {r[:4] for r in after if r[0] >= 5}
    kept = spark.read.format("statestore").option("path", f"{state}/checkpoint").option("stateVarName", "session").load()
    assert kept.select("key").distinct().count() <= 2


def test_users_of_one_key_are_forgotten_one_by_one(spark, tmp_path):
    """Users 0 to 4 come an hour apart and are kept for six hours: each timer leaves a timer for who is next."""
    source, state, left = f"{tmp_path}/in", f"file://{tmp_path}/state", []
    for batch in ([(u, START + timedelta(hours=u), u, "a") for u in range(5)], [(5, START + timedelta(hours=7, minutes=30), 9, "a")], [(6, START + timedelta(hours=9, minutes=30), 9, "a")]):
        spark.createDataFrame(batch, "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.mode("append").parquet(source)
        S.drained(S.session_state(S.event_stream(spark, source), keep_ms=6 * 3_600_000, delay="1 second", buckets=1), "update", state)
        left.append({r.user_id for r in K.sessions_of(spark, f"{state}/checkpoint").collect()})
    assert left == [{0, 1, 2, 3, 4}, {2, 3, 4, 9}, {4, 9}]


def test_rows_without_a_user_are_one_user(spark, tmp_path):
    """Beside them an id that doubles can't hold stays exact, and user 0 is another one."""
    big = 2**60 + 1
    rows = [(e, START + timedelta(hours=e), user, "a", 0, [1.0, 0.0]) for e, user in enumerate([0, None, big, None, 0])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/in")
    events = lambda: S.event_stream(spark, f"{tmp_path}/in")
    states = S.drained(S.session_state(events(), buckets=1), "update", f"file://{tmp_path}/a")
    assert {r.user_id: r.n for r in states.collect()} == {r.user_id: r.n for r in K.sessions_of(spark, f"file://{tmp_path}/a/checkpoint").collect()} == {0: 2, None: 2, big: 1}
    on_time, late = K.keep_late(K.marked_late(events(), 3_600_000, buckets=1), f"file://{tmp_path}/b")
    assert {r.event_id: r.user_id for r in on_time.collect()} == {0: 0, 1: None, 2: big, 3: None, 4: 0} and late.count() == 0
    answers = S.drained(K.semantic_cache(events(), 0.5, buckets=1), "append", f"file://{tmp_path}/c")
    assert {r.event_id: (r.user_id, r.hit) for r in answers.collect()} == {0: (0, False), 1: (None, False), 2: (big, False), 3: (None, True), 4: (0, True)}
