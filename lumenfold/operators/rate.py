"""Rate limits per event: counts over a RANGE frame, and a token bucket folded over the ordered events.

Neither holds all events of a user in one task. The frame is cut by time: an event goes to the bucket of the frame's width
that it falls into, and as context to the next one. The fold runs over ranges of (user, time): a range that begins within a
user's events doesn't know the bucket's level, so it is folded for every level at once, which gives a map from level to
level; the maps are composed from range to range, and only such ranges' first events are folded again.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Levels (in seconds) that a bucket may have: capacity times the seconds to a token.
MOST_LEVELS = 1 << 20
#: Events of a range that are folded between two looks at which levels have become one.
STEP = 32


def frame_counts(events: DataFrame, seconds: int) -> DataFrame:
    """event_id, user_id, n: events of the user in the so many seconds up to each event, ends included, itself too."""
    width = seconds * 1_000_000
    own = events.select("event_id", "user_id", F.unix_micros("ts").alias("at"))
    both = own.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("context")).withColumn("bucket", F.floor(F.col("at") / width) + F.col("context"))
    counted = both.selectExpr("*", f"count(*) over (partition by user_id, bucket order by at range between {width} preceding and current row) as n")
    return counted.where("context = 0").select("event_id", "user_id", "n")


def folded(seconds: np.ndarray, level: int, at: int | None, cost: int, full: int) -> tuple[list[bool], list[int]]:
    """Whether each event is allowed, and the level after it, from a level at a time."""
    ok, levels = [], []
    for s in seconds.tolist():
        level = min(full, level + (s - at if at is not None else 0))
        ok.append(level >= cost)
        level -= cost * ok[-1]
        levels.append(level)
        at = s
    return ok, levels


def level_map(seconds: np.ndarray, cost: int, full: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values): the level after events for each level 0 .. full at the first one; values[k] from starts[k] on."""
    values, of = np.arange(full + 1), np.arange(full + 1)
    gaps = np.diff(seconds, prepend=seconds[0])
    for lo in range(0, len(gaps), STEP):
        for gap in gaps[lo : lo + STEP].tolist():
            values = np.minimum(values + gap, full)
            values -= cost * (values >= cost)
        values, inverse = np.unique(values, return_inverse=True)
        of = inverse[of]
        if len(values) == 1:  # all levels have become one
            _, rest = folded(seconds[lo + STEP :], int(values[0]), int(seconds[min(lo + STEP, len(seconds)) - 1]), cost, full)
            values = np.array(rest[-1:] or values)
            break
    whole = values[of]
    starts = np.flatnonzero(np.diff(whole, prepend=whole[0] - 1))
    return starts, whole[starts]


_ROWS = "kind int, part int, user_id long, event_id long, s long, allowed boolean, credits long, first_s long, last_user long, last_s long, whole boolean, starts array<long>, values array<long>"


def token_bucket(events: DataFrame, capacity: int, refill_seconds: int, parts: int | None = None) -> DataFrame:
    """event_id, user_id, allowed, credits (seconds' worth left) of every event, in the order of (second, event_id).

    A user begins with a full bucket of so many tokens; a token comes back each refill_seconds; an event takes one or is
    refused. Driver: a row for each range of events, with its level map.
    """
    spark, cost, full = events.sparkSession, refill_seconds, capacity * refill_seconds
    if full > MOST_LEVELS:
        raise ValueError("the bucket has too many levels: take a smaller capacity or refill time")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = events.select("user_id", F.unix_seconds("ts").alias("s"), "event_id")
    ranged = own.repartitionByRange(parts, "user_id", "s", "event_id").sortWithinPartitions("user_id", "s", "event_id")
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("user_id", pa.int64()), ("event_id", pa.int64()), ("s", pa.int64()), ("allowed", pa.bool_()), ("credits", pa.int64()), ("first_s", pa.int64()), ("last_user", pa.int64()), ("last_s", pa.int64()), ("whole", pa.bool_()), ("starts", pa.list_(pa.int64())), ("values", pa.list_(pa.int64()))])

    def batch(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches):
        part, first, held, user, level, at = TaskContext.get().partitionId(), None, [], None, full, None
        for b in batches:
            users, seconds, ids = (b.column(i).to_numpy() for i in range(3))
            for i, j in _runs(users):
                u, s = int(users[i]), seconds[i:j]
                if first is None:
                    first = (u, int(s[0]))
                if u == first[0]:  # how full the bucket is isn't known here
                    held.append(s)
                    yield batch(kind=[1] * (j - i), part=[part] * (j - i), user_id=users[i:j], event_id=ids[i:j], s=s)
                    user, at = u, int(s[-1])
                    continue
                if u != user:
                    level, at = full, None
                ok, levels = folded(s, level, at, cost, full)
                user, level, at = u, levels[-1], int(s[-1])
                yield batch(kind=[0] * (j - i), user_id=users[i:j], event_id=ids[i:j], allowed=ok, credits=levels)
        if first is not None:
            starts, values = level_map(np.concatenate(held), cost, full)
            yield batch(kind=[2], part=[part], user_id=[first[0]], first_s=[first[1]], last_user=[user], last_s=[at], credits=[level], whole=[user == first[0]], starts=[starts], values=[values])

    folder = shared_folder(spark, "rate")
    ranged.mapInArrow(run, _ROWS).write.parquet(f"{folder}/rows")
    rows = spark.read.schema(_ROWS).parquet(f"{folder}/rows")
    begun, carried = [], None  # (user, level, second) at the end of the range before
    for r in rows.where("kind = 2").orderBy("part").toLocalIterator():
        level = full if carried is None or carried[0] != r.user_id else min(full, carried[1] + r.first_s - carried[2])
        begun.append((r.part, level))
        after = r["values"][int(np.searchsorted(r.starts, level, "right")) - 1] if r.whole else r.credits
        carried = (r.last_user, after, r.last_s)

    def again(t: pa.Table) -> pa.Table:
        t = t.sort_by([("s", "ascending"), ("event_id", "ascending")])
        ok, levels = folded(t["s"].to_numpy(), t["level"][0].as_py(), None, cost, full)
        return pa.table({"event_id": t["event_id"], "user_id": t["user_id"], "allowed": pa.array(ok), "credits": pa.array(levels, pa.int64())})

    out = "event_id long, user_id long, allowed boolean, credits long"
    level = spark.createDataFrame(begun, "part int, level long")
    late = rows.where("kind = 1").select("part", "user_id", "event_id", "s").join(F.broadcast(level), "part").groupBy("part").applyInArrow(again, out)
    return rows.where("kind = 0").select("event_id", "user_id", "allowed", "credits").unionByName(late)


def _runs(users: np.ndarray):
    """(start, end) of the runs of equal users."""
    edges = np.flatnonzero(np.diff(users)) + 1
    return zip(chain([0], edges.tolist()), chain(edges.tolist(), [len(users)] if len(users) else []), strict=False)
