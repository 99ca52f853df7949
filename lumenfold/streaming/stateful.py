"""Keyed state beyond counts: a semantic cache with eviction, late rows kept beside, snapshots of state and restarts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
#: Keys of the processors: users share them by hash, since a key costs milliseconds of Python for its frames whatever its
#: rows. A checkpoint keeps the number that it was begun with.
BUCKETS = 1024
USER = T.StructType([T.StructField("user_id", T.LongType())])


def bucketed(buckets: int) -> list[Column]:
    """user_id without nulls, which pandas would turn into floats, and the bucket: rows without a user have a bucket of their own."""
    return [F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"), F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(buckets))).cast("long").alias("bucket")]


def user_of(user: str = "user_id", bucket: str = "bucket") -> Column:
    return F.when(F.col(bucket) >= 0, F.col(user)).alias("user_id")


class SemanticCache(StatefulProcessor):
    """Users' caches of answered requests: MapState of a bucket of users, from the user to the entries (a vector's id, when
    it was last asked, the vector), the least recent first.

    Requests are taken in the order of (ts, event_id) within a micro-batch. A request is a hit if the nearest entry that is
    younger than the time to live has at least the threshold's inner product; hit or miss, its own vector then is the most
    recent entry, and beyond the capacity the least recent one goes. An event-time timer clears the users who haven't
    asked for the time to live. A bucket's rows of one micro-batch are held in memory.
    """

    def __init__(self, threshold: float, capacity: int, ttl_ms: int, kind: str):
        self.threshold, self.capacity, self.ttl, self.kind = threshold, capacity, ttl_ms * 1000, np.dtype(kind)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("vec_ids", "at", "event_ids")]
        self.entries = handle.getMapState("entries", USER, T.StructType([*lists, T.StructField("vectors", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["user_id", "at", "event_id"])
        kept = self.entries.exists()
        users = asked["user_id"].to_numpy()
        ends = [*(np.flatnonzero(users[1:] != users[:-1]) + 1).tolist(), len(users)]
        columns = [asked[c].tolist() for c in ("vec_id", "at", "event_id", "embedding")]
        best, oldest, begin = [], None, 0
        for end in ends:
            user, own = int(users[begin]), [c[begin:end] for c in columns]
            held = self.entries.getValue((user,)) if kept else None
            found, entries = self._asked(held, *own)
            best += found
            self.entries.updateValue((user,), entries)
            latest = max(entries[1])
            oldest, begin = latest if oldest is None else min(oldest, latest), end
        self.handle.registerTimer(self._end(oldest))
        ids, scores = zip(*best, strict=True)
        hit = np.array([k is not None for k in ids])
        yield pd.DataFrame({"event_id": asked["event_id"].to_numpy(), "bucket": key[0], "user_id": users, "vec_id": asked["vec_id"].to_numpy(), "hit": hit, "response_id": pd.Series(ids, dtype="Int64"), "score": pd.Series(scores, dtype="float64")})

    def _asked(self, held, vecs: list, at: list, events: list, vectors: list) -> tuple[list, tuple]:
        """The (id, score) of the entry that answers each request of one user, or (None, None); and the entries thereafter."""
        cache = {k: (t, e, i) for i, (k, t, e) in enumerate(zip(*held[:3], strict=True))} if held else {}
        known = self._matrix([held[3]], len(cache)) if held else None
        cache = dict(sorted(cache.items(), key=lambda x: x[1][:2]))  # the least recent first
        found = []
        for begin in range(0, len(vecs), BLOCK):
            block = slice(begin, begin + BLOCK)
            own = self._matrix(vectors[block], len(vecs[block]))
            first = 0 if known is None else len(known)
            known = own if known is None else np.concatenate([known, own])
            scores = np.round(own @ known.T, 6).tolist()
            for n, (vec, now, event) in enumerate(zip(vecs[block], at[block], events[block], strict=True)):
                best = (None, None)
                for k, (t, _, i) in list(cache.items()):
                    score = scores[n][i]
                    if now - t >= self.ttl:
                        del cache[k]
                    elif score >= self.threshold and (best[0] is None or (-score, k) < (-best[1], best[0])):
                        best = (k, score)
                found.append(best)
                cache.pop(vec, None)
                cache[vec] = (now, event, first + n)
                if len(cache) > self.capacity:
                    del cache[next(iter(cache))]
            known = known[[v[2] for v in cache.values()]]
            cache = {k: (t, e, i) for i, (k, (t, e, _)) in enumerate(cache.items())}
        return found, (list(cache), [v[0] for v in cache.values()], [v[1] for v in cache.values()], known.astype(self.kind).tobytes())

    def _matrix(self, vectors: list, n: int) -> np.ndarray:
        """n vectors in double precision; a missing one is NaN, which is near nothing."""
        if any(v is None for v in vectors):
            width = next((len(v) for v in vectors if v is not None), self.kind.itemsize)
            vectors = [np.full(width // self.kind.itemsize, np.nan, self.kind).tobytes() if v is None else v for v in vectors]
        return np.frombuffer(b"".join(vectors), self.kind).reshape(n, -1).astype(np.float64)

    def _end(self, at: int) -> int:
        return at // 1000 + self.ttl // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left = timerValues.getCurrentWatermarkInMs(), []
        for user, entries in list(self.entries.iterator()):
            end = self._end(max(entries[1]))
            if end <= now:
                self.entries.removeKey(user)
            else:
                left.append(end)
        if left:
            self.handle.registerTimer(min(left))
        return iter(())

    def close(self) -> None:
        pass


#: Requests of a user that are compared with the cache and one another by one matrix product.
BLOCK = 256


def packed(column: str, kind: str = "f8") -> Column:
    """Vectors (arrays) as the bytes of their numbers, which cross to Python faster."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, kind).tobytes())

    return pack(column).alias(column)


def semantic_cache(requests: DataFrame, threshold: float, capacity: int = 8, ttl_ms: int = 7 * DAY_MS, delay: str = "1 hour", kind: str = "f8", buckets: int = BUCKETS) -> DataFrame:
    """event_id, user_id, vec_id, hit, response_id, score of a stream of requests (event_id, user_id, ts, vec_id, embedding).

    embedding: arrays, or what packed made of them with the same kind of number.
    """
    schema = "event_id long, bucket long, user_id long, vec_id long, hit boolean, response_id long, score double"
    vector = F.col("embedding") if isinstance(requests.schema["embedding"].dataType, T.BinaryType) else packed("embedding", kind)
    own = requests.select("event_id", "ts", F.unix_micros("ts").alias("at"), "vec_id", vector, *bucketed(buckets)).withWatermark("ts", delay)
    answered = own.groupBy("bucket").transformWithStateInPandas(SemanticCache(threshold, capacity, ttl_ms, kind), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return answered.select("event_id", user_of(), "vec_id", "hit", "response_id", "score")


class LateRows(StatefulProcessor):
    """Passes all rows on, and says of each whether it is behind its user's watermark and by how much.

    The watermark of a user is the largest ts of their earlier micro-batches less the delay; it only grows. It is kept here
    (MapState of a bucket of users, from the user to that ts) and not by Spark, which drops late rows before they reach a
    processor. Rows are held one Arrow batch at a time.
    """

    def __init__(self, delay_us: int):
        self.delay = delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", USER, T.StructType([T.StructField("ts", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept, seen, top = self.seen.exists(), {}, {}
        for part in rows:
            at = part["at"].to_numpy()
            users, place = np.unique(part["user_id"].to_numpy(), return_inverse=True)
            tops = np.full(len(users), NEVER)
            np.maximum.at(tops, place, at)
            for user, ts in zip(users.tolist(), tops.tolist(), strict=True):
                if user not in seen:
                    state = self.seen.getValue((user,)) if kept else None
                    seen[user] = NEVER if state is None else state[0]
                top[user] = max(ts, top.get(user, NEVER))
            bar = np.array([seen[user] for user in users.tolist()])[place]
            behind = np.where(bar == NEVER, 0, np.maximum(bar - self.delay - at, 0))
            yield pd.DataFrame({"event_id": part["event_id"].to_numpy(), "bucket": key[0], "user_id": part["user_id"].to_numpy(), "at": at, "late": behind > 0, "behind_us": behind})
        for user, ts in top.items():
            if ts > seen[user]:
                self.seen.updateValue((user,), (ts,))

    def close(self) -> None:
        pass


#: Before every ts.
NEVER = np.iinfo(np.int64).min


def marked_late(events: DataFrame, delay_ms: int, buckets: int = BUCKETS) -> DataFrame:
    """event_id, user_id, ts, late, behind_us for every row of the stream."""
    schema = "event_id long, bucket long, user_id long, at long, late boolean, behind_us long"
    own = events.select("event_id", F.unix_micros("ts").alias("at"), *bucketed(buckets))
    marked = own.groupBy("bucket").transformWithStateInPandas(LateRows(delay_ms * 1000), outputStructType=schema, outputMode="Append", timeMode="None")
    return marked.select("event_id", user_of(), F.timestamp_micros("at").alias("ts"), "late", "behind_us")


def keep_late(marked: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Drains the stream into one table partitioned by late; returns the rows on time and the side table of late ones."""
    spark = marked.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{folder}/rows/batch={number}")

    run = marked.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema("event_id long, user_id long, ts timestamp, behind_us long, batch long, late boolean").parquet(f"{folder}/rows")
    return rows.where("not late"), rows.where("late")


# ---- state as tables


def state_of(spark: SparkSession, checkpoint: str, variable: str, batch: int | None = None) -> DataFrame:
    """Keys (users) and values of a MapState variable as of the end of a micro-batch (the last one if none is given)."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable)
    own = (reader if batch is None else reader.option("batchId", batch)).load()
    return own.select(user_of("user_map_key.user_id", "key.bucket"), "user_map_value.*")


def sessions_of(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """user_id, n, last_ts, last_type, last_id of the session state, which a new stream may begin from."""
    own = state_of(spark, checkpoint, "session", batch)
    return own.select("user_id", "n", F.timestamp_micros("last_us").alias("last_ts"), "last_type", "last_id")


def batches_of(spark: SparkSession, checkpoint: str) -> tuple[int, int]:
    """The first and last micro-batch whose state can be read."""
    return spark.read.format("state-metadata").load(checkpoint).select("minBatchId", "maxBatchId").first()
