"""Rate limits, session windows, keyed session state and duplicate suppression over an event stream.

Event time must be TIMESTAMP (watermarks don't take TIMESTAMP_NTZ). Complete mode gives every window, also those that a
watermark hasn't closed; append mode gives closed ones only and drops late rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import shared_folder
from .stateful import BUCKETS, NEVER, USER, bucketed, user_of

#: How long a user's session state outlives the last event (event time).
KEEP_MS = 90 * 86_400_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events of a Parquet file or folder as a stream, with ts as TIMESTAMP."""
    batch = spark.read.parquet(path)
    folder, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", name).parquet(folder) if not _is_folder(spark, path) else spark.readStream.schema(batch.schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def tumbling(events: DataFrame, width: str = "1 minute") -> DataFrame:
    own = events.withWatermark("ts", "1 hour").groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return own.select("user_id", F.col("w.start").alias("start"), "n")


def sliding(events: DataFrame, width: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    own = events.withWatermark("ts", "1 hour").groupBy("user_id", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"))
    return own.select("user_id", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    own = events.withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return own.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


class SessionState(StatefulProcessor):
    """Keeps for each user how many events came and the last one; yields the state after each batch.

    The state is a MapState of a bucket of users. A user without events for keep_ms (event time) is forgotten by a timer.
    The state may begin from a snapshot (n, last_us, last_type, last_id by user). Rows are held one Arrow batch at a time.
    """

    def __init__(self, keep_ms: int = KEEP_MS):
        self.keep = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = T.StructType([T.StructField("n", T.LongType()), T.StructField("last_us", T.LongType()), T.StructField("last_type", T.StringType()), T.StructField("last_id", T.LongType())])
        self.handle, self.state = handle, handle.getMapState("session", USER, fields)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._put({user: own for user, *own in zip(*(initialState[c].tolist() for c in ("user_id", "n", "last_us", "last_type", "last_id")), strict=True)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept, users = self.state.exists(), {}
        for part in rows:
            part = part.sort_values(["user_id", "at", "event_id"])
            ids = part["user_id"].to_numpy()
            last = np.append(np.flatnonzero(ids[1:] != ids[:-1]), len(ids) - 1)
            counts = np.diff(last, prepend=-1)
            final = part.iloc[last]
            for user, more, at, kind, event in zip(final["user_id"].tolist(), counts.tolist(), final["at"].tolist(), final["event_type"].tolist(), final["event_id"].tolist(), strict=True):
                if user not in users:
                    users[user] = (self.state.getValue((user,)) if kept else None) or (0, NEVER, None, NEVER)
                n, *before = users[user]
                users[user] = (n + more, at, kind, event) if (at, event) >= (before[0], before[2]) else (n + more, *before)
        self._put(users)
        yield pd.DataFrame({"bucket": key[0], "user_id": list(users), **{c: [own[i] for own in users.values()] for i, c in enumerate(("n", "at", "last_type"))}})

    def _put(self, users: dict) -> None:
        for user, own in users.items():
            self.state.updateValue((user,), tuple(own))
        self.handle.registerTimer(min(self._end(own[1]) for own in users.values()))

    def _end(self, last_us: int) -> int:
        return last_us // 1000 + self.keep

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left = timerValues.getCurrentWatermarkInMs(), []
        for user, own in list(self.state.iterator()):
            end = self._end(own[1])
            if end <= now:
                self.state.removeKey(user)
            else:
                left.append(end)
        if left:
            self.handle.registerTimer(min(left))
        return iter(())

    def close(self) -> None:
        pass


def session_state(events: DataFrame, keep_ms: int = KEEP_MS, snapshot: DataFrame | None = None, delay: str = "7 days", buckets: int = BUCKETS) -> DataFrame:
    """user_id, n, last_ts, last_type after each batch; events later than the delay are dropped; snapshot: such rows of an
    earlier state to begin from, with last_id (the last event's id, which decides between equal times) if it is known."""
    schema = "bucket long, user_id long, n long, at long, last_type string"
    begun = None
    if snapshot is not None:
        last = F.coalesce("last_id", F.lit(NEVER)) if "last_id" in snapshot.columns else F.lit(NEVER)
        begun = snapshot.select("n", F.unix_micros("last_ts").alias("last_us"), "last_type", last.alias("last_id"), *bucketed(buckets)).groupBy("bucket")
    own = events.select("event_id", "ts", F.unix_micros("ts").alias("at"), "event_type", *bucketed(buckets)).withWatermark("ts", delay)
    states = own.groupBy("bucket").transformWithStateInPandas(SessionState(keep_ms), outputStructType=schema, outputMode="Update", timeMode="EventTime", initialState=begun)
    return states.select(user_of(), "n", F.timestamp_micros("at").alias("last_ts"), "last_type")


def drained(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """What a stream yields over all that is there now: each batch is written as a table (complete mode: the last one stays).

    A folder may be given to go on from its checkpoint later.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    run = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)
