"""Queries of the streaming operators, and the batch SQL that they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..sources.tables import events as event_rows
from ..sources.tables import table
from ..streaming import operators as S
from ..streaming import stateful as K
from .registry import query


def events(spark, sf):
    return S.event_stream(spark, f"{sf}/events.parquet")


def plain(df, *times):
    return df.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})


@query("s01_tumbling", "select user_id, date_trunc('minute', ts) as start, count(*)::bigint as n from events group by 1, 2")
def _tumbling(spark, sf):
    return plain(S.drained(S.tumbling(events(spark, sf)), "complete"), "start")


@query(
    "s02_sliding",
    "with w as (select user_id, time_bucket(interval '5 minutes', ts) - g.g * interval '5 minutes' as start from events, (select unnest([0, 1]) as g) g) select user_id, start, count(*)::bigint as n from w group by 1, 2",
)
def _sliding(spark, sf):
    return plain(S.drained(S.sliding(events(spark, sf)), "complete"), "start")


@query(
    "s03_sessions",
    """with l as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events),
    s as (select user_id, ts, sum(case when before is null or ts - before >= interval '30 minutes' then 1 else 0 end) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from l)
    select user_id, min(ts) as start, max(ts) + interval '30 minutes' as "end", count(*)::bigint as n from s group by user_id, k""",
)
def _sessions(spark, sf):
    return plain(S.drained(S.sessions(events(spark, sf)), "complete"), "start", "end")


@query("s04_session_state", "select user_id, count(*)::bigint as n, max(ts) as last_ts, arg_max(event_type, (ts, event_id)) as last_type from events group by user_id")
def _state(spark, sf):
    """The state after all events: of each user's rows, that with the most of them."""
    every = S.drained(S.session_state(events(spark, sf)), "update")
    last = every.groupBy("user_id").agg(F.max_by(F.struct("n", "last_ts", "last_type"), "n").alias("s"))
    return plain(last.select("user_id", "s.n", "s.last_ts", "s.last_type"), "last_ts")


@query("s05_distinct", "select distinct event_id, user_id, event_type from events")
def _distinct(spark, sf):
    return S.drained(S.distinct_events(events(spark, sf)), "append").select("event_id", "user_id", "event_type")


@query("s06_late", "select user_id, date_trunc('hour', ts) as start, count(*)::bigint as n from events where date_trunc('hour', ts) + interval '1 hour' <= (select max(ts) - interval '1 hour' from events) group by 1, 2")
def _late(spark, sf):
    """Append mode: only the windows that the watermark has closed."""
    return plain(S.drained(S.tumbling(events(spark, sf), "1 hour"), "append"), "start")


MIDDLE = "(select min(ts) + (max(ts) - min(ts)) / 2 as cut from events)"


@query(
    "s07_recovery",
    f"select user_id, count(*) filter (where ts < cut)::bigint as n_before, count(*)::bigint as n, max(ts) as last_ts, arg_max(event_type, (ts, event_id)) as last_type, count(*)::bigint as n_restarted from events, {MIDDLE} group by user_id",
)
def _recovery(spark, sf):
    """Half of the events, then the state as of that batch; then the rest, once from the checkpoint and once in a new
    stream that begins from the snapshot."""
    rows, folder, other = event_rows(spark, sf), shared_folder(spark, "stream"), shared_folder(spark, "stream")
    cut = rows.agg((F.unix_micros(F.min("ts")) + F.unix_micros(F.max("ts"))).alias("c")).first()[0] / 2
    early = F.unix_micros("ts") < cut
    rows.where(early).write.parquet(f"{folder}/in")
    S.drained(S.session_state(S.event_stream(spark, f"{folder}/in")), "update", folder)
    stopped = K.batches_of(spark, f"{folder}/checkpoint")[1]
    rows.where(~early).write.parquet(f"{other}/in")
    rows.where(~early).write.mode("append").parquet(f"{folder}/in")
    S.drained(S.session_state(S.event_stream(spark, f"{folder}/in")), "update", folder)
    before = K.sessions_of(spark, f"{folder}/checkpoint", stopped)
    after = K.sessions_of(spark, f"{folder}/checkpoint")
    S.drained(S.session_state(S.event_stream(spark, f"{other}/in"), snapshot=before), "update", other)
    again = K.sessions_of(spark, f"{other}/checkpoint").select("user_id", F.col("n").alias("n_restarted"))
    own = after.select("user_id", "n", "last_ts", "last_type").join(before.select("user_id", F.col("n").alias("n_before")), "user_id", "left").join(again, "user_id")
    return plain(own.withColumn("n_before", F.coalesce("n_before", F.lit(0)).cast("long")), "last_ts").select("user_id", "n_before", "n", "last_ts", "last_type", "n_restarted")


@query(
    "s08_late_kept",
    """with m as (select user_id, max(ts) - interval '1 hour' as bar from events where event_id % 7 <> 0 group by user_id)
    select event_id, e.user_id, ts, event_id % 7 = 0 and ts < bar as late, case when event_id % 7 = 0 then greatest(epoch_us(bar) - epoch_us(ts), 0) else 0 end::bigint as behind_us
    from events e left join m on m.user_id = e.user_id where event_id % 7 <> 0 or bar is not null union all
    select event_id, user_id, ts, false, 0::bigint from events where event_id % 7 = 0 and user_id not in (select user_id from m)""",
)
def _late_kept(spark, sf):
    """Each seventh event comes in a second batch: the table of rows on time and the side table of late ones are all rows."""
    rows, folder = event_rows(spark, sf), shared_folder(spark, "stream")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    for part in (rows.where("event_id % 7 <> 0"), rows.where("event_id % 7 = 0")):
        part.write.mode("append").parquet(f"{folder}/in")
        on_time, late = K.keep_late(K.marked_late(S.event_stream(spark, f"{folder}/in"), 3_600_000), folder)
    return plain(on_time.unionByName(late), "ts").select("event_id", "user_id", "ts", "late", "behind_us")


@query(
    "s09_cache_stream",
    """with r as (select event_id, user_id, ts, event_id % n as vec_id from events, (select count(*) as n from embeddings)),
    p as (select a.event_id, b.vec_id as k, max((b.ts, b.event_id)) as last from r a join r b on a.user_id = b.user_id and (b.ts, b.event_id) < (a.ts, a.event_id) and b.ts > a.ts - interval '7 days' group by 1, 2),
    c as (select event_id, k, row_number() over (partition by event_id order by last desc) as age from p),
    s as (select r.event_id, k, round(list_inner_product(x.embedding::double[], y.embedding::double[]), 6) as score from r join c on c.event_id = r.event_id and age <= 8 join embeddings x on x.vec_id = r.vec_id join embeddings y on y.vec_id = k),
    b as (select *, row_number() over (partition by event_id order by score desc, k) as place from s)
    select r.event_id, user_id, r.vec_id, coalesce(score >= 0.3, false) as hit, case when score >= 0.3 then k end as response_id, case when score >= 0.3 then score end as score
    from r left join b on b.event_id = r.event_id and place = 1""",
)
def _cache_stream(spark, sf):
    """The events ask in turn, each for one of the vectors."""
    vectors = table(spark, sf, "embeddings").select("vec_id", K.packed("embedding", "f4"))
    asked = events(spark, sf).withColumn("vec_id", F.col("event_id") % vectors.count())
    return S.drained(K.semantic_cache(asked.join(vectors, "vec_id"), 0.3, kind="f4"), "append")
