"""Queries of routing, memory, guardrails and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import guard as G
from ..operators import memory as M
from ..operators import rate as T
from ..operators import routing as Q
from ..operators import sketches as K
from ..operators import uploads as U
from ..operators.index import index_of
from ..sources.manifest import uploads
from ..sources.shared import kept, shared_folder
from ..sources.tables import events, table
from .registry import query
from .retrieval import BM, DENSE, TERMS, bm25_top, documents, items
from .uploads import O

THRESHOLD = 60.0
USERS = "u as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn)::int as nth from conversations where role = 'user')"
GOLD = "gold as (select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text))"
JUDGED = f"{BM}, {GOLD}, j as (select bmr.item_id, bmr.doc_id, rank, case when gold.doc_id is null then 0 else 1 end as rel from bmr left join gold on gold.item_id = bmr.item_id and gold.doc_id = bmr.doc_id where rank <= 10 and bmr.item_id in (select item_id from gold))"
ANSWERS = """t as (select conv_id, turn, role, text as answer, lag(text) over (partition by conv_id order by turn) as question, lag(role) over (partition by conv_id order by turn) as before from conversations),
 a as (select conv_id, turn, answer, question from t where role = 'assistant' and before = 'user')"""
WORDS = f"w as (select conv_id, turn, list_distinct({TERMS.format('answer')}) as a, list_distinct({TERMS.format('question')}) as q from a)"


def conversations(spark, sf):
    return table(spark, sf, "conversations")


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def asked(spark, sf):
    return vectors(spark, sf).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.col("label").alias("user"))


def strong(spark, sf):
    return bm25_top(spark, sf, 1).where(F.col("score") >= THRESHOLD)


def judged(spark, sf):
    """Both lists come from one narrowed index; the relevant documents are met more than once, so they are written."""
    index = index_of(spark, f"{sf}/documents.parquet").narrowed(items(spark, sf))
    relevant = kept(E.gold(items(spark, sf), documents(spark, sf), index), shared_folder(spark, "judged"), "relevant")
    return E.judged(bm25_top(spark, sf, 10, index), relevant), relevant


@query("q01_route", f"with {BM} select item_id, case when coalesce(score, 0) >= {THRESHOLD} then 'grounded' else 'general' end as route from benchmark left join (select * from bmr where rank = 1) using (item_id)")
def _route(spark, sf):
    return Q.routed(items(spark, sf).select("item_id").join(bm25_top(spark, sf, 1).select("item_id", "score"), "item_id", "left"), THRESHOLD)


@query("q02_followup", f"with {USERS} select conv_id, turn, nth > 1 and length(text) < {Q.SHORT} as follow_up from u")
def _followup(spark, sf):
    return Q.follow_ups(conversations(spark, sf))


@query("q03_ambiguous", f"with {USERS} select conv_id, turn, regexp_matches(text, '{Q.DEICTIC}') as refers, regexp_matches(text, '{Q.DEICTIC}') and nth = 1 as ambiguous from u")
def _ambiguous(spark, sf):
    return Q.ambiguous(conversations(spark, sf))


@query("q04_structural", f"select conv_id, turn, lower(regexp_extract(text, '{Q.STRUCTURE}', 1)) as part, regexp_extract(text, '{Q.STRUCTURE}', 2)::int as number from conversations where regexp_matches(text, '{Q.STRUCTURE}')")
def _structural(spark, sf):
    own = conversations(spark, sf).select("conv_id", "turn", Q.structural(F.col("text")).alias("s")).where("s is not null")
    return own.select("conv_id", "turn", "s.part", "s.number")


@query("q05_abstain", f"with {BM} select item_id from benchmark where item_id not in (select item_id from bmr where rank = 1 and score >= {THRESHOLD})")
def _abstain(spark, sf):
    return Q.abstained(items(spark, sf).select("item_id"), strong(spark, sf))


@query(
    "q06_resolve",
    f"""with {BM}, t as (select item_id // 10 as session, item_id % 10 as turn, doc_id from benchmark left join (select item_id, doc_id from bmr where rank = 1 and score >= {THRESHOLD}) using (item_id))
    select session, turn, last_value(doc_id ignore nulls) over (partition by session order by turn rows between unbounded preceding and current row) as doc_id from t""",
)
def _resolve(spark, sf):
    """Ten items in turn stand in for a session."""
    own = items(spark, sf).select("item_id").join(strong(spark, sf).select("item_id", "doc_id"), "item_id", "left")
    return Q.resolved(own.selectExpr("item_id div 10 as session", "item_id % 10 as turn", "doc_id"))


@query("m01_session", "select conv_id, count(*)::bigint as n_turns, max(turn) as last_turn, arg_max(role, turn) as last_role, arg_max(text, turn) filter (where role = 'user') as last_user_text from conversations group by conv_id")
def _session(spark, sf):
    return M.session_state(conversations(spark, sf))


@query("m02_cache", f"with {DENSE.format('a.vec_id % 100 = 0')} select q.vec_id as query_id, case when score >= 0.45 then dnr.vec_id end as response_id, case when score >= 0.45 then score end as score, coalesce(score >= 0.45, false) as hit from (select vec_id from embeddings where vec_id % 100 = 0) q left join dnr on dnr.query_id = q.vec_id and rank = 1")
def _cache(spark, sf):
    return M.cache_lookup(asked(spark, sf), vectors(spark, sf), 0.45)


@query("m03_memory", f"with {DENSE.format('a.vec_id % 100 = 0 and a.label = b.label')} select query_id, vec_id, score, rank from dnr where rank <= 3")
def _memory(spark, sf):
    return M.recall(asked(spark, sf), vectors(spark, sf), 3)


@query("m04_longterm", "select user_id, count(*)::bigint as n_events, count(distinct event_type)::bigint as n_types, round(sum(value), 4) as total, min(ts) as first_ts, max(ts) as last_ts from events group by user_id")
def _longterm(spark, sf):
    return M.long_term(table(spark, sf, "events"))


@query("m05_recover", "select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as history from conversations group by conv_id")
def _recover(spark, sf):
    return M.recovered(conversations(spark, sf))


@query("g01_isolation", f"with {DENSE.format('a.vec_id % 100 = 0 and a.label = b.label')} select query_id, count(*)::bigint as n, 0::bigint as leaked from dnr where rank <= 3 group by query_id")
def _isolation(spark, sf):
    own = vectors(spark, sf).select("vec_id", F.col("label").alias("owner"))
    found = M.recall(asked(spark, sf), vectors(spark, sf), 3).join(own, "vec_id").join(asked(spark, sf).select("query_id", "user"), "query_id")
    return found.groupBy("query_id").agg(F.count("*").alias("n"), F.sum((F.col("owner") != F.col("user")).cast("long")).alias("leaked"))


@query("g02_evidence", f"with {BM} select item_id, item_id in (select item_id from bmr where rank = 1 and score >= {THRESHOLD}) as supported from benchmark")
def _evidence(spark, sf):
    return G.evidence_state(items(spark, sf), strong(spark, sf))


@query(
    "g03_numeric",
    rf"""with s as (select doc_id, string_split(text, chr(10)) as l, text from documents), e as (select doc_id, unnest(l) as line, generate_subscripts(l, 1)::int as n from s),
    x as (select doc_id, n, list_distinct(regexp_extract_all(line, '{G.NUMBER}')) as own from e),
    o as (select a.doc_id, a.n, a.own, list_distinct(flatten(coalesce(list(b.own) filter (where b.own is not null), []))) as others from x a left join x b on a.doc_id = b.doc_id and a.n <> b.n group by a.doc_id, a.n, a.own)
    select doc_id, n as line, len(own)::int as n_numbers, len(list_filter(own, lambda v: not list_contains(others, v)))::int as n_missing from o where len(own) > 0""",
)
def _numeric(spark, sf):
    """Each line with numbers is a claim, the document's other lines its evidence."""
    return G.missing_numbers(documents(spark, sf))


@query(
    "g10_numeric_near",
    rf"""with s as (select row_number() over () as r, doc_id, string_split(text, chr(10)) as l from documents), e as (select r, doc_id, unnest(l) as t, generate_subscripts(l, 1)::int as line from s),
    x as (select distinct r, doc_id, line, unnest(regexp_extract_all(t, '{G.NUMBER}'))::double as v from e)
    select a.doc_id, a.line, count(*)::int as n_numbers, count(*) filter (where not exists (select 1 from x b where b.r = a.r and b.line <> a.line and abs(a.v - b.v) <= 0.5))::int as n_unmatched from x a group by a.r, a.doc_id, a.line""",
)
def _numeric_near(spark, sf):
    return G.unmatched_numbers(documents(spark, sf), 0.5)


@query("g11_rate_frame", "select event_id, user_id, count(*) over (partition by user_id order by ts range between interval '6 hours' preceding and current row)::bigint as n from events")
def _rate_frame(spark, sf):
    return T.frame_counts(events(spark, sf), 6 * 3600)


@query(
    "g12_token_bucket",
    """with recursive e as (select user_id, event_id, floor(epoch(ts))::bigint as s, row_number() over (partition by user_id order by floor(epoch(ts)), event_id) as n from events),
    f as (select user_id, event_id, n, s, true as allowed, 36000::bigint as credits from e where n = 1 union all
      select e.user_id, e.event_id, e.n, e.s, least(54000, f.credits + e.s - f.s) >= 18000, least(54000, f.credits + e.s - f.s) - case when least(54000, f.credits + e.s - f.s) >= 18000 then 18000 else 0 end from f join e on e.user_id = f.user_id and e.n = f.n + 1)
    select event_id, user_id, allowed, credits::bigint as credits from f""",
)
def _token_bucket(spark, sf):
    """Three tokens, one back in five hours."""
    return T.token_bucket(events(spark, sf), 3, 5 * 3600)


@query("g04_grounded", f"with {ANSWERS}, {WORDS} select conv_id, turn, round(case when len(a) > 0 then len(list_intersect(a, q)) / len(a)::double else 0 end, 6) as grounded from w")
def _grounded(spark, sf):
    return E.answers(conversations(spark, sf)).select("conv_id", "turn", F.round(G.groundedness(F.col("answer"), F.col("question")), 6).alias("grounded"))


@query("g05_fallback", "select event_id, coalesce(case when event_type = 'click' then json_extract_string(props, '$.k') end, event_type) as model from events")
def _fallback(spark, sf):
    primary = F.when(F.col("event_type") == "click", F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").select("event_id", G.fallback(primary, F.col("event_type")).alias("model"))


@query("g06_rate", "select user_id, date_trunc('hour', ts) as start, count(*)::bigint as n from events group by 1, 2 having count(*) >= 2")
def _rate(spark, sf):
    own = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return G.over_limit(own, "1 hour", 2).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("g07_errors", f"""{O} select doc_id, '{{"status":' || status || ',"detail":"' || detail || '"}}' as body from o where status <> 201""")
def _errors(spark, sf):
    return U.outcome(uploads(spark, sf)).where("status <> 201").select("doc_id", G.error_body(F.col("status"), F.col("detail")).alias("body"))


@query(
    "g08_retry",
    f"""{O}, r as (select doc_id, original_filename, suffix, size_bytes, case when status = 400 and detail = '{U.BAD_TYPE}' then 2 else 1 end as attempt, status from o)
    select doc_id, attempt, case when attempt = 1 then status when size_bytes > {U.MAX_BYTES} then 413 when size_bytes = 0 then 400 else 201 end as status from r""",
)
def _retry(spark, sf):
    """Files rejected for their content type go once more, under the type of their suffix."""
    first = U.outcome(uploads(spark, sf))
    failed = F.col("detail") == U.BAD_TYPE
    guess = F.when(U.suffix(F.col("original_filename")) == ".pdf", "application/pdf").when(U.suffix(F.col("original_filename")) == ".png", "image/png").otherwise("image/jpeg")
    again = U.outcome(first.where(failed).drop("status", "detail", "file_retained").withColumn("content_type", guess))
    return first.where(~failed).select("doc_id", F.lit(1).alias("attempt"), "status").unionByName(again.select("doc_id", F.lit(2).alias("attempt"), "status"))


@query("e01_coverage", f"with {JUDGED}, k as (select item_id, max(rel) as hit from j group by item_id) select count(*)::bigint as n, round(avg(hit), 6) as coverage from k")
def _coverage(spark, sf):
    return E.coverage(judged(spark, sf)[0])


@query("e02_precision", f"with {JUDGED}, p as (select item_id, rel, sum(rel) over (partition by item_id order by rank rows between unbounded preceding and current row) / rank::double as p from j) select item_id, round(coalesce(sum(p * rel) / nullif(sum(rel), 0), 0), 6) as precision from p group by item_id")
def _precision(spark, sf):
    return E.precision(judged(spark, sf)[0])


@query("e03_recall", f"with {JUDGED} select j.item_id, round(sum(rel) / any_value(t.total)::double, 6) as recall from j join (select item_id, count(*) as total from gold group by item_id) t on t.item_id = j.item_id group by j.item_id")
def _recall(spark, sf):
    ranked, relevant = judged(spark, sf)
    return E.recall(ranked, relevant)


@query("e04_faithfulness_lex", f"with {ANSWERS}, {WORDS} select conv_id, round(avg(case when len(a) > 0 then len(list_intersect(a, q)) / len(a)::double else 0 end), 5) as faithfulness from w group by conv_id")
def _faithful(spark, sf):
    own = E.answers(conversations(spark, sf)).select("conv_id", G.groundedness(F.col("answer"), F.col("question")).alias("f"))
    return own.groupBy("conv_id").agg(F.round(F.avg("f"), 5).alias("faithfulness"))


@query("e05_relevancy_lex", f"with {ANSWERS}, {WORDS} select conv_id, turn, round(case when len(a) + len(q) > 0 then len(list_intersect(a, q)) / (len(a) + len(q) - len(list_intersect(a, q)))::double else 0 end, 6) as relevancy from w")
def _relevancy(spark, sf):
    return E.answers(conversations(spark, sf)).select("conv_id", "turn", E.relevancy(F.col("answer"), F.col("question")).alias("relevancy"))


TOP1 = f"{BM}, p as (select item_id, q.query, d.text, q.t as e, list_distinct(d.t) as a from bmr join q using (item_id) join d using (doc_id) where rank = 1)"


@query("e06_correctness_lex", f"with {TOP1} select item_id, round(case when len(a) + len(e) > 0 then 2 * len(list_intersect(a, e)) / (len(a) + len(e))::double else 0 end, 6) as f1 from p")
def _correct(spark, sf):
    return _top_texts(spark, sf).select("item_id", E.correctness(F.col("text"), F.col("query")).alias("f1"))


@query("e07_entity_lex", rf"with {TOP1}, x as (select item_id, list_distinct(regexp_extract_all(query, '{E.ENTITY}')) as e, regexp_extract_all(text, '{E.ENTITY}') as a from p) select item_id, round(case when len(e) > 0 then len(list_intersect(e, a)) / len(e)::double else 0 end, 6) as entity_recall from x")
def _entity(spark, sf):
    return _top_texts(spark, sf).select("item_id", E.entity_recall(F.col("text"), F.col("query")).alias("entity_recall"))


def _top_texts(spark, sf):
    best = bm25_top(spark, sf, 1).select("item_id", "doc_id")
    return best.join(items(spark, sf).select("item_id", F.col("text").alias("query")), "item_id").join(documents(spark, sf), "doc_id")


@query(
    "e08_cosine",
    f"""with {ANSWERS}, n as (select count(*) as n from conversations), d as (select term, ln((n + 1.0) / (count(*) + 1)) + 1 as idf from (select unnest(list_distinct({TERMS.format('text')})) as term from conversations), n group by term, n),
    x as (select conv_id, turn, unnest({TERMS.format('answer')}) as term, 1 as a, 0 as q from a union all select conv_id, turn, unnest({TERMS.format('question')}), 0, 1 from a),
    c as (select conv_id, turn, term, sum(a) as a, sum(q) as q from x group by all),
    s as (select conv_id, turn, sum(a * q * idf * idf) / nullif(sqrt(sum(a * a * idf * idf) * sum(q * q * idf * idf)), 0) as c from c join d using (term) group by conv_id, turn)
    select a.conv_id, a.turn, round(coalesce(c, 0), 6) as cosine from a left join s on s.conv_id = a.conv_id and s.turn = a.turn""",
)
def _cosine(spark, sf):
    own = conversations(spark, sf)
    return E.cosine(E.answers(own), own.select("text"))


@query("m06_rollup", "select event_type, count(*)::bigint as n, true as users_hold, true as median_holds from events group by event_type")
def _rollup(spark, sf):
    """Sketches by type and day, rolled up by type: users within 2 % of the exact count, the median within 2 % of rank."""
    rows = table(spark, sf, "events")
    daily = K.sketched(rows.withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id", "value")
    found = K.estimated(K.merged(daily, ["event_type"]))
    exact = rows.join(found.select("event_type", "quantile"), "event_type").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.avg((F.col("value") < F.col("quantile")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("quantile")).cast("double")).alias("to"))
    holds = (F.abs(F.col("n_distinct") - F.col("users")) <= 0.02 * F.col("users")).alias("users_hold")
    return found.join(exact, "event_type").select("event_type", "n", holds, ((F.col("below") <= 0.52) & (F.col("to") >= 0.48)).alias("median_holds"))
