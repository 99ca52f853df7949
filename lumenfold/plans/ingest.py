"""Queries of the ingestion operators."""

from __future__ import annotations

from ..operators import ingest as I
from ..operators import near as N
from ..sources.tables import table
from .registry import query
from .retrieval import TERMS

BLOCKS = rf"""b as (select page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '{I.BOILERPLATE.replace(chr(92) + '"', '"')}', ' ', 'g'), '{I.INLINE}', '', 'g'), '{I.BLOCK}') as m from pages),
 e as (select page_id, unnest(m) as m, generate_subscripts(m, 1)::int as ordinal from b),
 k as (select page_id, ordinal, lower(regexp_extract(m, '^<([A-Za-z0-9]+)', 1)) as tag, trim(regexp_extract(m, '(?s)>(.*)$', 1), ' ') as text from e)"""
KIND = "case when tag in ('title', 'h1', 'h2', 'h3') then 'heading' when tag = 'li' then 'list_item' when tag = 'figcaption' then 'caption' else 'paragraph' end"
SHINGLES = rf"""w as (select doc_id, {TERMS.format('text')} as w from documents),
 s as (select doc_id, case when len(w) > 0 then list_distinct(list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) else [] end as s from w)"""


def documents(spark, sf):
    return table(spark, sf, "documents")


@query("i01_html_blocks", f"with {BLOCKS} select page_id, ordinal, {KIND} as kind, text from k where text <> ''")
def _blocks(spark, sf):
    return I.blocks(table(spark, sf, "pages"))


@query("i02_headings", f"with {BLOCKS} select page_id, ordinal, text from k where text <> '' and {KIND} = 'heading'")
def _headings(spark, sf):
    return I.blocks(table(spark, sf, "pages")).where("kind = 'heading'").select("page_id", "ordinal", "text")


@query("i03_equations", f"with e as (select doc_id, regexp_extract_all(text, '{I.EQUATION}') as m from documents) select doc_id, generate_subscripts(m, 1)::int as ordinal, unnest(m) as equation from e")
def _equations(spark, sf):
    return I.equations(documents(spark, sf))


@query(
    "i04_captions",
    f"""with e as (select page_id, regexp_extract_all(html, '{I.CAPTION.replace(chr(92) + '"', '"')}') as m from pages), f as (select page_id, generate_subscripts(m, 1)::int as ordinal, unnest(m) as m from e)
    select page_id, ordinal, trim(case when lower(m) like '<img%' then regexp_extract(m, '(?is)alt="([^"]*)"', 1) else regexp_extract(m, '(?s)>(.*)$', 1) end, ' ') as text from f""",
)
def _captions(spark, sf):
    return I.captions(table(spark, sf, "pages"))


@query(
    "i05_chunks",
    """with c as (select doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 1000) / 800.0))::bigint + 1))::int as chunk_id from documents)
    select doc_id, chunk_id, chunk_id * 800 as start, least(chunk_id * 800 + 1000, length(text))::int as "end", substr(text, chunk_id * 800 + 1, 1000) as text from c""",
)
def _chunks(spark, sf):
    return I.chunks(documents(spark, sf))


@query("i06_exact_dedup", "select doc_id, min(doc_id) over (partition by text) as keeper, doc_id = min(doc_id) over (partition by text) as kept from documents")
def _exact(spark, sf):
    return I.exact_duplicates(documents(spark, sf))


NEAR = f"""with {SHINGLES}, k as (select doc_id, list_sort(s) as s, len(s) as n from s),
    c as (select doc_id, n, case when n > 0 then min(doc_id) over (partition by array_to_string(s, '|')) else doc_id end as class_id, s from k),
    x as (select class_id, n, unnest(s) as x from c where doc_id = class_id),
    p as (select a.class_id as a, b.class_id as b, count(*) as shared, any_value(a.n) as na, any_value(b.n) as nb from x a join x b on a.x = b.x and a.class_id <> b.class_id group by 1, 2),
    l as (select a, count(*) as n_links from p where 5 * shared >= 4 * (na + nb - shared) group by a)
    select doc_id, class_id, coalesce(n_links, 0)::bigint as n_links from c left join l on l.a = c.class_id"""


@query("i07_near_dup", NEAR)
def _near(spark, sf):
    return N.near_duplicates(documents(spark, sf), 0.8, N.prefix_buckets)


@query("i11_minhash_join", NEAR)
def _minhash_join(spark, sf):
    """By bands: the SQL compares all pairs, so every link is found here."""
    return N.near_duplicates(documents(spark, sf), 0.8, N.band_buckets)


@query("i08_minhash", f"with {SHINGLES}, e as (select doc_id, unnest(s) as x from s) select doc_id, g.g::int as seed, min(md5(g.g || ':' || x)) as minhash from e, (select unnest([0, 1, 2, 3]) as g) g group by doc_id, g.g")
def _minhash(spark, sf):
    return I.minhash(documents(spark, sf))


@query("i09_scope", f"select doc_id, case when regexp_matches(text, '{I.SCOPE}') then 'out_of_scope' else 'in_scope' end as scope from documents")
def _scope(spark, sf):
    return I.scope(documents(spark, sf))


@query("i10_validation", "select doc_id, case when trim(coalesce(text, ''), ' ') = '' then 'empty' when coalesce(n_chars, -1) <> length(text) then 'wrong_length' when coalesce(lang, '') not in ('en', 'fr', 'de', 'es') then 'language' else 'ok' end as verdict from documents")
def _validated(spark, sf):
    return I.validated(documents(spark, sf))
