"""Queries of the intake operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import page_table
from ..functions.text import suffix
from ..operators import uploads as U
from ..sources.manifest import SQL as M
from ..sources import stored
from ..sources.manifest import uploads
from ..sources.shared import shared_folder
from .registry import query

SERVICE = "lumenfold"
SUFFIX = r"lower(regexp_extract(regexp_extract(regexp_replace(original_filename, '(/\.?)+$', ''), '([^/]*)$', 1), '(?s)^.+(\.[^.]+)$', 1))"
EXTENSIONS, TYPES = ", ".join(f"'{x}'" for x in U.EXTENSIONS), ", ".join(f"'{x}'" for x in U.CONTENT_TYPES)
CONDITIONS = ["coalesce(original_filename, '') = ''", f"suffix not in ({EXTENSIONS})", f"coalesce(content_type, '') not in ({TYPES})", f"size_bytes > {U.MAX_BYTES}", "size_bytes = 0"]
CHAIN = " ".join(f"when {c} then {{}}" for c in CONDITIONS)
STATUS = f"case {CHAIN.format(*(c[0] for c in U.CHECKS))} else 201 end"
DETAIL = "case " + CHAIN.format(*(f"'{c[1]}'" for c in U.CHECKS)) + f" else '{U.SUCCESS}' end"
O = f"with {M}, s as (select *, {SUFFIX} as suffix from m), o as (select *, {STATUS} as status, {DETAIL} as detail from s)"
#: What str.strip() removes, spelled out.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
PAGES = rf"p as (select doc_id, t.i::int as page_number, regexp_replace(t.t, '\A{WHITE}|{WHITE}\z', '', 'g') as text from o, (select doc_id as d, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from o) t where t.d = o.doc_id and suffix = '.pdf')"

query("u01_health", f"select '{SERVICE} API is running' as message")(lambda spark, sf: U.health(spark, SERVICE))


@query("u02_suffix", f"{O} select doc_id, original_filename, suffix from o")
def _suffix(spark, sf):
    return uploads(spark, sf).select("doc_id", "original_filename", suffix(F.col("original_filename")).alias("suffix"))


for _name, _detail in (("u03_missing_name", U.NO_NAME), ("u04_bad_ext", U.BAD_EXTENSION), ("u05_bad_mime", U.BAD_TYPE), ("u06_too_large", U.TOO_LARGE), ("u07_empty", U.EMPTY)):
    query(_name, f"{O} select doc_id, original_filename, content_type, size_bytes, status from o where detail = '{_detail}'")(
        lambda spark, sf, d=_detail: U.rejected(uploads(spark, sf), d).select("doc_id", "original_filename", "content_type", "size_bytes", "status")
    )


@query("u08_outcome", f"{O} select doc_id, status, detail, status in (201, 422) as file_retained from o")
def _outcome(spark, sf):
    return U.outcome(uploads(spark, sf)).select("doc_id", "status", "detail", "file_retained")


@query("u09_accepted", f"{O} select doc_id, original_filename, size_bytes from o where status = 201")
def _accepted(spark, sf):
    return U.outcome(uploads(spark, sf)).where("file_retained").select("doc_id", "original_filename", "size_bytes")


@query(
    "u10_chunk_plan",
    f"{O} select doc_id, ceil(size_bytes / {U.CHUNK_BYTES}.0)::bigint as n_chunks, ceil(size_bytes / {U.CHUNK_BYTES}.0)::bigint + 1 as n_reads, size_bytes as summed_bytes from o where status = 201",
)
def _chunks(spark, sf):
    own = U.outcome(uploads(spark, sf)).where("status = 201").withColumn("c", U.chunk_sizes(F.col("size_bytes")))
    return own.select("doc_id", F.size("c").cast("long").alias("n_chunks"), (F.size("c") + 1).cast("long").alias("n_reads"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("summed_bytes"))


@query("u11_pages", f"{O}, {PAGES} select doc_id, page_number, text from p")
def _pages(spark, sf):
    return U.pages(uploads(spark, sf))


@query("u12_page_array", f"{O}, {PAGES} select doc_id, count(*)::int as number_of_pages, string_agg(page_number || ':' || text, chr(10) order by page_number) as pages from p group by doc_id")
def _page_array(spark, sf):
    own = U.collected(U.pages(uploads(spark, sf)))
    return own.select("doc_id", F.size("extracted_pages").alias("number_of_pages"), F.array_join(F.transform("extracted_pages", lambda p: F.concat(p.page_number.cast("string"), F.lit(":"), p.text)), "\n").alias("pages"))


@query(
    "u13_response",
    f"""{O}, {PAGES}, a as (select doc_id, count(*) as n, string_agg(page_number || ':' || text, chr(10) order by page_number) as pages from p group by doc_id)
    select '{U.SUCCESS}' as message, original_filename, md5(o.doc_id::varchar) || suffix as saved_filename, content_type, size_bytes,
      coalesce(a.n, 0)::int as number_of_pages, coalesce(a.pages, '') as extracted_pages from o left join a on a.doc_id = o.doc_id where status = 201""",
)
def _response(spark, sf):
    flat = F.array_join(F.transform("extracted_pages", lambda p: F.concat(p.page_number.cast("string"), F.lit(":"), p.text)), "\n")
    return U.response(uploads(spark, sf)).withColumn("extracted_pages", flat)


@query("u14_status_counts", f"{O} select status, detail, count(*)::bigint as n, sum(size_bytes)::bigint as bytes from o group by status, detail")
def _counts(spark, sf):
    return U.outcome(uploads(spark, sf)).groupBy("status", "detail").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query("u15_saved_name", f"{O} select doc_id, md5(doc_id::varchar) || suffix as saved_filename, 'uploads/' || md5(doc_id::varchar) || suffix as path from o where status = 201")
def _saved(spark, sf):
    name = U.saved_name(F.col("doc_id"), F.col("original_filename"))
    return U.outcome(uploads(spark, sf)).where("status = 201").select("doc_id", name.alias("saved_filename"), F.concat_ws("/", F.lit("uploads"), name).alias("path"))


@query(
    "u16_residual_files",
    f"{O} select doc_id, case when suffix = '.pdf' and instr(text, '@') > 0 then 422 else 201 end as status from o where status = 201",
)
def _residual(spark, sf):
    """Files on disk after intake; PDFs whose text has an at sign stand in for those that don't parse."""
    return U.outcome(uploads(spark, sf), F.instr("text", "@") > 0).where("file_retained").select("doc_id", "status")


@query("u17_mime_default", f"with {M} select coalesce(nullif(content_type, ''), '{U.UNKNOWN_TYPE}') as content_type, count(*)::bigint as n from m group by 1")
def _types(spark, sf):
    return uploads(spark, sf).groupBy(U.reported_type(F.col("content_type")).alias("content_type")).agg(F.count("*").alias("n"))


#: What an upload's bytes are: its text, or that a thousand times over (no more of it than shows that it's too large).
CONTENT = f"encode(case when doc_id % 11 = 0 then '' when doc_id % 7 = 0 then repeat(text, cast(least(1000, {U.MAX_BYTES + U.CHUNK_BYTES} div greatest(octet_length(text), 1) + 1) as int)) else text end, 'utf-8')"


def saved(spark, sf, folder):
    """The manifest's uploads in a store that holds them compressed: raw, it takes forty times the documents."""
    own = uploads(spark, sf).selectExpr("doc_id as upload_id", "original_filename", "content_type", f"{CONTENT} as content")
    return stored.intake(own, folder, "zstd")


@query(
    "u18_intake",
    f"""{O} select doc_id, status, detail, case when status = 201 then md5(doc_id::varchar) || suffix end as saved_filename,
    case when status = 201 then ceil(size_bytes / {U.CHUNK_BYTES}.0)::bigint + 1 when status = 413 then 11 when detail = '{U.EMPTY}' then 1 end as n_reads,
    case when status = 201 then size_bytes end as n_bytes from o""",
)
def _intake(spark, sf):
    """The manifest's uploads with their bytes through the sink: outcomes as it wrote them."""
    found = saved(spark, sf, shared_folder(spark, "uploads"))
    return found.select(F.col("upload_id").cast("long").alias("doc_id"), "status", "detail", "saved_filename", "n_reads", F.when(F.col("status") == 201, F.col("n_bytes")).alias("n_bytes"))


@query("u19_stored_chunks", f"""{O}, c as (select doc_id, suffix, size_bytes, unnest(range(0, ceil(size_bytes / {U.CHUNK_BYTES}.0)::bigint)) as number from o where status = 201)
    select md5(doc_id::varchar) || suffix as saved_filename, number::int as number, least({U.CHUNK_BYTES}, size_bytes - number * {U.CHUNK_BYTES})::int as n_bytes from c""")
def _stored_chunks(spark, sf):
    """What lies in the store after the intake, chunk by chunk."""
    folder = shared_folder(spark, "uploads")
    saved(spark, sf, folder)
    return stored.chunks(spark, folder).select("saved_filename", "number", "n_bytes")


@query(
    "u20_response_json",
    f"""{O}, {PAGES}, a as (select doc_id, list({{'page_number': page_number, 'text': text}} order by page_number) as pages from p group by doc_id)
    select o.doc_id, to_json({{'message': '{U.SUCCESS}', 'original_filename': original_filename, 'saved_filename': md5(o.doc_id::varchar) || suffix, 'content_type': content_type,
      'size_bytes': size_bytes, 'number_of_pages': coalesce(len(pages), 0), 'extracted_pages': coalesce(pages, [])}})::varchar as body from o left join a on a.doc_id = o.doc_id where status = 201""",
)
def _response_json(spark, sf):
    return U.response_json(uploads(spark, sf))


@query("u21_page_table", f"{O}, {PAGES} select doc_id, page_number, text from p")
def _page_table(spark, sf):
    """The pages of PDFs by the table function, called from SQL."""
    page_table.register(spark)
    own = uploads(spark, sf).where(suffix(F.col("original_filename")) == ".pdf").select("doc_id", F.lit(0).alias("part"), "text")
    return spark.sql("select doc_id, page_number, text from page_table(table({own}))", own=own)
