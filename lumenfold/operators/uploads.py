"""File intake: ordered validation with the first failure reported, page records, responses.

Inputs have original_filename, content_type and size_bytes; no check reads file content, so a plan prunes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, suffix

# What is accepted, the limits, and the wording of the outcomes.
EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg")
CONTENT_TYPES = ("application/pdf", "image/png", "image/jpeg")
MAX_BYTES = 10 * 1024 * 1024
CHUNK_BYTES = 1024 * 1024
NO_NAME = "No filename was provided."
BAD_EXTENSION = "Only PDF, PNG, JPG and JPEG files are allowed."
BAD_TYPE = "Unsupported file content type."
TOO_LARGE = "File is larger than the 10 MB limit."
EMPTY = "The uploaded file is empty."
NOT_READ = "PDF text could not be extracted."
NOT_SAVED = "The file could not be saved."
SUCCESS = "File uploaded successfully."
UNKNOWN_TYPE = "unknown"

#: The checks in their order: (status, detail, condition of a failure).
CHECKS: list[tuple[int, str, callable]] = [
    (400, NO_NAME, lambda: F.col("original_filename").isNull() | (F.col("original_filename") == "")),
    (400, BAD_EXTENSION, lambda: ~suffix(F.col("original_filename")).isin(*EXTENSIONS)),
    (400, BAD_TYPE, lambda: ~F.coalesce(F.col("content_type"), F.lit("")).isin(*CONTENT_TYPES)),
    (413, TOO_LARGE, lambda: F.col("size_bytes") > MAX_BYTES),
    (400, EMPTY, lambda: F.col("size_bytes") == 0),
]


def _first(pick) -> Column:
    out = None
    for check in CHECKS:
        out = F.when(check[2](), F.lit(pick(check))) if out is None else out.when(check[2](), F.lit(pick(check)))
    return out


def outcome(uploads: DataFrame, unreadable: Column | None = None) -> DataFrame:
    """uploads with status, detail and file_retained. unreadable: whether a PDF's text can't be extracted.

    A file is kept if it is accepted, and also if it is a PDF that was saved and then failed to parse.
    """
    bad = F.lit(False) if unreadable is None else unreadable & (suffix(F.col("original_filename")) == ".pdf")
    status = F.coalesce(_first(lambda c: c[0]), F.when(bad, 422).otherwise(201))
    detail = F.coalesce(_first(lambda c: c[1]), F.when(bad, NOT_READ).otherwise(SUCCESS))
    return uploads.withColumns({"status": status, "detail": detail}).withColumn("file_retained", F.col("status").isin(201, 422))


def checked(uploads: DataFrame) -> DataFrame:
    """uploads with status and detail of the first check on name and type that fails; null where both pass.

    The checks that need a file's bytes are those of whoever reads them.
    """
    status = detail = None
    for code, text, failed in CHECKS[:3]:
        status = F.when(failed(), F.lit(code)) if status is None else status.when(failed(), F.lit(code))
        detail = F.when(failed(), F.lit(text)) if detail is None else detail.when(failed(), F.lit(text))
    return uploads.withColumns({"status": status, "detail": detail})


def rejected(uploads: DataFrame, detail: str) -> DataFrame:
    return outcome(uploads).where(F.col("detail") == detail)


def reported_type(content_type: Column) -> Column:
    return F.coalesce(F.nullif(content_type, F.lit("")), F.lit(UNKNOWN_TYPE))


def chunk_sizes(size: Column) -> Column:
    """Bytes of each read of a file: full chunks, then the rest."""
    whole = F.array_repeat(F.lit(CHUNK_BYTES).cast("long"), (F.floor(size / CHUNK_BYTES)).cast("int"))
    return F.when(size % CHUNK_BYTES == 0, whole).otherwise(F.concat(whole, F.array((size % CHUNK_BYTES).cast("long"))))


def saved_name(key: Column, name: Column) -> Column:
    """32 hex digits and the suffix. From a key, so that a task run again gives the same name."""
    return F.concat(F.md5(key.cast("string")), suffix(name))


def random_saved_name(name: Column) -> Column:
    return F.concat(F.replace(F.uuid(), F.lit("-"), F.lit("")), suffix(name))


def page_array(text: Column) -> Column:
    """Pages in order, numbered from 1, blank ones too: lines stand in for pages here."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda t, i: F.struct((i + 1).alias("page_number"), strip(t).alias("text")))


def with_pages(uploads: DataFrame) -> DataFrame:
    """extracted_pages of PDFs (by suffix, not by type); an empty array for other files."""
    none = F.array().cast("array<struct<page_number:int,text:string>>")
    return uploads.withColumn("extracted_pages", F.when(suffix(F.col("original_filename")) == ".pdf", page_array(F.col("text"))).otherwise(none))


def pages(uploads: DataFrame) -> DataFrame:
    return with_pages(uploads).select("doc_id", F.explode("extracted_pages").alias("p")).select("doc_id", "p.page_number", "p.text")


def collected(page_rows: DataFrame) -> DataFrame:
    """Page rows gathered again, in page order."""
    return page_rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("extracted_pages"))


def response(uploads: DataFrame) -> DataFrame:
    own = with_pages(outcome(uploads).where("status = 201"))
    return own.select(
        F.lit(SUCCESS).alias("message"),
        "original_filename",
        saved_name(F.col("doc_id"), F.col("original_filename")).alias("saved_filename"),
        reported_type(F.col("content_type")).alias("content_type"),
        "size_bytes",
        F.size("extracted_pages").alias("number_of_pages"),
        "extracted_pages",
    )


def response_json(uploads: DataFrame) -> DataFrame:
    """doc_id, body: the response of each accepted upload as one JSON object, its pages nested in it."""
    own = with_pages(outcome(uploads).where("status = 201"))
    body = F.struct(
        F.lit(SUCCESS).alias("message"),
        "original_filename",
        saved_name(F.col("doc_id"), F.col("original_filename")).alias("saved_filename"),
        reported_type(F.col("content_type")).alias("content_type"),
        "size_bytes",
        F.size("extracted_pages").alias("number_of_pages"),
        "extracted_pages",
    )
    return own.select("doc_id", F.to_json(body).alias("body"))


def health(spark, service: str) -> DataFrame:
    return spark.range(1).select(F.concat(F.lit(service), F.lit(" API is running")).alias("message"))
