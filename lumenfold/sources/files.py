"""File sources and sinks of the intake, and the plug-in points for parsers and models.

Parsers and models are functions given by the caller. None is bundled: without one, rows say so in their status, and no
text is made up.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import suffix
from ..operators.uploads import MAX_BYTES, NOT_READ, outcome, saved_name

PAGES = "upload_id string, status int, detail string, pages array<struct<page_number:int,text:string>>"


def landing(spark: SparkSession, folder: str, content_types: DataFrame | None = None) -> DataFrame:
    """Uploads of a landing folder: upload_id (the path), original_filename, content_type, size_bytes, content.

    content is read only where a plan asks for it. content_types: (original_filename, content_type) as declared.
    """
    files = spark.read.format("binaryFile").load(folder)
    own = files.select(F.col("path").alias("upload_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("original_filename"), F.col("length").alias("size_bytes"), "content")
    return own.join(content_types, "original_filename", "left") if content_types is not None else own.withColumn("content_type", F.lit(None).cast("string"))


def default_reader() -> Callable[[bytes], list[str]] | None:
    """A PDF reader if a library for it is installed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    return lambda data: [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def extracted(uploads: DataFrame, reader: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Page texts of accepted PDFs (upload_id, content): status 201 with pages, 422 if the reader fails on the file, whole.

    501 where no reader is at hand. The filter stands before the Python step: it isn't pushed through it.
    """
    pdfs = outcome(uploads).where((F.col("status") == 201) & (suffix(F.col("original_filename")) == ".pdf") & (F.col("size_bytes") <= MAX_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader or default_reader()
        kind = pa.list_(pa.struct([("page_number", pa.int32()), ("text", pa.string())]))
        for b in batches:
            status, detail, pages = [], [], []
            for cell in b.column(1):
                got: list[dict] = []
                if read is None:
                    status.append(501)
                    detail.append("No PDF reader is installed.")
                else:
                    try:
                        got = [{"page_number": i, "text": (t or "").strip()} for i, t in enumerate(read(cell.as_py()), 1)]
                        status.append(201)
                        detail.append("")
                    except Exception:  # whatever a parser raises on a damaged file is that file's outcome
                        status.append(422)
                        detail.append(NOT_READ)
                pages.append(got)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(status, pa.int32()), pa.array(detail, pa.string()), pa.array(pages, kind)], ["upload_id", "status", "detail", "pages"])

    return pdfs.select("upload_id", "content").mapInArrow(run, PAGES)


def store(uploads: DataFrame, folder: str) -> DataFrame:
    """Writes the files to be kept (name, content) and returns what became of every upload; rejects leave nothing behind."""
    own = outcome(uploads).withColumn("saved_filename", saved_name(F.col("upload_id"), F.col("original_filename")))
    own.where("file_retained").select("saved_filename", "content").write.mode("overwrite").parquet(folder)
    return own.drop("content")


def recognised(images: DataFrame, engine: Callable[[bytes], str] | None = None) -> DataFrame:
    """upload_id, status, text of images; without an engine status is "ocr_unavailable" and text is null."""

    def run(batches):
        for b in batches:
            text = [engine(c.as_py()) if engine else None for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["ok" if engine else "ocr_unavailable"] * len(text), pa.string()), pa.array(text, pa.string())], ["upload_id", "status", "text"])

    return images.select("upload_id", "content").mapInArrow(run, "upload_id string, status string, text string")


def generated(prompts: DataFrame, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """prompt_id, status, answer; without a model status is "model_unavailable" and answer is null."""

    def run(batches):
        for b in batches:
            answers = model(b.column(1).to_pylist()) if model else [None] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["ok" if model else "model_unavailable"] * b.num_rows, pa.string()), pa.array(answers, pa.string())], ["prompt_id", "status", "answer"])

    return prompts.select("prompt_id", "prompt").mapInArrow(run, "prompt_id long, status string, answer string")
