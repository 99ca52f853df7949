"""Uploads derived from documents: a stand-in for an upload table, the same in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table

NAME = """case doc_id % 8 when 0 then '' when 1 then concat('d', doc_id, '.pdf') when 2 then concat('D', doc_id, '.PDF')
  when 3 then concat('d', doc_id, '.png') when 4 then concat('d', doc_id, '.JPEG') when 5 then concat('d', doc_id, '.txt')
  when 6 then '.pdf' else concat('d', doc_id, '.tar.jpg') end"""
TYPE = "case doc_id % 5 when 0 then 'application/pdf' when 1 then 'image/png' when 2 then 'image/jpeg' when 3 then 'text/plain' end"
SIZE = "case when doc_id % 11 = 0 then 0 when doc_id % 7 = 0 then {length} * 1000 else {length} end"


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upload for each document: every branch of the checks has rows."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{NAME} as original_filename", f"{TYPE} as content_type", f"cast({SIZE.format(length='octet_length(text)')} as bigint) as size_bytes", "text")


#: The same as a common table expression m of SQL.
SQL = f"m as (select doc_id, {NAME} as original_filename, {TYPE} as content_type, cast({SIZE.format(length='strlen(text)')} as bigint) as size_bytes, text from documents)"
