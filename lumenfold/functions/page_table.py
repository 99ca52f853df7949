"""page_table: the pages of documents as a table function, for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class PageTable:
    """TABLE (doc_id, part, text) to (doc_id, page_number, text): each line is a page, stripped, blank ones too.

    The parts of a document may be several rows; its pages are numbered through, in the order of part. A null text is one
    blank page. The function asks for its input by document and part, so the caller needn't.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or {"doc_id", "part", "text"} - set(rows.dataType.names):
            raise ValueError("page_table takes a TABLE with doc_id, part and text")
        schema = T.StructType([T.StructField("doc_id", rows.dataType["doc_id"].dataType), T.StructField("page_number", T.IntegerType()), T.StructField("text", T.StringType())])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("part")])

    def __init__(self):
        self.number = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        for line in (row["text"] or "").split("\n"):
            self.number += 1
            yield row["doc_id"], self.number, line.strip()


def register(spark: SparkSession) -> None:
    spark.udtf.register("page_table", udtf(PageTable))
