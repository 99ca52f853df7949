"""What the operators of this package share: the shared folder, written tables, inputs with defined nulls."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.memory import tidied


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and the session runs in one process (as in tests) is a local folder made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "lumenfold-shared")
    return f"{base.rstrip('/')}/lf-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it; for the local one, file:/x and file:///x alike."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pafs.FileSystem.from_uri(uri)


def remove(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables of a shared folder that are no longer read (the whole folder without names)."""
    for uri in [f"{folder}/{n}" for n in names] or [folder]:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_file(uri: str, chunks, attempt: object) -> int:
    """Write a file under a name of this attempt's own, then move it into place; returns its bytes.

    A task that is run again, or twice at a time, leaves one whole file with the same content.
    """
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own, n = f"{path}.{attempt}-{uuid.uuid4().hex[:8]}", 0
    with fs.open_output_stream(own) as out:
        for c in chunks:
            out.write(c)
            n += len(c)
    fs.move(own, path)
    return n


def read_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts its lineage, and is read again instead of computed again."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def input_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over all rows (null: 0)."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0))).first()[0])


def parts(spark: SparkSession, nbytes: int, each: int) -> int:
    """How many parts of about so many bytes, and at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nbytes // each))


def row_and_text(docs: DataFrame) -> list[Column]:
    """The whole row as a struct, and its text beside it only where the struct's isn't a string: texts are sent once."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return [row] if isinstance(docs.schema["text"].dataType, T.StringType) else [row, text_or_empty()]


def row_texts(batch: pa.RecordBatch) -> pa.Array:
    """The texts (null: empty) of a batch of row_and_text."""
    own = batch.column(1) if batch.num_columns > 1 else pc.struct_field(batch.column(0), "text")
    return pc.fill_null(own, "")


def filter_rows(docs: DataFrame, make) -> DataFrame:
    """The rows whose text (null: empty) passes, unchanged, whatever columns they have.

    make() is called once a task and returns a function from some texts to whether each one's row stays.
    """

    def run(batches):
        keep = make()
        for b in batches:
            texts = row_texts(b)
            mask = [x for i in range(0, b.num_rows, 200) for x in keep(texts.slice(i, 200).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(mask, pa.bool_()))], ["row"])

    rows = docs.select(*row_and_text(docs))
    return rows.mapInArrow(tidied(run), T.StructType([T.StructField("row", docs.schema)])).select("row.*")
