"""Exact vector search as block matrix products: query blocks past row batches, the k best of each batch only go on."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import filesystem, shared_folder
from .retrieval import QUERY_BLOCK, top

#: Bytes of query blocks that a worker keeps; more are read anew for each batch of rows.
KEPT_BYTES = 64_000_000
#: Scores count as equal within this much: they are rounded to six digits.
SLACK = 2e-6


def matrices(ids: pa.Array, vectors: pa.Array):
    """(ids, matrix) of the vectors of each dimension; those that are null or hold nulls take no part."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]).astype(int).tolist():
        at = np.flatnonzero(lengths == n)
        flat = vectors.take(pa.array(at)).flatten()
        m = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), n)
        if flat.null_count:
            whole = ~np.asarray(flat.is_null()).reshape(len(at), n).any(axis=1)
            at, m = at[whole], m[whole]
        if len(at):
            yield ids.take(pa.array(at)), m


@functools.lru_cache(maxsize=1)
def _small(uri: str) -> list[dict] | None:
    """The query blocks, if they are small enough to be kept."""
    fs, path = filesystem(uri)
    own = pads.dataset(path, filesystem=fs, format="parquet", exclude_invalid_files=False)
    size = sum(fs.get_file_info(f).size for f in own.files)
    return own.to_table().to_pylist() if size <= KEPT_BYTES else None


def _blocks(uri: str):
    kept = _small(uri)
    if kept is not None:
        yield from kept
        return
    fs, path = filesystem(uri)
    for b in pads.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=4):
        yield from b.to_pylist()


def dense_top(queries: DataFrame, rows: DataFrame, k: int, but_itself: bool = True) -> DataFrame:
    """query_id, vec_id, score, rank: the k rows (vec_id, embedding) of the largest inner product with each query.

    Queries (query_id, qvec) meet rows of the same dimension; a row with the query's own id is left out unless wanted. The
    queries are a table of blocks in the shared folder; each task takes its rows past all of them by one matrix product a
    block and batch, and hands on what may be among the k best. Rows aren't shuffled.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "dense")
    asked, kind = queries.schema["query_id"].dataType, rows.schema["vec_id"].dataType

    def packed(batches):
        for b in batches:
            for lo in range(0, b.num_rows, QUERY_BLOCK):
                for ids, m in matrices(b.column(0).slice(lo, QUERY_BLOCK), b.column(1).slice(lo, QUERY_BLOCK)):
                    yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([m.shape[1]], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["ids", "n", "m"])

    schema = T.StructType([T.StructField("ids", T.ArrayType(asked)), T.StructField("n", T.IntegerType()), T.StructField("m", T.BinaryType())])
    queries.select("query_id", "qvec").mapInArrow(packed, schema).write.parquet(f"{folder}/queries")

    def run(batches):
        for b in batches:
            own = [(ids, np.array(ids.to_pylist(), object), m) for ids, m in matrices(b.column(0), b.column(1))]
            for block in _blocks(f"{folder}/queries"):
                q = np.frombuffer(block["m"]).reshape(-1, block["n"])
                for ids, plain, m in own:
                    if m.shape[1] != block["n"]:
                        continue
                    scores = q @ m.T
                    if but_itself:
                        scores[np.array(block["ids"], object)[:, None] == plain[None, :]] = -np.inf
                    least = np.partition(scores, -k, axis=1)[:, -k] - SLACK if scores.shape[1] > k else np.full(len(q), -np.inf)
                    i, j = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array([block["ids"][x] for x in i.tolist()], pa_asked), ids.take(pa.array(j)), pa.array(scores[i, j])], ["query_id", "vec_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    pa_asked = to_arrow_type(asked)
    out = T.StructType([T.StructField("query_id", asked), T.StructField("vec_id", kind), T.StructField("score", T.DoubleType())])
    met = rows.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding").mapInArrow(run, out)
    return top(met, "query_id", "vec_id", k)
