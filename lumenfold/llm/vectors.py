"""Vectors as Arrow columns and numpy matrices, and a sweep that joins blocks of rows with streams of others."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column) -> object:
    """Whether a vector takes part: not null, no null or non-finite component, not all zeros."""
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(x, lambda v: v != 0), F.lit(False))


def dimension(df: DataFrame, column: str) -> int:
    """The most frequent length of usable vectors (the longest of equals), 0 if there are none."""
    row = df.where(usable(column)).groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return row["n"] if row else 0


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """A row for each vector, in double precision; all must have the dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def packed(x: np.ndarray) -> pa.Array:
    """Rows as binary cells, in single precision if that is exact."""
    narrow = x.astype(np.float32)
    x = np.ascontiguousarray(narrow if (narrow == x).all() else x)
    return pa.array([r.tobytes() for r in x], pa.binary())


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    cells = column.to_pylist()
    if all(len(c) == 4 * dim for c in cells):
        return np.frombuffer(b"".join(cells), np.float32).reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(c, np.float32 if len(c) == 4 * dim else np.float64).astype(np.float64) for c in cells]) if cells else np.empty((0, dim))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fingerprint(row: np.ndarray) -> str:
    """Equal for equal vectors (128 bits); -0.0 counts as 0.0."""
    return hashlib.blake2b((row + 0.0).tobytes(), digest_size=16).hexdigest()


SWEEP = "cell long, chunk int, role int, id long, n long, vec binary"


def sweep_batch(cell, chunk, role, ids, n, vec) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(chunk, pa.int32()), pa.array(role, pa.int32()), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), vec], ["cell", "chunk", "role", "id", "n", "vec"])


def sweep(rows: DataFrame, parts: int, dim: int, make, schema: str) -> DataFrame:
    """For each (cell, chunk), rows of role 0 as one block and rows of role 1 as a stream against it.

    make(ids, n, matrix) of the block returns (feed, finish): feed(ids, n, matrix) takes some rows of the stream, finish()
    ends the pair; both return lists of columns. A task holds one block and one batch of the stream, however long that is.
    """

    def run(batches):
        key, block, handler = None, [], None

        def close():
            nonlocal handler, block
            out = []
            if handler is None and block:
                handler = make(*(np.concatenate(c) for c in zip(*block, strict=True)))
            if handler is not None:
                out = handler[1]()
            handler, block = None, []
            return out

        names = [c.split()[0] for c in schema.split(",")]
        kinds = [pa.float64() if c.split()[1] == "double" else pa.int64() for c in schema.split(",")]
        batch_of = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        for b in batches:
            cell, chunk, role, ids, n = (b.column(i).to_numpy() for i in range(5))
            if not len(cell):
                continue
            change = np.flatnonzero((np.diff(cell) != 0) | (np.diff(chunk) != 0) | (np.diff(role) != 0)) + 1
            for i, j in zip([0, *change.tolist()], [*change.tolist(), len(cell)], strict=True):
                if key != (own := (cell[i], chunk[i])):
                    if cols := close():
                        yield batch_of(cols)
                    key = own
                x = unpacked(b.column(5).slice(i, j - i), dim)
                if role[i] == 0:
                    block.append((ids[i:j], n[i:j], x))
                elif block or handler:
                    if handler is None:
                        handler = make(*(np.concatenate(c) for c in zip(*block, strict=True)))
                        block = []
                    if cols := handler[0](ids[i:j], n[i:j], x):
                        yield batch_of(cols)
        if cols := close():
            yield batch_of(cols)

    return rows.repartition(parts, "cell", "chunk").sortWithinPartitions("cell", "chunk", "role").mapInArrow(run, schema)
