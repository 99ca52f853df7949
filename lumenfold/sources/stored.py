"""Upload store as Spark data sources: a sink that saves files chunk by chunk and commits or aborts, a reader of chunks.

The sink writes each upload into the folder of its task attempt below _staging, in reads of CHUNK_BYTES, and looks at the
running size after each one, as an intake server does. What becomes of an upload is a row of the outcomes table: saved
(201), too large (413) or empty (400), or not saved (500) where the store raises an OSError. In all but the first case
the partial file is deleted at once and the task goes on. Commit moves the attempts' folders to their places, one move a
task; abort deletes _staging, so a failed job leaves no file. A task that is run again writes a folder of its own, and only
the attempt that Spark commits is moved.

With a codec the bytes are the same and take less room: each chunk is compressed by itself, behind its two lengths. The name
of an attempt's folder ends in the codec, by which the reader knows its files.
"""

from __future__ import annotations

import contextlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.uploads import CHUNK_BYTES, EMPTY, MAX_BYTES, NOT_SAVED, SUCCESS, TOO_LARGE, checked, saved_name
from .shared import filesystem

#: Bytes of files to a partition of the reader.
PARTITION_BYTES = 64 * CHUNK_BYTES
#: Compressed files to a partition of the reader: what they hold isn't known from their sizes.
PARTITION_FILES = 256
CODECS = ("zstd", "lz4", "gzip")
#: Compressed bytes of a chunk, its own bytes.
_FRAME = struct.Struct("<II")
OUTCOMES = pa.schema([("upload_id", pa.string()), ("status", pa.int32()), ("detail", pa.string()), ("saved_filename", pa.string()), ("n_reads", pa.int64()), ("n_bytes", pa.int64()), ("crc32", pa.int64())])


@dataclass
class Committed(WriterCommitMessage):
    folder: str
    n_files: int


class UploadSink(DataSource):
    """Format "upload_sink"; rows: upload_id string, saved_filename string, content binary; option path: the folder.

    Option compression: none (as they came, the default) or one of CODECS.
    """

    @classmethod
    def name(cls) -> str:
        return "upload_sink"

    def writer(self, schema, overwrite: bool) -> UploadWriter:
        if overwrite:
            raise ValueError("upload_sink appends: uploads that are there stay")
        codec = self.options.get("compression", "none")
        if codec not in ("none", *CODECS):
            raise ValueError(f"compression must be none or one of {CODECS}")
        return UploadWriter(self.options["path"], None if codec == "none" else codec)


class UploadWriter(DataSourceArrowWriter):
    def __init__(self, path: str, codec: str | None = None):
        self.path, self.codec, self.job = path.rstrip("/"), codec, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        task = TaskContext.get()
        own = f"{self.path}/_staging/{self.job}/{task.partitionId():06d}-{task.taskAttemptId()}{f'.{self.codec}' if self.codec else ''}"
        fs, folder = filesystem(own)
        fs.create_dir(folder, recursive=True)
        rows = [save(fs, folder, *(b.column(c)[i].as_py() for c in ("upload_id", "saved_filename", "content")), self.codec) for b in iterator for i in range(b.num_rows)]
        pq.write_table(pa.Table.from_pylist(rows, OUTCOMES), f"{folder}/_outcomes", filesystem=fs)
        return Committed(own, sum(r["status"] == 201 for r in rows))

    def commit(self, messages: list[Committed | None]) -> None:
        """Moves each attempt's outcomes, then its files' folder; with this the uploads are there."""
        fs, root = filesystem(self.path)
        for sub in ("files", "outcomes"):
            fs.create_dir(f"{root}/{sub}", recursive=True)
        for m in messages:
            if m is None:
                continue
            _, folder = filesystem(m.folder)
            name = f"{self.job[:8]}-{folder.rsplit('/', 1)[1]}"
            fs.move(f"{folder}/_outcomes", f"{root}/outcomes/{name}.parquet")
            if m.n_files:
                fs.move(folder, f"{root}/files/{name}")
        self._clear(fs, root)

    def abort(self, messages: list[Committed | None]) -> None:
        self._clear(*filesystem(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/_staging/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/_staging/{self.job}")


def save(fs: pafs.FileSystem, folder: str, upload_id: str, name: str, content: bytes | None, codec: str | None = None) -> dict:
    """Saves one upload and returns its outcome; a file that isn't kept is deleted."""
    content, size, reads, crc, path = memoryview(content or b""), 0, 0, 0, f"{folder}/{name}"
    status, detail = 201, SUCCESS
    try:
        with fs.open_output_stream(path) as out:
            while True:
                chunk = content[reads * CHUNK_BYTES : (reads + 1) * CHUNK_BYTES]
                reads, size = reads + 1, size + len(chunk)
                if not len(chunk):
                    break
                if size > MAX_BYTES:
                    status, detail = 413, TOO_LARGE
                    break
                if codec:
                    packed = pa.compress(pa.py_buffer(chunk), codec, asbytes=True)
                    out.write(_FRAME.pack(len(packed), len(chunk)) + packed)
                else:
                    out.write(chunk)
                crc = zlib.crc32(chunk, crc)
        if not size:
            status, detail = 400, EMPTY
    except OSError:
        status, detail = 500, NOT_SAVED
    if status != 201:
        with contextlib.suppress(OSError):  # a file that couldn't be opened isn't there
            fs.delete_file(path)
    kept = status == 201
    return {"upload_id": upload_id, "status": status, "detail": detail, "saved_filename": name if kept else None, "n_reads": reads, "n_bytes": size, "crc32": crc if kept else None}


@dataclass
class Ranges(InputPartition):
    """(file, first chunk, end) of several files, or of a part of one; end is None for a compressed file, read whole."""

    ranges: list[tuple[str, int, int | None]]


class ChunkSource(DataSource):
    """Format "upload_chunks": a row a chunk of the files below option path; content only with option content = true.

    Option limit: chunks of a file that are read at most (11 by default: what shows that a file is over the limit; 0: all).
    """

    @classmethod
    def name(cls) -> str:
        return "upload_chunks"

    def schema(self) -> str:
        content = ", content binary" if self.options.get("content") == "true" else ""
        return f"saved_filename string, number int, n_bytes int, crc32 long{content}"

    def reader(self, schema) -> ChunkReader:
        limit = int(self.options.get("limit", MAX_BYTES // CHUNK_BYTES + 1))
        return ChunkReader(self.options["path"], limit, self.options.get("content") == "true")


class ChunkReader(DataSourceReader):
    def __init__(self, path: str, limit: int, content: bool):
        self.path, self.limit, self.content = path, limit, content

    def partitions(self) -> list[Ranges]:
        """Byte ranges of whole chunks, small files together, a large file in several partitions; compressed files whole."""
        fs, root = filesystem(self.path)
        out, own, packed, size = [], [], [], 0
        each = PARTITION_BYTES // CHUNK_BYTES
        for f in sorted(fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)), key=lambda f: f.path):
            if f.type != pafs.FileType.File or f.base_name.startswith("_") or "/_staging/" in f.path:
                continue
            if codec_of(f.path):
                packed.append((f.path, 0, None))
                continue
            chunks = -(-f.size // CHUNK_BYTES)
            chunks = min(chunks, self.limit) if self.limit else chunks
            for first in range(0, chunks, each):
                end = min(first + each, chunks)
                own.append((f.path, first, end))
                size += min(f.size, (end - first) * CHUNK_BYTES)
                if size >= PARTITION_BYTES:
                    out.append(Ranges(own))
                    own, size = [], 0
        out += [Ranges(packed[i : i + PARTITION_FILES]) for i in range(0, len(packed), PARTITION_FILES)]
        return [*out, Ranges(own)] if own or not out else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        names = ["saved_filename", "number", "n_bytes", "crc32"] + ["content"] * self.content
        for path, first, end in partition.ranges:
            with fs.open_input_file(path) as f:
                found = self._unpacked(f, codec_of(path)) if end is None else self._plain(f, first, end)
                for k, chunk in enumerate(found, first):
                    cells = [pa.array([path.rsplit("/", 1)[1]]), pa.array([k], pa.int32()), pa.array([len(chunk)], pa.int32()), pa.array([zlib.crc32(chunk)], pa.int64())]
                    yield pa.RecordBatch.from_arrays(cells + [pa.array([chunk], pa.binary())] * self.content, names)

    def _plain(self, f: pa.NativeFile, first: int, end: int) -> Iterator[bytes]:
        f.seek(first * CHUNK_BYTES)
        for _ in range(first, end):
            yield f.read(CHUNK_BYTES)

    def _unpacked(self, f: pa.NativeFile, codec: str) -> Iterator[bytes]:
        n = 0
        while (not self.limit or n < self.limit) and (head := f.read(_FRAME.size)):
            packed, size = _FRAME.unpack(head)
            yield pa.decompress(f.read(packed), size, codec, asbytes=True)
            n += 1


def codec_of(path: str) -> str | None:
    """The codec of a stored file, by its folder's name."""
    codec = path.rsplit("/", 2)[-2].rpartition(".")[2]
    return codec if codec in CODECS else None


def register(spark: SparkSession) -> None:
    for source in (UploadSink, ChunkSource):
        spark.dataSource.register(source)


def intake(uploads: DataFrame, folder: str, compression: str = "none") -> DataFrame:
    """Saves uploads (upload_id, original_filename, content_type, content) and returns a row each: upload_id, status,
    detail, saved_filename, n_reads, n_bytes, crc32. compression: as the sink's option; sizes and checks are of the bytes that came.

    What the name or type rules out is never read; of the rest no more than shows that it's too large is sent to a task.
    """
    spark = uploads.sparkSession
    register(spark)
    own = checked(uploads)
    rest = own.where("status is null").select(F.col("upload_id").cast("string").alias("upload_id"), saved_name(F.col("upload_id"), F.col("original_filename")).alias("saved_filename"), F.substring("content", 1, MAX_BYTES + CHUNK_BYTES).alias("content"))
    rest.write.format("upload_sink").mode("append").options(path=folder, compression=compression).save()
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("saved_filename", "string"), ("n_reads", "long"), ("n_bytes", "long"), ("crc32", "long"))]
    rejects = own.where("status is not null").select(F.col("upload_id").cast("string").alias("upload_id"), "status", "detail", *nothing)
    return outcomes(spark, folder).unionByName(rejects)


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("upload_id string, status int, detail string, saved_filename string, n_reads long, n_bytes long, crc32 long").parquet(f"{folder}/outcomes")


def chunks(spark: SparkSession, folder: str, content: bool = False, limit: int | None = None) -> DataFrame:
    """saved_filename, number, n_bytes, crc32 (and content) of the chunks of what intake saved."""
    register(spark)
    reader = spark.read.format("upload_chunks").option("path", f"{folder}/files").option("content", str(content).lower())
    return (reader if limit is None else reader.option("limit", limit)).load()
