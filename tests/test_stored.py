"""The upload store: outcomes, partial files, aborted jobs, chunks."""

import os
import zlib

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import uploads as U
from lumenfold.sources import stored

SCHEMA = "upload_id string, original_filename string, content_type string, content binary"
MB = 1 << 20


def names(folder):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc"))


def test_intake_saves_and_deletes(spark, tmp_path):
    big = bytes(range(256)) * (MB // 256)
    rows = [("a", "a.pdf", "application/pdf", b"x" * 10), ("b", "b.png", "image/png", big * 10), ("c", "c.png", "image/png", big * 10 + b"!"), ("d", "d.png", "image/png", big * 30), ("e", "e.png", "image/png", b""), ("f", "f.png", "image/png", None), ("g", None, "image/png", b"x"), ("h", "h.txt", "image/png", b"x"), ("i", "i.png", "text/plain", b"x")]
    folder = str(tmp_path / "store")
    found = {r.upload_id: r for r in stored.intake(spark.createDataFrame(rows, SCHEMA).repartition(3), folder).collect()}
    assert {k: r.status for k, r in found.items()} == {"a": 201, "b": 201, "c": 413, "d": 413, "e": 400, "f": 400, "g": 400, "h": 400, "i": 400}
    assert [found[k].detail for k in "efghi"] == [U.EMPTY, U.EMPTY, U.NO_NAME, U.BAD_EXTENSION, U.BAD_TYPE]
    assert (found["b"].n_reads, found["b"].n_bytes, found["b"].crc32) == (11, 10 * MB, zlib.crc32(big * 10))
    assert (found["c"].n_reads, found["d"].n_reads, found["d"].n_bytes) == (11, 11, 11 * MB)
    files = [f for f in names(folder) if "/files/" in f]
    assert sorted(os.path.basename(f) for f in files) == sorted(found[k].saved_filename for k in "ab")
    assert not [f for f in names(folder) if "_staging" in f]


def test_a_failed_write_is_a_500_row(spark, tmp_path):
    stored.register(spark)
    rows = [("ok", "good.pdf", b"1"), ("long", "x" * 300 + ".pdf", b"2"), ("lost", "no/folder.pdf", b"3")]
    spark.createDataFrame(rows, "upload_id string, saved_filename string, content binary").coalesce(1).write.format("upload_sink").mode("append").option("path", str(tmp_path)).save()
    found = {r.upload_id: (r.status, r.detail, r.saved_filename) for r in stored.outcomes(spark, str(tmp_path)).collect()}
    assert found == {"ok": (201, U.SUCCESS, "good.pdf"), "long": (500, U.NOT_SAVED, None), "lost": (500, U.NOT_SAVED, None)}
    assert [os.path.basename(f) for f in names(tmp_path / "files")] == ["good.pdf"]


class FullDisk:
    """A store that breaks off in the middle of a file."""

    def __init__(self, inner):
        self.inner = inner

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def open_output_stream(self, path):
        out = self.inner.open_output_stream(path)

        class Stream:
            def __enter__(self):
                return self

            def __exit__(self, *a):
                out.close()

            def write(self, chunk):
                if out.tell() >= 2 * MB:
                    raise OSError(28, "No space left on device")
                out.write(chunk)

        return Stream()


def test_a_partial_file_is_deleted(tmp_path):
    row = stored.save(FullDisk(pafs.LocalFileSystem()), str(tmp_path), "u", "n.pdf", b"z" * (3 * MB))
    assert (row["status"], row["saved_filename"], row["crc32"]) == (500, None, None) and os.listdir(tmp_path) == []
    assert stored.save(FullDisk(pafs.LocalFileSystem()), str(tmp_path), "u", "n.pdf", b"z" * MB)["status"] == 201


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    stored.register(spark)
    good = spark.range(40).select(F.col("id").cast("string").alias("upload_id"), F.concat("id", F.lit(".pdf")).alias("saved_filename"), F.encode(F.lit("x"), "utf-8").alias("content"))
    good.write.format("upload_sink").mode("append").option("path", str(tmp_path)).save()
    before = names(tmp_path)
    bad = good.withColumn("content", F.when(F.col("upload_id") == "39", F.raise_error(F.lit("source broke off")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broke off"):
        bad.write.format("upload_sink").mode("append").option("path", str(tmp_path)).save()
    assert names(tmp_path) == before and not os.path.exists(tmp_path / "_staging" / "x") and os.listdir(tmp_path / "_staging") == []
    with pytest.raises(Exception, match="appends"):
        good.write.format("upload_sink").mode("overwrite").option("path", str(tmp_path)).save()


def test_chunks_are_byte_ranges(spark, tmp_path, monkeypatch):
    data = {"a": os.urandom(3 * MB + 5), "b": b"1", "c": os.urandom(14 * MB), "d": b""}
    os.makedirs(tmp_path / "files/x")
    for k, v in data.items():
        (tmp_path / "files/x" / k).write_bytes(v)
    for limit, n in ((None, 11), (0, 14), (2, 2)):
        rows = stored.chunks(spark, str(tmp_path), content=True, limit=limit).collect()
        for k, v in data.items():
            own = sorted((r for r in rows if r.saved_filename == k), key=lambda r: r.number)
            got = b"".join(bytes(r.content) for r in own)
            assert got == v[: n * MB] and all(r.crc32 == zlib.crc32(bytes(r.content)) and r.n_bytes == len(r.content) for r in own)
            assert [r.number for r in own] == list(range(min(n, -(-len(v) // MB))))
    monkeypatch.setattr(stored, "PARTITION_BYTES", 4 * MB)
    ranges = stored.ChunkReader(f"{tmp_path}/files", 0, False).partitions()
    assert len(ranges) == 4 and [len(p.ranges) for p in ranges] == [3, 1, 1, 1]
    assert stored.chunks(spark, str(tmp_path / "nothing")).collect() == []


@pytest.mark.parametrize("codec", stored.CODECS)
def test_a_compressed_store_gives_the_same_bytes_in_less_room(spark, tmp_path, codec):
    data = {"a": b"again and again " * (MB // 5), "b": b"1", "c": os.urandom(2 * MB + 5), "d": b"x" * (10 * MB), "e": b"x" * (10 * MB + 1), "f": b""}
    rows = [(k, f"{k}.pdf", "application/pdf", v) for k, v in data.items()]
    plain = stored.intake(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "plain"))
    packed = stored.intake(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "packed"), codec)
    assert sorted(plain.collect()) == sorted(packed.collect()) and sum(r.status == 201 for r in packed.collect()) == 4
    for limit in (None, 0, 2):
        a, b = (sorted(stored.chunks(spark, str(tmp_path / s), content=True, limit=limit).collect()) for s in ("plain", "packed"))
        assert a == b and len(a) == (18 if limit != 2 else 7)
    size = {s: sum(os.path.getsize(f) for f in names(tmp_path / s / "files")) for s in ("plain", "packed")}
    assert len(names(tmp_path / "packed" / "files")) == 4 and size["plain"] > 15 * MB and size["packed"] < 3 * MB


def test_the_queries_store_less_than_twice_the_documents(spark, tmp_path):
    from lumenfold.plans import uploads as plan
    from lumenfold.sources.tables import table

    sf = "/root/testdata/sf0.001"
    plan.saved(spark, sf, str(tmp_path)).collect()
    room = sum(os.path.getsize(f) for f in names(tmp_path))
    assert room < 2 * table(spark, sf, "documents").agg(F.sum(F.octet_length("text"))).first()[0]
