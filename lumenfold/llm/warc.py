"""WARC archives: a writer with revisit records for equal payloads, and a reader that salvages damaged archives.

Each record is a gzip member of its own. The reader checks every record (member checksum, version line, content length,
block digest, closing blank lines). After a failed check it looks for the next member or version line, reads on from
there, and reports the bytes between as a gap. A member that holds several records is read the same way inside; of one that
is cut or corrupt, what it yields before its error is read. Blocks are read in steps, searches remember what they found and a
byte is hashed for DEPTH failed digests at most (but for blocks of a few KB), so neither a record's size nor the number of
failed checks needs memory or more than a bounded number of passes over the archive.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import re
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, parts, shared_dir, write_file, written

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Bytes after which a task opens another archive.
ARCHIVE_BYTES = 32_000_000
#: Bytes of a member's content that are held at once, about.
HELD_BYTES = 1 << 25
#: Failed digests that may cover a byte before a block over it is given up; the longest content searched for a changed byte.
DEPTH, _LOCATED = 8, 1 << 23
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = re.compile(r"<urn:lumenfold:page:(-?\d+|none)>$")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_ID, _DATE = re.compile(r"<[^<>\s]+>"), re.compile(r"\d{4}(-\d\d(-\d\d(T[\d:.]+Z)?)?)?")
_MAGIC, _ZERO = b"\x1f\x8b\x08", re.compile(b"\0")
#: The start of a gzip member whose reserved flags are zero, and of one that has neither a name nor a comment.
_MEMBER, _NAMELESS = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]"), re.compile(rb"\x1f\x8b\x08[\x00-\x07]")
#: Bytes to a read and to the first read of a header, bytes decompressed at once, and the longest pattern.
_STEP, _HEAD, _PIECE, _LONGEST = 1 << 16, 1 << 11, 1 << 18, 16


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:lumenfold:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response with its payload, or a revisit (header of the response only) where refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _urn(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._"),
        "WARC-Payload-Digest": _sha1(payload),
        "WARC-Block-Digest": _sha1(block),
        "WARC-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers_to)}
    fields["Content-Length"] = str(len(block))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class Damage(ValueError):
    """A record that fails a check."""


class Hits:
    """Where patterns occur next in a file. What was found is remembered, so that a file is searched once however many checks fail."""

    def __init__(self, f, size: int):
        self.f, self.size, self.known = f, size, {}

    def __call__(self, what: re.Pattern, at: int) -> int:
        """Position of a pattern's first match from a position on, or the file's end."""
        since, hit = self.known.get(what, (0, -1))
        if since <= at <= hit:
            return hit
        hit, tail, pos = self.size, b"", at
        while pos < self.size:
            self.f.seek(pos)
            part = self.f.read(_STEP)
            if not part:
                break
            data = tail + part
            if m := what.search(data):
                hit = pos - len(tail) + m.start()
                break
            tail, pos = data[-_LONGEST:], pos + len(part)
        self.known[what] = (at, hit)
        return hit


class Content:
    """What a gzip member holds, as a file to read anywhere in; end is the member's end, or None with why it isn't whole.

    Of a member that is cut or corrupt it is what comes before the error. HELD_BYTES of it are held at once; to read what
    lies before them, the member is decompressed anew.
    """

    def __init__(self, f, at: int, start: int):
        self.f, self.at, self.start, self.end, self.why = f, at, start, None, ""
        self.cut, self.trailer = False, None  # whether it only ends too early; the trailer's checksum and length where they are wrong
        self.size = self.pos = 1 << 62  # not known yet, and nothing to keep
        self._open()
        while self._more():
            pass
        self.size, self.pos = self.first + len(self.held), 0

    def _open(self) -> None:
        self.d, self.source, self.step, self.crc, self.first, self.held, self.over = zlib.decompressobj(-15), self.start, 1 << 9, 0, 0, bytearray(), False

    def _more(self) -> bool:
        """Decompresses a step more; whether there may be another."""
        if self.over or self.first + len(self.held) >= self.size:
            return False
        part = self.d.unconsumed_tail
        if not part:
            self.f.seek(self.source)
            part = self.f.read(self.step)
            self.source += len(part)
            self.step = min(_STEP, 4 * self.step)
        if not part:
            self.why, self.over, self.cut = "member cut short", True, True
            return False
        before = self.d.copy()
        try:
            out = self.d.decompress(part, _PIECE)
        except zlib.error as e:
            self.why, self.over, out = f"member: {e}", True, _before_error(before, part)
        self.crc = zlib.crc32(out, self.crc)
        self.held += out
        if len(self.held) > 2 * HELD_BYTES:
            over = max(0, min(len(self.held) - HELD_BYTES, self.pos - self.first))  # what is being read stays
            del self.held[:over]
            self.first += over
        if self.d.eof:
            self.over = True
            self._close()
        return not self.over

    def _close(self) -> None:
        """Checks the trailer after the compressed data: checksum and length."""
        end = self.source - len(self.d.unused_data)
        self.f.seek(end)
        trailer = self.f.read(8)
        if len(trailer) < 8:
            self.why, self.cut = "member cut short", True
        elif int.from_bytes(trailer[:4], "little") != self.crc or int.from_bytes(trailer[4:], "little") != (self.first + len(self.held)) & 0xFFFFFFFF:
            self.why = "member: checksum differs"
            self.stop = end + 8
            self.trailer = int.from_bytes(trailer[:4], "little"), int.from_bytes(trailer[4:], "little")
        else:
            self.end = end + 8

    def stored(self) -> bool:
        """Whether all of it is stored, not deflated."""
        at = self.start
        while True:
            self.f.seek(at)
            head = self.f.read(5)
            if len(head) < 5 or head[0] & 6:
                return False
            if head[0] & 1:
                return True
            at += 5 + int.from_bytes(head[1:3], "little")

    def seek(self, pos: int) -> None:
        self.pos = pos

    def read(self, n: int) -> bytes:
        stop = min(self.pos + n, self.size)
        if self.pos < self.first:
            self._open()
        while self.first + len(self.held) < stop and self._more():
            pass
        out = bytes(self.held[self.pos - self.first : max(0, stop - self.first)])
        self.pos += len(out)
        return out


def _before_error(d, part: bytes) -> bytes:
    """What a decompressor gives before its error in a part of its input."""
    out = b""
    while len(part) > 1:
        half, copy = len(part) // 2, d.copy()
        try:
            got = copy.decompress(part[:half])
        except zlib.error:
            part = part[:half]
            continue
        d, out, part = copy, out + got, part[half:]
    return out


def _compressed(f, at: int, size: int, hits: Hits) -> int | None:
    """Where the compressed data of the gzip member at a position begin; None if there is no member's header."""
    f.seek(at)
    head = f.read(12)
    if len(head) < 12 or head[:3] != _MAGIC or head[3] & 0xE0:
        return None
    pos = at + 10
    if head[3] & 4:
        pos += 2 + int.from_bytes(head[10:], "little")
    for flag in (8, 16):  # the file's name and a comment, each with a zero at its end
        if head[3] & flag:
            pos = hits(_ZERO, pos) + 1
    pos += 2 * bool(head[3] & 2)
    return pos if pos < size else None


class Block:
    """A record's block where it lies in a file: read in steps, so that its size needs no memory. bytes() gives it whole."""

    def __init__(self, f, start: int, size: int):
        self.f, self.start, self.size, self.payload_bytes = f, start, size, 0

    def steps(self):
        at, stop = self.start, self.start + self.size
        while at < stop:
            self.f.seek(at)
            part = self.f.read(min(_STEP, stop - at))
            if not part:
                raise Damage("block cut short")
            at += len(part)
            yield part

    def __bytes__(self) -> bytes:
        return b"".join(self.steps())

    def digests(self) -> tuple[str, str]:
        """Of the block and of the payload in it, which payload_bytes then counts."""
        block, payload, tail = hashlib.sha1(), None, b""
        for part in self.steps():
            block.update(part)
            if payload is None:
                head, blank, rest = (tail + part).partition(b"\r\n\r\n")
                tail = head[-3:]
                if blank:
                    payload, part = hashlib.sha1(), rest
            if payload is not None:
                payload.update(part)
                self.payload_bytes += len(part)
        return tuple("sha1:" + base64.b32encode((x or hashlib.sha1()).digest()).decode() for x in (block, payload))


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def _fields(f, at: int) -> tuple[dict[str, str], int]:
    """Header fields (lower-case names) of the record at a position, and where its block begins. Reads on a line at a time."""
    f.seek(at)
    data, fields = f.read(_HEAD), {}
    m = _VERSION.match(data)
    if not m:
        raise Damage("no version line")
    start = m.end()
    while True:
        end = data.find(b"\r\n", start)
        if end == start:
            return fields, at + end + 2
        if end < 0:
            more = f.read(len(data))
            if not more:
                raise Damage("header without an end")
            data += more
            continue
        name, colon, value = data[start:end].decode("utf-8", "replace").partition(":")
        if not colon:
            raise Damage("a header line without a colon")
        fields[name.strip().lower()] = value.strip()
        start = end + 2


def _same(fields: dict[str, str]) -> bytes:
    """Equal for records of equal headers, the block's digest among them."""
    return hashlib.sha1(repr(sorted(fields.items())).encode()).digest()


def _record(f, at: int, size: int, failed: list[int]) -> tuple[dict[str, str], Block, int]:
    """Header fields, block and end of the record at a position; Damage if a check fails.

    failed: ends of the blocks before it whose digest differed, in order. A block of some length that DEPTH of them reach
    into by half isn't hashed once more: else headers whose lengths all reach far would be hashed to there one by one.
    """
    fields, start = _fields(f, at)
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or len(length) > 18:
        raise Damage("no content length")
    stop = start + int(length)
    if stop > size:
        raise Damage("block cut short")
    f.seek(stop)
    if f.read(4) != b"\r\n\r\n":
        raise Damage("no blank lines after the block")
    block, digest, response = Block(f, start, int(length)), fields.get("warc-block-digest", ""), fields.get("warc-type") == "response"
    if response or digest.startswith("sha1:"):
        if block.size > _STEP >> 4 and len(failed) - bisect.bisect_left(failed, start + block.size // 2) >= DEPTH:
            raise Damage("within blocks whose digest differs")
        own, payload = block.digests()
        if digest.startswith("sha1:") and digest != own or response and (p := fields.get("warc-payload-digest", "")).startswith("sha1:") and p != payload:
            bisect.insort(failed, stop)
        if digest.startswith("sha1:") and digest != own:
            raise Damage("block digest differs")
        if response and (digest := fields.get("warc-payload-digest", "")).startswith("sha1:") and digest != payload:
            raise Damage("payload digest differs")
    return fields, block, stop + 4


def _inverse() -> tuple[list[int], dict[int, int]]:
    """The table of crc32, and its entries' numbers by their upper byte."""
    table = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        table.append(b)
    return table, {t >> 24: k for k, t in enumerate(table)}


def _flipped(syndrome: int, size: int, ranges: list[tuple[int, int]]) -> int | None:
    """Where in the ranges of a content of that size one changed byte explains how its crc32 differs; None: nowhere.

    A changed byte leaves an entry of the crc's table behind, moved on once for each byte that follows; moving the
    difference back finds it.
    """
    table, upper = _inverse()
    entries, v = {t for t in table if t}, syndrome
    for p in range(size - 1, -1, -1):
        if v in entries and any(a <= p < b for a, b in ranges):
            return p
        k = upper[v >> 24]
        v = ((v ^ table[k]) << 8 | k) & 0xFFFFFFFF
    return None


def _believed(content: Content):
    """Fields and block of the records of a damaged member that the damage can't have reached.

    All of them have the fields that a header must have and a block digest that holds; headers have none. Where the damage shows in a gap, records that another
    one or the proper end of the data follows (what stands just before an error may be its work), but none with the id of one
    before it; that another field of a deflated header has changed isn't noticed there. Without a gap: where the
    data were merely cut; where only the trailer is damaged (its length differs or its checksum alone in two bytes at most,
    or is blank); and of stored data, all records but that whose header holds the one byte that explains the checksum.
    Of deflated data any header may be altered then, repeated ones too, and no record is believed.
    """
    each = list(scan(content, content.size, False))
    good = [(at, x, y) for kind, at, x, y in each if kind == "record" and x.get("warc-block-digest", "").startswith("sha1:") and _ID.fullmatch(x.get("warc-record-id", "")) and _DATE.fullmatch(x.get("warc-date", "")) and "warc-type" in x]
    if any(kind == "gap" for kind, *_ in each):
        ids = set()
        for _, x, y in good:
            stop, known = y.start + y.size + 4, len(ids)
            ids.add(x.get("warc-record-id", stop))
            if len(ids) == known:  # damage to deflated data comes again where they repeat themselves
                continue
            content.seek(stop)
            if _VERSION.match(content.read(16)) or (stop == content.size and content.d.eof):
                yield x, y
        return
    bad = None
    if content.trailer is not None:
        crc, length = content.trailer
        wrong = crc ^ content.crc
        blank = crc in (0, 0xFFFFFFFF)
        if wrong and not blank and sum(wrong >> k & 0xFF > 0 for k in (0, 8, 16, 24)) > 2:
            if length != content.size & 0xFFFFFFFF or not content.stored() or content.size > _LOCATED:
                return
            bad = _flipped(wrong, content.size, [(at, y.start) for at, _, y in good] + [(y.start + y.size, y.start + y.size + 4) for *_, y in good])
    elif not content.cut:
        return
    for at, x, y in good:
        if bad is None or not at <= bad < y.start + y.size + 4:
            yield x, y


def _inside(content: Content):
    """Yields fields and block of the records in a gzip member, and at last (None, what is wrong)."""
    why = content.why
    if content.end is None:
        if content.size:
            yield from _believed(content)
    else:
        for kind, _, x, y in scan(content, content.size, False):
            if kind == "gap":
                why = why or y
            else:
                yield x, y
    yield None, why


def scan(f, size: int, members: bool = True):
    """Yields ("record", offset, fields, Block) and ("gap", start, end, reason) over a seekable file.

    A gap of a member from which some records were recovered is the whole member, after those records. Of stored data the
    records also lie plainly in the file; those that the member has given already aren't given again. A block is to be read
    before the next record is asked for.
    """
    hits = Hits(f, size)
    at, gap, why = 0, None, ""
    failed: list[int] = []
    given, reach = set(), 0
    while at < size:
        end, start = None, _compressed(f, at, size, hits) if members else None
        if start is not None:
            content = Content(f, at, start)
            found, end = _inside(content), content.end
            damaged = end is None
            if damaged and content.trailer is not None and content.stored():
                end = content.stop  # its blocks' lengths are doubled, so this is where it ends: all of it was looked through
            elif damaged and at >= reach:
                given, reach = set(), content.source
        else:
            damaged = False
            try:
                *one, end = _record(f, at, size, failed)
                if at < reach and _same(one[0]) in given:
                    at = end
                    continue
                found = [tuple(one), (None, "")]
            except Damage as e:
                found = [(None, str(e))]
        wrong = ""
        for fields, block in found:
            if fields is None:
                wrong = block
                continue
            if gap is not None:
                yield "gap", gap, at, why
                gap = None
            if damaged:
                given.add(_same(fields))
            yield "record", at, fields, block
        if wrong and gap is None:
            gap, why = at, wrong
        elif not wrong and gap is not None:
            yield "gap", gap, at, why
            gap = None
        if end is None:
            end = hits(_VERSION, at + 1)
            if members:  # without a zero ahead, no name or comment ends
                end = min(end, hits(_MEMBER if hits(_ZERO, at + 1) < size else _NAMELESS, at + 1))
        at = end
    if gap is not None:
        yield "gap", gap, size, why


def salvage(f, size: int):
    """The same with whole blocks in memory."""
    for kind, at, x, y in scan(f, size):
        yield kind, at, x, bytes(y) if kind == "record" else y


def _page(urn: str) -> int | None:
    m = _URN.search(urn)
    return None if not m or m[1] == "none" else int(m[1])


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of the pages' html; returns one row an archive: uri, n_records, n_bytes.

    Payload: html in UTF-8, null as empty. Of the rows with equal payloads of REVISIT_BYTES or more, that with the largest
    page_id is a response and the others revisit it; rows that tie there (a page repeated) are responses all, as are rows
    without a page_id. Equal payloads are found by their SHA-1: only one row for each repeated digest is joined back, and
    a digest on very many rows is summed before it is shuffled and split by the skew join.
    """
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = own.withColumn("d", F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha1(F.col("html").cast("binary"))))
    kept = keyed.where("d is not null and page_id is not null").groupBy("d").agg(F.max("page_id").alias("first"), F.min("page_id").alias("least")).where("first > least").select("d", "first")
    kept = written(kept, folder + "-index", "repeated")  # its size is known: if small, pages stay where they are
    rows = keyed.join(kept, "d", "left").select("page_id", "url", "html", F.when(F.col("first") > F.col("page_id"), F.col("first")).alias("refers_to"))

    def run(batches):
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        out, n, size, k = [], 0, 0, 0
        schema = pa.schema([("uri", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

        def close():
            nonlocal out, n, size, k
            uri = f"{folder}/part-{part:06d}-{k:05d}.warc.gz"
            write_file(uri, out, attempt)
            row = pa.RecordBatch.from_pylist([{"uri": uri, "n_records": n, "n_bytes": size}], schema=schema)
            out, n, size, k = [], 0, 0, k + 1
            return row

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, html, refers = (c[i].as_py() for c in b.columns)
                out.append(gzip.compress(record(page_id, url, html.encode(), refers), 6, mtime=0))
                n, size = n + 1, size + len(out[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if n:
            yield close()

    return written(rows.mapInArrow(run, "uri string, n_records long, n_bytes long"), folder + "-index", "archives")


RECORDS = "kind string, uri string, start long, stop long, reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Records and gaps of archives (uri), each archive read by one task as a stream of records.

    kind is "record" or "gap". A gap's start and stop are the bytes that no record was recovered from, with the first
    failed check as the reason. payload is null unless asked for.
    """
    schema = pa.schema([("kind", pa.string()), ("uri", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows: list[dict] = []
                held = 0
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as f:
                    for kind, at, x, y in scan(f, f.size()):
                        if kind == "gap":
                            rows.append({"kind": kind, "uri": uri, "start": at, "stop": x, "reason": y})
                            continue
                        kind_ = x.get("warc-type", "")
                        payload = payload_of(bytes(y)) if payloads and kind_ == "response" else None
                        digest = x.get("warc-payload-digest", "").removeprefix("sha1:")
                        try:
                            digest = base64.b32decode(digest).hex()
                        except ValueError:
                            pass
                        length = y.payload_bytes if kind_ == "response" else int(x["warc-payload-length"]) if x.get("warc-payload-length", "").isdigit() else None
                        rows.append({"kind": kind, "uri": uri, "start": at, "page_id": _page(x.get("warc-record-id", "")), "url": x.get("warc-target-uri"), "record_type": kind_, "refers_to": _page(x.get("warc-refers-to", "")), "payload_bytes": length, "payload_digest": digest, "payload": payload})
                        held += len(payload or b"")
                        if len(rows) >= 5000 or held > 16_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("uri").repartition(parts(archives.sparkSession, 0, 1), "uri").mapInArrow(run, RECORDS)


def salvage_bytes(data: bytes) -> list[tuple]:
    return list(salvage(io.BytesIO(data), len(data)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are the query's own: a gap in them would mean lost pages, so it is an error."""
    found = read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark)))
    lost = F.raise_error(F.concat_ws(" ", F.lit("gap in"), "uri", F.col("start").cast("string"), F.col("stop").cast("string"), "reason"))
    return found.where(F.when(F.col("kind") == "record", F.lit(True)).otherwise(lost.cast("boolean"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
select page_id, strlen(h) as payload_bytes, sha1(h) as payload_digest,
       case when strlen(h) >= 1000 and page_id < max(page_id) over (partition by h) then 'revisit' else 'response' end as record_type,
       case when strlen(h) >= 1000 and page_id < max(page_id) over (partition by h) then max(page_id) over (partition by h) end as refers_to
from (select page_id, coalesce(html, '') as h from pages)
"""
