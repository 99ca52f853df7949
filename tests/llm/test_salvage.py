"""Salvage of damaged archives by their properties: nothing twice, nothing altered, nothing lost outside the damage."""

import gzip
import random
import time
import zlib

import pytest

from lumenfold.llm import warc


def records(n, seed=0):
    rng = random.Random(seed)
    return [warc.record(i, f"http://h/{i}", bytes(rng.randrange(97, 120) for _ in range(rng.randrange(20, 900)))) for i in range(n)]


def member(parts, level):
    d = zlib.compressobj(level, zlib.DEFLATED, 31)
    return d.compress(b"".join(parts)) + d.flush()


def layouts():
    own = records(20)
    yield "stored, many", own, member(own, 0)
    yield "deflated, many", own, member(own, 6)
    yield "stored, one each", own, b"".join(member([r], 0) for r in own)
    yield "deflated, one each", own, b"".join(member([r], 6) for r in own)
    yield "plain", own, b"".join(own)
    yield "five each", own, b"".join(member(own[i : i + 5], 6 * (i % 2)) for i in range(0, 20, 5))


def found(data):
    """Numbers of the records that come back, and whether each is as it was."""
    rows = [(x, y) for kind, _, x, y in warc.salvage_bytes(data) if kind == "record"]
    return [(warc._page(x.get("warc-record-id", "")), x, y) for x, y in rows]


def heads(own):
    return {i: {k.lower(): v for k, v in (line.split(": ", 1) for line in r.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:])} for i, r in enumerate(own)}


@pytest.mark.parametrize("layout", list(layouts()), ids=lambda x: x[0])
def test_flips_and_cuts(layout):
    name, own, data = layout
    rng, want = random.Random(name), heads(own)
    for trial in range(150):
        damaged = bytearray(data)
        at = rng.randrange(len(data))
        if trial % 3:
            damaged[at] ^= 1 << rng.randrange(8)
        else:
            del damaged[at:]
        got = found(bytes(damaged))
        ids = [i for i, *_ in got]
        assert len(ids) == len(set(ids)), (name, trial)
        if name != "plain":  # nothing but a digest of the block guards a plain record's header
            assert all((x == want[i] or name == "deflated, many") and y == own[i].split(b"\r\n\r\n", 1)[1][:-4] for i, x, y in got), (name, trial)
        if "one each" in name or name == "plain":
            assert len(ids) >= 18 * (trial % 3 > 0), (name, trial)
        if name == "stored, many" and trial % 3:
            assert len(ids) >= 18, (name, trial, at, len(ids))


@pytest.mark.parametrize("level", [0, 6])
def test_a_damaged_trailer_loses_no_record(level):
    own = records(20)
    for at, x in ((-8, 0xFF), (-5, 1), (-4, 1), (-1, 0x80)):
        damaged = bytearray(member(own, level))
        damaged[at] ^= x
        rows = warc.salvage_bytes(bytes(damaged))
        assert [warc._page(x["warc-record-id"]) for kind, _, x, _ in rows if kind == "record"] == list(range(20))
        assert [r[1:3] for r in rows if r[0] == "gap"] == [(0, len(damaged))]


def test_stored_records_come_once():
    own = records(20)
    damaged = bytearray(member(own, 0))
    damaged[damaged.index(own[7][-40:])] ^= 1
    assert sorted(i for i, *_ in found(bytes(damaged))) == [i for i in range(20) if i != 7]


def test_a_changed_header_is_found_by_the_checksum():
    own = records(20)
    damaged = bytearray(member(own, 0))
    damaged[damaged.index(b"http://h/7") + 5] ^= 3
    assert sorted(i for i, *_ in found(bytes(damaged))) == [i for i in range(20) if i != 7]
    for p in (0, 10, 999):
        data = bytearray(random.Random(p).randbytes(1000))
        crc = zlib.crc32(data)
        data[p] ^= 0x41
        assert warc._flipped(crc ^ zlib.crc32(data), 1000, [(0, 1000)]) == p


def test_nested_lengths_are_linear():
    def nested(n):
        head = b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Block-Digest: sha1:A\r\nContent-Length: %08d\r\n\r\n"
        size = len(head % 0)
        return b"".join(head % ((n - 1 - i) * size) for i in range(n)) + b"\r\n\r\n"

    took = []
    for n in (10_000, 40_000):
        data = nested(n) + gzip.compress(records(1)[0])
        began = time.process_time()
        assert [i for i, *_ in found(data)] == [0]
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1
