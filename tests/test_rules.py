"""Rules on literal rows that the tables don't hold: names, sizes, white space, patterns, plug-ins, late rows."""

import json
import random
from datetime import datetime, timedelta
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from lumenfold.functions.text import chunk_starts, strip, suffix
from lumenfold.operators import evaluate, guard, ingest, memory, near, retrieval, routing, uploads
from lumenfold.sources import files
from lumenfold.streaming import operators as streaming

NAMES = ["a.pdf", ".pdf", "a.", "a.b.PDF", "a.pdf ", "d/.pdf", "d/a.pdf/", "d/a.pdf/.", "a", "", "..pdf", "a..pdf", "x.tar.JPG", "a.pdf\n", "é.ÉXT", "a/b.c/d", "...", "a .png", "/", "a.b."]


def outcomes(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, original_filename string, content_type string, size_bytes long")
    return [(r.status, r.detail) for r in uploads.outcome(df).orderBy("doc_id").collect()]


def test_suffix_is_pathlibs(spark):
    got = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", suffix(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == {n: PurePosixPath(n).suffix.lower() for n in NAMES}


def test_strip_is_pythons(spark):
    white = [chr(c) for c in range(1, 0x3001) if chr(c).isspace()] + ["​", "᠎", "﻿"]
    texts = [a + "x " + b + "y" + b + a for a in white for b in white[:6]] + ["".join(white), "", "x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s")).collect()
    assert all(r.s == r.t.strip() for r in got)


def test_checks_in_order(spark):
    rows = [(None, "x", 1), ("", "x", 1), ("a.txt", "bad", 0), ("a.pdf", None, 1), ("a.pdf", "Application/PDF", 1), ("a.png", "image/png", 10485760), ("a.png", "image/png", 10485761), ("a.png", "image/png", 0), ("a.png", "application/pdf", 1), ("a.pdf", "image/png", 1)]
    want = [(400, uploads.NO_NAME)] * 2 + [(400, uploads.BAD_EXTENSION)] + [(400, uploads.BAD_TYPE)] * 2 + [(201, uploads.SUCCESS), (413, uploads.TOO_LARGE), (400, uploads.EMPTY), (201, uploads.SUCCESS), (201, uploads.SUCCESS)]
    assert outcomes(spark, rows) == want


def test_an_unreadable_pdf_stays_on_disk(spark):
    df = spark.createDataFrame([(1, "a.pdf", "image/png", 9), (2, "a.png", "image/png", 9), (3, "a.txt", "image/png", 9)], "doc_id long, original_filename string, content_type string, size_bytes long")
    got = {r.doc_id: (r.status, r.file_retained) for r in uploads.outcome(df, F.lit(True)).collect()}
    assert got == {1: (422, True), 2: (201, True), 3: (400, False)}


def test_pages_and_response(spark):
    df = spark.createDataFrame([(1, "a.pdf", "application/pdf", 9, " x \n\n y"), (2, "b.png", "application/pdf", 9, "x"), (3, "c.pdf", "application/pdf", 9, None)], "doc_id long, original_filename string, content_type string, size_bytes long, text string")
    got = {r.original_filename: r for r in uploads.response(df).collect()}
    assert [tuple(p) for p in got["a.pdf"].extracted_pages] == [(1, "x"), (2, ""), (3, "y")]
    assert got["b.png"].number_of_pages == 0 and got["c.pdf"].number_of_pages == 1
    body = json.loads(uploads.response(df).where("original_filename = 'a.pdf'").select(F.to_json(F.struct("*")).alias("j")).first().j)
    assert list(body) == ["message", "original_filename", "saved_filename", "content_type", "size_bytes", "number_of_pages", "extracted_pages"]
    assert uploads.health(spark, "x").first().message == "x API is running"
    name = spark.range(1).select(uploads.random_saved_name(F.lit("a.PNG")).alias("n")).first().n
    assert len(name) == 36 and name.endswith(".png")


def test_chunk_reads(spark):
    sizes = [0, 1, 1 << 20, (1 << 20) + 1, 10485760]
    got = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", uploads.chunk_sizes(F.col("s")).alias("c")).collect()
    assert all(sum(r.c) == r.s and len(r.c) == -(-r.s // (1 << 20)) for r in got)


def test_chunks_cover_texts(spark):
    r = random.Random(1)
    texts = ["x" * n for n in (0, 1, 999, 1000, 1001, 1800, 1801, 2600, 2601)] + ["".join(r.choice("aé漢🙂") for _ in range(5000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ingest.chunks(docs).orderBy("doc_id", "chunk_id").collect()
    for i, t in enumerate(texts):
        own = [c for c in got if c.doc_id == i]
        assert own and own[-1].end == len(t)
        assert all(c.text == t[c.start : c.end] for c in own) and all(a.end > b.start or not t for a, b in zip(own, own[1:]))
    assert spark.range(1).select(F.size(chunk_starts(F.lit("x" * 1801))).alias("n")).first().n == 3


def test_patterns_without_rows_in_the_tables(spark):
    pages = spark.createDataFrame([(1, '<figure><img src=a alt="A cart"><figcaption>Fig. 1: a <b>cart</b></figcaption></figure><h2>On <i>carts</i></h2><p>x</p><ul><li>one</ul>')], "page_id long, html string")
    assert [(r.ordinal, r.text) for r in ingest.captions(pages).collect()] == [(1, "A cart"), (2, "Fig. 1: a")]
    assert [(r.kind, r.text) for r in ingest.blocks(pages).orderBy("ordinal").collect()] == [("caption", "Fig. 1: a cart"), ("heading", "On carts"), ("paragraph", "x"), ("list_item", "one")]
    docs = spark.createDataFrame([(1, "Here F = m*a and v2 = v1+at hold")], "doc_id long, text string")
    assert [r.equation for r in ingest.equations(docs).collect()] == ["F = m*a", "v2 = v1+at"]
    asks = spark.createDataFrame([("What does Figure 3 on page 12 show?",), ("no",), (None,)], "t string").select(routing.structural(F.col("t")).alias("s")).collect()
    assert [r.s and tuple(r.s) for r in asks] == [("figure", 3), None, None]


def test_verdicts(spark):
    docs = spark.createDataFrame([(1, "ab", "en", 2), (2, "ab", "en", 3), (3, None, "en", 0), (4, "ab", None, 2), (5, " ", "en", 1)], "doc_id long, text string, lang string, n_chars long")
    assert [r.verdict for r in ingest.validated(docs).orderBy("doc_id").collect()] == ["ok", "wrong_length", "empty", "language", "empty"]


def test_fusion_and_ranks(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "item_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 6, 1), (1, 7, 2)], "item_id long, doc_id long, rank int")
    one, two = ({r.doc_id: r.score for r in retrieval.fuse(*x).collect()} for x in ((a, b), (b, a)))
    assert one == two and one[6] == pytest.approx(1 / 62 + 1 / 61)
    ties = spark.createDataFrame([(1, d, 0.5) for d in (9, 3, 4)], "item_id long, doc_id long, score double")
    assert [(r.doc_id, r["rank"]) for r in retrieval.top(ties, "item_id", "doc_id", 2).orderBy("rank").collect()] == [(3, 1), (4, 2)]


def test_texts_of_few_candidates(spark):
    found = spark.createDataFrame([(1, 5), (1, 5), (2, 6), (3, 5), (1, 9), (None, 5), (1, None)], "item_id long, doc_id long").distinct()
    asked = spark.createDataFrame([(1, "one"), (1, "uno"), (2, None), (None, "none")], "item_id long, text string")
    docs = spark.createDataFrame([(5, "five"), (5, "5"), (6, None), (7, "seven"), (None, "x")], "doc_id long, text string")
    both = retrieval.with_texts(found, asked, docs)
    assert both.columns == ["doc_id", "item_id", "query", "text"]
    assert sorted(map(tuple, both.collect()), key=str) == sorted([(5, 1, "one", "five"), (5, 1, "one", "5"), (5, 1, "uno", "five"), (5, 1, "uno", "5"), (6, 2, None, None)], key=str)
    wide = spark.range(10**7).selectExpr("id as doc_id", "repeat('x ', 50) as text")  # too large to be broadcast
    plan = retrieval.with_texts(found, asked.limit(2), wide)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan


def test_dense_blocks_meet_every_row(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    asked = rows.selectExpr("vec_id as query_id", "embedding as qvec")
    whole = {tuple(r) for r in retrieval.dense(asked, rows).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    assert {tuple(r) for r in retrieval.dense(asked, rows).collect()} == whole and len(whole) == 1600


def test_near_duplicates_and_null_texts(spark):
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base, "x"])), (4, "other words"), (5, None), (6, "")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.near_duplicates(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0), 5: (5, 0), 6: (6, 0)}


def test_isolation_never_leaks(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i)], i % 3) for i in range(30)], "vec_id long, embedding array<double>, label int")
    asked = rows.selectExpr("vec_id as query_id", "embedding as qvec", "label as user")
    assert all(r.query_id % 3 == r.vec_id % 3 and r.query_id != r.vec_id for r in memory.recall(asked, rows, 5).collect())
    assert guard.isolated(rows, "label", F.lit(7)).count() == 0 and guard.isolated(rows, "label", F.lit(None)).count() == 0


def test_numbers_and_overlap(spark):
    df = spark.createDataFrame([("3.5 of 12", "12 and 3.5"), ("7", None), (None, "1")], "a string, b string")
    assert [r.x for r in df.select(guard.unsupported_numbers(F.col("a"), F.col("b")).alias("x")).collect()] == [[], ["7"], []]
    got = df.select(evaluate.correctness(F.col("a"), F.col("b")).alias("f"), guard.groundedness(F.col("a"), F.col("b")).alias("g")).collect()
    assert got[1].g == 0 and got[2].g == 0 and got[0].f > 0


def test_plug_ins(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two ")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.png").write_bytes(b"image")
    (tmp_path / "d.txt").write_bytes(b"text")
    types = spark.createDataFrame([("a.pdf", "application/pdf"), ("b.pdf", "application/pdf"), ("c.png", "image/png"), ("d.txt", "text/plain")], "original_filename string, content_type string")
    found = files.landing(spark, str(tmp_path), types)

    def reader(data):
        if data == b"broken":
            raise ValueError("no PDF")
        return data.decode().split("|")

    got = {r.upload_id[-5:]: r for r in files.extracted(found, reader).collect()}
    assert got["a.pdf"].status == 201 and [tuple(p) for p in got["a.pdf"].pages] == [(1, "one"), (2, "two")]
    assert (got["b.pdf"].status, got["b.pdf"].detail, got["b.pdf"].pages) == (422, uploads.NOT_READ, []) and len(got) == 2
    if files.default_reader() is None:
        assert {r.status for r in files.extracted(found).collect()} == {501}
    kept = files.store(found, f"{tmp_path}/stored")
    assert kept.count() == 4 and spark.read.parquet(f"{tmp_path}/stored").count() == 3
    assert {(r.status, r.text) for r in files.recognised(found).collect()} == {("ocr_unavailable", None)}
    assert {(r.status, r.text) for r in files.recognised(found, lambda c: "seen").collect()} == {("ok", "seen")}
    prompts = spark.createDataFrame([(1, "hi")], "prompt_id long, prompt string")
    assert files.generated(prompts).first().status == "model_unavailable"
    assert files.generated(prompts, lambda ps: [p.upper() for p in ps]).first().answer == "HI"


def test_late_rows_are_dropped_and_streams_resume(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    source, state = f"{tmp_path}/in", f"file://{tmp_path}/state"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    put([(1, start, 1, "a"), (2, start + timedelta(hours=5), 1, "b"), (2, start + timedelta(hours=5), 1, "b")])
    first = streaming.drained(streaming.session_state(streaming.event_stream(spark, source)), "update", state).collect()
    assert [(r.user_id, r.n, r.last_type) for r in first] == [(1, 3, "b")]
    put([(3, start + timedelta(minutes=1), 1, "late"), (4, start + timedelta(hours=9), 1, "c")])
    again = streaming.drained(streaming.session_state(streaming.event_stream(spark, source)), "update", state)
    assert max((r.n, r.last_type) for r in again.collect()) == (5, "c")
    once = streaming.drained(streaming.distinct_events(streaming.event_stream(spark, source)), "append").collect()
    assert sorted(r.event_id for r in once) == [1, 2, 3, 4]

    source = f"{tmp_path}/late"
    counts = lambda: streaming.drained(streaming.tumbling(streaming.event_stream(spark, source), "1 hour"), "append", f"file://{tmp_path}/windows")
    put([(1, start, 1, "a"), (2, start + timedelta(hours=5), 1, "b")])
    counts()
    put([(3, start + timedelta(minutes=1), 1, "late"), (4, start + timedelta(hours=9), 1, "c")])
    got = {(r.start, r.n) for r in counts().collect()}
    assert (start, 1) in got and (start, 2) not in got
