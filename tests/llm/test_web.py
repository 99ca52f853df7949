"""op5 and op7: round trips through damaged archives, and pages of several templates."""

import gzip
import hashlib
import io
import random
import time
import tracemalloc

import pytest

from lumenfold.llm import html_text, warc

SF = "/root/testdata/sf0.001"
BIG = "x" * 1000


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type int")


def round_trip(spark, rows, tmp_path, payloads=False):
    return warc.read(warc.write(pages(spark, rows), f"file://{tmp_path}/w"), payloads)


def test_archives_hold_every_page(spark, tmp_path):
    rows = [(1, "http://a/é b", BIG), (5, None, BIG), (3, "u", BIG), (4, "u", None), (6, "u", ""), (7, "u", "é" * 500), (8, "u", "é" * 500), (9, "u", "x" * 999), (10, "u", "x" * 999), (5, None, BIG), (None, "u", BIG), (12, "a\r\nb", "l\r\n\r\nWARC/1.1\r\n")]
    got = round_trip(spark, rows, tmp_path, payloads=True).collect()
    assert all(r.kind == "record" for r in got) and len(got) == len(rows)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got)
    assert kinds == sorted([(1, "revisit", 5, 1000), (3, "revisit", 5, 1000), (5, "response", 0, 1000), (5, "response", 0, 1000), (-1, "response", 0, 1000), (4, "response", 0, 0), (6, "response", 0, 0), (7, "revisit", 8, 1000), (8, "response", 0, 1000), (9, "response", 0, 999), (10, "response", 0, 999), (12, "response", 0, 15)])
    text = {r[0]: r[2] or "" for r in rows}
    for r in got:
        assert r.payload_digest == hashlib.sha1(text[r.page_id].encode()).hexdigest()
        if r.record_type == "response":
            assert r.payload.decode() == text[r.page_id]


def test_query_over_a_table(spark):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = warc.query(spark, SF).collect()
    first = {}
    for k, h in html.items():
        first[h] = max(k, first.get(h, -1))
    want = {(k, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if len(h.encode()) >= 1000 and first[h] > k else "response", first[h] if len(h.encode()) >= 1000 and first[h] > k else None) for k, h in html.items()}
    assert {tuple(r) for r in got} == want and len(got) == len(html)


def records(n=6):
    return [warc.record(i, f"u{i}", (f"page {i} " * 50).encode()) for i in range(n)]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_of_damaged_archives(zipped):
    parts = [gzip.compress(r, mtime=0) if zipped else r for r in records()]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts) + 1)]
    whole = warc.salvage_bytes(b"".join(parts))
    assert [w[0] for w in whole] == ["record"] * 6
    rng = random.Random(4)
    for _ in range(60):
        k = rng.randrange(6)
        data = bytearray(b"".join(parts))
        head = 1 if zipped else parts[k].index(b"\r\n\r\n") + 4  # a plain header's fields have no checksum
        at = rng.randrange(starts[k] + head, starts[k + 1] - 5)
        data[at] ^= 0x5A
        found = warc.salvage_bytes(bytes(data))
        ids = [int(f[2]["warc-target-uri"][1:]) for f in found if f[0] == "record"]
        assert [i for i in range(6) if i != k] == [i for i in ids if i != k]
        if k not in ids:
            gap = [f for f in found if f[0] == "gap"]
            assert [(g[1], g[2]) for g in gap] == [(starts[k], starts[k + 1])] and gap[0][3]
    cut = b"".join(parts)[: starts[5] + 20]
    found = warc.salvage_bytes(cut)
    assert len(found) == 6 and found[-1][:3] == ("gap", starts[5], len(cut))
    found = warc.salvage_bytes(b"junk\r\n" * 9 + parts[0] + b"\x1f\x8b\x08 more junk" + parts[1])
    assert [f[0] for f in found] == ["gap", "record", "gap", "record"]
    assert warc.salvage_bytes(b"") == []


def test_salvage_inside_a_member(monkeypatch):
    def ids(found):
        return [int(f[2]["warc-target-uri"][1:]) for f in found if f[0] == "record"]

    monkeypatch.setattr(warc, "HELD_BYTES", 500, raising=False)
    rng = random.Random(1)
    parts = [warc.record(i, f"u{i}", bytes(rng.randrange(97, 123) for _ in range(2000))) for i in range(6)]
    bad = parts[:2] + [parts[2].replace(b"\r\n\r\n", b"\r\n\r\n?", 1)] + parts[3:]
    one, other = gzip.compress(b"".join(bad), mtime=0), gzip.compress(parts[0], mtime=0)
    found = warc.salvage_bytes(one + other)
    assert ids(found) == [0, 1, 3, 4, 5, 0] and [f[1:3] for f in found if f[0] == "gap"] == [(0, len(one))]
    whole = gzip.compress(b"".join(parts), mtime=0)
    found = warc.salvage_bytes(whole[: len(whole) * 3 // 4])
    assert ids(found) == [0, 1, 2, 3] and found[-1][:3] == ("gap", 0, len(whole) * 3 // 4)
    for at in range(len(whole) // 2, len(whole) - 8, 211):
        data = bytearray(whole)
        data[at] ^= 0x5A
        found = warc.salvage_bytes(bytes(data) + other)
        assert found[-1][:2] == ("record", len(whole)) and all(f[3] in parts[k] for k, f in zip(ids(found), found) if f[0] == "record")
    assert [f[0] for f in warc.salvage_bytes(whole + other)] == ["record"] * 7


def test_salvage_is_linear():
    began = time.time()
    assert warc.salvage_bytes(b"\x1f\x8b\x08" * ((64 << 20) // 3))[0][:2] == ("gap", 0)  # starts of members that aren't
    assert [f[:3] for f in warc.salvage_bytes(b"WARC/1.1\r\n" * 200_000 + b"\r\n\r\n")] == [("gap", 0, 2_000_004)]
    rng = random.Random(2)
    junk = b"".join(b"\x1f\x8b\x08\x00" + rng.randbytes(252) for _ in range(1 << 16))
    good = gzip.compress(warc.record(1, "u1", b"page"), mtime=0)
    assert [f[:3] for f in warc.salvage_bytes(junk + good)] == [("gap", 0, len(junk)), ("record", len(junk), warc.salvage_bytes(good)[0][2])]
    assert time.time() - began < 30


def test_large_blocks_are_read_in_steps(monkeypatch):
    monkeypatch.setattr(warc, "HELD_BYTES", 10_000)
    payload = random.Random(3).randbytes(1000) * 3000
    parts = [warc.record(1, "u1", payload), warc.record(2, "u2", b"x")]
    for data in (gzip.compress(b"".join(parts), mtime=0), b"".join(gzip.compress(p, mtime=0) for p in parts), b"".join(parts)):
        assert [(f[0], f[3] in parts[k]) for k, f in enumerate(warc.salvage_bytes(data))] == [("record", True)] * 2
        tracemalloc.start()
        sizes = [block.payload_bytes for *_, block in warc.scan(io.BytesIO(data), len(data))]
        assert sizes == [len(payload), 1] and tracemalloc.get_traced_memory()[1] < 2_500_000
        tracemalloc.stop()
    head = b"WARC/1.1\r\nX-Long: " + b"x" * (5 << 20) + b"\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [(f[0], f[3]) for f in warc.salvage_bytes(head)] == [("record", b"ab")]


def test_a_gap_in_the_querys_archives_is_an_error(spark, tmp_path, monkeypatch):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(records()[0], mtime=0) + b"junk")
    monkeypatch.setattr(warc, "write", lambda *_: spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "uri string"))
    with pytest.raises(Exception, match="gap in"):
        warc.query(spark, SF).collect()


def test_reader_logs_gaps_in_spark(spark, tmp_path):
    parts = [gzip.compress(r, mtime=0) for r in records()]
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + parts[1][:-9] + parts[2])
    got = warc.read(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "uri string")).collect()
    assert sorted((r.kind, r.page_id, r.stop) for r in got if r.kind == "record") == [("record", 0, None), ("record", 2, None)]
    assert [(r.start, r.stop) for r in got if r.kind == "gap"] == [(len(parts[0]), len(parts[0]) + len(parts[1]) - 9)]


def text(html, winners=()):
    return html_text.main_text(html_text.Page(html), list(winners))


PAGE = """<!doctype html><html><head><title>T</title><style>p{x:1}</style><script>var a="</p>";</script></head><body class="home has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div id="cookie-notice"><p>We use cookies on this long long long long site</p></div>
<div class="layout with-sidebar"><div class="post-%d content"><h1>A &amp; B</h1><p>One <b>bo</b>ld&nbsp;word.<p>Two<br>lines <a href=x>linked</a>.<ul><li>x</li><li>y</li></ul>
<div class="ad-slot"><p>Buy this thing now, it is very good</p></div><form><input value="q"><p>Search here</p></form><!-- c > --><p>Last para of the text, long enough to win over.</p></div>
<aside>Side</aside><div class="sidebarBox"><p>Other text</p></div></div><section id="comments"><article class="comment"><p>First! %s</p></article></section><footer>&copy; foot</footer></body></html>"""
WANT = "A & B One bold word. Two lines linked. x y Last para of the text, long enough to win over."


def test_page_text():
    assert text(PAGE % (7, "reader " * 200)) == WANT
    assert text("") == "" and text("<html><body></body>") == "" and text("just words") == "just words"
    assert text("<div><p>cut of") == "cut of" and text("<div><p>a</p><script>x") == "a"
    assert text("<article><p>a &lt;b&gt; &#233;&am</article><div>") == "a <b> é&am"
    assert text('<div><p class="x" title="a>b">in</p><p class=ad>out<p>in2</div>') == "in in2"


def test_nested_and_multi_section_articles(spark):
    words = lambda name, n: (name + " ") * n + name
    lead, body, more = words("lead", 19), words("body", 399), words("more", 119)
    nested = f"<body><nav>x</nav><article><h1>Title</h1><p>{lead}</p><div class=body><p>{body}</p></div></article><div class=promo2>few</div></body>"
    sections = f"<body><article><section><p>{body}</p></section><section><p>{more}</p></section></article></body>"
    boxes = f"<body><div class=top><a href=x>{words('menu', 30)}</a></div><div class=post><h1>T</h1><div class=body>{body}</div><div class=more>{more}</div></div><div>few</div></body>"
    twice = f"<body><div class=m>{body}</div><div class=m>{more}</div><div class=z>few</div></body>"
    want = {1: f"Title {lead} {body}", 2: f"{body} {more}", 3: f"T {body} {more}"}
    assert [text(nested), text(sections), text(boxes)] == list(want.values())
    assert text(twice, [(">body>div.m", 2)]) == f"{body} {more}"
    rows = [(k, f"http://h{k}.example/{i}", h) for k, h in zip(want, (nested, sections, boxes)) for i in range(3)]
    assert all(r.text == want[r.page_id] for r in html_text.extract(pages(spark, rows)).collect())


def test_misleading_marks(spark):
    prose = ("words of the article " * 60).strip()
    side = "<div class=sidebar><p>Other things here</p></div><div id=comments><p>Nice</p></div>"
    wrappers = ["<div class='page sidebar-right'>%s</div>", "<div id=wrap class=header-fixed>%s</div>", "<article class='post comments-open tag-search'>%s</article>", "<div class='page sidebar-right'><div class='text header-fixed'>%s</div></div>",
                "<div class=widget><main>%s</main></div>", "<div class=social-page><article>%s</article></div>", "<form><div class=x>%s</div></form>", "<div class=banner><section>%s</section></div>", "<app-root class=header-fixed><div>%s</div></app-root>"]
    made = [f"<body><p>Skip</p>{w % f'<h1>T</h1><p>{prose}</p>{side}'}<footer>foot</footer></body>" for w in wrappers]
    for html in made:
        assert f"T {prose}" in text(html) and "Other" not in text(html) and "Nice" not in text(html), html
    assert text(f"<body><div class=discussion><p>{prose}</p></div></body>") == prose
    assert text(f"<body><div class=m><p>{prose}</p></div><div id=comments><p>{prose * 5}</p></div><div class=sidebar-right><p>Other</p></div></body>") == prose
    rows = [(k, f"http://h{k}.example/{i}", h) for k, h in enumerate(made) for i in range(3)]
    assert all(prose in r.text for r in html_text.extract(pages(spark, rows)).collect())


def test_hosts_vote(spark):
    body = "<body><div class=m><p>%s</p></div><div class=wide><p>%s</p></div></body>"
    rows = [(i, "http://H.example:80/a", body % (f"main {i} " * 9, "promo ")) for i in range(5)]
    rows += [(9, "http://h.example/b", body % ("short", "an odd page with a long other text " * 5)), (10, None, None), (11, "x", ""), (12, "http://h.example/", "<main><p>another template</p></main>"), (12, "http://h.example/", "<main><p>another template</p></main>")]
    got = html_text.extract(pages(spark, rows)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[9].text == "short" and by[10].text == "" and by[10].url is None
    assert by[0].text == ("main 0 " * 9).strip() and by[12].text == "another template" and by[12].n_chars == 16
    assert html_text.extract(pages(spark, rows).limit(0)).count() == 0


def test_rare_templates_of_a_host(spark):
    def page(k, name):
        return k, "http://h.example/", f"<body><div class=box>short box</div><div class={name}><p>{f'article {k} ' * 40}</p></div></body>"

    rows = [(k, "http://h.example/", f"<body><div class=box>{f'article {k} ' * 40}</div></body>") for k in range(40)]
    rows += [page(40 + 2 * i + j, name) for i, name in enumerate(["b", "c", "d", "e", "f"]) for j in range(2)]
    got = html_text.extract(pages(spark, rows)).collect()
    assert len(got) == 50 and all(r.text == (f"article {r.page_id} " * 40).strip() for r in got)


def test_extraction_over_a_table(spark):
    import re

    for r in html_text.query(spark, SF).collect():
        assert r.n_chars == len(r.text) and "<" not in re.sub(r"&", "", r.text)
    src = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import html as h

    got = {r.page_id: r.text for r in html_text.query(spark, SF).collect()}
    for k, page in src.items():
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
        want = " ".join(h.unescape(re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>", "", re.sub(r"<[^>]*\Z", "", m[1])))).split()) if m else None
        if want:
            assert got[k] == want, k
