"""Spelling variants against a brute-force comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from lumenfold.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n int"  # extra columns with clashing names
SMALL = {i: i + 32 for i in range(65, 91)}


def counted(docs, chars, count):
    total = Counter()
    for d, t, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= chars and n >= count}


def edits(a, b):
    """Whether one edit makes b of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(docs, chars=S.LEAST_CHARS, count=S.LEAST_COUNT):
    n = counted(docs, chars, count)
    near = {w: [v for v in n if edits(w, v)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(rows)


def made(spark, docs, **k):
    rows = S.variants(spark.createDataFrame(docs, SCHEMA).repartition(3), **k).collect()
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows)


def test_equals_brute_force_on_typed_words(spark):
    rng = random.Random(1)
    base = ["letters", "lettre", "straße", "Ünder", "ÿÿÿÿÿ", "aaaaaa", "a×b÷cde", "cabbage"]
    docs = []
    for d in range(150):
        words = []
        for _ in range(40):
            w = rng.choice(base[: 1 + rng.randrange(len(base))])
            if rng.random() < 0.3:
                i, c = rng.randrange(len(w) + 1), rng.choice("abeßüz")
                w = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
            words.append(w.upper() if rng.random() < 0.2 and w.isascii() else w)
        docs.append((d, rng.choice([" ", "-", " 中 ", "\n"]).join(words), "w", 1))
    docs += [(None, "cabbage cabbage", "w", 1), (3, None, "w", 1), (4, "", "w", 1)] + [docs[0]] * 3
    found = made(spark, docs)
    assert found == brute(docs) and any(r[1] for r in found) and any(r[2] != (r[1] or r[0]) for r in found)


def test_equals_brute_force_on_long_words(spark):
    rng = random.Random(2)
    docs = []
    for length in (S.LONG - 1, S.LONG, S.LONG + 1, 200, 3000):
        w = "".join(rng.choice("ab") for _ in range(length))
        own = [w, w[:-1], w[: length // 2] + "c" + w[length // 2 :], "b" + w[1:], "a" + w[1:], w[:40] + "d" + w[41:], w[:40] + "e" + w[41:]]
        docs += [(k, " ".join(own), "w", 1) for k in range(4)] + [(9, " ".join([w] * 12), "w", 1)]
    docs += [(k, "z" * 70 + " " + "z" * 71 + " " + "z" * 72, "w", 1) for k in range(5)]
    assert made(spark, docs) == brute(docs)


def test_chains_lead_to_the_last(spark):
    words = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx"]
    docs = [(1000 + i, w, "w", 1) for k, w in enumerate(words) for i in range(3 * 3**k)]
    found = made(spark, docs)
    assert found == brute(docs)
    assert {r[2] for r in found if r[0] in words} == {words[-1]}


@pytest.mark.parametrize("docs", [[], [(1, None, "w", 1)], [(1, "once", "w", 1)]])
def test_nothing_to_group(spark, docs):
    assert S.variants(spark.createDataFrame(docs, SCHEMA)).collect() == []


def test_neighbourhood_is_full_and_distinct():
    for w in (b"aab", b"aaaa", b"abca", b"a"):
        found = [x for _, x in S.neighbourhood([w], b"abc")]
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + g :] for i in range(len(w) + 1) for c in (b"a", b"b", b"c") for g in (0, 1)}
        assert len(found) == len(set(found)) and set(found) == {x for x in want if x != w}


def test_few_filter_bits_change_nothing(spark, monkeypatch):
    docs = [(d, " ".join(f"word{c}{e} Words{c}" for c in "abcdef" for e in "xyz"), "w", 1) for d in range(4)]
    monkeypatch.setattr(S, "FILTER_BITS", 64)
    monkeypatch.setattr(S, "MOST_WORDS", 3)
    assert made(spark, docs) == brute(docs)


def test_query_equals_brute_force(spark):
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = S.query(spark, folder)
    assert sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows.collect()) == brute(docs)
    assert rows.where(F.col("form").isNotNull()).count() > 0
