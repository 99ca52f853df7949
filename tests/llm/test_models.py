"""op4 and op8: held-out accuracy, the training's edge cases, sentences located, rows with nulls and repeats."""

import zlib

import numpy as np
import pytest

from lumenfold.llm import quality, toxicity

SF = "/root/testdata/sf0.01"
ROWS = [(1, None, 5), (1, None, 5), (None, "some words", 5), (3, "", 5), (4, " \n ", 5), (5, "long words " * 40_000, 5), (6, "... !!", 5)]


def area(score, y):
    rank = np.empty(len(score))
    rank[np.argsort(score)] = np.arange(len(score))
    return (rank[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())


@pytest.mark.parametrize(("module", "column", "threshold", "least"), [(quality, "quality", 0.7, 0.99), (toxicity, "toxic", 0.3, 0.85)])
def test_held_out_accuracy(spark, module, column, threshold, least):
    got = module.query(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    label = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    pairs = [(r.score, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    assert area(np.array([p[0] for p in pairs]), np.array([p[1] == 1 for p in pairs])) >= least


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, module, column):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, score int")
    train, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = module.train(train, labels)
    got = module.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1, 3, 4)} == {got[0].score}
    assert module.score(docs.limit(0), model).count() == 0
    none = labels.limit(0)
    alone = module.train(train, none)
    assert module.score(docs, alone).count() == len(ROWS)
    one = labels.where(f"{column} = 0")
    assert all(r.predicted == 0 for r in module.score(docs, module.train(train, one)).collect())
    keep = module.keep_good if module is quality else module.keep_clean
    kept = keep(docs, labels)
    assert kept.columns == docs.columns


def test_locating_sentences(spark):
    docs = spark.createDataFrame([(i, "The sun is out. You vile grub, leave!\nAll is well here." if i % 3 == 0 else f"The sun is out, number {i}. All is well. Leave it") for i in range(300)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) as toxic")
    model = toxicity.train(docs, labels)
    found = toxicity.locate(docs, model).collect()
    assert {r.doc_id for r in found} == set(range(0, 300, 3))
    assert {(r.sentence, r.text, r.start) for r in found} == {(1, "You vile grub, leave", 16)}


def test_attention_finds_the_passage():
    rng = np.random.default_rng(1)
    bags, y = [], []
    for k in range(300):
        bag = rng.normal(0, 0.3, (6, quality.WIDTH)).astype(np.float32)
        if k % 2:
            bag[k % 6, :3] += 4
        bags.append(bag)
        y.append(float(k % 2))
    model = quality.fit(bags, np.array(y), np.ones(300), epochs=30)
    s = model.scores(bags)
    assert ((s > 0.5) == np.array(y, bool)).mean() > 0.98
    assert np.mean([np.argmax(model.attention(bags[k])) == k % 6 for k in range(1, 300, 2)]) > 0.9


def test_slopes_equal_differences_of_the_loss():
    rng = np.random.default_rng(4)
    assert abs(toxicity.noisy_or(np.array([0.2, 0.5, 0.0])) - (1 - 0.8 * 0.5)) < 1e-12
    lengths = rng.integers(1, 5, 12)
    starts, owner = np.cumsum(lengths) - lengths, np.sort(np.concatenate([np.arange(5), rng.integers(0, 5, 7)]))
    of_word, local, flat = np.repeat(np.arange(8), 2), rng.integers(0, 6, 16), rng.integers(0, 8, lengths.sum())
    y, weight, v, bias = np.array([1.0, 0, 1, 0, 1]), rng.uniform(0.5, 2, 5), rng.normal(0, 1, 6), -1.5

    def loss(v, bias):
        return toxicity.loss_and_slopes(v, bias, of_word, local, 8, flat, starts, lengths, owner, y, weight, 0.01)

    _, g, gb = loss(v, bias)
    for k in range(6):
        step = np.eye(6)[k] * 1e-6
        assert abs((loss(v + step, bias)[0] - loss(v - step, bias)[0]) / 2e-6 - g[k]) < 1e-6
    assert abs((loss(v, bias + 1e-6)[0] - loss(v, bias - 1e-6)[0]) / 2e-6 - gb) < 1e-6


def test_scores_equal_a_plain_forward_pass(spark):
    """One sentence, one word, one feature at a time, over 200 whole documents; the located sentence is the worst one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(200)
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    floor = 1 / (1 + np.exp(-model.bias))
    assert model.bias < 0
    for r in toxicity.score(docs, model).collect():
        none, each = 1.0, []
        for start, end, words in toxicity.sentences(text[r.doc_id]):
            z = model.bias
            for w in words:
                for feature in toxicity.word_features(w):
                    z += float(model.weights[feature])
            each.append((max(0.0, (1 / (1 + np.exp(-z)) - floor) / (1 - floor)), start, end))
            none *= 1 - each[-1][0]
        assert abs(r.score - (1 - none)) < 1e-5
        if r.predicted:
            assert abs(r.sentence_score - max(each)[0]) < 1e-5 and (r.sentence_start, r.sentence_end) in [e[1:] for e in each if e[0] > max(each)[0] - 1e-5]
        else:
            assert (r.sentence_start, r.sentence_end, r.sentence_score) == (None, None, None)


def test_length_alone_is_not_toxic():
    weights = np.zeros(toxicity.FEATURES, np.float32)
    weights[toxicity.word_features("bad")] = 9.0
    scorer = toxicity.Model(weights, -8.0).scorer()
    clean = toxicity.sentence_words("some plain words. " * 20_000)
    assert toxicity.noisy_or(scorer(clean)) == 0 and toxicity.noisy_or(scorer([*clean, ["bad"]])) > 0.7
    assert toxicity.noisy_or(toxicity.Model(0 * weights, 6.0).scorer()([["x"]])) > 0.9


def test_long_words_are_read_to_their_end():
    for joined in ("_".join(["plain"] * 20 + ["awful"]), "x" * 40 * 3 + "awful"):
        for text in (joined, "é " + joined):
            assert toxicity.sentence_words(text)[0][-1] == "awful"
            assert [w for _, _, w in toxicity.sentences(text)] == toxicity.sentence_words(text)
    assert toxicity.sentence_words("snake_case " + "_" * 90 + " end") == [["snake_case", "end"]] and toxicity.sentence_words("_" * 90) == []
    assert toxicity.word_features("x" * 39 + "ab") != toxicity.word_features("x" * 39 + "ac")
    assert quality.shape("a" * 70 + "0") == "a0"
