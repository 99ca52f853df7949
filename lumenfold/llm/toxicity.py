"""Toxicity by multiple-instance learning: a document's label is the noisy-or of its sentences'.

A sentence's score is s = sigmoid(bias + sum of its distinct words' weights); a word's weight is the sum of the weights of its
hashed features (the word, its first and last letters) that enough documents of the sample hold. A document's score is
1 - product(1 - s) after taking out of each s what a sentence without known words has, so that length alone adds nothing.
Only documents are labelled: the gradient reaches the sentences that explain the label, and the trained sentence scores
then locate the offending ones.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_rows, text_or_empty

FEATURES = 1 << 18
#: Labelled rows of each class that a model is fitted on at most, and the longest text among them in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 100_000
#: A sentence ends at these marks or a line's end, and after so many words anyway.
_SENTENCE = re.compile(r"[^.!?\n]+")
_TOKEN = re.compile(r"\w+")
#: A longer run of word characters is several words: what stands between underscores, in pieces of at most so many characters.
LONGEST_WORD = 40
_PIECE = re.compile(rf"[^\W_]{{1,{LONGEST_WORD}}}")
SENTENCE_WORDS = 60
THRESHOLD = 0.3
#: Documents of the sample that must hold a feature; where the weights of words and of their parts (other words share
#: them) and the bias start. Chosen by the least log loss in cross-validation within the training rows (toxicity_tuning.py).
LEAST_DOCS, START, PART_START, BIAS = 5, 4.0, 3.0, -10.0
FOLDS, HELD_OUT = 4, 2


SCORED = "doc_id long, held_out boolean, score double, predicted int, sentence_start int, sentence_end int, sentence_score double"


def held_out():
    """Whether the CRC-32 of the doc_id as text leaves 2 when divided by 4 (null doc_id: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int, longest: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of a bounded sample of labelled rows outside the held-out fold.

    Of each class, the rows whose doc_ids have the smallest hashes: the same ones at every run. The weights restore the
    classes' shares. Labels other than 0 and 1, and rows without text, are left out of the fit.
    """
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(column).alias("y")).dropDuplicates(["doc_id"])
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        own = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = own if picked is None else picked.unionByName(own)
    got = docs.where(F.octet_length("text").between(1, longest)).select("doc_id", "text").join(F.broadcast(picked), "doc_id").collect()  # 2 * rows ids at most
    seen: dict[int, tuple[str, int]] = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["text"])):
        seen.setdefault(r["doc_id"], (r["text"], r["y"]))
    y = np.array([v[1] for v in seen.values()], np.float64)
    n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    total = max(1, sum(shares.values()))
    weight = np.array([shares.get(int(c), 0) / total / n[int(c)] for c in y]) * len(y)
    return [v[0] for v in seen.values()], y, weight


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word, without repeats."""
    w = word
    own = [f"w {w}", *(f"p {w[:n]}" for n in (4, 5, 6) if len(w) > n), *([f"s {w[-5:]}"] if len(w) > 5 else [])]
    return sorted({zlib.crc32(x.encode("utf-8", "replace")) % FEATURES for x in own})


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, distinct words in lower case) of each sentence that has words; long ones are cut."""
    out = []
    for m in _SENTENCE.finditer(text):
        spans = []
        for w in _TOKEN.finditer(text, m.start(), m.end()):
            spans += [w.span()] if w.end() - w.start() <= LONGEST_WORD else [p.span() for p in _PIECE.finditer(text, *w.span())]
        for i in range(0, len(spans), SENTENCE_WORDS):
            part = spans[i : i + SENTENCE_WORDS]
            out.append((part[0][0], part[-1][1], list(dict.fromkeys(text[a:b].lower() for a, b in part))))
    return out


def sentence_words(text: str) -> list[list[str]]:
    """The distinct words of the same sentences, without their places: a word said often counts once in a sentence."""
    out = []
    for s in _SENTENCE.findall(text.lower() if text.isascii() else text):
        words = _TOKEN.findall(s)
        if words and len(max(words, key=len)) > LONGEST_WORD:
            words = [p for w in words for p in ([w] if len(w) <= LONGEST_WORD else _PIECE.findall(w))]
        if not text.isascii():
            words = [w.lower() for w in words]
        out += [list(dict.fromkeys(words[i : i + SENTENCE_WORDS])) for i in range(0, len(words), SENTENCE_WORDS)]
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self, most: int = 150_000):
        """A function from lists of words (sentences) to their scores; word weights are kept in a bounded table.

        A score is what is above that of a sentence without known words, as a share of what there is above it. Only a
        model that calls everything toxic (its sample was) keeps that score.
        """
        table: dict[str, float] = {}
        weights, bias = self.weights, self.bias
        floor = 1 / (1 + np.exp(-np.clip(bias, -40, 40))) if bias < 0 else 0.0

        def score(lists: list[list[str]]) -> np.ndarray:
            if len(table) > most:
                table.clear()
            flat = []
            for words in lists:
                for w in words:
                    x = table.get(w)
                    if x is None:
                        x = table[w] = float(weights[word_features(w)].sum())
                    flat.append(x)
            starts = np.cumsum([0, *(len(words) for words in lists[:-1])])
            z = bias + np.add.reduceat(np.array(flat), starts)
            s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            return np.maximum(0, s - floor) / (1 - floor)

        return score


def noisy_or(s: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(s, 1 - 1e-12)).sum()))


def loss_and_slopes(v, bias, of_word, local, n_words, flat, starts, lengths, owner, y, weight, decay):
    """The mean negative log likelihood of the documents' labels with its decay term, and its slopes by v and bias.

    v: weights of features; (of_word, local): which features a word has; (flat, starts, lengths): the sentences' words;
    owner: a sentence's document.
    """
    word_weight = np.bincount(of_word, v[local], n_words)
    z = np.clip(bias + np.add.reduceat(word_weight[flat], starts), -30, 30)
    total = np.clip(np.bincount(owner, np.logaddexp(0, z), len(y)), 1e-6, 50)  # -log of the chance that no sentence is toxic
    loss = float((weight * np.where(y > 0, -np.log(-np.expm1(-total)), total)).sum() / len(y) + decay / 2 * (v * v).sum())
    slope = np.where(y > 0, -1 / np.expm1(total), 1.0) * weight / len(y)
    gz = slope[owner] / (1 + np.exp(-z))
    gw = np.bincount(flat, np.repeat(gz, lengths), n_words)
    return loss, np.bincount(local, gw[of_word], len(v)) + decay * v, float(gz.sum())


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray, steps: int = 60, rate: float = 0.2, decay: float = 1e-4, least_docs: int = LEAST_DOCS, start: float = START, part_start: float = PART_START, bias: float = BIAS) -> Model:
    """Noisy-or likelihood by Adam over the whole sample. Without both classes, a model of the share alone."""
    share = float((weight * y).sum() / max(weight.sum(), 1e-9)) if len(y) else 0.0
    if len(y) == 0 or share in (0.0, 1.0):
        return Model(np.zeros(FEATURES, np.float32), -12.0 if share < 0.5 else 6.0)
    words: dict[str, int] = {}
    ids, lengths, owner = array("i"), array("i"), array("i")
    for d, t in enumerate(texts):
        for own in sentence_words(t):
            ids.extend([words.setdefault(w, len(words)) for w in own])
            lengths.append(len(own))
            owner.append(d)
    if not ids:
        return Model(np.zeros(FEATURES, np.float32), -12.0)
    flat, lengths, owner = np.array(ids), np.array(lengths), np.array(owner)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    feature_n, features = array("i"), array("i")
    for w in words:
        own = word_features(w)
        feature_n.append(len(own))
        features.extend(own)
    of, feature_n, features = range(len(words)), np.array(feature_n), np.array(features)
    del ids
    # Features of few documents would fit the labels by chance: they have no weight.
    of_word = np.repeat(np.arange(len(of), dtype=np.int32), feature_n)
    in_docs = np.unique(np.repeat(owner, lengths).astype(np.int64) << 32 | flat)
    seen = np.flatnonzero(np.bincount(features, np.bincount(in_docs & 0xFFFFFFFF, minlength=len(of))[of_word], FEATURES) >= least_docs)
    if not len(seen):
        return Model(np.zeros(FEATURES, np.float32), -12.0)
    fits = np.isin(features, seen)
    features, of_word = features[fits], of_word[fits]
    feature_n = np.bincount(of_word, minlength=len(of))
    local = np.searchsorted(seen, features)
    # The start: features much more frequent in documents of label 1, by their log odds.
    marked = np.bincount(in_docs & 0xFFFFFFFF, y[in_docs >> 32], len(of))
    both = [np.bincount(local, c[of_word], len(seen)) for c in (marked, np.bincount(in_docs & 0xFFFFFFFF, minlength=len(of)) - marked)]
    few = 3 * np.array([y.mean(), 1 - y.mean()])  # so many documents more, as if without the label's influence
    odds = np.log((both[0] + few[0]) / (y.sum() + few[0])) - np.log((both[1] + few[1]) / ((1 - y).sum() + few[1]))
    whole = np.isin(seen, [zlib.crc32(f"w {w}".encode("utf-8", "replace")) % FEATURES for w in words])
    v = np.where(whole, start, part_start) * np.maximum(0, odds - 1)
    m1, m2, b1, b2 = np.zeros_like(v), np.zeros_like(v), 0.0, 0.0
    for t in range(1, steps + 1):
        _, g, gb = loss_and_slopes(v, bias, of_word, local, len(of), flat, starts, lengths, owner, y, weight, decay)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.98 * m2 + 0.02 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.98 * b2 + 0.02 * gb * gb
        lr = rate * (1 - 0.9 * t / steps)
        c1, c2 = 1 - 0.9**t, 1 - 0.98**t
        v -= lr * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-7)
        bias -= lr * (b1 / c1) / (np.sqrt(b2 / c2) + 1e-7)
    weights = np.zeros(FEATURES, np.float32)
    weights[seen] = v
    return Model(weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES) -> Model:
    return fit(*labelled_sample(docs, labels, "toxic", rows, longest))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, over its whole text; sentence_start, sentence_end, sentence_score.

    The last three are the place in the text and the score of the first sentence of the highest score, in rows predicted
    1 (else null).
    A text without words (null, empty) has no sentence and scores 0. Repeated rows and null doc_ids are kept as they are;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES floats

    def run(batches):
        scorer = shared.value.scorer()
        for b in batches:
            out, worst = [], []
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py()
                own = sentence_words(text)
                each = scorer(own) if own else np.zeros(0)
                out.append(noisy_or(each))
                k = int(each.argmax()) if len(each) and out[-1] >= threshold else -1
                worst.append((*sentences(text)[k][:2], float(each[k])) if k >= 0 else (None, None, None))
            place = zip(*worst, strict=True) if worst else ((), (), ())
            cols = [b.column(0), b.column(1), pa.array(out, pa.float64()), pa.array([int(x >= threshold) for x in out], pa.int32())]
            cols += [pa.array(list(c), t) for c, t in zip(place, (pa.int32(), pa.int32(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, SCORED.replace(",", "").split()[::2])

    return docs.select("doc_id", held_out().alias("held_out"), text_or_empty()).mapInArrow(run, SCORED)


def locate(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, sentence (its number from 0), start and end in the text, its text and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = shared.value.scorer()
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                own = sentences(text)
                for k, s in enumerate(scorer([w for _, _, w in own]) if own else []):
                    if s >= threshold:
                        for col, v in zip(rows, (b.column(0)[i].as_py(), k, own[k][0], own[k][1], text[own[k][0] : own[k][1]], float(s)), strict=True):
                            col.append(v)
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["doc_id", "sentence", "start", "end", "text", "score"])

    return docs.select("doc_id", text_or_empty()).mapInArrow(run, "doc_id long, sentence int, start int, end int, text string, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text the model doesn't call toxic, as they came (all columns)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def make():
        scorer = shared.value.scorer()

        return lambda texts: [not own or noisy_or(scorer(own)) < threshold for own in map(sentence_words, texts)]

    return filter_rows(docs, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
