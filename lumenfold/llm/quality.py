"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded (a hidden layer over statistics of its words), a gated attention
unit weighs it against the document's other passages, and the weighted mean of the encodings is scored. Only documents
are labelled; the attention learns which passages carry the label.

Attention: a_k = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k))), score = sigmoid(c . sum_k a_k h_k + b).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import filter_rows, text_or_empty
from .toxicity import held_out, labelled_sample

#: Labelled rows of each class that a model is fitted on at most, and the longest text among them in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 100_000
PASSAGE_WORDS = 64
SHAPES, STATS = 48, 8
MORE = 10
WIDTH = SHAPES + STATS + MORE
THRESHOLD = 0.7
HIDDEN, GATE = 32, 16


def shape(word: str) -> str:
    """Letters by case, digits as 0, other characters as they are; runs of one kind once, longer ones marked."""
    out, last, run = [], "", 0
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        run = run + 1 if k == last else 1
        if run == 1:
            out.append(k)
        elif run == 3 and k not in "Aa0":
            out.append("+")
        last = k
    return "".join(out)


def word_row(word: str) -> tuple[int, list[float]]:
    """Shape bucket and statistics of a word."""
    n = len(word)
    letters = sum(c.isalpha() for c in word)
    upper = sum(c.isupper() for c in word)
    digits = sum(c.isdigit() for c in word)
    other = n - letters - digits
    return zlib.crc32(shape(word).encode("utf-8", "replace")) % SHAPES, [min(n, 40) / 10, upper / n, digits / n, other / n, float(letters == 0), float(n == 1), float(n > 20), float(letters > 1 and upper == letters)]


class Encoder:
    """Texts to the feature rows of their passages; what is known of a word is kept in a bounded table."""

    def __init__(self, most: int = 120_000):
        self.most, self.ids = most, {}
        self.buckets, self.rows = np.zeros(1 << 12, np.int64), np.zeros((1 << 12, STATS), np.float32)

    def _know(self, words: list[str]) -> None:
        if len(self.ids) > self.most:
            self.ids.clear()
        for w in words:
            if w not in self.ids:
                k = self.ids[w] = len(self.ids)
                if k >= len(self.buckets):
                    self.buckets, self.rows = np.concatenate([self.buckets, np.zeros_like(self.buckets)]), np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.buckets[k], self.rows[k] = word_row(w)

    def passages(self, text: str) -> np.ndarray:
        """A row for each PASSAGE_WORDS words (the last passage may be shorter); one row of zeros without words."""
        words = text.split()
        if not words:
            return np.zeros((1, WIDTH), np.float32)
        try:
            ids = np.array([self.ids[w] for w in words])
        except KeyError:
            self._know(words)
            ids = np.array([self.ids[w] for w in words])
        n = len(ids)
        of = np.arange(n) // PASSAGE_WORDS
        k = int(of[-1]) + 1
        starts = np.arange(k) * PASSAGE_WORDS
        size = np.diff(np.append(starts, n)).astype(np.float32)
        x = np.zeros((k, WIDTH), np.float32)
        x[:, :SHAPES] = np.bincount(of * SHAPES + self.buckets[ids], minlength=k * SHAPES).reshape(k, SHAPES) / size[:, None]
        stats = self.rows[ids]
        x[:, SHAPES : SHAPES + STATS] = np.add.reduceat(stats, starts, axis=0) / size[:, None]
        m = x[:, SHAPES + STATS :]
        first = np.unique(of.astype(np.int64) << 32 | ids) >> 32
        m[:, 0] = np.bincount(first, minlength=k) / size  # share of distinct words
        same = np.zeros(n, np.float32)
        same[1:] = ids[1:] == ids[:-1]
        same2 = np.zeros(n, np.float32)
        same2[2:] = ids[2:] == ids[:-2]
        m[:, 1] = np.add.reduceat(same, starts) / size
        m[:, 2] = np.add.reduceat(same2, starts) / size
        length = stats[:, 0]
        m[:, 3] = np.sqrt(np.maximum(np.add.reduceat(length * length, starts) / size - (np.add.reduceat(length, starts) / size) ** 2, 0))
        m[:, 4] = np.log1p(size) / 4
        m[:, 5] = np.log1p(n) / 8
        m[:, 6] = len(np.unique(ids)) / n
        lines = text.split("\n")
        m[:, 7] = 1 - len(set(lines)) / len(lines)
        m[:, 8] = min(len(lines) / n, 1.0) * 5
        m[:, 9] = 1.0
        return x


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    share: float | None = None  # where there was nothing to learn

    def forward(self, x: np.ndarray, starts: np.ndarray):
        p = self.p
        u = (x - self.mean) / self.scale
        h = np.tanh(u @ p["W"] + p["d"])
        v, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (v * g) @ p["w"]
        n = np.diff(np.append(starts, len(x)))
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), n))
        a /= np.repeat(np.add.reduceat(a, starts), n)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return u, h, v, g, a, n, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"][0], -30, 30)))

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        """0 to 1 for each document's passages."""
        if self.share is not None:
            return np.full(len(bags), self.share)
        if not bags:
            return np.zeros(0)
        return self.forward(np.concatenate(bags), np.cumsum([0, *(len(b) for b in bags[:-1])]))[-1].astype(np.float64)

    def attention(self, bag: np.ndarray) -> np.ndarray:
        """The weights of a document's passages."""
        return self.forward(bag, np.array([0]))[4] if self.share is None else np.full(len(bag), 1 / len(bag))


def fit(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.004, seed: int = 7) -> Model:
    """Cross entropy by Adam. Without both classes, a model of the share alone."""
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    p = {"W": rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "d": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    model = Model(mean, scale, p)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    t, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            own = order[i : i + batch]
            part = [bags[k] for k in own]
            starts = np.cumsum([0, *(len(b) for b in part[:-1])])
            u, h, v, g, a, n, z, s = model.forward(np.concatenate(part), starts)
            ds = ((s - y[own]) * weight[own] / len(own)).astype(np.float32)
            dz = ds[:, None] * p["c"]
            dz_k = np.repeat(dz, n, axis=0)
            da = (dz_k * h).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, starts), n))
            dv, dg = de[:, None] * p["w"] * g * (1 - v * v), de[:, None] * p["w"] * v * g * (1 - g)
            dh = a[:, None] * dz_k + dv @ p["V"].T + dg @ p["U"].T
            dp = dh * (1 - h * h)
            grads = {"W": u.T @ dp, "d": dp.sum(0), "V": h.T @ dv, "U": h.T @ dg, "w": (v * g).T @ de, "c": z.T @ ds, "b": np.array([ds.sum()])}
            t += 1
            lr = rate * (1 - 0.95 * t / steps)
            for k, d in grads.items():
                d = d.astype(np.float32) + 1e-4 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d * d
                p[k] -= lr * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-7)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES) -> Model:
    texts, y, weight = labelled_sample(docs, labels, "quality", rows, longest)
    encoder = Encoder()
    return fit([encoder.passages(t) for t in texts], y, weight)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, over its whole text.

    A text without words (null, empty) is one passage of zeros and is scored as such. Repeated rows and null doc_ids are
    kept as they are; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        encoder = Encoder()
        for b in batches:
            out = np.concatenate([shared.value.scores([encoder.passages(t) for t in b.column(2).slice(i, 200).to_pylist()]) for i in range(0, b.num_rows, 200)]) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64()), pa.array((out >= threshold).astype("i4"))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), text_or_empty()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text the model takes for quality 1, as they came (all columns)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def make():
        encoder = Encoder()
        return lambda texts: [bool(x >= threshold) for x in shared.value.scores([encoder.passages(t) for t in texts])]

    return filter_rows(docs, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
