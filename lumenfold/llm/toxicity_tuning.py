"""How toxicity.py's constants are chosen: cross-validation within the training rows. No query runs this.

Rows whose crc32(doc_id as text) mod 4 is 2 are never read. Each of the other three remainders is scored by a model of the
other two; the constants of the least mean log loss win.

    python -m lumenfold.llm.toxicity_tuning <folder of documents and labels>
"""

from __future__ import annotations

import sys
import zlib
from itertools import product
from multiprocessing import Pool

import numpy as np
import pyarrow.parquet as pq

from . import toxicity

#: start and part_start, bias, least_docs.
GRID = [*product([(0.0, 0.0), (2.0, 1.5), (4.0, 3.0), (4.0, 1.0)], [-8.0, -6.0, -4.0], [2, 5]), *product([(4.0, 3.0), (4.0, 4.0), (6.0, 4.5), (6.0, 3.0), (8.0, 6.0)], [-8.0, -10.0, -12.0], [5, 8])]
#: Labelled rows that are read at most, those of the smallest doc_ids' hashes, and the longest text in characters.
ROWS, LONGEST = 6000, 100_000


def training_rows(folder: str) -> list[tuple[int, str, int]]:
    """(remainder, text, label) of labelled rows outside the held-out fold."""
    label = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist() if r["toxic"] in (0, 1)}
    out = []
    for b in pq.ParquetFile(f"{folder}/documents.parquet").iter_batches(columns=["doc_id", "text"]):
        for r in b.to_pylist():
            crc = zlib.crc32(str(r["doc_id"]).encode())
            if crc % toxicity.FOLDS != toxicity.HELD_OUT and r["doc_id"] in label and r["text"] and len(r["text"]) <= LONGEST:
                out.append((crc, r["text"], label[r["doc_id"]]))
    return [(c % toxicity.FOLDS, t, y) for c, t, y in sorted(out)[:ROWS]]


def validated(rows: list[tuple[int, str, int]], **constants) -> tuple[float, float, float, float]:
    """Mean log loss, accuracy, recall, false alarms over all rows, each scored by a model that hasn't seen its remainder."""
    score, label = [], []
    for fold in sorted({f for f, _, _ in rows}):
        own = [(t, y) for f, t, y in rows if f != fold]
        scorer = toxicity.fit([t for t, _ in own], np.array([y for _, y in own], float), np.ones(len(own)), **constants).scorer()
        for f, t, y in rows:
            if f == fold:
                words = toxicity.sentence_words(t)
                score.append(toxicity.noisy_or(scorer(words)) if words else 0.0)
                label.append(y == 1)
    s, y = np.clip(score, 1e-4, 1 - 1e-4), np.array(label)
    toxic = s >= toxicity.THRESHOLD
    return float(-np.log(np.where(y, s, 1 - s)).mean()), float((toxic == y).mean()), float(toxic[y].mean()), float(toxic[~y].mean())


def _one(job):
    rows, ((start, part), bias, least) = job
    return validated(rows, start=start, part_start=part, bias=bias, least_docs=least), job[1]


if __name__ == "__main__":
    table = training_rows(sys.argv[1])
    with Pool() as pool:
        for figures, constants in sorted(pool.imap_unordered(_one, [(table, g) for g in dict.fromkeys(GRID)])):
            print("log loss %.4f accuracy %.4f recall %.4f false alarms %.4f" % figures, constants)
