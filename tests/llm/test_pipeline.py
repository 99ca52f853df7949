"""The pipeline's stages against plain versions of their decisions, and run() against the stages in turn."""

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lumenfold.llm import packing, quality, toxicity
from tests.llm.test_shingles import brute

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    encoder, model = quality.Encoder(), quality.train(docs, labels)
    good = [r for r in docs.collect() if model.scores([encoder.passages(r.text)])[0] >= 0.7]
    got = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert got.columns == docs.columns and rows(got) == sorted(map(tuple, good), key=str)

    docs = spark.createDataFrame(good, docs.schema)
    scorer = toxicity.train(docs, labels).scorer()
    clean = [r for r in docs.collect() if not (s := toxicity.sentence_words(r.text)) or toxicity.noisy_or(scorer(s)) < 0.3]
    got = corpus_pipeline.toxicity_filter(spark, docs, SF)
    assert got.columns == docs.columns and rows(got) == sorted(map(tuple, clean), key=str)
    assert 0.5 * len(good) < len(clean)

    docs = spark.createDataFrame(clean, docs.schema)
    first = {d for d, n, c in brute([(r.doc_id, r.text) for r in clean]) if d == c}
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    kept = [r for r in clean if r.doc_id in first]
    assert got.columns == docs.columns and rows(got) == sorted(map(tuple, kept), key=str)

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    tokenizer.encode_special_tokens = True
    packed = corpus_pipeline.packed_sequences(spark, spark.createDataFrame(kept, docs.schema), SF).collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1] for r in kept}
    for r in packed:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(np.asarray(own, "<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in packed) == sum(map(len, ids.values()))
    assert rows(corpus_pipeline.run(spark, SF)) == sorted((tuple(r) for r in packed), key=str)


def test_stages_keep_odd_rows_whole(spark):
    """Nulls, repeated rows and extra columns go through the filters without a crash; the models decide on the text alone."""
    docs = spark.createDataFrame([(1, None, "a", 1), (None, "x y z", None, 2), (3, "", "a", 3), (3, "", "a", 3)], "doc_id long, text string, row string, fp int")
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.count() <= 4
        assert stage(spark, docs.limit(0), SF).count() == 0
