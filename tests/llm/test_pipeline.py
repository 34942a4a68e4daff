"""The pipeline's stages against brute force and what each has to keep."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from memberlens.llm import decontamination, sentencepieces
from memberlens.llm.common import read_table

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece_encoding",
    ]
    docs = read_table(spark, SF, "documents")
    bad = {r.doc_id for r in read_table(spark, SF, "labels").where("toxic = 1").collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stage(function(spark, docs, SF))
        assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() <= docs.count(), name
        docs = kept
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(bad & set(texts)) <= len(bad) // 2
    words = {i: decontamination.words_of(t.encode()) for i, t in texts.items()}
    phrases = set()
    for r in read_table(spark, SF, "benchmark").collect():
        w = decontamination.words_of(r.text.encode())
        phrases |= {tuple(w[k : k + min(10, len(w))]) for k in range(len(w) - min(10, len(w)) + 1)}
    lengths = {len(p) for p in phrases}
    assert not any(tuple(w[k : k + n]) in phrases for w in words.values() for n in lengths for k in range(len(w) - n + 1))
    model = sentencepieces.pieces(corpus_pipeline.public_tokenizers.path(corpus_pipeline.PIECES))
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encoded} == {i: model.library.encode(t) for i, t in texts.items()}
