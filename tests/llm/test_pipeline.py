from collections import Counter

import numpy as np

import corpus_pipeline
from driftledger.llm import pii, quality_cnn
from driftledger.llm.decontaminate import words
from driftledger.llm.queries import table

from .test_similar import brute_groups

FOLDER = "/root/testdata/sf0.001"


def test_run_equals_a_plain_version(spark, tokenizer):
    docs, labels, benchmark = (table(spark, FOLDER, t) for t in ("documents", "labels", "benchmark"))
    net = quality_cnn.train(docs, labels)
    left = [(r.doc_id, r.text) for r in docs.collect()]
    keep = quality_cnn.probability([t.encode() for _, t in left], net, net.tables()) >= 0.5
    left = [x for x, k in zip(left, keep, strict=True) if k]

    group = brute_groups(sorted(left))  # transitive: a document goes if a chain of links leads to a smaller one
    kept = [x for k, x in enumerate(sorted(left)) if group[k] == k]
    windows = {}
    for r in benchmark.collect():
        w = words(r.text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(n, set()).add(tuple(w[k : k + n]))
    kept = [(d, t) for d, t in kept if not any(tuple(w[k : k + n]) in s for w in [words(t)] for n, s in windows.items() for k in range(len(w) - n + 1))]
    judge = pii.trained()
    want = Counter()
    for d, t in kept:
        want[d] += len(tokenizer[1](pii.redacted(t, judge))) + 1
    found = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert found.groupby("doc_id").length.sum().to_dict() == want
    assert found.groupby("sequence_id").length.sum().max() <= 2048
    assert np.unique(found[["doc_id", "piece"]].to_numpy(), axis=0).shape[0] == len(found)


def test_stages_take_odd_rows(spark, docs):
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, FOLDER).cache()
        assert name == "best_fit_packing" or at.columns == docs.columns
    assert at.count() > 0
