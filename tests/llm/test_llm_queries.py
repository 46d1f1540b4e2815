"""The registered queries over whole tables, against SQL where there is some and plain versions elsewhere."""

import hashlib
import zlib

import numpy as np
import pytest

from driftledger.llm import pii, queries

from ..oracle import compare, connect
from .test_pii import brute as brute_pii
from .test_quality import brute as brute_quality
from .test_simhash import brute_print, union

FOLDER = "/root/testdata/sf0.001"
RUN = queries.queries()


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r.doc_id, r.text) for r in queries.table(spark, FOLDER, "documents").collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert compare(RUN[name](spark, FOLDER), connect(FOLDER), queries.oracle_sql()[name]) > 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in RUN if n.startswith("op")) == list(range(1, 11)) and "pipeline" in RUN


def test_op1(spark, texts, tokenizer):
    found, start = {r.doc_id: r for r in RUN["op1_token_store"](spark, FOLDER).collect()}, 0
    for d, t in texts:
        ids = tokenizer[1](t) + [0]
        r = found[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op4(spark, texts, tokenizer):
    found = RUN["op4_best_fit_packing"](spark, FOLDER).toPandas().sort_values(["doc_id", "piece"])
    for d, own in found.groupby("doc_id"):
        ids, at = tokenizer[1](dict(texts)[d]) + [0], 0
        assert own.length.sum() == len(ids) and (own.length[1:] == 2048).all()
        for r in own.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
    placed = found.sort_values(["sequence_id", "offset"])
    before = placed.groupby("sequence_id").length.cumsum() - placed.length
    assert (before == placed.offset).all() and placed.groupby("sequence_id").length.sum().max() <= 2048
    assert placed.sequence_id.nunique() <= -(-placed.length.sum() // 2048) + 1


def test_op5(spark, texts):
    found = {r.doc_id: r for r in RUN["op5_personal_data"](spark, FOLDER).collect()}
    for d, t in texts:
        spans = brute_pii(t)
        assert found[d].base_sha256 == hashlib.sha256(pii.listed(spans).encode()).hexdigest()
        assert set(pii.listed(spans).split(",")) <= set(found[d].spans.split(","))


def test_op6(spark, texts):
    prints = {d: brute_print(t) for d, t in texts}
    group = union([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2], prints)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in RUN["op6_simhash"](spark, FOLDER).collect()}
    assert found == {d: (f"{prints[d]:016x}", group[d]) for d in prints}


def test_op8(spark, texts):
    found = {r.doc_id: r for r in RUN["op8_quality_rules"](spark, FOLDER).collect()}
    for d, t in texts:
        r = found[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t)
        assert not (r.base_failed and r.kept)


def test_op9_and_op10(spark, texts):
    counts, scores = ({r.doc_id: r for r in RUN[n](spark, FOLDER).collect()} for n in ("op9_token_counts", "op10_quality_cnn"))
    for d, t in texts:
        assert counts[d].n_words == len(t.encode().split()) <= counts[d].n_pieces
        assert scores[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and scores[d].predicted == int(scores[d].score >= 0.5)
