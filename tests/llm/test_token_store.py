import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftledger.llm.storage import new_path
from driftledger.llm.token_store import pack, read_token_store, unpack, write_token_store


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1)))
def test_code_round_trip(values):
    control, data = pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert unpack(control, data, len(values)).tolist() == values


def test_small_ranks_take_one_byte():
    control, data = pack(np.array([0, 255, 256, 65535, 65536], np.uint32))
    assert len(data) == 1 + 1 + 2 + 2 + 3 and len(control) == 2


@pytest.mark.parametrize("sizes", [{}, {"block_ids": 50, "file_bytes": 200}])
def test_store_equals_library(spark, docs, rows, tokenizer, sizes):
    path, encode = tokenizer
    folder = new_path(spark, "test-store")
    write_token_store(docs, folder, path, **sizes)
    found = read_token_store(spark, folder, with_ids=True).collect()
    want = sorted(([r[0], encode(r[1]) + [0]] for r in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    found.sort(key=lambda r: r.start)
    assert [r.doc_id for r in found] == [d for d, _ in want]
    start = 0
    for r, (_, ids) in zip(found, want, strict=True):
        raw = np.array(ids, "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)


def test_no_documents(spark, empty, tokenizer):
    folder = new_path(spark, "test-store")
    write_token_store(empty, folder, tokenizer[0])
    assert read_token_store(spark, folder).count() == 0


def test_damage_is_seen(spark, docs, tokenizer):
    from driftledger.llm.storage import open_filesystem

    folder = new_path(spark, "test-store")
    write_token_store(docs, folder, tokenizer[0])
    from pathlib import Path

    file = next(Path(open_filesystem(folder)[1]).glob("*.tkv"))
    raw = bytearray(file.read_bytes())
    raw[-1] ^= 1
    file.write_bytes(raw)
    with pytest.raises(Exception, match="damaged block"):
        read_token_store(spark, folder).collect()


def test_a_doc_id_that_most_rows_share_fills_several_shards(spark, tokenizer):
    path, encode = tokenizer
    rows = [(None, "no id")] * 80 + [(7, "hot")] * 150 + [(7, "other text")] * 20 + [(k, f"text {k}") for k in range(40)]
    folder = new_path(spark, "test-store")
    manifest = write_token_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder, path)
    assert max(docs for _, _, docs, _ in manifest["shards"]) <= 110
    found = sorted(read_token_store(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(found, found[1:], strict=False)) and found[0].start == 0
    crc = lambda text: zlib.crc32(np.array(encode(text) + [0], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in found) == sorted((str(d), crc(t)) for d, t in rows)


def test_more_shards_than_partitions(spark, docs, rows, tokenizer, monkeypatch):
    from driftledger.llm import token_store

    folder = new_path(spark, "test-store")
    monkeypatch.setattr(token_store.encode_documents, "__defaults__", (0, 2000))
    manifest = write_token_store(docs, folder, tokenizer[0])
    found = sorted(read_token_store(spark, folder).collect(), key=lambda r: r.start)
    assert len(manifest["shards"]) > 4 and len(found) == len(rows)
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))


def test_a_very_long_text(spark, tokenizer):
    path, encode = tokenizer
    text, folder = "Some long text, d'accord \u2014 \u4e2d\u6587 's. " * 40_000, new_path(spark, "test-store")
    write_token_store(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), folder, path)
    first, second = sorted(read_token_store(spark, folder).collect(), key=lambda r: r.start)
    ids = encode(text) + [0]
    assert (first.n_tokens, first.ids_crc32, second.start) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids))
