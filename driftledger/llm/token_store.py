"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Layout of a store, a folder:

* ``dictionary.bin``: the id of every rank, little-endian unsigned 32-bit. Frequent ids have low ranks.
* ``shard-SSSSSS-FFFF.tkv``: documents in ascending doc_id order, across files in name order. A file is the magic, its
  shard, the ids before it in the shard, then blocks. A block is a header, doc_ids, null marks, lengths, control bytes
  (two bits a rank: its bytes less one, four ranks to a byte) and data bytes (each rank's low bytes).
* ``manifest.json``: ids in each shard, from which starts follow.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import bounded_batches, drop_staged, read_bytes, staged, write_bytes
from .tokens import encoder

MAGIC = b"TKVBYTE1"
_FILE = "<8sIQ"
_BLOCK = "<IIIII"
#: Bytes of each of the four ranks of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
#: The same four in one number, so that one lookup gives them all.
QUADS = np.ascontiguousarray(LENGTHS).view("<u4").reshape(-1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    ends = np.cumsum(code, dtype=np.int64) + np.arange(1, len(code) + 1)
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - code - 1
    data[starts] = values.astype(np.uint8)
    for k in range(1, 4):
        longer = np.flatnonzero(code >= k)
        if not len(longer):
            break
        data[starts[longer] + k] = (values[longer] >> (8 * k)).astype(np.uint8)
    padded = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    padded[: len(code)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of pack(), found by looking every control byte up in the table of lengths."""
    lengths = QUADS[np.frombuffer(control, np.uint8)].view(np.uint8)[:n]
    at = np.cumsum(lengths, dtype=np.int64)
    at -= lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw.take(at).astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        out[longer] |= raw.take(at.take(longer) + k).astype(np.uint32) << (8 * k)
    return out


def deal_keys(spark: SparkSession) -> list[int]:
    """For each partition of a shuffle a number that hashing puts there, so that one shard goes to each."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.range(40 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("at")).groupBy("at").agg(F.min("id").alias("id"))
    return [r.id for r in found.orderBy("at").collect()]


def shard_of(doc_ids: np.ndarray, bounds: np.ndarray, turn: int) -> np.ndarray:
    """The shard of each doc_id: the first whose bound, its last doc_id, is not below it.

    A doc_id that is the bound of several shards fills these alone, and its rows are dealt to them in turn.
    """
    first = np.searchsorted(bounds, doc_ids, side="left")
    several = np.maximum(np.searchsorted(bounds, doc_ids, side="right") - first, 1)
    return first + (turn + np.arange(len(doc_ids))) % several


def _encode_rows(path: str, end_id: int, bounds: np.ndarray, keys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        end, total = np.array([end_id], e.dtype).tobytes(), np.zeros(e.size, np.int64)
        names, turn = ["doc_id", "ids", "shard", "deal", "counts"], TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [x + end for x in e.encode(part.column(1).to_pylist())]
                total += np.bincount(np.frombuffer(b"".join(ids), e.dtype), minlength=e.size)
                known = np.array([np.iinfo(np.int64).min if x is None else x for x in part.column(0).to_pylist()], np.int64)
                shard, turn = shard_of(known, bounds, turn), turn + len(known)
                columns = [part.column(0), pa.array(ids, pa.binary()), pa.array(shard, pa.int64()), pa.array(keys[shard % len(keys)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(ids), pa.binary())], names)
        if total.any():
            no_id, counts = pa.nulls(1, pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([no_id, pa.nulls(1, pa.binary()), no_id, no_id, counts], names)

    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, shard_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, ids, shard, deal, counts): each whole text's ids and the end id, little-endian, unsigned 16-bit where the vocabulary fits.

    Shards are ranges of doc_id between approximate quantiles of all of them, null doc_ids in the first: as many as the
    shuffle has partitions, or more so that one has about ``shard_bytes`` of text. A doc_id, or null, that many rows share
    fills several shards. ``deal`` is what hashing deals a shard out by. Each partition ends with a row of its own that
    holds how often every id occurred in it, in ``counts``.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = deal_keys(docs.sparkSession)
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = max(len(keys), -(-size // shard_bytes))
    steps = [k / shards for k in range(1, shards)]
    known = F.coalesce("doc_id", F.lit(np.iinfo(np.int64).min))
    found = rows.agg(F.percentile_approx(known, steps, max(10_000, 4 * shards)).alias("q")).first().q if steps else None
    bounds = np.sort(np.array(found or [], np.int64))
    return rows.mapInArrow(_encode_rows(tokenizer_path, end_id, bounds, np.array(keys)), "doc_id long, ids binary, shard long, deal long, counts binary")


def _count_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["id", "n"])

    return run


def rank_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """Ids by falling frequency, then by id: at most one row for each id of the vocabulary reaches the driver."""
    found = tokens.where("counts is not null").select("counts")
    counts = found.mapInArrow(_count_rows(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size, np.int64)
    total[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return np.lexsort((np.arange(size), -total)).astype("<u4")


def _block(doc_ids: list[int | None], lengths: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    body = b"".join(
        [
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            bytes(x is None for x in doc_ids),
            np.array(lengths, "<u4").tobytes(),
            control,
            data,
        ]
    )
    return struct.pack(_BLOCK, len(doc_ids), len(ranks), len(control), len(data), zlib.crc32(body)) + body


class _Writer:
    """Writes one shard after another, each as files of about ``file_bytes``."""

    def __init__(self, folder: str, dtype: str, rank_of: np.ndarray, block_ids: int, file_bytes: int):
        self.folder, self.dtype, self.rank_of, self.block_ids, self.file_bytes = folder, dtype, rank_of, block_ids, file_bytes
        self.shard: int | None = None
        self.blocks: list[bytes] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.parts: list[bytes] = []

    def start(self, shard: int) -> None:
        self.shard, self.files, self.docs, self.total, self.before, self.held, self.size = shard, 0, 0, 0, 0, 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // np.dtype(self.dtype).itemsize
        self.doc_ids.append(doc_id)
        self.lengths.append(n)
        self.parts.append(ids)
        self.held, self.total, self.docs = self.held + n, self.total + n, self.docs + 1
        if self.held >= self.block_ids:
            self.close_block()
            if self.size >= self.file_bytes:
                self.close_file()

    def close_block(self) -> None:
        if self.doc_ids:
            self.blocks.append(_block(self.doc_ids, self.lengths, self.rank_of[np.frombuffer(b"".join(self.parts), self.dtype)]))
            self.size, self.held = self.size + len(self.blocks[-1]), 0
            self.doc_ids, self.lengths, self.parts = [], [], []

    def close_file(self) -> None:
        if self.blocks:
            write_bytes(self.folder, f"shard-{self.shard:06d}-{self.files:04d}.tkv", [struct.pack(_FILE, MAGIC, self.shard, self.before), *self.blocks])
            self.files, self.before, self.size, self.blocks = self.files + 1, self.total, 0, []

    def end(self) -> pa.RecordBatch:
        self.close_block()
        self.close_file()
        return pa.RecordBatch.from_pydict({"shard": [self.shard], "files": [self.files], "docs": [self.docs], "ids": [self.total]})


def _write_rows(*settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(*settings)
        for batch in batches:
            for shard, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != writer.shard:
                    if writer.shard is not None:
                        yield writer.end()
                    writer.start(shard)
                writer.add(doc_id, ids)
        if writer.shard is not None:
            yield writer.end()

    return run


def write_token_store(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, block_ids: int = 1 << 16, file_bytes: int = 8 << 20) -> dict:
    """Encode the documents and write the store; returns its manifest.

    Texts are encoded and ids counted once; the ids are staged, then dealt out by ranges of doc_id and written in order. The
    driver sees one row per id of the vocabulary and one per shard. Null text: empty. Rows with one doc_id stand side by
    side, in order of their ids in each shard; null doc_ids come first. No documents: no shard files. Extra columns are
    not read.
    """
    spark = docs.sparkSession
    e = encoder(tokenizer_path)
    dtype = e.dtype.str
    tokens = staged(encode_documents(docs, tokenizer_path, end_id), "token-ids")
    ranked = rank_ids(tokens, e.size)
    rank_of = np.empty(e.size, "<u4")
    rank_of[ranked] = np.arange(e.size, dtype="<u4")
    kept = tokens.where("counts is null").select("shard", "doc_id", "ids", "deal")
    ordered = kept.repartition("deal").sortWithinPartitions("shard", "doc_id", F.xxhash64("ids")).drop("deal")
    rows = ordered.mapInArrow(_write_rows(folder, dtype, rank_of, block_ids, file_bytes), "shard long, files long, docs long, ids long").collect()
    drop_staged(tokens)
    manifest = {"shards": [[r.shard, r.files, r.docs, r.ids] for r in sorted(rows)], "end_id": end_id}
    write_bytes(folder, "dictionary.bin", [ranked.tobytes()])
    write_bytes(folder, "manifest.json", [json.dumps(manifest).encode()])
    return manifest


def read_blocks(content: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(shard, ids before it in the shard, doc_ids, lengths, ranks) of each block of a file."""
    magic, shard, before = struct.unpack_from(_FILE, content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at, content = struct.calcsize(_FILE), memoryview(content)
    while at < len(content):
        n_docs, n, n_control, n_data, crc = struct.unpack_from(_BLOCK, content, at)
        at += struct.calcsize(_BLOCK)
        end = at + 13 * n_docs + n_control + n_data
        if zlib.crc32(content[at:end]) != crc:
            raise ValueError("damaged block")
        ids = np.frombuffer(content, "<i8", n_docs, at).tolist()
        null = bytes(content[at + 8 * n_docs : at + 9 * n_docs])
        lengths = np.frombuffer(content, "<u4", n_docs, at + 9 * n_docs)
        c = at + 13 * n_docs
        ranks = unpack(content[c : c + n_control], content[c + n_control : end], n)
        yield shard, before, [None if z else x for x, z in zip(ids, null, strict=True)], lengths, ranks
        before, at = before + n, end


def _read_rows(ranked: np.ndarray, shard_start: dict[int, int], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for shard, before, doc_ids, lengths, ranks in read_blocks(content.as_buffer()):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    raw = memoryview(ranked[ranks].tobytes())
                    spans = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
                    columns = [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(ends - lengths + (shard_start[shard] + before), pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([bytes(raw[4 * a : 4 * b]) for a, b in spans], pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_token_store(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids as little-endian unsigned 32-bit]) of every document, from the files.

    Starts need the ids of earlier shards only: one number a shard.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    shards = json.loads(read_bytes(folder, "manifest.json"))["shards"]
    starts = np.cumsum([0, *(n for *_, n in shards)]).tolist()
    if not any(files for _, files, _, _ in shards):
        return spark.createDataFrame([], schema)
    ranked = np.frombuffer(read_bytes(folder, "dictionary.bin"), "<u4")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tkv").load(folder).select("content")
    return files.mapInArrow(_read_rows(ranked, {s: starts[k] for k, (s, *_) in enumerate(shards)}, with_ids), schema)
