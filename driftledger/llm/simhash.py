"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within distance 2r share a variant within distance r of both. Every distinct fingerprint is sent to all
its variants; those that meet at a variant are linked after a check of their distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .storage import bounded_batches, drop_staged, free_name, staged, without

BITS = 64


def shingle_hashes(text: str | None, size: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned hashes of all shingles, repeats included; fewer words than a shingle are one, no words none."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z, and only the six white spaces
    if not words:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, n, out = xxhash.xxh64_intdigest, len(words) - size + 1, []
    for at in range(0, n, 1 << 16):
        a, b = starts[at : min(n, at + (1 << 16))].tolist(), ends[at + size - 1 : at + size - 1 + (1 << 16)].tolist()
        out.append(np.array([digest(joined[x:y], seed) for x, y in zip(a, b, strict=True)], np.uint64))
    return np.concatenate(out)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; of none, zero."""
    set_ = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        set_ += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bits that are set in over half of the hashes of all shingles, repeats included; without words zero."""
    return majority(shingle_hashes(text, shingle, seed))


def text_key() -> Column:
    """A hash of the text, by which rows are told apart where doc_ids are missing or repeat."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _fingerprint_rows(shingle: int, seed: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = np.array([fingerprint(t, shingle, seed) for t in part.column(0).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), *part.columns[1:]], names)

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, key: str | None = None) -> DataFrame:
    """(fp as a signed long, doc_id[, key]) of each document; null text has no words."""
    bounded_batches(docs.sparkSession)
    read = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *([key] if key else []))
    schema = "fp long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema.fields[1:])
    return read.mapInArrow(_fingerprint_rows(shingle, seed, ["fp", *read.columns[1:]]), schema)


def masks(radius: int) -> list[int]:
    """All differences of at most so many bits, as signed longs."""
    out = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in out]


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Links (u, v) between distinct fingerprints that keep every pair within the distance connected.

    A variant is met by its own ball of fingerprints only, at most 65 at distance 2, so no variant is hot. Those that
    meet there are at most the distance apart, so links to the smallest of them stand for all pairs.
    """
    balls = distinct.select("fp", F.explode(F.array(*map(F.lit, masks((distance + 1) // 2)))).alias("mask"))
    balls = balls.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = balls.withColumn("first", F.min("fp").over(Window.partitionBy("variant"))).where("fp <> first")
    if distance % 2:  # an odd distance: two of a ball may lie one bit too far apart, so that all its pairs are checked
        other = balls.select(F.col("fp").alias("first"), "variant")
        met = balls.join(other, "variant").where("first < fp")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("first"))) <= distance).select(F.col("fp").alias("u"), F.col("first").alias("v")).distinct()


def near_duplicates(docs: DataFrame, distance: int = 2, shingle: int = 3, seed: int = 42, key: str | None = None) -> DataFrame:
    """(doc_id, fp, label, component_id): component_id is the smallest doc_id that links reach, the document itself included.

    label is the smallest fingerprint of the component. With ``key``, that column of the documents comes along.

    Copies fold into their fingerprint before anything is sent out. Texts without words, null ones included, have
    fingerprint zero and link like any other. Null doc_ids count as no doc_id: a component of only such rows has none.
    Repeated rows each stay. No documents: no rows. Extra columns are not read.
    """
    prints = staged(fingerprints(docs, shingle, seed, key), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    near = staged(links(distinct, distance), "links")
    labels = connected_components(near)
    drop_staged(near)
    linked = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    component = linked.join(least, "label").select("fp", "label", "component_id")
    return prints.join(component, "fp").select("doc_id", "fp", "label", "component_id", *([key] if key else []))


def one_of_each(docs: DataFrame, distance: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The rows of one document of each component, that with the smallest doc_id, all columns kept.

    Texts decide, not doc_ids: rows without a doc_id are compared like any other and stay only where their component has
    no doc_id; different texts under one doc_id are judged each for itself; of wholly equal rows one stays.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    found = near_duplicates(rows.select(F.struct("doc_id", "text_key").alias("key"), "text", "doc_id"), distance, shingle, seed, key="key")
    return keep_one(docs, found.select("key.*", "label"))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of each component of ``found`` (doc_id, text_key, label): the smallest doc_id's, null doc_ids last."""
    found = staged(found.select("doc_id", "text_key", "label"), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    kept = found.groupBy("label").agg(F.min(order).alias("kept"))
    named = found.join(kept, "label").select("doc_id", "text_key", (order == F.col("kept")).alias("stays"))
    named = staged(named.groupBy("doc_id", "text_key").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("n")), "kept-rows")
    drop_staged(found)
    out = without(docs, [F.col("doc_id").cast("long"), text_key()], named.where(~F.col("stays")).select("doc_id", "text_key"))
    again = named.where("stays and n > 1").select("doc_id", "text_key")
    if not again.limit(1).count():
        return out
    # Equal doc_ids and texts: one row of each, the first by a hash of all its columns.
    name = free_name(docs.columns, "first_of")
    rest = without(docs, [F.col("doc_id").cast("long"), text_key()], named.where("not stays or n > 1").select("doc_id", "text_key"))
    several = without(out, [F.col("doc_id").cast("long"), text_key()], again, anti=False)
    hashed = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = several.groupBy(F.col("doc_id"), text_key()).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*hashed)).alias(name))
    return rest.unionByName(one.select(f"{name}.*"))
