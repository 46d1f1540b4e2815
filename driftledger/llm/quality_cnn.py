"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, filters slide over every byte of a document in overlapping chunks, each filter keeps its largest
answer of a chunk, and the largest and the mean of these over the chunks combine into one probability. As the input is
bytes, embedding and filters fold into one table for each place of a filter, and scoring is looking up and adding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches

#: The number of a byte beyond the end of a text; its embedding stays zero.
PAD = 256


@dataclass
class Network:
    width: int = 5
    filters: int = 16
    embedding: int = 8
    chunk: int = 512
    overlap: int = 64
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        self.weights = {
            "embed": np.concatenate([r.normal(0, 0.5, (256, self.embedding)), np.zeros((1, self.embedding))]).astype(np.float32),
            "conv": r.normal(0, (self.width * self.embedding) ** -0.5, (self.width, self.embedding, self.filters)).astype(np.float32),
            "bias": np.zeros(self.filters, np.float32),
            "out": np.zeros(2 * self.filters, np.float32),
            "c": np.zeros(1, np.float32),
        }
        return self

    def tables(self) -> np.ndarray:
        return np.einsum("be,kef->kbf", self.weights["embed"], self.weights["conv"]).astype(np.float32)


def count_chunks(size: int, net: Network) -> int:
    return max(1, -(-(size - net.overlap) // (net.chunk - net.overlap)))


def chunks(texts: list[bytes], net: Network, parts: list[tuple[int, int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each chunk and of the filter's reach beyond it, the text of each chunk); every byte is in a chunk.

    ``parts`` names runs of chunks as (text, first, behind the last); without it all chunks of all texts are meant.
    """
    hop, span = net.chunk - net.overlap, net.chunk + net.width - 1
    if parts is None:
        parts = [(k, 0, count_chunks(len(t), net)) for k, t in enumerate(texts)]
    n = np.array([b - a for _, a, b in parts], np.int64)
    room = (n - 1) * hop + span
    base = np.cumsum(room) - room
    flat = np.full(int(room.sum()), PAD, np.int16)
    for (k, first, _), at, size in zip(parts, base.tolist(), room.tolist(), strict=True):
        piece = texts[k][first * hop : first * hop + size]
        flat[at : at + len(piece)] = np.frombuffer(piece, np.uint8)
    of = np.repeat(np.arange(len(parts)), n)
    within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return flat[(base[of] + within * hop)[:, None] + np.arange(span)], np.repeat(np.array([k for k, *_ in parts], np.int64), n)


def runs_of_chunks(texts: list[bytes], net: Network, most: int) -> Iterator[list[tuple[int, int, int]]]:
    """All chunks of all texts in order, as lists of parts of at most so many chunks together."""
    held, room = [], most
    for k, t in enumerate(texts):
        at, n = 0, count_chunks(len(t), net)
        while at < n:
            end = min(n, at + room)
            held.append((k, at, end))
            room, at = room - (end - at), end
            if not room:
                yield held
                held, room = [], most
    if held:
        yield held


def pooled(block: np.ndarray, tables: np.ndarray, bias: np.ndarray, length: int, at: bool = False):
    """Each filter's largest answer in every chunk, and where it was."""
    out = np.take(tables[0], block[:, :length], axis=0)
    for k in range(1, len(tables)):
        out += np.take(tables[k], block[:, k : k + length], axis=0)
    best = out.max(axis=1) + bias
    return (np.maximum(best, 0), best, out.argmax(axis=1)) if at else np.maximum(best, 0)


def combined(pool: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The largest and the mean of the chunks of each text."""
    first = np.searchsorted(owner, np.arange(n))
    return np.concatenate([np.maximum.reduceat(pool, first), np.add.reduceat(pool, first) / np.bincount(owner, minlength=n)[:, None]], axis=1)


def probability(texts: list[bytes], net: Network, tables: np.ndarray, at_once: int = 256, most: int = 4096) -> np.ndarray:
    """One probability for each text; at most ``most`` chunks are unpacked at once, however long a text is."""
    top, total = np.zeros((len(texts), net.filters)), np.zeros((len(texts), net.filters))
    for parts in runs_of_chunks(texts, net, most):
        block, owner = chunks(texts, net, parts)
        pool = np.concatenate([pooled(block[a : a + at_once], tables, net.weights["bias"], net.chunk) for a in range(0, len(block), at_once)])
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        here = owner[first]
        top[here] = np.maximum(top[here], np.maximum.reduceat(pool, first))
        total[here] += np.add.reduceat(pool.astype(np.float64), first)
    n = np.array([count_chunks(len(t), net) for t in texts]).reshape(-1, 1)
    z = np.concatenate([top, total / n], axis=1) @ net.weights["out"] + net.weights["c"][0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def gradients(net: Network, block: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    w, n = net.weights, len(y)
    pool, best, place = pooled(block, net.tables(), w["bias"], net.chunk, at=True)
    z = combined(pool, owner, n)
    error = (1 / (1 + np.exp(-np.clip(z @ w["out"] + w["c"], -30, 30))) - y) / n
    dz = error[:, None] * w["out"]
    top = pool >= z[owner, : net.filters]  # ties share
    share = top / np.maximum(1, np.add.reduceat(top, np.searchsorted(owner, np.arange(n))))[owner]
    d = dz[owner, : net.filters] * share + (dz[:, net.filters :] / np.bincount(owner, minlength=n)[:, None])[owner]
    d = d * (best > 0)
    seen = block[np.arange(len(block))[:, None, None], place[:, :, None] + np.arange(net.width)]  # chunk, filter, place
    embedded = w["embed"][seen]
    d_embed = np.zeros_like(w["embed"])
    np.add.at(d_embed, seen, np.einsum("cf,kef->cfke", d, w["conv"]))
    d_embed[PAD] = 0
    return {"embed": d_embed, "conv": np.einsum("cf,cfke->kef", d, embedded), "bias": d.sum(axis=0), "out": error @ z, "c": error.sum(keepdims=True)}


def padded(pieces: list[bytes], net: Network) -> np.ndarray:
    out = np.full((len(pieces), net.chunk + net.width - 1), PAD, np.int16)
    for row, piece in zip(out, pieces, strict=True):
        row[: len(piece)] = np.frombuffer(piece, np.uint8)
    return out


def fit(drawn: list[list[bytes]], labels: list[int], net: Network | None = None, epochs: int = 12, steps: int = 400, batch: int = 64, chunks_each: int = 4, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the log loss, for so many epochs and steps at least, over the chunks that draw() took from each text.

    Each step shows up to ``chunks_each`` of these, chosen anew, of every text in it.
    """
    net = (net or Network()).start(seed)
    r, y = np.random.default_rng(seed), np.array(labels, np.float32)
    if not len(y):
        return net
    share = np.clip(y.mean(), 0.02, 0.98)
    net.weights["c"][:] = np.log(share / (1 - share))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    step, epochs = 0, max(epochs, steps // -(-len(y) // batch))
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            chosen = [r.permutation(len(drawn[i]))[:chunks_each] for i in rows]
            block = padded([drawn[i][k] for i, own in zip(rows, chosen, strict=True) for k in own], net)
            g = gradients(net, block, np.repeat(np.arange(len(rows)), list(map(len, chosen))), y[rows])
            step += 1
            now = rate * (1 - epoch / epochs)
            for k, v in net.weights.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                v -= (now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def draw(text: bytes, net: Network, most: int, seed: int) -> list[bytes]:
    """Up to ``most`` chunks from anywhere in the whole text, without repetition."""
    hop, span, n = net.chunk - net.overlap, net.chunk + net.width - 1, count_chunks(len(text), net)
    chosen = range(n) if n <= most else np.sort(np.random.default_rng(seed).choice(n, most, replace=False))
    return [text[int(k) * hop : int(k) * hop + span] for k in chosen]


def _draw_rows(net: Network, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            drawn = [draw((t or "").encode("utf-8", "replace"), net, most, abs(d)) for d, t in zip(ids, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(drawn, pa.list_(pa.binary()))], ["doc_id", "drawn"])

    return run


def is_held_out():
    """Rows whose crc32(doc_id as text) leaves 1 when divided by 3 never teach; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, most_chunks: int = 32, column: str = "quality") -> Network:
    """Fit on a bounded sample: the ``sample`` labelled rows first in hash order, ``most_chunks`` chunks of each.

    Both bounds hold for fitting only. Chunks are drawn on the executors from the whole text of a row, so that the driver
    sees at most sample * most_chunks of them; scoring reads whole texts. Null labels teach nothing, a null text is
    empty; of rows that repeat a doc_id the text first by its hash teaches, and of repeated labels the smallest.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(column).cast("int")).alias("label"))
    chosen = {r.doc_id: r.label for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    if not chosen:
        return fit([], [])
    bounded_batches(spark)
    wanted = F.broadcast(spark.createDataFrame([(d,) for d in chosen], "doc_id long"))  # at most ``sample`` rows
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(wanted, "doc_id", "left_semi")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = rows.mapInArrow(_draw_rows(Network(), most_chunks), "doc_id long, drawn array<binary>").collect()
    found = sorted((r.doc_id, [bytes(x) for x in r.drawn]) for r in found)
    return fit([x for _, x in found], [int(chosen[d] == 1) for d, _ in found])


def _score_rows(net: Network, at: int, into: str):
    tables = net.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = [(t or "").encode("utf-8", "replace") for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(probability(texts, net, tables), pa.float64())], [*part.schema.names, into])

    return run


def score(docs: DataFrame, net: Network, keep: list[str] | None = None, into: str = "score") -> DataFrame:
    """The frame's columns in ``keep`` (doc_id alone if none are named) and a score, from the whole text only.

    ``into`` must not be the name of a kept column; storage.free_name() gives one that is not.
    Null and empty texts get the network's answer to no bytes; repeated rows are scored each for itself.
    """
    bounded_batches(docs.sparkSession)
    names = keep or ["doc_id"]
    read = docs.select(*names, *([] if "text" in names else ["text"]))
    at = read.columns.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields), f"`{into}` double"])
    out = read.mapInArrow(_score_rows(net, at, into), schema)
    return out.select(*(F.col(f"`{c}`") for c in names), into)


def classify(docs: DataFrame, labels: DataFrame, sample: int = 2000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs, train(docs, labels, sample))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
