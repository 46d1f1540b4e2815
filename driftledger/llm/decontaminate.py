"""Benchmark decontamination with a distributed positional inverted index of the training documents.

The index is split by documents: a row holds a few megabytes of whole documents as a dictionary of their words and, for
each word, the rising list of its positions. All lists that one phrase needs for one document are then in one row, so
that a search needs no shuffle. Benchmark windows are searched in every row from the words that are rarest there: the
offset-adjusted list of the rarest is intersected with that of the next rarest, what is left with the third, and so on.

The benchmark is written in parts of bounded size to the shared folder, from where each search reads one part after
another; the driver sees the names of the parts only.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, new_path, read_bytes, staged, without, write_bytes

#: Fixed value: a word is a longest run of digits, letters a-z and characters beyond ASCII, in lower-cased text.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
INDEX = "doc_ids array<long>, text_keys array<long>, n_words array<int>, terms binary, counts binary, positions binary"


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


def text_key() -> Column:
    """A hash of the text: what is decided of a text holds for every row that has it, whatever its doc_id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _index_rows(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list[int | None] = []
        keys: list[int] = []
        n_words: list[int] = []
        ids: list[np.ndarray] = []
        vocabulary: dict[bytes, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal held
            flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
            narrow = flat.astype(np.uint16) if len(vocabulary) <= 1 << 16 else flat  # 16 bits sort by radix
            out = {
                "doc_ids": pa.array([list(doc_ids)], pa.list_(pa.int64())),
                "text_keys": pa.array([list(keys)], pa.list_(pa.int64())),
                "n_words": pa.array([list(n_words)], pa.list_(pa.int32())),
                "terms": pa.array([b"\n".join(vocabulary)], pa.binary()),
                "counts": pa.array([np.bincount(flat, minlength=len(vocabulary)).astype("<u4").tobytes()], pa.binary()),
                "positions": pa.array([np.argsort(narrow, kind="stable").astype("<u4").tobytes()], pa.binary()),
            }
            held = 0
            doc_ids.clear(), keys.clear(), n_words.clear(), ids.clear(), vocabulary.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc_id, key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    found = words(text)
                    doc_ids.append(doc_id), keys.append(key), n_words.append(len(found))
                    ids.append(np.fromiter(map(vocabulary.__getitem__, found), np.uint32, len(found)))
                    held += len(text or "") + 16
                    if held >= block_bytes:
                        yield close()
        if doc_ids:
            yield close()

    return run


def build_index(docs: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """The stored index, one row for each block of whole documents; null text has no words, extra columns are not read."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(_index_rows(block_bytes), INDEX)
    return staged(rows, "positions")


@dataclass
class Windows:
    """Benchmark windows as rows of term numbers, -1 where an item is shorter than a window."""

    terms: list[bytes]
    words: np.ndarray
    length: np.ndarray
    item: np.ndarray
    items: list[str]


def make_windows(items: list[tuple[str, list[bytes]]], size: int) -> Windows:
    """The windows of items or of pieces of items, which share a name."""
    number: dict[bytes, int] = {}
    named: dict[str, int] = {}
    rows, length, item = [], [], []
    for name, own in items:
        found = np.array([number.setdefault(w, len(number)) for w in own], np.int64)
        n = min(size, len(found))
        if not n:
            continue
        at = np.arange(len(found) - n + 1)[:, None] + np.arange(n)
        rows.append(np.pad(found[at], ((0, 0), (0, size - n)), constant_values=-1))
        length.append(np.full(len(at), n))
        item.append(np.full(len(at), named.setdefault(name, len(named))))
    none = np.zeros(0, np.int64)
    return Windows(list(number), np.concatenate([none.reshape(0, size), *rows]), np.concatenate([none, *length]), np.concatenate([none, *item]), list(named))


def _part_files(folder: str, size: int, part_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, names, sizes, held, n = TaskContext.get().partitionId(), [], [], [], 0

        def close() -> None:
            nonlocal n
            if held:
                names.append(f"part-{task:06d}-{len(names):06d}.json")
                sizes.append(n)
                write_bytes(folder, names[-1], [json.dumps(held).encode()])
                held.clear()
                n = 0

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [w.decode("latin-1") for w in words(text)]
                step = max(size, part_words)  # a longer item is cut so that every window is whole in one piece
                for at in range(0, max(1, len(own) - size + 1), step):
                    piece = own[at : at + step + size - 1]
                    held.append([name, " ".join(piece)])
                    n += len(piece)
                    if n >= part_words:
                        close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "n_words"])

    return run


def write_parts(benchmark: DataFrame, folder: str, size: int, part_words: int) -> list[list[str]]:
    """Write the benchmark's words and return the files of each part, a part of about ``part_words`` words or less.

    An item without an id counts as the item "null"; a null text has no words.
    """
    bounded_batches(benchmark.sparkSession)
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    files = rows.mapInArrow(_part_files(folder, size, part_words), "name string, n_words long").collect()
    parts, n = [], part_words
    for f in sorted(files):
        if n + f.n_words > part_words:
            parts.append([])
            n = 0
        parts[-1].append(f.name)
        n += f.n_words
    return parts


@functools.lru_cache(maxsize=1)
def load_part(folder: str, files: tuple[str, ...], size: int) -> Windows:
    """One part of the benchmark, kept by a worker until it needs another."""
    items = [(name, text.encode("latin-1").split()) for f in files for name, text in json.loads(read_bytes(folder, f))]
    return make_windows(items, size)


def _runs(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which run, position) for every position of the runs that begin there and are so long."""
    which = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return which, begin[which] + within


class Block:
    """One row of the index, opened for a search."""

    def __init__(self, doc_ids: list, text_keys: list, n_words: list, terms: bytes, counts: bytes, positions: bytes):
        self.doc_ids, self.text_keys, self.n_words = doc_ids, text_keys, np.array(n_words, np.int64)
        self.ends = np.cumsum(self.n_words)
        self.local = {t: k for k, t in enumerate(terms.split(b"\n"))} if counts else {}
        self.counts = np.frombuffer(counts, "<u4").astype(np.int64)
        self.positions = np.frombuffer(positions, "<u4").astype(np.int64)
        self.begin = np.cumsum(self.counts) - self.counts
        self.total = len(self.positions)
        # Every posting as one number, its list's and its place in it; all lists one after another rise.
        self.postings = np.repeat(np.arange(len(self.counts)), self.counts) * self.total + self.positions

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, side="right")

    def meets(self, term: np.ndarray, place: np.ndarray, doc: np.ndarray, slop: int) -> np.ndarray:
        """Whether the term's list has a position within the slop of the place, in the document: a binary search in it."""
        low, high = np.maximum(place - slop, self.ends[doc] - self.n_words[doc]), np.minimum(place + slop, self.ends[doc] - 1)
        at = np.searchsorted(self.postings, term * self.total + low)
        there = (at < self.total) & (low <= high)
        return there & (self.postings[np.where(there, at, 0)] <= term * self.total + high)

    def search(self, w: Windows, slop: int = 0, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(window, start, document, whether exact) wherever each word of a window stands within the slop of its own place.

        Without a slop these are the exact occurrences. With one, a start may lie up to the slop outside of its document;
        words are looked for inside the document only.
        """
        if not self.total or not len(w.words):
            return
        local = np.fromiter((self.local.get(t, -1) for t in w.terms), np.int64, len(w.terms))
        here = np.where(w.words >= 0, local[w.words], 0)
        active = np.flatnonzero((here >= 0).all(axis=1))
        if not len(active):
            return
        here, length = here[active], w.length[active]
        weight = np.where(w.words[active] >= 0, self.counts[here], np.iinfo(np.int64).max)
        order = np.argsort(weight, axis=1, kind="stable")
        rows = np.arange(len(active))
        first, second = order[:, 0], order[:, min(1, order.shape[1] - 1)]
        next_ = np.where(length > 1, here[rows, second], -1)
        # Windows whose two rarest words are the same, as far apart, share one intersection of these.
        starts = np.stack([here[rows, first], next_, np.where(length > 1, second - first, 0)], axis=1)
        pairs, pair = np.unique(starts, axis=0, return_inverse=True)
        pair = pair.reshape(-1)
        by_pair, pair_count = np.argsort(pair, kind="stable"), np.bincount(pair, minlength=len(pairs))
        pair_begin = np.cumsum(pair_count) - pair_count
        rare, next_, delta = pairs.T
        shifts, n = np.arange(-slop, slop + 1), self.counts[rare]
        cuts = np.searchsorted(np.cumsum(n), np.arange(at_once, n.sum() + at_once, at_once), side="left") + 1
        for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
            which, place = _runs(self.begin[rare[a:b]], n[a:b])
            place, term = self.positions[place], next_[a:b][which]
            doc = self.document(place)
            keep = (term < 0) | self.meets(np.maximum(term, 0), place + delta[a:b][which], doc, 2 * slop)
            which, place, doc = which[keep], place[keep], doc[keep]
            # Every window that begins with such a pair, at every start that leaves the rarest word within the slop.
            at, row = _runs(pair_begin[a:b][which], pair_count[a:b][which])
            row, at, shift = np.repeat(by_pair[row], len(shifts)), np.repeat(at, len(shifts)), np.tile(shifts, len(row))
            start, doc = place[at] - first[row] + shift, doc[at]
            row, start, doc = self._all_meet(here, length, order, row, start, doc, slop)
            if slop and len(row):  # several places of the rarest word may give one start
                row, start, doc = np.unique(np.stack([row, start, doc], axis=1), axis=0).T
            exact = np.ones(len(row), bool)
            if slop:
                exact[:] = False
                mark = np.arange(len(row))
                exact[self._all_meet(here, length, order, row, start, doc, 0, mark)[3]] = True
            yield active[row], start, doc, exact

    def _all_meet(self, here: np.ndarray, length: np.ndarray, order: np.ndarray, row: np.ndarray, start: np.ndarray, doc: np.ndarray, slop: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
        """Those of the starts at which all words of the window meet, the rarest words first."""
        kept = (row, start, doc, *more)
        for k in range(order.shape[1]):
            row, start, doc, *_ = kept
            column = order[row, k]
            keep = (k >= length[row]) | self.meets(here[row, column], start + column, doc, slop)
            kept = tuple(x[keep] for x in kept)
        return kept


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(**{name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)})


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


class _Found:
    """What the parts searched so far have hit in one block."""

    def __init__(self, block: Block):
        self.block, self.edge = block, np.zeros(block.total + 1, np.int32)
        self.exact: dict[int, set[str]] = defaultdict(set)
        self.near: dict[int, set[str]] = defaultdict(set)

    def add(self, w: Windows, slop: int) -> None:
        for window, start, doc, exact in self.block.search(w, slop):
            np.add.at(self.edge, start[exact], 1)
            np.add.at(self.edge, start[exact] + w.length[window[exact]], -1)
            for mask, into in ((exact, self.exact), (slice(None), self.near)):
                for d, i in np.unique(np.stack([doc[mask], w.item[window[mask]]], axis=1), axis=0).tolist():
                    into[d].add(w.items[i])

    def rows(self) -> pa.RecordBatch:
        b = self.block
        hit = np.concatenate([[0], np.cumsum(np.cumsum(self.edge[:-1]) > 0)])
        n_hit = hit[b.ends] - hit[b.ends - b.n_words]
        docs, nothing = range(len(b.doc_ids)), _digest([])
        of = lambda found: (pa.array([len(found.get(d, ())) for d in docs], pa.int64()), pa.array([_digest(list(found[d])) if d in found else nothing for d in docs]))
        columns = [pa.array(b.doc_ids, pa.int64()), pa.array(b.n_words), pa.array(n_hit, pa.int64()), *of(self.exact), pa.array(n_hit > 0), *of(self.near)]
        columns += [pa.array([sorted(self.exact.get(d, ())) for d in docs], pa.list_(pa.string())), pa.array(b.text_keys, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long, near_items_sha256 string, items array<string>, text_key long"


def _result_rows(folder: str, parts: list[list[str]], size: int, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_Found(block) for block in _blocks([batch])]
            for files in parts:
                w = load_part(folder, tuple(files), size)
                for x in found:
                    x.add(w, slop)
            yield from (x.rows() for x in found)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, part_words: int = 1 << 20, slop: int = 2) -> DataFrame:
    """One row for each document: its words, those inside an occurrence of a window, and the items with such windows.

    Also the items of which a window stands near: each of its words, in the document, at most ``slop`` places from where
    it would stand, exact occurrences included. An item of fewer words than a window is one window. Null texts have no
    words and match nothing; an item without an id counts as the item "null". Items of equal text each match. Rows that
    share a doc_id are judged each for itself; empty tables give no rows or no hits; extra columns are not read. The
    benchmark is searched in parts of bounded size, one after another in each row of the index.
    """
    index = build_index(docs)
    folder = new_path(docs.sparkSession, "benchmark-parts")
    return index.mapInArrow(_result_rows(folder, write_parts(benchmark, folder, window, part_words), window, slop), RESULT)


def _match_rows(folder: str, parts: list[list[str]], size: int, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = list(_blocks([batch]))
            for files in parts:
                w = load_part(folder, tuple(files), size)
                for block in blocks:
                    for x, start, doc, exact in block.search(w, slop):
                        columns = [
                            pa.array([block.doc_ids[d] for d in doc], pa.int64()),
                            pa.array([w.items[i] for i in w.item[x]], pa.string()),
                            pa.array(start - (block.ends[doc] - block.n_words[doc]), pa.int64()),
                            pa.array(w.length[x], pa.int64()),
                            pa.array(exact, pa.bool_()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start", "length", "exact"])

    return run


def matches(index: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 0, part_words: int = 1 << 20) -> DataFrame:
    """Every occurrence (doc_id, item_id, start word, length, exact) of a window.

    With a slop, also proximity matches: every start at which each word of the window stands within the slop of its own
    place, in the same document; such a start may lie up to the slop outside of the document.
    """
    folder = new_path(index.sparkSession, "benchmark-parts")
    parts = write_parts(benchmark, folder, window, part_words)
    return index.mapInArrow(_match_rows(folder, parts, window, slop), "doc_id long, item_id string, start long, length long, exact boolean")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of documents whose text holds no benchmark window, all columns kept; texts decide, whatever the doc_id."""
    found = staged(contamination(docs, benchmark, window, slop=0).where("contaminated").select("text_key").distinct(), "contaminated")
    return without(docs, [text_key()], found)
