"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie. Each node's failure link leads to where matching goes on once the longest pieces of its string
are popped, and the number of pieces popped is kept with it, so that a word is counted in one pass over its bytes
without a piece being built.
"""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches
from .tokens import byte_alphabet


class Automaton:
    """``initial`` pieces start a word, ``continuing`` ones go on with it; without the latter one set does both."""

    def __init__(self, initial: set[bytes], continuing: set[bytes] | None = None, cache_entries: int = 500_000):
        self.child: list[dict[int, int]] = [{}]
        self.piece: list[bool] = [False]
        self.root = 0
        self.suffix_root = 0 if continuing is None else self._node()
        for root, pieces in ((self.root, initial), (self.suffix_root, continuing or ())):
            for p in pieces:
                if p:
                    self._add(root, p)
        self._link()
        self.cache: dict[bytes, int] = {}
        self.cache_entries = cache_entries

    def _node(self) -> int:
        self.child.append({})
        self.piece.append(False)
        return len(self.child) - 1

    def _add(self, at: int, piece: bytes) -> None:
        for b in piece:
            nxt = self.child[at].get(b)
            if nxt is None:
                nxt = self.child[at][b] = self._node()
            at = nxt
        self.piece[at] = True

    def _link(self) -> None:
        """Failure links and popped-piece counts, from short strings to long ones; -1 where nothing can go on."""
        self.fail, self.popped = [-1] * len(self.child), [0] * len(self.child)
        level = [self.root] if self.root == self.suffix_root else [self.root, self.suffix_root]
        while level:
            below = []
            for u in level:
                for b, v in self.child[u].items():
                    below.append(v)
                    if self.piece[v]:
                        self.fail[v], self.popped[v] = self.suffix_root, 1
                        continue
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and b not in self.child[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.child[z][b], n
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest match; a word that it cannot cut is one unknown piece, an empty word none."""
        child, fail, popped = self.child, self.fail, self.popped
        u, n = self.root, 0
        for b in word:
            while b not in child[u]:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 1
            u = child[u][b]
        while u not in (self.root, self.suffix_root):
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 1
        return n

    def __call__(self, word: bytes) -> int:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= self.cache_entries:
                self.cache.clear()
            found = self.cache[word] = self.count(word)
        return found


@functools.lru_cache(maxsize=2)
def byte_level(path: str) -> Automaton:
    """The automaton of a byte-level vocabulary file, in which pieces that start a word hold the space before it."""
    table = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return Automaton({bytes(table[c] for c in p) for p in vocabulary if all(c in table for c in p)})


@functools.lru_cache(maxsize=2)
def word_pieces(pieces: tuple[str, ...], mark: str = "##") -> Automaton:
    """The automaton of a word-piece list whose continuing pieces begin with a mark."""
    return Automaton({p.encode() for p in pieces if not p.startswith(mark)}, {p[len(mark) :].encode() for p in pieces if p.startswith(mark)})


def _count_rows(make, before: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n_words, n_pieces = [], []
                for text in part.column(1).to_pylist():
                    words = (text or "").encode("utf-8", "replace").split()  # bytes: only the six white spaces
                    n_words.append(len(words))
                    if len(words) > 1000:  # in a long text most words recur
                        n_pieces.append(sum(n * count(before + w) for w, n in Counter(words).items()))
                    else:
                        n_pieces.append(sum([count(before + w) for w in words]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_pieces, pa.int64())], ["doc_id", "n_words", "n_pieces"])

    return run


def token_counts(docs: DataFrame, path: str | None = None, pieces: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, n_words, n_pieces) of each whole text, words as white space leaves them.

    From a byte-level vocabulary file, each word with a space before it, or from a word-piece list. Null and empty texts
    have none; repeated rows are counted each for itself; extra columns are not read.
    """
    bounded_batches(docs.sparkSession)
    make, before = (functools.partial(byte_level, path), b" ") if path else (functools.partial(word_pieces, pieces or ()), b"")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count_rows(make, before), "doc_id long, n_words long, n_pieces long")
