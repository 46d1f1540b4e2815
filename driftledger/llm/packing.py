"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so the whole instance is a count for each length, however many documents
there are. The reduction and the packing work on these counts; documents then take the places by their rank among those
of their length. The task that cuts a document numbers its pieces by length as it goes, and what the tasks before it
hold of each length makes ranks of these numbers, so that nothing is sorted or dealt out.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, new_path, open_filesystem, short_reads, staged, write_bytes
from .tokens import encoder

#: The file that has, for each task, how many pieces of each length the tasks before it hold.
BEFORE = "before.bin"
#: A pattern is what a sequence holds: lengths, longest first, and how many sequences hold it.
Pattern = tuple[tuple[int, ...], int]


def _present(counts: np.ndarray, without: int) -> np.ndarray:
    """Lengths that are left when one of ``without`` is taken, rising, each up to three times."""
    left = counts.copy()
    left[without] -= 1
    return np.repeat(np.arange(len(left)), np.minimum(left, 3))


def dominating_set(counts: np.ndarray, s: int) -> tuple[int, ...] | None:
    """Lengths of a set that holds s and dominates every feasible set that holds s, or None if none is proved.

    A set dominates another if the other's lengths can be grouped so that each group fits within a length of its own:
    then some best packing uses it.
    """
    room = len(counts) - 1 - s
    others = _present(counts, s)
    fit = others[others <= room]
    if not len(fit):
        return (s,)
    best = int(fit[-1])
    if best == room or len(fit) == 1 or fit[0] + fit[1] > room:  # nothing beside it is larger, and no two fit
        return (s, best)
    if len(fit) > 2 and fit[:3].sum() <= room:
        return None
    # At most two fit beside s. The largest sum of two, by the largest partner of each.
    partner = np.searchsorted(fit, room - fit, side="right") - 1
    partner = np.where(partner >= np.arange(len(fit)), partner - (partner == np.arange(len(fit))), partner)
    low = np.arange(len(fit))
    ok = (partner >= 0) & (fit + fit[partner] <= room)
    if not ok.any():
        return (s, best)
    if (fit[low[ok]] + fit[partner[ok]]).max() <= best:
        return (s, best)
    second = fit[:-1][fit[:-1] <= room - best]
    if not len(second):
        return None
    second = int(second[-1])
    # {s, best, second} dominates if every pair has a smaller length up to second or a sum up to best.
    smaller, larger = np.minimum(fit[low[ok]], fit[partner[ok]]), np.maximum(fit[low[ok]], fit[partner[ok]])
    if ((smaller <= second) | (smaller + larger <= best)).all():
        return (s, best, second)
    return None


def reduce_instance(counts: np.ndarray) -> tuple[list[Pattern], np.ndarray]:
    """Fix dominating sets until none is left; returns them and the counts that remain."""
    counts, fixed = counts.copy(), []
    changed = True
    while changed:
        changed = False
        for s in range(len(counts) - 1, 0, -1):
            while counts[s] and (found := dominating_set(counts, s)):
                times = min(int(counts[x]) // found.count(x) for x in set(found))
                if len(found) == 3:
                    times = 1
                for x in found:
                    counts[x] -= times
                fixed.append((tuple(sorted(found, reverse=True)), times))
                changed = True
    return fixed, counts


def best_fit(counts: np.ndarray) -> list[Pattern]:
    """Best fit, longest first: each goes to the fullest open sequence that still has room for it."""
    capacity = len(counts) - 1
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for s in range(capacity, 0, -1):
        left = int(counts[s])
        for room in sorted(r for r in open_ if r >= s):
            for held in sorted(open_[room]):
                if not left:
                    break
                n, each = open_[room][held], room // s
                full = min(n, left // each)
                part = left - full * each if full < n else 0
                part = min(part, each - 1) if full < n else 0
                moved = full + (part > 0)
                open_[room][held] -= moved
                if not open_[room][held]:
                    del open_[room][held]
                if full:
                    open_[room - each * s][held + (s,) * each] += full
                if part:
                    open_[room - part * s][held + (s,) * part] += 1
                left -= full * each + part
            if not open_[room]:
                del open_[room]
        each = capacity // s
        if left // each:
            open_[capacity - each * s][(s,) * each] += left // each
        if left % each:
            open_[capacity - left % each * s][(s,) * (left % each)] += 1
    return [(held, n) for room in sorted(open_) for held, n in sorted(open_[room].items())]


def plan(counts: np.ndarray) -> list[Pattern]:
    fixed, rest = reduce_instance(counts)
    return fixed + best_fit(rest)


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks that take the same place in consecutive sequences, sorted by length and rank."""
    used: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for held, times in patterns:
        offset = 0
        for s in held:
            rows.append((s, used[s], first, offset))
            used[s] += times
            offset += s
        first += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "first": table[:, 2], "offset": table[:, 3]}


def _numbered(length: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The number of each piece among those of its length, from 0, where ``used`` have come before; counts them there."""
    counts = np.bincount(length, minlength=len(used))
    order = np.argsort(length, kind="stable")
    row = np.empty(len(length), np.int64)
    row[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
    row += used[length]
    used += counts
    return row


def _piece_rows(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, 500_000)  # leaves room for what other stages keep in a worker
        end, width = np.array([end_id], e.dtype).tobytes(), e.dtype.itemsize
        task, used = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for doc_id, raw in zip(part.column(0).to_pylist(), e.encode(part.column(1).to_pylist()), strict=True):
                    raw += end
                    n = len(raw) // width
                    wide = np.frombuffer(raw, e.dtype).astype("<u4").tobytes()
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        ids = wide[4 * a : 4 * b]
                        for name, value in (("doc_id", doc_id), ("piece", k), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(ids)), ("ids", ids)):
                            out[name].append(value)
                columns = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32"))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.binary()))
                    names.append("ids")
                columns += [pa.array(np.full(len(out["piece"]), task), pa.int32()), pa.array(_numbered(np.array(out["length"], np.int64), used))]
                yield pa.RecordBatch.from_arrays(columns, [*names, "task", "row"])

    return run


def _count_rows(capacity: int):
    """(task, counts) of (task, length): packed counts of each length; a task may have several rows, which add up."""

    def packed(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in held.values()], pa.binary())], ["task", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(capacity + 1, "<i8"))
        for batch in batches:
            task, length = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for t in np.unique(task).tolist():
                held[t] += np.bincount(length[task == t], minlength=capacity + 1)
            if len(held) >= 256:
                yield packed(held)
                held.clear()
        yield packed(held)

    return run


def _before(counts: dict[int, list[bytes]], capacity: int) -> Iterator[bytes]:
    """For each task in rising order, how many pieces of each length the tasks before it hold."""
    so_far = np.zeros(capacity + 1, "<i8")
    for task in sorted(counts):
        yield so_far.tobytes()
        for c in counts[task]:
            so_far += np.frombuffer(zlib.decompress(c), "<i8")


def _place_rows(table: dict[str, np.ndarray], folder: str, tasks: np.ndarray, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = open_filesystem(folder)
        width, known = 8 * (capacity + 1), {}
        with filesystem.open_input_file(f"{path}/{BEFORE}") as f:

            def read(k: int) -> np.ndarray:
                f.seek(k * width)
                return np.frombuffer(f.read(width), "<i8")

            for batch in batches:
                if not batch.num_rows:
                    continue
                column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
                length, task, row = (column[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "task", "row"))
                own, which = np.unique(np.searchsorted(tasks, task), return_inverse=True)
                known = {k: known[k] if k in known else read(k) for k in own.tolist()}
                rank = np.stack(list(known.values()))[which, length] + row
                at = np.searchsorted(table["key"], (length << 44) + rank, side="right") - 1
                column |= {"sequence_id": pa.array(table["first"][at] + rank - table["rank"][at]), "offset": pa.array(table["offset"][at])}
                names = [k for k in column if k not in ("task", "row")]
                yield pa.RecordBatch.from_arrays([column[k] for k in names], names)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): a row for each piece of each document.

    Documents over the capacity are cut into full pieces behind a shorter first one. Each task numbers its pieces of each
    length, so that copies and repeated rows, whose pieces a third of all may be, stay where they are. The driver sees
    packed counts of lengths for each task and writes what the tasks before each hold to the shared folder, 8 bytes a
    length, of which a worker reads the tasks of a batch. Null text: empty, which is the end id alone. Rows with one
    doc_id are packed each for itself; no documents give no rows; extra columns are not read.
    """
    spark = bounded_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_piece_rows(tokenizer_path, end_id, capacity, with_ids), schema + ", task int, row long")
    with short_reads(spark):  # else the texts of thousands of rows lie in an executor's heap at once
        pieces = staged(rows, "pieces")
    counts: dict[int, list[bytes]] = defaultdict(list)
    for task, packed in pieces.select("task", "length").mapInArrow(_count_rows(capacity), "task int, counts binary").collect():
        counts[task].append(bytes(packed))
    total = np.zeros(capacity + 1, np.int64)
    for packed in (c for held in counts.values() for c in held):
        total += np.frombuffer(zlib.decompress(packed), "<i8")
    folder = new_path(spark, "ranks")
    write_bytes(folder, BEFORE, _before(counts, capacity))
    return pieces.mapInArrow(_place_rows(places(plan(total)), folder, np.array(sorted(counts), np.int64), capacity), schema + ", sequence_id long, offset long")
