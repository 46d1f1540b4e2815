import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftledger.llm import packing
from driftledger.llm.packing import _numbered, best_fit, dominating_set, pack_documents, plan, reduce_instance
from driftledger.llm.storage import bounded_batches


def optimum(items: tuple[int, ...], capacity: int) -> int:
    """Fewest bins, by trying every set with the largest item."""
    from functools import lru_cache

    @lru_cache(None)
    def best(left: tuple[int, ...]) -> int:
        if not left:
            return 0
        first, rest, out = left[-1], left[:-1], len(left)
        seen = set()

        def fill(k: int, room: int, taken: tuple[int, ...]):
            nonlocal out
            remaining = tuple(sorted((Counter(rest) - Counter(taken)).elements()))
            if remaining not in seen:
                seen.add(remaining)
                out = min(out, 1 + best(remaining))
            for j in range(k, len(rest)):
                if rest[j] <= room:
                    fill(j + 1, room - rest[j], (*taken, rest[j]))

        fill(0, capacity - first, ())
        return out

    return best(tuple(sorted(items)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(items):
    counts = np.bincount(items, minlength=21)
    fixed, rest = reduce_instance(counts)
    left = tuple(np.repeat(np.arange(21), rest).tolist())
    assert sum(n for _, n in fixed) + optimum(left, 20) == optimum(tuple(items), 20)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_plan_packs_everything_once(items):
    counts = np.bincount(items, minlength=51)
    for patterns in (plan(counts), best_fit(counts)):
        packed = Counter()
        for held, n in patterns:
            assert sum(held) <= 50 and n > 0
            for x in held:
                packed[x] += n
        assert packed == Counter(items)


def test_best_fit_equals_one_by_one():
    r = np.random.default_rng(1)
    for _ in range(30):
        items = sorted(r.integers(1, 40, 60).tolist(), reverse=True)
        rooms: list[int] = []
        for x in items:
            fit = [k for k in range(len(rooms)) if rooms[k] >= x]
            if fit:
                rooms[min(fit, key=lambda k: rooms[k])] -= x
            else:
                rooms.append(40 - x)
        assert sum(n for _, n in best_fit(np.bincount(items, minlength=41))) == len(rooms)


@pytest.mark.parametrize(("items", "s", "want"), [([19, 5], 19, (19,)), ([12, 8, 3], 12, (12, 8)), ([12, 7, 6, 5], 12, (12, 7))])
def test_dominating_sets(items, s, want):
    assert dominating_set(np.bincount(items, minlength=21), s) == want


def test_documents(docs, rows, tokenizer):
    path, encode = tokenizer
    capacity = 256
    found = pack_documents(docs, path, capacity, with_ids=True).collect()
    pieces = defaultdict(list)
    for r in found:
        raw = bytes(r.ids)
        assert r.length == len(raw) // 4 <= capacity and zlib.crc32(raw) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.piece, raw))
    want = Counter((r[0], np.array(encode(r[1]) + [0], "<u4").tobytes()) for r in rows)
    whole = Counter()
    for d, parts in pieces.items():
        copies = sum(1 for r in rows if r[0] == d)
        parts.sort()
        for k in range(copies):
            own = parts[k::copies]
            assert [p for _, p, _ in own] == list(range(len(own)))
            assert all(len(x) == 4 * capacity for _, _, x in own[1:])
            whole[d, b"".join(x for *_, x in own)] += 1
    assert whole == want
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= 1.1 * sum(r.length for r in found) / capacity + 1


def test_no_documents(empty, tokenizer):
    assert pack_documents(empty, tokenizer[0]).count() == 0


def test_numbers_go_on_where_the_last_part_ended():
    used = np.zeros(6, np.int64)
    assert _numbered(np.array([2, 5, 2, 2, 1]), used).tolist() == [0, 0, 1, 2, 0]
    assert _numbered(np.array([5, 1, 2]), used).tolist() == [1, 1, 3] and used.tolist() == [0, 2, 4, 0, 0, 2]


def test_executors_hold_no_sort_and_deal_nothing_out(spark, tokenizer):
    rows = [(k, "one text" * (k % 3)) for k in range(900)]  # many tasks, some without rows, all with the same lengths
    found = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(37, "doc_id"), tokenizer[0], 64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Exchange", "Sort", "Window", "Aggregate") if x in plan]
    found = found.toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(found.doc_id) == list(range(900))
    assert (found.groupby("sequence_id").length.cumsum() - found.length == found.offset).all()
    assert found.groupby("sequence_id").length.sum().max() <= 64 and found.sequence_id.nunique() == -(-found.length.sum() // 64)


def test_texts_are_read_few_at_a_time(spark, docs, tokenizer, monkeypatch):
    keys, seen = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch"), []
    stage = packing.staged
    monkeypatch.setattr(packing, "staged", lambda *a: (seen.append([int(spark.conf.get(k)) for k in keys]), stage(*a))[1])
    bounded_batches(spark)
    before = [spark.conf.get(k) for k in keys]
    pack_documents(docs, tokenizer[0])
    assert seen[0][0] <= 128 and seen[0][1] <= 2 << 20 and [spark.conf.get(k) for k in keys] == before


def test_a_very_long_text_and_many_copies(spark, tokenizer):
    path, encode = tokenizer
    text = "A long text — d'accord, 中文 's. " * 30_000
    rows = [(1, text)] + [(2, "copy of one text")] * 3000 + [(None, None)] * 50
    found = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path).toPandas()
    own, ids = found[found.doc_id == 1].sort_values("piece"), encode(text) + [0]
    assert own.length.sum() == len(ids) and (own.length[1:] == 2048).all() and list(own.piece) == list(range(len(own)))
    assert (found.doc_id == 2).sum() == 3000 and found.doc_id.isna().sum() == 50
    placed = found.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.sequence_id.nunique() == -(-placed.length.sum() // 2048)
