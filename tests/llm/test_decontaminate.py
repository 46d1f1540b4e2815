import hashlib
import re

import pytest

from driftledger.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_near(docs, items, slop, size=10):
    """(doc_id, item, start) of every start at which all words of a window stand within the slop of their places."""
    out = set()
    for doc_id, text in docs:
        w = words(text)
        for item, t in items:
            own = words(t)
            n = min(size, len(own))
            for k in range(len(own) - n + 1 if own else 0):
                for s in range(-slop, len(w) - n + 1 + slop):
                    if all(own[k + j] in w[max(0, s + j - slop) : max(0, s + j + slop + 1)] for j in range(n)):
                        out.add((doc_id, "null" if item is None else str(item), s))
    return out


def brute(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            own = words(t)
            n = min(size, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add("null" if item is None else str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    long = words(rows[9][1])
    items = [(1, " ".join(long[50:75])), (2, "two words"), (10, "Two  WORDS!"), (3, None), (4, "..."), (5, "one"), (None, rows[5][1]), (7, "absent phrase nowhere"), (8, " ".join(long[-12:]))]
    return spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("part_words", [1 << 21, 8])
@pytest.mark.parametrize("block_bytes", [4 << 20, 300])
def test_equals_brute_force(docs, rows, benchmark, part_words, block_bytes, monkeypatch):
    frame, items = benchmark
    monkeypatch.setattr(d.build_index, "__defaults__", (block_bytes,))
    found = d.contamination(docs, frame, part_words=part_words)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()), key=repr)
    assert got == brute([(r[0], r[1]) for r in rows], items)


def test_empty_tables(docs, empty, benchmark, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(empty, benchmark[0]).count() == 0
    assert d.contamination(docs, none).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta filler gamma delta"), (2, "alpha beta gamma delta"), (3, "delta alpha gamma beta")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma delta")], "item_id long, text string")
    index = d.build_index(docs)
    assert {r.doc_id for r in d.matches(index, items).collect()} == {2}
    near = {(r.doc_id, r.exact) for r in d.matches(index, items, slop=1).collect()}
    assert {(1, False), (2, True)} <= near
    assert 3 not in {x for x, _ in near}


@pytest.mark.parametrize("slop", [0, 1, 2])
@pytest.mark.parametrize("block_bytes", [4 << 20, 40])
def test_proximity_equals_brute_force(spark, slop, block_bytes):
    import random

    r = random.Random(slop)
    docs = [(k, " ".join(r.choice("a b c d e f".split()) for _ in range(r.randint(0, 25)))) for k in range(60)]
    items = [(k, " ".join(r.choice("a b c d e f".split()) for _ in range(r.randint(1, 7)))) for k in range(20)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id, x.start) for x in d.matches(d.build_index(frame, block_bytes), bench, 4, slop, part_words=9).collect()}
    assert found == brute_near(docs, items, slop, 4)
    for x in d.contamination(frame, bench, 4, 9, slop).collect():
        own = {i for k, i, _ in found if k == x.doc_id}
        assert (x.n_near_items, x.near_items_sha256) == (len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest())


def test_a_very_long_text_and_a_long_item(spark):
    words_ = [f"w{k % 9973}x{k % 31}" for k in range(300_000)]
    docs = spark.createDataFrame([(1, " ".join(words_)), (2, "w1x1")], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(words_[1000:61_000])), (6, "w1x1 w2x2 nothing")], "item_id long, text string")
    found = {r.doc_id: r for r in d.contamination(docs, items, part_words=5000).collect()}
    assert found[1].n_hit >= 60_000 and found[1].items == ["5"] and not found[2].contaminated


def test_filter_keeps_columns_and_clean_rows(docs, benchmark, rows):
    kept = d.without_contaminated(docs, benchmark[0])
    assert kept.columns == docs.columns
    clean = sorted((r[0] for r in brute([(r[0], r[1]) for r in rows], benchmark[1]) if not r[5]), key=repr)
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr) == clean


def test_rows_without_an_id_or_with_a_repeated_one_are_judged_by_their_text(spark):
    phrase = " ".join(f"q{k}" for k in range(12))
    docs = spark.createDataFrame([(None, phrase), (None, "clean text"), (1, f"x {phrase}"), (1, "other clean text"), (2, None)], "doc_id long, text string")
    kept = d.without_contaminated(docs, spark.createDataFrame([(1, phrase)], "item_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [(1, "other clean text"), (2, None), (None, "clean text")]
