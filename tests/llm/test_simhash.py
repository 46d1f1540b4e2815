import random

import numpy as np
import pytest
import xxhash

from driftledger.llm import similar, simhash
from driftledger.llm.components import connected_components


def brute_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_equals_brute_force(docs, rows, empty):
    found = simhash.near_duplicates(docs).collect()
    prints = [(r[0], brute_print(r[1])) for r in rows]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i][1] ^ prints[j][1]).bit_count() <= 2]
    group = union(pairs, range(len(prints)))
    least = {}
    for k, (d, _) in enumerate(prints):
        if d is not None:
            least[group[k]] = min(least.get(group[k], d), d)
    want = sorted(((d, f, least.get(group[k])) for k, (d, f) in enumerate(prints)), key=repr)
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found), key=repr) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_keep_every_pair_connected(spark, distance):
    r = random.Random(distance)
    prints = []
    for _ in range(40):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            prints.append(f)
            for _ in range(r.randint(1, 4)):
                f ^= 1 << r.randrange(64)
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance)
    got = union([(e.u % (1 << 64), e.v % (1 << 64)) for e in edges.collect()], prints)
    want = union([(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= distance], prints)
    assert got == want


def test_components_of_long_chains(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000 + k, 1000 + (k * 7 + 1) % 50) for k in range(50)]
    found = {r.node: r.label for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == union(chain, {x for e in chain for x in e})
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each(docs, rows):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    prints = [brute_print(r[1]) for r in rows]
    group = union([(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2], range(len(rows)))
    first = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        first.setdefault(group[k], rows[k][0])
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr) == sorted(first.values(), key=repr)


def test_one_of_each_goes_by_texts_where_ids_are_missing_or_repeat(spark):
    r = random.Random(9)
    text = lambda: " ".join("w%d" % r.randrange(9000) for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a, "x", 1), (1, b, "y", 2), (None, a, "z", 3), (None, c, "x", 4), (None, c, "x", 5), (2, d, "p", 6), (2, d, "p", 7), (3, d, "q", 8), (None, None, None, None), (4, "", "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key_0 string, first_of int").repartition(3)
    for one_of_each in (simhash.one_of_each, similar.one_of_each_similar):
        kept = one_of_each(docs)
        found = sorted(((x.doc_id, x.text) for x in kept.collect()), key=repr)
        assert kept.columns == docs.columns and found == sorted([(1, a), (1, b), (None, c), (2, d), (4, "")], key=repr)


def test_a_very_long_text(spark):
    text = " ".join(f"w{k * 7919 % 100_003}" for k in range(200_000))
    rows = [(1, text), (2, text.replace("w5 ", "x5 ")), (3, "short")]
    found = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    w = text.split()
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(len(w) - 2)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))
    assert found[1].fp % (1 << 64) == want and found[3].component_id == 3
    kept = similar.one_of_each_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
