import random
import time

import numpy as np

import corpus_pipeline
from driftledger.llm import similar

from .test_simhash import union


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_groups(rows):
    sets = brute_sets([t for _, t in rows])
    near = lambda a, b: 9 * len(a & b) >= 4 * (len(a) + len(b))
    return union([(i, j) for i in range(len(sets)) for j in range(i) if near(sets[i], sets[j])], range(len(sets)))


def test_every_pair_of_similarity_is_found(spark, monkeypatch):
    monkeypatch.setattr(similar, "OFTEN", 3)
    r = random.Random(4)
    word = lambda: "w%d" % r.randrange(5000)
    licence, rows = " ".join(word() for _ in range(40)), []
    for _ in range(40):
        words = [word() for _ in range(r.randint(3, 150))]
        for _ in range(r.randint(1, 5)):
            words = list(words)
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = word()
            rows.append((len(rows), " ".join(words) + (" " + licence if r.random() < 0.3 else "")))
    rows += [(len(rows), None), (len(rows) + 1, " "), (len(rows) + 2, "one")]
    group = brute_groups(rows)
    found = {x.doc_id: x.component_id for x in similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found == group and len(set(group.values())) < len(rows) - 20


def test_stage_drops_a_copy_with_few_edited_words(spark):
    r = random.Random(5)
    words = ["w%d" % r.randrange(9000) for _ in range(400)]
    rows = [(1, " ".join(words))]
    for k in range(2, 12):
        for at in r.sample(range(400), 3):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    rows.append((99, " ".join("v%d" % r.randrange(9000) for _ in range(400))))
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(x.doc_id for x in kept.collect()) == [1, 99]


def edited(seed, groups, most, words=60):
    """Texts in groups of some, of which each has a few other words than the one before."""
    r, rows = random.Random(seed), []
    for _ in range(groups):
        text = ["w%d" % r.randrange(9000) for _ in range(words)]
        for _ in range(r.randint(2, most)):
            text = list(text)
            text[r.randrange(words)] = "w%d" % r.randrange(9000)
            rows.append((len(rows), " ".join(text)))
    return rows


def test_many_pairs_are_checked_in_parts_and_without_broadcast(spark, monkeypatch):
    rows, staged, made = edited(6, 12, 12), similar.staged, []
    monkeypatch.setattr(similar, "LEAST_ROOM", 64)
    monkeypatch.setattr(similar, "BROADCAST", 0)
    monkeypatch.setattr(similar, "staged", lambda df, label: made.append(label) or staged(df, label))
    found = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {x.doc_id: x.component_id for x in found.collect()} == brute_groups(rows)
    assert made.count("links") > made.count("pairs") > 2


def test_shuffle_files_of_finished_queries_are_removed(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles
    shuffles = lambda: {f.getName() for f in map(files().apply, range(files().length())) if f.getName().startswith("shuffle_")}
    docs = spark.createDataFrame(edited(7, 5, 3), "doc_id long, text string").repartition(3)
    held = shuffles()
    similar.similar_documents(docs)
    for _ in range(50):
        if not (left := shuffles() - held):
            break
        time.sleep(0.2)
    assert sum(name.endswith(".data") for name in left) == 0 and spark.conf.get(key) == "false"
    spark.conf.set(key, before)


def test_links_of_widely_held_shingles_that_no_hub_joins_are_found(spark, monkeypatch):
    r, rows = random.Random(8), []
    template = ["w%d" % r.randrange(9000) for _ in range(60)]
    for at in r.sample(range(5, 55), 30):  # each lacks one word of the template; those that lack neighbours are alike
        rows.append((len(rows), " ".join([*template[:at], "x%d" % len(rows), *template[at + 1 :]])))
    group = brute_groups(rows)
    assert 1 < len(set(group.values())) < len(rows) // 2
    monkeypatch.setattr(similar, "FEW", 1)
    monkeypatch.setattr(similar, "MORE", 10)  # the rounds end after the first
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block, room in ((1024, similar.LEAST_ROOM), (4, 256)):
        monkeypatch.setattr(similar, "BLOCK", block, raising=False)
        monkeypatch.setattr(similar, "LEAST_ROOM", room)
        assert {x.doc_id: x.component_id for x in similar.similar_documents(docs).collect()} == group


def test_sets_that_are_nearly_alike_are_told_apart_where_they_meet(spark, monkeypatch):
    r, rows, staged, made = random.Random(9), [], similar.staged, []
    template = ["w%d" % r.randrange(9000) for _ in range(200)]
    for k in range(150):
        text = list(template)
        for at in r.sample(range(5, 195), 1 + k % 5):
            text[at] = "x%dy%d" % (k, at)
        rows.append((k, " ".join(text)))
    monkeypatch.setattr(similar, "staged", lambda df, label: (out := staged(df, label), made.append((label, out.count())))[0])
    monkeypatch.setattr(similar, "MORE", 10)  # the rounds end after the first
    found = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    group = brute_groups(rows)
    assert {x.doc_id: x.component_id for x in found.collect()} == group and len(set(group.values())) > 20
    # Of 11175 pairs the last search made 8690 for 822 links before sketches were compared, and then 964.
    pairs, links = ([n for label, n in made if label == kind][-1] for kind in ("pairs", "links"))
    assert pairs < 2 * links


def test_sketches_differ_in_no_more_bits_than_sets_in_members():
    r = np.random.default_rng(10)
    for n in (0, 1, 5, 40, 400, 5000):
        for differ in (0, 1, 3, 50):
            a = r.integers(-(1 << 63), (1 << 63) - 1, n)
            b = np.concatenate([a[differ:], r.integers(-(1 << 63), (1 << 63) - 1, differ)])
            bits = np.unpackbits((similar.sketch(a) ^ similar.sketch(b)).view(np.uint8)).sum()
            assert bits <= len(set(a.tolist()) ^ set(b.tolist())) and (bits > 0 or not differ or n == 5000)
            assert len(similar.sketch(a)) == similar.SKETCH
