import re
from collections import Counter

import numpy as np
import pytest

from driftledger.llm import quality_cnn as cnn
from driftledger.llm import quality_rules as rules


def brute(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_counts(docs, rows, empty):
    judged = rules.judge(docs)
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged.collect()), key=repr)
    assert found == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert judged.where("base_failed and kept").count() == 0
    assert rules.judge(empty).count() == 0
    plan = rules.features(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_accuracies_are_recovered():
    r = np.random.default_rng(1)
    good, bad = (0.97, 0.95, 0.99), (0.7, 0.4, 0.6)
    patterns = Counter()
    for _ in range(20000):
        y = r.random() < 0.85
        patterns["".join("+" if (r.random() < (g if y else 1 - b)) else "-" for g, b in zip(good, bad, strict=True))] += 1
    model = rules.expectation_maximisation(dict(patterns), strength=0.001)
    assert np.allclose(model.good, good, atol=0.04) and np.allclose(model.bad, bad, atol=0.12)


def test_votes_on_real_labels(spark):
    folder = "/root/testdata/sf0.01"
    found = rules.judge(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed")
    assert found.where("kept = (quality = 1)").count() >= 0.97 * found.count()


def test_chunks_cover_every_byte():
    net = cnn.Network()
    r = np.random.default_rng(0)
    for n in (0, 1, 5, 511, 512, 513, 960, 961, 5000):
        text = r.integers(0, 256, n).astype(np.uint8).tobytes()
        block, owner = cnn.chunks([text, b"next"], net)
        hop = net.chunk - net.overlap
        own = block[owner == 0]
        out = np.full(len(own) * hop + net.chunk + net.width, cnn.PAD)
        for k, row in enumerate(own):
            out[k * hop : k * hop + len(row)] = row
        assert out[:n].astype(np.uint8).tobytes() == text and (out[n:] == cnn.PAD).all()


def test_gradients_equal_differences():
    net = cnn.Network(width=3, filters=4, embedding=3, chunk=16, overlap=4).start(1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    net.weights["out"] = np.random.default_rng(2).normal(size=8)
    texts, y = [b"hello world, this is some text", b"!!! $$$ abc", b""], np.array([1.0, 0.0, 1.0])
    block, owner = cnn.chunks(texts, net)

    def loss():
        pool = cnn.pooled(block, np.einsum("be,kef->kbf", net.weights["embed"], net.weights["conv"]), net.weights["bias"], net.chunk)
        p = 1 / (1 + np.exp(-(cnn.combined(pool, owner, 3) @ net.weights["out"] + net.weights["c"][0])))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    net.tables = lambda: np.einsum("be,kef->kbf", net.weights["embed"], net.weights["conv"])
    found = cnn.gradients(net, block, owner, y)
    for name, at in (("conv", (1, 2, 3)), ("conv", (0, 0, 0)), ("out", (1,)), ("out", (6,)), ("c", (0,)), ("embed", (ord("l"), 1)), ("embed", (ord("$"), 0))):
        w, e = net.weights[name], 1e-6
        w[at] += e
        up = loss()
        w[at] -= 2 * e
        down = loss()
        w[at] += e
        assert found[name][at] == pytest.approx((up - down) / (2 * e), abs=1e-5), name


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = cnn.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() >= 0.93
    assert found[found.quality == 1].predicted.mean() >= 0.97


def test_edge_cases(docs, empty, spark, rows):
    labels = spark.createDataFrame([(5, 1), (12, 0), (None, 1), (7, None), (9, 1)], "doc_id long, quality int")
    found = cnn.classify(docs, labels, sample=10)
    assert found.count() == len(rows) and found.where("score is null or score < 0 or score > 1").count() == 0
    assert cnn.classify(empty, labels).count() == 0
    assert cnn.classify(docs, labels.limit(0)).where("predicted = 1").count() == len(rows)
    kept = cnn.score(docs, cnn.Network().start(), docs.columns, "__score")
    assert kept.columns == [*docs.columns, "__score"]


def plain_score(text, net):
    """The forward pass written out: every filter at every place of every chunk."""
    w, hop, reach = {k: v.astype(np.float64) for k, v in net.weights.items()}, net.chunk - net.overlap, net.chunk + net.width - 1
    n, pools = max(1, -(-(len(text) - net.overlap) // hop)), []
    for k in range(n):
        piece = [*text[k * hop : k * hop + reach]]
        piece += [cnn.PAD] * (reach - len(piece))
        embedded = w["embed"][piece]
        answers = [sum(embedded[p + j] @ w["conv"][j] for j in range(net.width)) + w["bias"] for p in range(net.chunk)]
        pools.append(np.maximum(np.max(answers, axis=0), 0))
    z = np.concatenate([np.max(pools, axis=0), np.mean(pools, axis=0)]) @ w["out"] + w["c"][0]
    return 1 / (1 + np.exp(-z))


def test_scores_equal_a_plain_forward_pass():
    net = cnn.Network().start(3)
    net.weights["out"] = np.random.default_rng(2).normal(size=2 * net.filters).astype(np.float32)
    texts = [b"", b"x", "中文 and é".encode(), b"word " * 300, bytes(range(256)) * 9, b"a" * 1000]
    want = [plain_score(t, net) for t in texts]
    for most in (1, 3, 4096):
        assert cnn.probability(texts, net, net.tables(), most=most) == pytest.approx(want, abs=1e-5)


def test_long_texts_take_bounded_memory():
    import tracemalloc

    net = cnn.Network().start(3)
    text = b"some words of a very long text. " * 300_000
    tracemalloc.start()
    (p,) = cnn.probability([text], net, net.tables())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= p <= 1 and peak < 100e6


def test_chunks_are_drawn_from_the_whole_text():
    net, text = cnn.Network(), bytes(k // 1000 % 256 for k in range(200_000))
    drawn = cnn.draw(text, net, 32, 5)
    places = [text.index(d) // 448 for d in drawn]
    assert len(drawn) == len(set(drawn)) == 32 and min(places) < 60 and max(places) > 380
    assert b"".join(cnn.draw(b"short", net, 32, 5)) == b"short"


def test_a_repeated_doc_id_teaches_once(spark):
    labels = spark.createDataFrame([(5, 1), (5, 0), (12, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame([(5, "b " * 50), (5, "a " * 50), (12, "% " * 50)] * 20, "doc_id long, text string")
    one, two = (cnn.train(docs.repartition(n), labels, sample=10) for n in (1, 5))
    assert all((one.weights[k] == two.weights[k]).all() for k in one.weights)


def test_verdicts_equal_a_plain_model(docs, rows):
    """Votes and probability of op8 by a plain version of the rules and of expectation-maximisation."""
    import math

    def plain_votes(text):
        n, chars, symbols, dups, repeats, _ = brute(text)
        t = text or ""
        upper, letters, bang, lines = sum("A" <= c <= "Z" for c in t), sum(c > "\x7f" or "A" <= c <= "Z" or "a" <= c <= "z" for c in t), t.count("!"), t.count("\n") + 1
        pairs = [
            (n >= 50, n < 20), (20 * repeats < n, 100 * repeats > 30 * n), (dups == 0, 10 * dups > 3 * lines), (50 * symbols < n, 10 * symbols > n),
            (200 * symbols < chars, 50 * symbols > chars), (100 * letters > 92 * chars, 100 * letters < 85 * chars),
            (3 * n <= chars <= 9 * n, chars < 2 * n or chars > 14 * n), (5 * upper < letters, 2 * upper > letters), (50 * bang < n, 5 * bang > n),
        ]
        return "".join("-" if bad else "+" if good else "0" for good, bad in pairs)

    votes = [plain_votes(r[1]) for r in rows]
    prior, good, bad, hold = 0.8, [0.97] * 9, [0.5] * 9, max(1.0, 0.1 * len(rows))

    def posteriors():
        out = []
        for v in votes:
            a, b = prior, 1 - prior
            for k, c in enumerate(v):
                a *= {"+": good[k], "-": 1 - good[k], "0": 1}[c]
                b *= {"+": 1 - bad[k], "-": bad[k], "0": 1}[c]
            out.append(a / (a + b))
        return out

    for _ in range(100):
        p = posteriors()
        old = [prior, *good, *bad]
        prior = (sum(p) + 0.8 * hold) / (len(p) + hold)
        for k in range(9):
            said = [(x, v[k]) for x, v in zip(p, votes, strict=True) if v[k] != "0"]
            good[k] = (sum(x for x, c in said if c == "+") + 0.97 * hold) / (sum(x for x, _ in said) + hold)
            bad[k] = (sum(1 - x for x, c in said if c == "-") + 0.5 * hold) / (sum(1 - x for x, _ in said) + hold)
        if max(abs(x - y) for x, y in zip(old, [prior, *good, *bad], strict=True)) < 1e-6:
            break
    want = sorted(((r[0], v, round(p, 6), not brute(r[1])[5] and p >= 0.5) for r, v, p in zip(rows, votes, posteriors(), strict=True)), key=repr)
    assert sorted(((x.doc_id, x.votes, round(x.probability, 6), x.kept) for x in rules.judge(docs).collect()), key=repr) == want and math.isfinite(prior)


def test_a_very_long_text_is_counted(spark):
    text = "every window of eight words here is new " + " ".join(f"w{k}" for k in range(200_000)) + "\n#line\n#line"
    (r,) = rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text)
