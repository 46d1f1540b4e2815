"""Quality rules as weak supervision: rules vote or abstain, and their accuracies are learnt without labels.

DataFrame functions only. Documents are read once, into a row of counts. The votes of all documents fold into one count
for each pattern of votes, at most three to the number of rules; expectation-maximisation runs over these patterns, and
its result is a sum of weights, one for each vote, which turns back into a column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import staged

#: White space between words, and the characters that count as symbols.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
#: A-Z, a-z and everything beyond ASCII.
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window that must not recur.
WINDOW = 8


def _count(text: Column, runs: str) -> Column:
    """Characters in all runs of a class: what goes when they are replaced by nothing, without a list of matches."""
    return F.length(text) - F.length(F.regexp_replace(text, runs, ""))


def _folded(hashes: Column, n: Column, step: int) -> Column:
    """Hashes of runs twice as long: each joined with the one ``step`` places on."""
    size = F.greatest(n - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), size), F.slice(hashes, F.lit(step + 1), size), lambda a, b: F.xxhash64(a, b))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, counts) of each whole text; a null text has no words. Windows are compared by 64-bit hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.btrim(text, F.lit(SPACE)).alias("trimmed"), F.split(text, "\n").alias("lines"))
    df = df.withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SPACES)))
    df = df.select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        _count(F.col("text"), "[A-Z]+").alias("n_upper"),
        _count(F.col("text"), LETTERS).alias("n_letters"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).alias("n_bang"),
        F.size("lines").alias("n_lines"),
        F.when(F.size(F.array_distinct("lines")) < F.size("lines"), F.filter("lines", lambda x: F.btrim(x, F.lit(SPACE)) != "")).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    n = F.col("n_words")
    df = df.withColumn("h2", _folded(F.col("h1"), n, 1)).drop("h1")
    df = df.withColumn("h4", _folded(F.col("h2"), n - 1, 2)).drop("h2")
    df = df.withColumn("h8", _folded(F.col("h4"), n - 3, 4)).drop("h4")
    repeats = F.size(F.array_distinct("h8")) < F.size("h8")
    df = df.withColumn("sorted", F.when(repeats, F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("h8")
    m = F.size("sorted")
    same = F.zip_with(F.slice("sorted", F.lit(1), m - 1), F.slice("sorted", F.lit(2), m - 1), lambda a, b: a["h"] == b["h"])
    df = df.withColumn("same", F.when(F.col("sorted").isNotNull(), same))
    none = F.array(F.lit(False))
    marks = F.zip_with(F.concat(none, "same"), F.concat("same", none), lambda a, b: a | b)
    kept = F.filter(F.zip_with("sorted", marks, lambda s, k: F.when(k, s["i"])), lambda i: i.isNotNull())
    df = df.withColumn("at", F.sort_array(kept)).drop("sorted", "same")
    k = F.size("at")
    steps = F.zip_with(F.slice("at", F.lit(1), k - 1), F.slice("at", F.lit(2), k - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.col("at").isNull(), 0).otherwise(F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x))
    dup = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size(F.array_distinct("lines")))
    names = ("n_words", "word_chars", "n_symbols", "n_upper", "n_letters", "n_bang", "n_lines")
    return df.select("doc_id", *(F.col(c).cast("long").alias(c) for c in names), dup.cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"))


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, bad where ``bad`` does, and else abstains."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words >= 50", "n_words < 20"),
    Rule("repetition", "20 * n_repeat_words < n_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("lines", "n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    Rule("symbols", "50 * n_symbols < n_words", "10 * n_symbols > n_words"),
    Rule("symbol_share", "200 * n_symbols < word_chars", "50 * n_symbols > word_chars"),
    Rule("letters", "100 * n_letters > 92 * word_chars", "100 * n_letters < 85 * word_chars"),
    Rule("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("capitals", "5 * n_upper < n_letters", "2 * n_upper > n_letters"),
    Rule("shouting", "50 * n_bang < n_words", "5 * n_bang > n_words"),
)


def votes(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> Column:
    """All votes as one string: + good, - bad, 0 abstains."""
    one = lambda r: F.when(F.expr(r.bad), "-").when(F.expr(r.good), "+").otherwise("0")
    return F.concat(*map(one, rules))


@dataclass(frozen=True)
class LabelModel:
    prior: float  # share of good documents
    good: tuple[float, ...]  # of each rule, probability that its vote is good on a good document
    bad: tuple[float, ...]  # and that its vote is bad on a bad one

    def weights(self) -> tuple[float, list[tuple[float, float]]]:
        """Log odds of good: at the start, and added by a good and by a bad vote of each rule."""
        logit = math.log(self.prior / (1 - self.prior))
        return logit, [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(self.good, self.bad, strict=True)]


#: What is held of a rule beforehand: it seldom votes bad on a good document, and notices half of the bad ones.
PRIOR, GOOD, BAD = 0.8, 0.97, 0.5


def expectation_maximisation(patterns: dict[str, int], rounds: int = 100, strength: float = 0.1) -> LabelModel:
    """Accuracies that explain the votes best, held to what is known beforehand as if by ``strength`` of all documents."""
    total = sum(patterns.values())
    n_rules = len(next(iter(patterns), "")) or len(RULES)
    model, hold = LabelModel(PRIOR, (GOOD,) * n_rules, (BAD,) * n_rules), max(1.0, strength * total)
    for _ in range(rounds if total else 0):
        start, w = model.weights()
        sums = [[0.0] * 4 for _ in range(n_rules)]
        share = 0.0
        for pattern, n in patterns.items():
            odds = start + sum(w[k][0] if v == "+" else w[k][1] for k, v in enumerate(pattern) if v != "0")
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            share += n * p
            for k, v in enumerate(pattern):
                if v != "0":
                    sums[k][0] += n * p
                    sums[k][1] += n * p * (v == "+")
                    sums[k][2] += n * (1 - p)
                    sums[k][3] += n * (1 - p) * (v == "-")
        next_ = LabelModel(
            (share + PRIOR * hold) / (total + hold),
            tuple((g + GOOD * hold) / (a + hold) for a, g, _, _ in sums),
            tuple((b + BAD * hold) / (a + hold) for _, _, a, b in sums),
        )
        moved = max(abs(x - y) for x, y in zip((model.prior, *model.good, *model.bad), (next_.prior, *next_.good, *next_.bad), strict=True))
        model = next_
        if moved < 1e-6:
            break
    return model


def posterior(pattern: Column, model: LabelModel) -> Column:
    """Probability that a document is good, given its votes."""
    start, weights = model.weights()
    odds = F.lit(start)
    for k, (good, bad) in enumerate(weights):
        vote = F.substring(pattern, k + 1, 1)
        odds = odds + F.when(vote == "+", good).when(vote == "-", bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """Counts, votes, quality probability and verdict of each document.

    kept is false if a base rule fails (under 20 words, or over 30 per cent of them in recurring windows), and else
    whether the probability reaches ``least``. Null texts have no words and fail. Rows that share a doc_id or a text are
    judged alike, each for itself; no documents give no rows; extra columns are not read.
    """
    counts = staged(features(docs), "quality-counts")
    voted = counts.withColumn("votes", votes(counts, rules))
    patterns = {r.votes: r["count"] for r in voted.groupBy("votes").count().collect()}  # at most 3 ** len(rules)
    model = expectation_maximisation(patterns)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = voted.withColumn("probability", posterior(F.col("votes"), model)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= least))
