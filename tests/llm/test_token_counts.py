from hypothesis import given, settings
from hypothesis import strategies as st

from driftledger.llm.token_counts import Automaton, byte_level, token_counts, word_pieces


def greedy(word: bytes, initial: set[bytes], continuing: set[bytes]) -> int:
    n, pieces = 0, initial
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not k:
            return 1
        word, n, pieces = word[k:], n + 1, continuing
    return n


PIECES = st.sets(st.text("abc", min_size=1, max_size=4).map(str.encode), max_size=12)


@settings(max_examples=500, deadline=None)
@given(PIECES, PIECES, st.lists(st.text("abcd", max_size=14).map(str.encode), max_size=20))
def test_equals_greedy_longest_match(initial, continuing, words):
    two, one = Automaton(initial, continuing), Automaton(initial)
    for w in words:
        assert two.count(w) == greedy(w, initial, continuing)
        assert one.count(w) == greedy(w, initial, initial)


def test_marked_pieces():
    a = word_pieces(("un", "##aff", "##able", "##a", "##ff", "abc"))
    assert [a.count(w) for w in (b"unaffable", b"unx", b"abc", b"", b"affable")] == [3, 1, 1, 0, 1]


def test_documents(docs, rows, empty, tokenizer):
    a = byte_level(tokenizer[0])
    found = sorted(((r.doc_id, r.n_words, r.n_pieces) for r in token_counts(docs, tokenizer[0]).collect()), key=repr)
    want = [(r[0], len((r[1] or "").encode().split()), sum(a.count(b" " + w) for w in (r[1] or "").encode().split())) for r in rows]
    assert found == sorted(want, key=repr)
    assert token_counts(empty, tokenizer[0]).count() == 0
    assert token_counts(docs, pieces=("the", "##ing")).count() == len(rows)


def test_the_query_equals_greedy_matching_over_the_vocabulary(spark, tokenizer):
    """Whole texts against a plain search for the longest piece, piece after piece."""
    import json
    from functools import lru_cache

    from driftledger.llm import queries
    from driftledger.llm.tokens import byte_alphabet

    with open(tokenizer[0], encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    table = byte_alphabet()
    pieces = {bytes(table[c] for c in p) for p in vocabulary if all(c in table for c in p)}
    longest, n_of = max(map(len, pieces)), lru_cache(None)(lambda w: plain(w))

    def plain(word):
        n = 0
        while word:
            k = next(k for k in range(min(len(word), longest), 0, -1) if word[:k] in pieces)
            word, n = word[k:], n + 1
        return n

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in queries.table(spark, folder, "documents").collect()}
    for r in queries.op9_token_counts(spark, folder).collect():
        words = (texts[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_pieces) == (len(words), sum(n_of(b" " + w) for w in words))


def test_a_very_long_text_and_a_very_long_word(spark, tokenizer):
    text = "word " * 500_000 + "x" * 1_000_000
    (r,) = token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer[0]).collect()
    assert r.n_words == 500_001 and r.n_pieces > 500_001
