import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftledger.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = Encoder(PATH, cache_entries=50)


def ids(raw: bytes) -> list[int]:
    import numpy as np

    return np.frombuffer(raw, OURS.dtype).tolist()


PIECES = ["'s", "'ll", " 'tis", ")'", "\u2019s ", "\u0416 f'stuff", "\u4e2d\u6587 ", "<|endoftext|>", "<|endoftext", "\u3000", "\n\n", " don't", "\u201cwe've\u201d", "\u0441\u043b\u043e\u0432\u043e'd", "\U0001f600'm", "  ", "12'3"]
ALPHABET = st.sampled_from(list("aZé ²1'strevlmd\n\t\r\x0b\x1c\x85\xa0  ​œß中-_.,!<|>\U0001f600"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(ALPHABET, max_size=40), st.text(max_size=30)), max_size=4))
def test_equals_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [ids(x) for x in OURS.encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("text", ["it's 'S we'll  can't\n\n x", "<|endoftext|> end", "a   b\t\tc \n d ", "x" * 5000, "%%%'s ''s"])
def test_known_texts(text):
    assert ids(OURS.encode([text])[0]) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_null_is_empty_and_word_tokenizer_is_plain():
    assert OURS.encode([None, ""]) == [b"", b""]
    other = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.chunked
    import numpy as np

    assert np.frombuffer(other.encode(["Hello World"])[0], other.dtype).tolist() == other.tokenizer.encode("Hello World", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["\u4e2d )'s 'tis", "\u4e2d [x]'s -'t 'single", "he\u2019s 's \u201cit's\u201d's a\u2014b's", "\U0001f600's)'ll \u4e2d\u6587'd12ab", "\u3000 'tis\u3000\u3000)'s \n\n 'tis", "\u0153's 'tis\xa0\xa0x \x85\u2028 a"])
def test_words_beside_wider_characters(text):
    assert ids(OURS.encode([text])[0]) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_mixed_scripts_quotes_and_special_tokens_by_the_thousand():
    import random

    r = random.Random(11)
    texts = ["".join(r.choice(PIECES) if r.random() < 0.5 else r.choice("ab '\u0416\u4e2d-.1\xe9 \t") for _ in range(r.randint(1, 14))) for _ in range(20_000)]
    assert [ids(x) for x in OURS.encode(texts)] == [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]
