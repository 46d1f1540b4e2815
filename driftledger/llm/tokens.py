"""Exact byte-pair encoding with the tokenizers library, each distinct chunk of text encoded once per worker."""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: Fixed value: the Unicode White_Space characters, which the byte-level splitter treats as space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Boundaries that no token of the byte-level splitter crosses, in any text.
_CHUNK = re.compile(f"[{_SPACE}]+(?![^{_SPACE}])| ?[^{_SPACE}]+|[{_SPACE}]+")
#: The letters, numbers and white space of the first 256 characters, and the splitter's own words of these.
_LETTER, _NUMBER, _BLANK = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_WORD = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def _narrow(text: str) -> bool:
    """Whether every character is among the first 256, for which the splitter's own words are known."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _split(text: str) -> list[str]:
    """The splitter's own words; where a chunk has other characters than the first 256, that chunk whole."""
    if _narrow(text):
        return _WORD.findall(text)
    out = []
    for chunk in _CHUNK.findall(text):
        if _narrow(chunk):
            out += _WORD.findall(chunk)
        else:
            out.append(chunk)
    return out


def _holes(ids: list[bytes | None]) -> list[int]:
    """Where the list has None."""
    out, at = [], -1
    try:
        while True:
            at = ids.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


class Encoder:
    """Ids of whole texts, as little-endian integers of the narrowest type that holds the vocabulary.

    A byte-level splitter joins nothing across the boundaries of _split(), so ids are cached by chunk. New words of a
    batch go to the bare model in one text, with line feeds between them; chunks that may hold several words go to the
    whole library, which splits them, and so do whole texts that hold a special token, which the library cuts out first.
    Other tokenizers are called plainly. The cache is emptied when it holds ``cache_entries`` chunks, about 200 bytes each.
    """

    def __init__(self, path: str, cache_entries: int = 1_200_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.cache_entries = cache_entries
        self.cache: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        self.chunked = (
            spec.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space", True)
            and all(t.get("special") for t in spec.get("added_tokens", []))
            and spec["model"].get("type", "BPE") == "BPE"
            and not any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        )
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or "(?!)")
        if self.chunked:
            (self.line_feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
            # The same model for words that are split already: their bytes as the vocabulary's characters, cut at line feeds.
            by_byte = {b: c for c, b in byte_alphabet().items()}
            self.alphabet = "".join(by_byte[b] for b in range(256))
            model = spec["model"]
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            self.words = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))
            self.words.pre_tokenizer = pre_tokenizers.Split(by_byte[10], "isolated")

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _learn(self, chunks: list[str]) -> None:
        words, whole = [], []
        for c in chunks:
            (whole if c.isspace() or not _narrow(c) else words).append(c)
        if whole:
            self.cache.update(zip(whole, self._plain(whole), strict=True))
        width = self.dtype.itemsize
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            text = "\n".join(part).encode().decode("latin-1").translate(self.alphabet)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(ids == self.line_feed)
            if len(ends) != len(part) - 1:
                self.cache.update(zip(part, self._plain(part), strict=True))
                continue
            raw = ids.tobytes()
            begin, end = [0, *((ends + 1) * width).tolist()], [*(ends * width).tolist(), len(raw)]
            self.cache.update(zip(part, [raw[a:b] for a, b in zip(begin, end, strict=True)], strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null is an empty text."""
        texts = [t or "" for t in texts]
        if not self.chunked:
            return self._plain(texts)
        whole = [k for k, t in enumerate(texts) if self.special.search(t)]
        out = self._by_chunk(["" if self.special.search(t) else t for t in texts] if whole else texts)
        for k, ids in zip(whole, self._plain([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out

    def _by_chunk(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 64):
            if len(self.cache) > self.cache_entries:
                self.cache.clear()
            get, holes, missing = self.cache.get, [], set()
            split = [_split(t) for t in texts[at : at + 64]]
            found = [list(map(get, chunks)) for chunks in split]
            for chunks, ids in zip(split, found, strict=True):
                if empty := _holes(ids):
                    holes.append((chunks, ids, empty))
                    missing.update([chunks[i] for i in empty])
            if missing:
                self._learn(list(missing))
                for chunks, ids, empty in holes:
                    for i in empty:
                        ids[i] = get(chunks[i])
            out += map(b"".join, found)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, cache_entries: int = 1_200_000) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    return Encoder(path, cache_entries)
