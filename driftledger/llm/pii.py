"""Personal data: generators propose spans, boosted trees judge those that a pattern alone does not settle.

Spans of the four base kinds always count. Other generators are broad and overlap: each of their candidates is judged by
its form and by the words around it, and counts if its calibrated probability reaches the limit of its kind. The trees
are fitted on examples written here from templates, as the corpus has no labels for personal data.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .storage import bounded_batches

#: The base kinds, in the order in which spans of one start are listed, then the kinds that trees judge.
BASE = ("email", "ip", "card", "phone")
JUDGED = ("local_phone", "national_id", "bank_account", "written_email", "loose_card")
KINDS = BASE + JUDGED
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match from inside a number would have begun before
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "local_phone": re.compile(r"(?<![0-9A-Za-z+.-])(?:\(?0?[0-9]{2,4}\)?[ ./-]{1,2})[0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9A-Za-z-])"),
    "national_id": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z-])"),
    "bank_account": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "written_email": re.compile(r"(?<![\w.])[A-Za-z0-9._-]{2,40} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,40} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}(?!\w)"),
    "loose_card": re.compile(r"(?<![0-9A-Za-z.-])[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}(?![0-9A-Za-z-])"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base kinds, in code points, end exclusive, sorted."""
    out = []
    floor = 0
    for m in _DOMAIN.finditer(text):  # the local part is the longest run before the sign, behind the last match
        start = at = m.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, 0, m.end()))
            floor = m.end()
    for m in _IP.finditer(text):
        if all(map(_at_most_255, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """All proposals of the broad generators, overlapping ones too."""
    return [(m.start(), KINDS.index(kind), m.end()) for kind, pattern in _LOOSE.items() for m in pattern.finditer(text)]


_HINTS = (
    r"phone|tel\b|tel[.:]|call|fax|mobile|cell|whatsapp|sms|dial",
    r"ssn|social|national id|tax id|passport|insured|identity",
    r"iban|bank|account|transfer|swift|bic",
    r"mail|contact|write|reach|address",
    r"card|visa|master|credit|debit|expir|cvv",
    r"order|invoice|item|part|serial|isbn|issn|version|release|build|ticket|case|ref\b|page|chapter|table|figure|model|sku",
    r"total|price|sum|amount|eur|usd|score|points|year|date|since|between|from",
)
_HINT = tuple(re.compile(h, re.I) for h in _HINTS)


def iban_ok(span: str) -> bool:
    s = span.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def describe(text: str, start: int, kind: int, end: int) -> list[float]:
    """Form and context of a candidate."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    digits = [c for c in span if c.isdigit()]
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    number = "".join(digits)
    return [
        *(float(kind == KINDS.index(k)) for k in JUDGED),
        len(span), len(digits), sum(c.isalpha() for c in span), len(groups), max(groups), min(groups), groups[0], groups[-1],
        float(luhn(number)) if number.isascii() and number else 0.0, float(kind == KINDS.index("bank_account") and iban_ok(span)),
        float("(" in span), float("-" in span), float(" " in span), float("." in span), float("/" in span), float(span.startswith("0") or "(0" in span),
        len(set(digits)), float(span[:3] in ("000", "666") or span[:1] == "9"), float(number[:1] in ("3", "4", "5", "6")),
        *(float(bool(h.search(before))) for h in _HINT), float(bool(_HINT[0].search(after) or _HINT[5].search(after))),
        float(before.rstrip()[-1:] in ("#", "$", "€", "=")), float(before.rstrip()[-1:] == ":"), float(bool(re.search(r"[0-9][ ,;]*$", before))), float(bool(re.match(r"[ ,;]*[0-9%€$]", after))),
    ]


def _examples(n: int, seed: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(text, start, kind, end, label): what the generators propose in texts written from templates."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("ta", "re", "mon", "li", "der", "sa", "que", "ing", "on")) for _ in range(r.randint(1, 3)))
    words = lambda k: " ".join(word() for _ in range(k))

    def iban() -> str:
        body = d(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE" + "00")) % 97
        s = f"DE{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    def card() -> str:
        s = r.choice("3456") + d(14)
        s += next(c for c in "0123456789" if luhn(s + c))
        return r.choice((" ", "-")).join(s[i : i + 4] for i in range(0, 16, 4))

    phone = lambda: r.choice((f"({d(3)}) {r.randint(200, 999)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"{r.randint(201, 989)}-{r.randint(200, 999)}-{d(4)}", f"{r.randint(201, 989)}.{d(3)}.{d(4)}"))
    ssn = lambda: f"{r.randint(100, 665)}-{d(2)}-{d(4)}"
    mail = lambda: f"{word()}.{word()} {r.choice(('at', '(at)', '[at]'))} {word()} {r.choice(('dot', '(dot)', '[dot]'))} {r.choice(('com', 'org', 'net', 'de'))}"
    good = (
        (phone, ("phone", "tel:", "call me at", "fax", "mobile", "reach us on", "contact", "")),
        (ssn, ("SSN", "social security number", "tax id", "insured no.", "")),
        (iban, ("IBAN", "bank account", "transfer to", "account:", "")),
        (mail, ("mail", "contact", "write to", "e-mail:", "")),
        (card, ("card", "visa", "credit card no.", "paid with", "")),
    )
    bad = (
        (lambda: f"{d(3)}-{d(4)}-{d(4)}", ("order", "part", "serial", "invoice", "ref", "ISBN", "model", "ticket")),
        (lambda: f"{d(3)} {d(3)} {d(4)}", ("total", "table", "figure", "points", "amount", "between", "sku", "version")),
        (lambda: f"{d(3)}-{d(2)}-{d(4)}", ("part", "order", "model", "serial", "sku", "release", "page", "000-")),
        (lambda: f"{r.choice(('AB', 'XZ', 'QK'))}{d(2)} {d(4)} {d(4)} {d(4)}", ("order", "serial", "part", "model", "")),
        (lambda: f"{word()} at {word()} dot {word()}", ("the point", "look", "we met", "one")),
        (lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", ("serial", "key", "order", "licence", "ref", "build")),
        (lambda: f"{d(4)} {d(4)} {d(4)} {d(2)}", ("table", "sum", "score", "from", "year")),
        (lambda: f"{r.randint(1900, 2030)}-{d(4)}-{d(3)}", ("since", "year", "date", "chapter", "case")),
    )
    for _ in range(n):
        label = r.random() < 0.5
        make, hints = r.choice(good if label else bad)
        thing, hint = make(), r.choice(hints)
        head = f"{words(r.randint(1, 5))} {hint}{r.choice((' ', ': ', ' '))}"
        text = f"{head}{thing}{r.choice((' ', '. ', ', '))}{words(r.randint(1, 4))}"
        for start, kind, end in candidates(text):
            if start < len(head) + len(thing) and end > len(head):
                yield text, start, kind, end, int(label)


class Intervals:
    """What is covered of a text, as disjoint intervals in order; each question is one search."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at == len(self.starts) or self.starts[at] >= end

    def cover(self, start: int, end: int) -> None:
        """Add an interval; those that it overlaps become one with it."""
        a, b = bisect_right(self.ends, start), bisect_left(self.starts, end)
        if a < b:
            start, end = min(start, self.starts[a]), max(end, self.ends[b - 1])
        self.starts[a:b], self.ends[a:b] = [start], [end]


@dataclass(frozen=True)
class Judge:
    trees: Trees
    limits: tuple[float, ...]  # of each judged kind

    def select(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Base spans and the candidates that pass, none of which overlaps a base span or a likelier candidate."""
        found = candidates(text)
        if not found:
            return base
        p = np.concatenate([self.trees.probability(np.array([describe(text, *c) for c in found[a : a + 4096]], np.float64)) for a in range(0, len(found), 4096)])
        out, taken = list(base), Intervals()
        for start, _, end in base:
            taken.cover(start, end)
        for k in sorted(range(len(found)), key=lambda k: (-p[k], found[k])):
            start, kind, end = found[k]
            if p[k] >= self.limits[kind - len(BASE)] and taken.free(start, end):
                taken.cover(start, end)
                out.append((start, kind, end))
        return sorted(out)


@functools.lru_cache(maxsize=1)
def trained(n: int = 3000, seed: int = 5, precision: float = 0.98) -> Judge:
    """Fit, calibrate and set limits, each on examples of its own: the lowest limit with that precision, 0.5 at least."""
    sets = []
    for part in range(3):
        rows = list(_examples(n, seed + part))
        sets.append((np.array([describe(t, s, k, e) for t, s, k, e, _ in rows], np.float64), np.array([y for *_, y in rows], np.float64), np.array([k for _, _, k, _, _ in rows])))
    (x, y, _), (cx, cy, _), (vx, vy, vk) = sets
    trees = fit(x, y)
    trees.calibrate(cx, cy)
    p, limits = trees.probability(vx), []
    for kind in JUDGED:
        own = vk == KINDS.index(kind)
        passing = [t for t in np.unique(p[own]) if t >= 0.5 and vy[own & (p >= t)].mean() >= precision]
        limits.append(float(min(passing, default=1.01)))
    return Judge(trees, tuple(limits))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan_rows(judge: Judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, digest, spans = [], [], []
                for text in part.column(1).to_pylist():
                    base = base_spans(text or "")
                    counts.append([sum(k == n for _, k, _ in base) for n in range(len(BASE))])
                    digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
                    spans.append(listed(judge.select(text or "", base)))
                columns = [part.column(0), *(pa.array([c[n] for c in counts], pa.int64()) for n in range(len(BASE))), pa.array(digest), pa.array(spans)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each whole text.

    Null texts are empty, and empty texts have no spans. Copies and repeated rows are read each for itself; no documents
    give no rows; extra columns are not read.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan_rows(judge or trained()), schema)


def redacted(text: str, judge: Judge) -> str:
    """The text with a mark of the kind for each span; spans of the base kinds that overlap become one mark."""
    out, last = [], 0
    for start, kind, end in judge.select(text, base_spans(text)):
        if end <= last:
            continue
        if start >= last:
            out += [text[last:start], f"[{KINDS[kind].upper()}]"]
        last = end
    return "".join([*out, text[last:]])


def _redact_rows(judge: Judge, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [t if t is None else redacted(t, judge) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(part.columns)], part.schema.names)

    return run


def redact(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """The same rows and columns, personal data in ``text`` replaced by marks; null texts stay null."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_redact_rows(judge or trained(), docs.columns.index("text")), docs.schema)
