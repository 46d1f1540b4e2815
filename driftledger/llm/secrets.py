"""Secret scans: patterned spans, and weak candidates that count only where complementary parts stand close by.

DataFrame functions only. A pattern's matches and the pieces between them alternate, so that running sums of their
lengths give every match its place. Parts of a credential (access identifiers, secrets, endpoints) are then joined by
interval: a document's edges lie on one line, and a range of ``scope`` places before a part's start or behind its end
says whether another part of a kind ends or starts there. Parts that overlap are no company for each other, so that a
value is never its own complement; pairs are not made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int
    least: int
    role: str
    weak: bool
    also: tuple[str, ...] = ()  # patterns that a weak candidate must hold too


def _either(words: str) -> str:
    """The pattern with each of a-z in either case."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in words)


#: The three base kinds, in the order in which spans of one start are listed, then the weak candidates.
KINDS = (
    Kind("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "secret", False),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16, "identifier", False),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32, "secret", False),
    Kind("identifier", "(" + _either("access_?key_?id|client_?id|user_?name|user|login|account") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)""", 2, 3, "identifier", True),
    Kind("opaque", r"[A-Za-z0-9+/_-]{20,}", 0, 20, "secret", True, ("[0-9]", "[A-Z]", "[a-z]")),
    Kind("endpoint", r"""(https?|ftp|ssh|jdbc|postgres(ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+""", 0, 12, "endpoint", True),
)
ROLES = ("identifier", "secret", "endpoint")
FIRST_WEAK = next(n for n, k in enumerate(KINDS) if k.weak)


def _matches(text: Column, number: int, kind: Kind) -> Column:
    """Every match of the pattern with the length of the piece before it; texts without a match are read once."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.when(F.size(found) > 0, F.split(text, kind.pattern))

    def valid(match: Column) -> Column:
        value = F.regexp_extract(match, kind.pattern, kind.group) if kind.group else match
        ok = F.length(value) >= kind.least
        for pattern in kind.also:
            ok = ok & match.rlike(pattern)
        return ok

    one = lambda piece, match: F.struct(F.lit(number).alias("kind"), F.length(piece).alias("gap"), F.length(match).alias("size"), valid(match).alias("ok"))
    return F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, one)


def _beside(spans: DataFrame, parts: dict[str, Column], scope: int) -> DataFrame:
    """The spans with a mark for each of ``parts``: whether such a span ends or starts within the scope, without overlap.

    Each span stands on its document's line twice, with its start (edge 0) and its end (edge 1); a marker of a document
    without spans stays as it is. A frame holds no more edges than the scope has places, whatever the text's length.
    """
    edges = spans.withColumn("edge", F.explode(F.array(F.lit(0), F.lit(1)))).where("kind is not null or edge = 0")
    edges = edges.withColumn("place", F.when(F.col("edge") == 0, F.col("start")).otherwise(F.col("end")))
    line = Window.partitionBy("row").orderBy("place")
    marks = {}
    for name, part in parts.items():
        ended, begun = (F.max(part & (F.col("edge") == e)) for e in (1, 0))
        found = F.when(F.col("edge") == 0, ended.over(line.rangeBetween(-scope, 0))).otherwise(begun.over(line.rangeBetween(0, scope)))
        marks[name] = F.coalesce(found, F.lit(False))
    return edges.withColumns(marks).groupBy(*spans.columns).agg(*(F.max(name).alias(name) for name in parts))


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """(row, doc_id, kind, start, end, weak, reported): spans in code points, end exclusive, and a null kind per document.

    Base spans are always reported. A weak identifier is reported if a secret stands within the scope, a weak secret if
    an identifier does, an endpoint if both do and each of them has its own complement; none that overlaps a base span
    is, and parts that overlap do not count for each other. Null texts are empty. A row of its own
    (null kind) stands for each document, so that those without spans remain. Repeated doc_ids stay apart by ``row``.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lists = [F.coalesce(_matches(F.col("text"), n, k), F.array().cast("array<struct<kind:int,gap:int,size:int,ok:boolean>>")) for n, k in enumerate(KINDS)]
    marker = F.array(F.struct(F.lit(None).cast("int").alias("kind"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(True).alias("ok")))
    rows = base.select("row", "doc_id", F.posexplode(F.concat(marker, *lists)).alias("at", "m")).select("row", "doc_id", "at", "m.*")

    # All of a document's rows go to one task once; the windows below and the digest reuse that.
    rows = rows.repartition("row")
    running = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("at"))
    spans = rows.withColumn("end", running).withColumn("start", F.col("end") - F.col("size")).where("ok").drop("gap", "size", "ok", "at")

    of = {role: F.col("kind").isin([n for n, k in enumerate(KINDS) if k.role == role]) for role in ROLES}
    is_weak = F.coalesce(F.col("kind") >= FIRST_WEAK, F.lit(False))
    found = _beside(spans, {"near_identifier": of["identifier"], "near_secret": of["secret"]}, scope)
    # An endpoint needs both, and both must have each other or the like: one value read in two ways is not enough.
    linked = {"linked_identifier": of["identifier"] & F.col("near_secret"), "linked_secret": of["secret"] & F.col("near_identifier")}
    found = _beside(found, linked, scope)

    # A weak span under a base span: base spans that start before its end, the furthest of which ends behind its start.
    solid = F.max(F.when(~is_weak & F.col("kind").isNotNull(), F.col("end")))
    by_start = Window.partitionBy("row").orderBy("start")
    found = found.withColumn("weak", is_weak).withColumn("under", F.coalesce(solid.over(by_start.rangeBetween(Window.unboundedPreceding, 0)) > F.col("start"), F.lit(False)))
    next_solid = F.min(F.when(~is_weak & F.col("kind").isNotNull(), F.col("start"))).over(Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("covered", F.col("under") | F.coalesce(next_solid < F.col("end"), F.lit(False)))
    complete = F.when(of["identifier"], F.col("near_secret")).when(of["secret"], F.col("near_identifier")).otherwise(F.col("linked_identifier") & F.col("linked_secret"))
    out = found.withColumn("reported", F.col("kind").isNotNull() & (~F.col("weak") | (complete & ~F.col("covered"))))
    return out.select("row", "doc_id", "kind", "start", "end", "weak", "reported")


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def digest(spans: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, a digest of the base spans, all spans and the linked ones."""
    n = {k.name: F.count_if(F.col("kind") == i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if not k.weak}
    item = F.when(F.col("reported"), F.struct("start", "kind", "end"))
    rows = spans.groupBy("row", "doc_id").agg(*n.values(), F.array_sort(F.collect_list(item)).alias("found"))
    base = F.filter("found", lambda s: s["kind"] < FIRST_WEAK)
    return rows.select(
        "doc_id",
        *(f"n_{k.name}" for k in KINDS if not k.weak),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
        (F.size("found") - F.size(base)).cast("long").alias("n_linked"),
    )


def mask(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Reported spans as (doc_id, kind name, start, end), for callers that redact or list them."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return scan(docs, scope).where("reported").select("doc_id", F.element_at(names, F.col("kind") + 1).alias("kind"), "start", "end")
