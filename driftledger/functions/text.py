"""Text checks: planted instructions, redaction, positions of fragments, grounding of quotes, seed keys."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from .vocabulary import is_marked

#: Signs that a text addresses a machine, in the order in which they are tried.
STRONG = (
    ("set_aside", r"\b(ignore|disregard|forget|override)\b[^.\n]{0,40}\b(previous|prior|earlier|above|all)\b[^.\n]{0,20}\b(instruction|instructions|prompt|rule|rules|context)\b"),
    ("role", r"\b(you are|act as|behave as)\b[^.\n]{0,30}\b(ai|assistant|language model|llm|reviewer|agent)\b"),
    ("system_prompt", r"\b(system prompt|system message|developer message)\b"),
    ("approval", r"\b(approved|signed off|reviewed)\b[^.\n]{0,30}\b(by|per)\b[^.\n]{0,30}\b(ai|assistant|automated|bot)\b"),
    ("markers", r"(^|\n)\s*(<<<|>>>|```|#{2,}\s|\[\d+\]\s*(you|tool))"),
    ("transcript", r"\b(it returned|tool result|end of results|assistant:|user:)\b"),
)
#: Weaker signs, what must be named beside them, and characters that hide a sign.
WEAK = (
    ("do_not_report", r"\b(do not|don't|never)\b[^.\n]{0,30}\b(report|flag|raise|warn|mention|analyse|analyze|review)\b"),
    ("verdict", r"\b(mark|report|treat|classify|consider|declare)\b[^.\n]{0,30}\b(as )?(safe|approved|benign|clean|no issues|not an issue|low risk)\b"),
)
AUTOMATION = r"\b(ai|a\.i\.|llm|language model|assistant|agent|bot|automated|automatic|reviewer|review tool|scanner|linter|copilot|chatgpt|claude|gpt)\b"
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff\u00ad"


def planted(text: Column) -> Column:
    """The first sign that the text addresses a machine, or null. Weak signs need a machine to be named."""
    legible = F.translate(text, INVISIBLE, "")
    out = F.lit(None).cast("string")
    for name, pattern in reversed(WEAK):
        out = F.when(legible.rlike("(?i)" + pattern) & legible.rlike("(?i)" + AUTOMATION), name).otherwise(out)
    for name, pattern in reversed(STRONG):
        out = F.when(legible.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def redaction(salt: str, value: Column) -> Column:
    """A token that stands for a value: the same for the same salt, and not to be turned back."""
    return F.substring(F.sha2(F.concat_ws("\x1f", F.lit(salt), value), 256), 1, 10)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), F.lit(1)))


def locate(files: DataFrame, fragment: str, longest: int = 4, least: float = 0.75) -> DataFrame:
    """(file, first_line, last_line, coverage): where a fragment most likely stands.

    Windows of one to four lines compete by the share of the fragment's words that they hold; shorter ones win, and a
    file in which two equally good ones remain has no answer.
    """
    wanted = tokens(F.lit(fragment))
    lines = files.select("file", F.split("text", "\n").alias("lines"))
    starts = lines.select("file", "lines", F.explode(F.sequence(F.lit(1), F.size("lines"))).alias("first_line"))
    windows = starts.select("file", "lines", "first_line", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("lines") - F.col("first_line") + 1))).alias("n"))
    text = F.array_join(F.slice("lines", F.col("first_line"), F.col("n")), " ")
    share = F.size(F.array_intersect(tokens(text), wanted)) / F.size(wanted)
    scored = windows.select("file", "first_line", "n", share.alias("coverage")).where(F.col("coverage") >= least)
    best = scored.groupBy("file").agg(F.max(F.struct("coverage", (-F.col("n")).alias("short"))).alias("best"))
    kept = scored.join(best, "file").where((F.col("coverage") == F.col("best.coverage")) & (-F.col("n") == F.col("best.short")))
    single = kept.groupBy("file").agg(F.count(F.lit(1)).alias("ways"), F.min("first_line").alias("first_line"), F.min("n").alias("n"), F.min("coverage").alias("coverage"))
    return single.where("ways = 1").select("file", "first_line", (F.col("first_line") + F.col("n") - 1).alias("last_line"), "coverage")


def grounded(quote: Column, text: Column) -> Column:
    """Whether the quote's words stand in the text one after another, in order, whatever is between them and around.

    Quotes of up to three words must stand together.
    """
    words = F.regexp_extract_all(F.lower(quote), F.lit(r"([a-z0-9_]+)"), F.lit(1))
    body = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), F.lit(1)), " "), F.lit(" "))
    together = F.contains(body, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))

    def step(at: Column, word: Column) -> Column:
        found = F.call_function("locate", F.concat(F.lit(" "), word, F.lit(" ")), body, at)
        return F.when((at > 0) & (found > 0), found + F.length(word) + 1).otherwise(0)

    ordered = F.aggregate(words, F.lit(1), step) > 0
    return (F.size(words) > 0) & F.when(F.size(words) <= 3, together).otherwise(ordered)


def mask_invocation(text: Column, invocation_id: str | None, since: str | None = None, until: str | None = None) -> Column:
    """Quoted literals that only say when or in which run a text was made become fixed ones: the run's id, and timestamps from ``since`` to ``until``."""
    if invocation_id:
        text = F.replace(text, F.lit(f"'{invocation_id}'"), F.lit("'<invocation>'"))
    if since is None or until is None:
        return text
    stamps = F.array_distinct(F.regexp_extract_all(text, F.lit(r"'([0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9:.]{8,})'"), F.lit(1)))
    inside = F.filter(stamps, lambda x: F.try_to_timestamp(x).between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))
    return F.aggregate(inside, text, lambda t, x: F.replace(t, F.concat(F.lit("'"), x, F.lit("'")), F.lit("'<started>'")))


def is_measurement(name: str, data_type) -> bool:
    """Numbers under a monetary name, and all fractions, are measured and never a key."""
    if isinstance(data_type, StringType):
        return False
    return isinstance(data_type, NumericType) and (is_marked(name, "monetary") or data_type.typeName() in ("double", "float", "decimal"))


def seed_keys(df: DataFrame) -> DataFrame:
    """(key, width): the smallest unique columns, or pairs of columns where no single one is; one scan for each width."""
    columns = [f.name for f in df.schema if not is_measurement(f.name, f.dataType)]
    total = F.count(F.lit(1))

    def found(width: int) -> DataFrame:
        sets = list(combinations(columns, width))
        whole = lambda s: F.count_if(F.coalesce(*(F.when(F.col(c).isNull(), F.lit(True)) for c in s), F.lit(False))) == 0
        row = df.agg(*((whole(s) & (F.count_distinct(F.struct(*s)) == total)).alias(f"k{i}") for i, s in enumerate(sets)))
        each = F.array(*(F.struct(F.lit("+".join(s)).alias("key"), F.lit(width).alias("width"), F.col(f"k{i}").alias("ok")) for i, s in enumerate(sets)))
        return row.select(F.inline(each)).where("ok").drop("ok")

    singles, pairs = found(1), found(2)
    any_single = singles.agg(F.count(F.lit(1)).alias("singles"))
    return singles.unionByName(pairs.crossJoin(any_single).where("singles = 0").drop("singles"))
