"""What a change of a model's text does to its outputs and what it reads, from Catalyst's parsed and analysed plans."""

from __future__ import annotations

import re
from collections import Counter
from typing import Any

from pyspark.sql import SparkSession

from . import catalyst as c

#: Columns that a history table carries beside those of its source.
VERSION_COLUMNS = ("dbt_valid_from", "dbt_valid_to", "dbt_scd_id", "dbt_updated_at", "valid_from", "valid_to", "is_current")
#: Functions that a key may be put together by without another column deciding it.
JOINING = ("concat", "concat_ws", "coalesce", "cast", "trim", "lower", "upper", "md5", "sha2", "string")


def _final(plan: Any) -> tuple[list[Any], list[Any]] | None:
    """(named outputs, plans that decide which rows there are) of a statement's last projection; None with a star or beyond a select."""
    k = c.kind(plan)
    if k in ("UnresolvedWith", "Sort", "GlobalLimit", "LocalLimit", "Distinct", "UnresolvedHaving", "Filter", "SubqueryAlias"):
        inner = _final(plan.child())
        if inner is None or k == "Distinct":  # every output decides which rows are equal
            return None
        around = [x._2() for x in c.seq(plan.cteRelations())] if k == "UnresolvedWith" else []
        # What stands around the projection is told apart by its own text, without what is below it.
        return inner[0], [*inner[1], *around, *([] if k in ("UnresolvedWith", "SubqueryAlias") else c.expressions(plan))]
    if k == "Project":
        outputs, rest = c.seq(plan.projectList()), [plan.child()]
    elif k == "Aggregate":
        outputs, rest = c.seq(plan.aggregateExpressions()), [plan.child(), *c.seq(plan.groupingExpressions())]
    else:
        return None
    if any(c.kind(e) in ("UnresolvedStar", "UnresolvedStarExceptOrReplace") or "UnresolvedStar" in e.toString() for e in outputs):
        return None
    return outputs, rest


def _same(a: Any, b: Any) -> bool:
    if hasattr(a, "sameResult") and c.kind(a) == c.kind(b):
        try:
            return a.sameResult(b)
        except Exception:  # an expression has no such method on the other side of the bridge
            pass
    return c.kind(a) == c.kind(b) and a.canonicalized().toString() == b.canonicalized().toString()


def _name(e: Any) -> str:
    if c.kind(e) == "Alias":
        return e.name()
    if c.kind(e) == "UnresolvedAttribute":
        return c.seq(e.nameParts())[-1]
    return ""


def changed_outputs(spark: SparkSession, before: str, after: str) -> tuple[str, ...] | None:
    """Output columns whose definition differs, if all else that decides the rows is the same; None: not confined to columns."""
    b, a = (_final(c.parsed(spark, text)) for text in (before, after))
    if b is None or a is None or len(b[1]) != len(a[1]) or not all(map(_same, b[1], a[1])):
        return None
    old, new = ({_name(e): (e.child() if c.kind(e) == "Alias" else e).canonicalized().toString() for e in side[0]} for side in (b, a))
    if "" in old or "" in new:
        return None
    return tuple(sorted(n for n in old.keys() | new.keys() if old.get(n) != new.get(n)))


def named_columns(spark: SparkSession, text: str) -> set[tuple[str, str]]:
    """(relation, column) that the text writes out by name; columns that only a star brings in are not among them."""
    written = {c.seq(e.nameParts())[-1].lower() for n in c.nodes(c.parsed(spark, text)) for x in c.expressions(n) for e in c.below(x) if c.kind(e) == "UnresolvedAttribute"}
    plan, owner, through = c.analysed(spark.sql(text)), {}, {}
    defined = {n.id(): n for n in c.nodes(plan) if c.kind(n) == "CTERelationDef"}

    def own(node: Any, name: str) -> None:
        if c.kind(node) == "SubqueryAlias":
            name = node.identifier().name()
        children = c.seq(node.children())
        for child in children:
            own(child, name)
        if c.kind(node) == "CTERelationRef":  # its columns are those of the expression that it names
            pairs = zip(c.seq(node.output()), c.seq(defined[node.cteId()].child().output()), strict=True)
            through.update({x.exprId().id(): y.exprId().id() for x, y in pairs if x.exprId().id() != y.exprId().id()})
        elif name and (not children or c.kind(node) == "View"):
            owner.update({x.exprId().id(): (name, x.name()) for x in c.seq(node.output())})

    for node in c.nodes(plan):
        own(node, "")
    found = set()
    for i in {e.exprId().id() for n in c.nodes(plan) for x in c.expressions(n) for e in c.below(x) if c.kind(e) == "AttributeReference"}:
        while i in through:
            i = through[i]
        if i in owner and owner[i][1].lower() in written:
            found.add(owner[i])
    return found


def edit_script(spark: SparkSession, before: str, after: str) -> tuple[Counter, Counter]:
    """(inserted, removed) operators and expressions of the parsed plans; moved ones and reformatted text are in neither."""

    def parts(text: str) -> Counter:
        out: Counter = Counter()
        for n in c.nodes(c.parsed(spark, text)):
            out[c.kind(n)] += 1
            out.update(re.sub(r"\s+", " ", x.canonicalized().toString()).lower() for e in c.expressions(n) for x in c.conjuncts(e))
        return out

    b, a = parts(before), parts(after)
    return a - b, b - a


def key_columns(spark: SparkSession, expression: str) -> tuple[str, ...]:
    """Columns that a concatenated key is made of, in order; none if something else than joining them decides it."""
    parsed, out = spark._jsparkSession.sessionState().sqlParser().parseExpression(expression), []
    for e in c.below(parsed):
        if c.kind(e) == "UnresolvedAttribute":
            out.append(c.seq(e.nameParts())[-1])
        elif c.kind(e) == "UnresolvedFunction":
            if c.seq(e.nameParts())[-1].lower() not in JOINING:
                return ()
        elif c.kind(e) not in ("Concat", "Cast", "Literal", "Coalesce", "Alias"):
            return ()
    return tuple(dict.fromkeys(out))


def keeps_versions(spark: SparkSession, text: str, histories: frozenset[str]) -> bool:
    """Whether a model that reads a history hands its versions on: a version column is written, or a star brings them."""
    df = spark.sql(text)
    reads = {n.identifier().name() for n in c.nodes(c.analysed(df)) if c.kind(n) == "SubqueryAlias"}
    return bool(reads & histories) and any(x.lower() in VERSION_COLUMNS for x in df.columns)
