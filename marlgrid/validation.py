"""Checks of results and of meaning, on Spark's plans and the question's words."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from marlgrid import policy
from marlgrid.catalog import Catalog
from marlgrid.errors import ErrorClass
from marlgrid.executor import Preview
from marlgrid.plans.questions import QuestionPlan


@dataclass(frozen=True)
class Report:
    accepted: bool
    error: ErrorClass | None = None
    signals: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    message: str = ""


def result_report(plan: QuestionPlan | None, preview: Preview) -> Report:
    """Warnings for empty and cut results; signals where a scalar was asked for."""
    warnings = (("EMPTY_RESULT",) if not preview.rows else ()) + (("RESULT_TRUNCATED",) if preview.truncated else ())
    signals: tuple[str, ...] = ()
    if plan and plan.task == "aggregation" and not plan.dimensions:
        if len(preview.rows) != 1:
            signals += ("SCALAR_AGGREGATE_ROW_COUNT",)
        if len(preview.columns) != max(1, len(plan.metrics)) and len(preview.columns) != 1:
            signals += ("SCALAR_AGGREGATE_COLUMN_COUNT",)
    return Report(not signals, ErrorClass.RESULT_SHAPE_MISMATCH if signals else None, signals, warnings)


@dataclass(frozen=True)
class Shape:
    """What the semantic rules need of a parsed query."""

    sorted_by: tuple[bool, ...]  # descending, per key of the top sort
    limit: int | None
    functions: frozenset[str]
    names: frozenset[str]
    distinct: bool
    outputs: int
    text: str
    tables: frozenset[str] = frozenset()


def shape(spark: SparkSession, sql: str) -> Shape:
    plan = policy.parse(spark, sql)
    top, limit, order, outputs = plan, None, (), 0
    while True:
        kind = policy._kind(top)
        if kind == "GlobalLimit":
            text = top.limitExpr().toString()
            limit = int(text) if text.isdigit() else None
        elif kind == "Sort":
            order = tuple(o.direction().toString() == "Descending" or "Desc" in policy._kind(o.direction()) for o in policy._items(top.order()))
        elif kind in ("Project", "Aggregate"):
            outputs = (top.projectList() if kind == "Project" else top.aggregateExpressions()).size()
            break
        elif kind not in ("LocalLimit", "UnresolvedWith", "UnresolvedHaving", "Distinct", "SubqueryAlias", "Filter"):
            break
        below = policy._items(top.children())
        if not below:
            break
        top = below[0]
    functions, names, tables, distinct = set(), set(), set(), False
    for node in policy.walk(plan):
        distinct |= policy._kind(node) == "Distinct"
        if policy._kind(node) == "UnresolvedRelation":
            tables.add(policy._items(node.multipartIdentifier())[-1].lower())
        for e in policy.expressions(node):
            if policy._kind(e) == "UnresolvedFunction":
                functions.add(policy._items(e.nameParts())[-1].lower())
                distinct |= bool(e.isDistinct())
            elif policy._kind(e) == "UnresolvedAttribute":
                names.add(policy._items(e.nameParts())[-1].lower())
    return Shape(order, limit, frozenset(functions), frozenset(names | tables), distinct, outputs, sql.casefold(), frozenset(tables))


# Phrases of a question that a rule listens to.
PHRASES = {
    "ranks": ("most ", "top ", "cao nhất", "lớn nhất"),
    "no_ranking": ("là bao nhiêu", "what is the maximum", "maximum number"),
    "average": ("average", "trung bình", "mean"),
    "maximum": ("lớn nhất từng", "what is the maximum", "maximum number"),
    "amount": ("bao nhiêu", "what is", "number"),
    "tie": ("alphabetical tie-break", "hòa thì", "tie-break by"),
    "returning": ("quay lại", "returning customer"),
    "customer": ("customer", "khách hàng"),
    "late": ("giao trễ", "giao hàng trễ", "late deliver", "delivered late"),
    "several": ("nhiều", "more than one", "> 1"),
    "several_photos": ("more than one", "nhiều hơn một", "> 1"),
    "record": (" record",),
    "freight": ("freight",),
    "per_order": ("per order",),
    "review_row": ("review row",),
    "photo": ("photo",),
    "which_month": ("tháng nào",),
}
MOST = re.compile(r"\bnhiều\b.{0,40}\bnhất\b")
TOP_N = re.compile(r"\btop\s+(\d+)\b")


def semantic_signals(spark: SparkSession, question: str, plan: QuestionPlan, sql: str, domain: str | None = None) -> tuple[str, ...]:
    """Signals of conflicts between what was asked and what the query does.

    Rules of a domain apply only where the domain is named.  The query is the one
    that was written, before any default limit.
    """
    text = f" {question.casefold()}"
    said = {topic for topic, phrases in PHRASES.items() if any(p in text for p in phrases)}
    if MOST.search(text):
        said.add("ranks")
    if any("avg" in m or "average" in m for m in plan.metrics):
        said.add("average")
    s = shape(spark, sql)
    raised: list[str] = []

    def rule(asked: bool, **conflicts: bool) -> None:
        if asked:
            raised.extend(name for name, conflict in conflicts.items() if conflict)

    top = TOP_N.search(text)
    rule(
        "ranks" in said and "no_ranking" not in said,
        RANKING_ORDER_MISSING=not s.sorted_by,
        RANKING_PRIMARY_NOT_DESC=s.sorted_by[:1] == (False,),
        RANKING_LIMIT_MISMATCH=s.limit != (plan.limit or (int(top[1]) if top else 1)),
    )
    rule("tie" in said, ALPHABETICAL_TIE_BREAK_MISSING=s.sorted_by[1:2] != (False,))
    rule(plan.task == "ranking" or plan.limit is not None, TOP_K_MISSING_ORDER=not s.sorted_by, TOP_K_MISSING_LIMIT=plan.limit is not None and s.limit is None)
    rule("average" in said, AVERAGE_AGGREGATE_MISSING=not s.functions & {"avg", "mean"})
    rule({"maximum", "amount"} <= said, SCALAR_MAXIMUM_AGGREGATE_MISSING="max" not in s.functions)
    rule("record" in said, RECORD_COUNT_MUST_NOT_BE_DISTINCT=s.distinct)
    rule("which_month" in said, YEAR_MONTH_CONTEXT_LOST="month" in s.functions or bool(re.search(r"date_format\s*\([^)]*'mm'", s.text)))
    if domain == "olist":
        facts = "customer_order_facts" in s.names
        rule(
            {"returning", "customer"} <= said,
            CUSTOMER_IDENTITY_NOT_UNIQUE=not facts and "customer_unique_id" not in s.names,
            RETURNING_CUSTOMER_REPEAT_FILTER_MISSING=facts and not re.search(r"order_count\s*>\s*1\b", s.text),
            RETURNING_CUSTOMER_OUTPUT_SHAPE=s.outputs != 1,
        )
        rule("late" in said, DELIVERY_POPULATION_NARROWED_BY_STATUS=bool(re.search(r"order_status\s*=\s*'delivered'", s.text)))
        rule({"freight", "per_order", "average"} <= said, FREIGHT_PER_ORDER_GRAIN_MISMATCH=not {"order_item_totals", "freight_cents"} <= s.names)
        rule({"review_row", "several"} <= said, MULTIPLE_REVIEW_ROWS_RULE_MISSING=not {"order_review_summary", "review_row_count"} <= s.names)
        rule({"photo", "several_photos"} <= said, PRODUCT_PHOTO_QUANTITY_FILTER_MISSING="product_photos_qty" not in s.names)
    return tuple(raised)


def fan_out(spark: SparkSession, sql: str, catalog: Catalog) -> bool:
    """Whether a query joins two tables that both have many rows per row of a third, without DISTINCT.

    What has many rows is read from the keys: a table that refers to another by
    columns that are not its own whole key.
    """
    s = shape(spark, sql)
    many: dict[str, set[str]] = {}
    for t in catalog.tables:
        for k in t.foreign_keys:
            if t.name.lower() in s.tables and set(t.primary_key) != set(k.columns) and {c.lower() for c in k.columns} <= s.names:
                many.setdefault(k.target, set()).add(t.name)
    return not s.distinct and any(len(tables) > 1 for tables in many.values())


def normalise(spark: SparkSession, text: str) -> tuple[str, str]:
    """One statement without fence and semicolon, and its fingerprint."""
    sql = re.sub(r"^\s*```(?:sql)?\s*|\s*```\s*$", "", text, flags=re.I).strip().rstrip("; \n")
    policy.parse(spark, sql)
    plain = "".join(p if i % 2 else re.sub(r"\s+", " ", p.lower()) for i, p in enumerate(re.split(r"('(?:[^']|'')*')", sql)))
    return sql, hashlib.sha256(plain.strip().encode()).hexdigest()


def display_hint(preview: Preview) -> str:
    """How a result is best shown: one figure, a line over time, bars or a table."""
    if len(preview.rows) == 1 and len(preview.columns) == 1:
        return "kpi"
    if len(preview.columns) == 2 and len(preview.rows) > 1:
        name, first = preview.columns[0].lower(), str(preview.rows[0][0])
        return "line" if any(w in name for w in ("date", "month", "year", "day")) or re.match(r"\d{4}(-\d{2})?", first) else "bar"
    return "table"
