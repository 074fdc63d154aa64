"""From a question to a structured plan: routing, clause hints, and a small compiler.

The planner and the SQL writer are protocols, so any model can stand behind them;
what is shipped is deterministic.  Batch routing of a table of questions is a
column expression and never leaves the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words by which questions are routed and read.
WRITE = [
    r"\b(insert|update|delete|drop|alter|create|truncate|merge|attach|detach)\b",
    r"\b(xóa|xoá|thêm|chèn|cập nhật|sửa)\b.{0,30}\b(dữ liệu|bản ghi|bảng|database)\b",
]
NO_DATA = [r"\b(return rate|returns|returned|refund|refunds|refunded)\b", r"\b(trả hàng|hoàn hàng|hoàn tiền|tỷ lệ trả)\b"]
GREETINGS = ["hi", "hello", "hey", "xin chào", "chào bạn", "cảm ơn", "thank you", "thanks"]
METRICS = {
    "revenue": ["revenue", "doanh thu"],
    "freight": ["freight", "shipping fee", "phí vận chuyển"],
    "paid value": ["paid value", "payment value", "thanh toán"],
    "order count": ["orders", "order count", "đơn hàng", "số đơn"],
    "customer count": ["customers", "customer count", "khách hàng"],
    "review score": ["review", "rating", "đánh giá", "điểm"],
    "delivery": ["delivery", "delivered", "giao hàng", "giao trễ"],
}
DIMENSIONS = {
    "category": ["category", "categories", "danh mục"],
    "state": ["state", "bang", "tiểu bang"],
    "seller": ["seller", "người bán"],
    "customer": ["customer", "khách hàng"],
    "time": ["year", "month", "năm", "tháng"],
    "payment type": ["payment type", "payment method", "phương thức thanh toán"],
}
STATED_LIMIT = re.compile(r"\b(?:top|limit|return|trả về)\s+(\d+)\b|\b(\d+)\s+(?:\w+\s+){0,3}(?:cao nhất|hàng đầu|nhiều .+ nhất)\b")
MOST_PATTERN, MOST_WORDS = re.compile(r"\bnhiều\b.{0,40}\bnhất\b"), ("most", "highest", "cao nhất")
SCALAR_MAXIMUM = ("what is the maximum", "maximum number", "lớn nhất từng")
LATE = ("delivered late", "late delivery", "giao trễ")
TIES = ("tie-break", "hòa thì")
COMPARED = ("compare", "so sánh")
VIETNAMESE = ("đơn", "hàng", "doanh thu", "khách", "phí", "điểm", "nhiều")
ENGLISH = re.compile(r"\b(the|how|what|which|orders?|customers?)\b")
STATUSES = ["delivered", "canceled", "unavailable", "giao thành công", "đã hủy"]


class Intent(str, Enum):
    QUERY = "QUERY"
    CLARIFY = "CLARIFY"
    WRITE_REQUEST = "WRITE_REQUEST"
    UNSUPPORTED = "UNSUPPORTED"


@dataclass(frozen=True)
class QuestionPlan:
    """What a question asks for; not to be confused with Catalyst's plans."""

    question: str
    task: str = "aggregation"  # lookup, aggregation, ranking, comparison, set
    metrics: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    filters: tuple[str, ...] = ()
    sort: tuple[str, ...] = ()
    limit: int | None = None
    years: tuple[str, ...] = ()
    language: str = "other"
    needs: tuple[str, ...] = field(default=())


class Planner(Protocol):
    def plan(self, question: str) -> QuestionPlan: ...


class Writer(Protocol):
    def write(self, plan: QuestionPlan, context: str, guidance: tuple[str, ...] = ()) -> str: ...


def settle(question: str) -> str:
    return " ".join(question.casefold().split())


def route(question: str | None) -> Intent:
    """The intent of one question."""
    text = settle(question or "")
    if len(text) < 4:
        return Intent.CLARIFY
    for patterns, intent in ((WRITE, Intent.WRITE_REQUEST), (NO_DATA, Intent.CLARIFY)):
        if any(re.search(p, text) for p in patterns):
            return intent
    return Intent.UNSUPPORTED if text.strip("!?. ") in GREETINGS else Intent.QUERY


def route_column(question: Column) -> Column:
    """The intents of a column of questions."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"\s+", " "))

    def any_of(patterns: list[str]) -> Column:
        return text.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))

    bare = F.regexp_replace(text, r"^[!?. ]+|[!?. ]+$", "")
    return (
        F.when(F.length(text) < 4, Intent.CLARIFY.value)
        .when(any_of(WRITE), Intent.WRITE_REQUEST.value)
        .when(any_of(NO_DATA), Intent.CLARIFY.value)
        .when(bare.isin(GREETINGS), Intent.UNSUPPORTED.value)
        .otherwise(Intent.QUERY.value)
    )


def _said(text: str, words) -> bool:
    return any(w in text for w in words)


def language(question: str) -> str:
    text = question.casefold()
    return "vi" if _said(text, VIETNAMESE) else "en" if ENGLISH.search(text) else "other"


class LexicalPlanner:
    """Reads metrics, dimensions, filters, order and limit from the question's words."""

    def plan(self, question: str) -> QuestionPlan:
        text = question.casefold()
        stated = STATED_LIMIT.search(text)
        most = _said(text, MOST_WORDS) or bool(MOST_PATTERN.search(text))
        one_value = _said(text, SCALAR_MAXIMUM)
        late = _said(text, LATE)
        metrics, dimensions = (tuple(n for n, words in table.items() if _said(text, words)) for table in (METRICS, DIMENSIONS))
        filters = [s for s in STATUSES if s in text]
        if late:  # lateness asks about every delivery, so a status must not narrow it
            filters = [s for s in filters if s != "delivered"] + ["late"]
        ranked = not one_value and (most or stated is not None)
        limit = int(stated[1] or stated[2]) if stated else 1 if ranked else None
        sort = ["metric desc"] * (most or "top" in text) + ["dimension asc"] * _said(text, TIES)
        task = "comparison" if _said(text, COMPARED) else "ranking" if ranked else "aggregation"
        return QuestionPlan(question, task, metrics, dimensions, tuple(filters), tuple(sort), limit, tuple(re.findall(r"\b20\d{2}\b", text)), language(question))


# How the compiler states each metric and dimension: expression, tables that hold it.
EXPRESSIONS = {
    "revenue": ("SUM(i.price_cents)", "items"),
    "freight": ("SUM(i.freight_value_cents)", "items"),
    "order count": ("COUNT(DISTINCT o.order_id)", "orders"),
    "customer count": ("COUNT(DISTINCT c.customer_unique_id)", "customers"),
}
GROUPS = {"state": ("c.customer_state", "customers"), "category": ("COALESCE(p.product_category_name, 'unknown')", "products"), "seller": ("i.seller_id", "items"), "time": ("SUBSTR(o.order_purchase_timestamp, 1, 7)", "orders")}
FROM = {
    "orders": "olist_orders_dataset o",
    "items": "olist_order_items_dataset i",
    "customers": "olist_customers_dataset c",
    "products": "olist_products_dataset p",
}
LINKS = {("orders", "items"): "i.order_id = o.order_id", ("orders", "customers"): "c.customer_id = o.customer_id", ("items", "products"): "p.product_id = i.product_id"}


class TemplateWriter:
    """Writes one query from a plan over the order domain's tables."""

    def write(self, plan: QuestionPlan, context: str, guidance: tuple[str, ...] = ()) -> str:
        metric = next((m for m in plan.metrics if m in EXPRESSIONS), None)
        if metric is None:
            raise ValueError("no known metric in the question")
        value, home = EXPRESSIONS[metric]
        group = next((GROUPS[d] for d in plan.dimensions if d in GROUPS and not (d == "customer")), None)
        used = {home} | ({group[1]} if group else set())
        where = []
        status = next(({"đã hủy": "canceled", "giao thành công": "delivered"}.get(f, f) for f in plan.filters if f in STATUSES), None)
        if status:
            used.add("orders")
            where.append(f"o.order_status = '{status}'")
        if plan.years:
            used.add("orders")
            where.append(f"SUBSTR(o.order_purchase_timestamp, 1, 4) = '{plan.years[0]}'")
        # The join path between what is used: orders stand between customers and items.
        if "customers" in used and used & {"items", "products"} or ("products" in used and "orders" in used):
            used |= {"orders", "items"}
        if "products" in used:
            used.add("items")
        if "customers" in used and metric == "order count":
            used.add("orders")
        order = [t for t in ("orders", "items", "customers", "products") if t in used]
        source = FROM[order[0]]
        for t in order[1:]:
            link = next(on for (a, b), on in LINKS.items() if t in (a, b) and (a if t == b else b) in order[: order.index(t)] or (t == b and a in order))
            source += f" JOIN {FROM[t]} ON {link}"
        tail = f" WHERE {' AND '.join(where)}" if where else ""
        if not group:
            return f"SELECT {value} AS metric_value FROM {source}{tail}"
        sql = f"SELECT {group[0]} AS dimension, {value} AS metric_value FROM {source}{tail} GROUP BY {group[0]} ORDER BY metric_value DESC, dimension ASC"
        return sql + (f" LIMIT {plan.limit}" if plan.limit else "")
