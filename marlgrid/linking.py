"""Joining what was found in a catalog into a context that fits a prompt.

Three separate steps: candidate sets of tables along declared keys, the columns
that each needs, and a table of named criteria by which the sets that fit are
compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

from marlgrid.catalog import Catalog
from marlgrid.plans.questions import QuestionPlan
from marlgrid.retrieval import tokens


class Ways:
    """The shortest way of at most two keys between every two tables of a catalog."""

    def __init__(self, catalog: Catalog):
        self.joins: dict[tuple[str, str], list[str]] = {}
        for name, key in catalog.edges():
            on = " AND ".join(f"{name}.{a} = {key.target}.{b}" for a, b in zip(key.columns, key.target_columns))
            for pair in {(name, key.target), (key.target, name)}:
                self.joins.setdefault(pair, []).append(on)
        self.beside: dict[str, list[str]] = {t.name: [] for t in catalog.tables}
        for a, b in sorted(self.joins):
            self.beside[a].append(b)
        self.known = set(self.beside)
        self.through: dict[tuple[str, str], tuple[str, ...]] = {(t, t): (t,) for t in self.known}
        for a in self.known:
            for b in self.beside[a]:
                self.through.setdefault((a, b), (a, b))
        for a in self.known:
            for b in self.beside[a]:
                for c in self.beside[b]:
                    self.through.setdefault((a, c), (a, b, c))

    def to_any(self, start: str, goals: Iterable[str], hops: int) -> tuple[str, ...] | None:
        """The shortest way from a table to one of several; of equal ones the first by name."""
        ways = [w for g in goals if (w := self.through.get((start, g))) and len(w) <= hops + 1]
        return min(ways, key=lambda w: (len(w), w), default=None)

    def along(self, way: tuple[str, ...]) -> list[str]:
        """The join conditions of a way: the first by name of each step."""
        return [min(self.joins[pair]) for pair in zip(way, way[1:])]


@lru_cache(maxsize=32)
def ways(catalog: Catalog) -> Ways:
    return Ways(catalog)


def _hops(hops: int) -> int:
    if not 0 <= hops <= 2:
        raise ValueError("hops must be 0, 1 or 2")
    return hops


def within_hops(catalog: Catalog, start: Iterable[str], hops: int) -> set[str]:
    """Tables that at most ``hops`` keys (0 to 2) separate from the start."""
    graph, first = ways(catalog), set(start)
    return {b for (a, b), way in graph.through.items() if a in first and len(way) <= _hops(hops) + 1}


def closure(catalog: Catalog, seeds: Iterable[str], hops: int = 2) -> tuple[set[str], list[str]]:
    """The smallest joined set of tables that holds most seeds, and its join conditions.

    Grown from every seed in turn; of equal results the one from the earlier seed stays.
    """
    graph = ways(catalog)
    wanted = [s for s in dict.fromkeys(seeds) if s in graph.known]

    def grown(anchor: str) -> tuple[set[str], set[str]]:
        tables, joins = {anchor}, set()
        for seed in wanted:
            way = graph.to_any(seed, tables, _hops(hops))
            if way:
                tables |= set(way)
                joins |= set(graph.along(way))
        return tables, joins

    found = [grown(a) for a in wanted]
    if not found:
        return set(), []
    tables, joins = max(found, key=lambda f: (len(f[0] & set(wanted)), -len(f[0])))
    return tables, sorted(joins)


#: Words that every table shares and that therefore tell nothing.
COMMON = frozenset("id order orders customer customers product products table dataset".split())


def estimate(text: str) -> int:
    """Rough prompt size: a third of the UTF-8 bytes, at least 1."""
    return max(1, math.ceil(len(text.encode()) / 3))


def render(catalog: Catalog, tables: Iterable[str], columns: set[str], joins: Iterable[str]) -> str:
    """Tables with their keys and chosen columns (the first one if none is), and the joins."""
    lines = []
    for name in sorted(tables):
        t = catalog.table(name)
        if t is None:
            continue
        shown = [c for c in t.columns if c.key_position or f"{name}.{c.name}" in columns] or list(t.columns[:1])
        lines.append(f"TABLE {name}({', '.join(f'{c.name} {c.data_type}' for c in shown)})")
    return "\n".join(lines + [f"FK {j}" for j in joins])


def fit(texts: list[str], budget: int) -> list[str]:
    """Texts in order as long as they fit; one that does not is passed over."""
    kept, used = [], 0
    for text in texts:
        size = estimate(text)
        if used + size <= budget:
            kept.append(text)
            used += size
    return kept


@dataclass(frozen=True)
class Context:
    tables: tuple[str, ...]
    columns: tuple[str, ...]
    joins: tuple[str, ...]
    text: str
    size: int
    evidence: tuple[tuple[str, float], ...] = ()


def expanded_query(plan: QuestionPlan) -> str:
    return " ".join([plan.question, *plan.metrics, *plan.dimensions, *plan.filters, *plan.needs])


def _words(parts: Iterable[str]) -> set[str]:
    return {w for part in parts for w in tokens(part)}


class _Asked:
    """The words of a plan by what they stand for."""

    def __init__(self, plan: QuestionPlan):
        self.metrics, self.dimensions = _words(plan.metrics), _words(plan.dimensions)
        self.intent = _words([plan.question]) | self.metrics | self.dimensions


#: What a better context has more of, the most telling first: (asked, context, words of its text) -> value.
CRITERIA: dict[str, Callable[[_Asked, Context, set[str]], float]] = {
    "dimensions": lambda asked, c, said: len(asked.dimensions & said),
    "metrics": lambda asked, c, said: len(asked.metrics & said),
    "intent": lambda asked, c, said: len(asked.intent & said),
    "evidence": lambda asked, c, said: sum(score for _, score in c.evidence) / max(1, len(c.evidence)),
    "few tables": lambda asked, c, said: -len(c.tables),
    "small": lambda asked, c, said: -c.size,
}


def _table_order(ranked: list[dict], most: int) -> list[str]:
    """Tables in order of what was found, those of both ends of a key included."""
    named = (name for d in ranked for name in (d["table"], *(side.split(".")[0] for pair in d["neighbors"] for side in pair.split("="))))
    return list(dict.fromkeys(named))[:most]


def _candidates(catalog: Catalog, order: list[str], hops: int) -> list[tuple[set[str], list[str]]]:
    """Different joined sets: around every table alone, then around ever more of them."""
    seeds = [[t] for t in order] + [order[:n] for n in range(2, len(order) + 1)]
    found = {(frozenset(tables), tuple(joins)): (tables, joins) for tables, joins in (closure(catalog, s, hops) for s in seeds)}
    return list(found.values())


def _columns(catalog: Catalog, ranked: list[dict], tables: set[str], joins: list[str], telling: set[str]) -> set[str]:
    """Columns that were found, that the question names, and that the joins need."""
    found = {f"{d['table']}.{d['column']}" for d in ranked if d["table"] in tables and d["column"]}
    named = {f"{t.name}.{c.name}" for t in catalog.tables if t.name in tables for c in t.columns if telling & set(tokens(c.name))}
    return found | named | {side for j in joins for pair in j.split(" AND ") for side in pair.split(" = ")}


def link(plan: QuestionPlan, found: list[dict], catalog: Catalog, budget: int = 1200, most_tables: int = 6, hops: int = 2) -> Context:
    """The joined tables and columns that serve a plan best within a budget.

    The first candidate over the budget ends the search: later ones hold more tables.
    """
    if budget < 1 or most_tables < 1:
        raise ValueError("budget and most_tables must be positive")
    asked = _Asked(plan)
    ranked = sorted(found, key=lambda d: (-d["score"], -len(asked.intent & set(tokens(d["text"]))), d["document_id"]))
    order = _table_order(ranked, most_tables)
    if not order:
        raise ValueError("nothing was found to link")
    fitting: list[Context] = []
    for tables, joins in _candidates(catalog, order, hops):
        columns = _columns(catalog, ranked, tables, joins, asked.intent - COMMON)
        text = render(catalog, tables, columns, joins)
        if estimate(text) > budget:
            break
        evidence = tuple((d["document_id"], d["score"]) for d in ranked if d["table"] in tables)
        fitting.append(Context(tuple(sorted(tables)), tuple(sorted(columns)), tuple(joins), text, estimate(text), evidence))
    if not fitting:
        raise ValueError("no linked schema fits the budget")
    return max(fitting, key=lambda c: tuple(value(asked, c, set(tokens(c.text))) for value in CRITERIA.values()))
