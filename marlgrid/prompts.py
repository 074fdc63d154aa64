"""What a model is asked, and what of its answer counts.

A model is any function from a prompt and a JSON schema to a text.  Its answer must
be one JSON object of that schema; an answer that is none is asked for once more,
with the fault named, and then refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass

from marlgrid.catalog import Catalog
from marlgrid.linking import Context
from marlgrid.plans.questions import QuestionPlan

#: Fields of an answer: name -> (JSON type, whether it must be there).
SQL_ANSWER = {"sql": ("string", True), "explanation": ("string", False)}
PLAN_ANSWER = {"task": ("string", True), "metrics": ("array", True), "dimensions": ("array", True), "filters": ("array", False), "limit": ("integer", False)}
_KINDS = {"string": str, "array": list, "integer": int, "number": (int, float), "boolean": bool, "object": dict}


class MalformedAnswer(ValueError):
    """A model's answer is no object of the schema."""


def json_schema(fields: dict[str, tuple[str, bool]]) -> dict:
    return {"type": "object", "additionalProperties": False, "properties": {n: {"type": k} for n, (k, _) in fields.items()}, "required": [n for n, (_, must) in fields.items() if must]}


def read_answer(text: str, fields: dict[str, tuple[str, bool]]) -> dict:
    """The one JSON object of an answer, with a fence around it or without."""
    plain = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text, flags=re.I)
    try:
        found = json.loads(plain)
    except ValueError as error:
        raise MalformedAnswer(f"no JSON: {error}") from None
    if not isinstance(found, dict):
        raise MalformedAnswer("not an object")
    unknown, missing = set(found) - set(fields), {n for n, (_, must) in fields.items() if must and n not in found}
    wrong = [n for n, v in found.items() if n in fields and v is not None and (not isinstance(v, _KINDS[fields[n][0]]) or (isinstance(v, bool) and fields[n][0] != "boolean"))]
    if unknown or missing or wrong:
        raise MalformedAnswer(f"unknown {sorted(unknown)}, missing {sorted(missing)}, of another type {sorted(wrong)}")
    return found


def full_schema(catalog: Catalog) -> str:
    """The whole catalog as text, where nothing was retrieved."""
    lines = []
    for t in catalog.tables:
        lines.append(f"{t.kind.upper()} {t.name}({', '.join(f'{c.name} {c.data_type}' for c in t.columns)})")
        lines += [f"FK {t.name}({', '.join(k.columns)}) -> {k.target}({', '.join(k.target_columns)})" for k in t.foreign_keys]
    return "\n".join(lines)


@dataclass(frozen=True)
class PromptBuilder:
    """Prompts for a query: the question, its plan, the schema, and the rules of a named domain only."""

    rules: dict[str, str]  # domain -> its glossary

    def sql(self, plan: QuestionPlan, catalog: Catalog, context: Context | None = None, domain: str | None = None, guidance: tuple[str, ...] = ()) -> str:
        parts = {
            "Task": "Write one read-only Spark SQL query that answers the question. Use only the tables and columns below.",
            "Question": plan.question,
            "Plan": json.dumps({k: v for k, v in asdict(plan).items() if v not in (None, (), "")}, ensure_ascii=False, sort_keys=True),
            "Schema, retrieved for the question" if context else "Schema, whole": context.text if context else full_schema(catalog),
            "Rules": self.rules.get(domain or "", "No rules beyond the schema."),
            "To be mended": "\n".join(guidance),
            "Catalog": catalog.digest,
            "Answer": "One JSON object of this schema: " + json.dumps(json_schema(SQL_ANSWER)),
        }
        return "\n\n".join(f"## {name}\n{text}" for name, text in parts.items() if text)


def ask(model: Callable[[str, dict], str], prompt: str, fields: dict[str, tuple[str, bool]]) -> tuple[dict, int]:
    """A model's answer and the calls it took: two at most."""
    try:
        return read_answer(model(prompt, json_schema(fields)), fields), 1
    except MalformedAnswer as fault:
        again = f"{prompt}\n\n## The last answer was refused\n{fault}"
    return read_answer(model(again, json_schema(fields)), fields), 2


class ModelWriter:
    """A query writer on top of a model; counts its calls."""

    def __init__(self, model: Callable[[str, dict], str], builder: PromptBuilder, catalog: Catalog, domain: str | None = None):
        self.model, self.builder, self.catalog, self.domain, self.calls = model, builder, catalog, domain, 0

    def write(self, plan: QuestionPlan, context: str, guidance: tuple[str, ...] = ()) -> str:
        given = Context((), (), (), context, 0) if context else None
        answer, calls = ask(self.model, self.builder.sql(plan, self.catalog, given, self.domain, guidance), SQL_ANSWER)
        self.calls += calls
        return answer["sql"]


class ModelPlanner:
    """A planner on top of a model; what the question states outright overrides the model's plan."""

    def __init__(self, model: Callable[[str, dict], str], stated):
        self.model, self.stated, self.calls = model, stated, 0

    def plan(self, question: str) -> QuestionPlan:
        base = self.stated.plan(question)
        prompt = f"## Task\nPlan the question.\n\n## Question\n{question}\n\n## Answer\nOne JSON object of this schema: {json.dumps(json_schema(PLAN_ANSWER))}"
        answer, calls = ask(self.model, prompt, PLAN_ANSWER)
        self.calls += calls
        return align(base, answer)


def align(stated: QuestionPlan, answer: dict) -> QuestionPlan:
    """A model's plan, overridden where the question is explicit: limit, order, ranking and scalar tasks."""
    ranked = stated.task == "ranking" or stated.limit is not None
    scalar = stated.task == "aggregation" and not stated.dimensions
    return QuestionPlan(
        stated.question,
        task="ranking" if ranked else answer["task"] if answer["task"] in ("lookup", "aggregation", "ranking", "comparison", "set") and not (scalar and answer["task"] == "ranking") else stated.task,
        metrics=tuple(dict.fromkeys((*stated.metrics, *map(str, answer["metrics"])))),
        dimensions=stated.dimensions or (() if scalar and stated.metrics else tuple(map(str, answer["dimensions"]))),
        filters=tuple(dict.fromkeys((*stated.filters, *map(str, answer.get("filters") or ())))),
        sort=stated.sort,
        limit=stated.limit if stated.limit is not None else (answer.get("limit") if ranked else None),
        years=stated.years, language=stated.language, needs=stated.needs,
    )
