"""Bounded execution of an approved query: rows, bytes and time."""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame

from marlgrid.errors import EngineError, ErrorClass, classify


@dataclass(frozen=True)
class Caps:
    rows: int = 200
    bytes: int = 2_000_000
    seconds: float = 10.0
    #: Joins without an equality are refused: no cap on rows bounds their work.
    allow_cross: bool = False


@dataclass(frozen=True)
class Preview:
    columns: tuple[str, ...]
    rows: tuple[tuple, ...]
    truncated: bool
    elapsed_s: float


def has_limit(df: DataFrame) -> bool:
    """Whether the outermost operation of a query is its own limit."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "GlobalLimit"


def is_scalar_aggregate(df: DataFrame) -> bool:
    """Whether a query is one aggregate over all its rows."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Sort", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() == "Aggregate" and plan.groupingExpressions().isEmpty()


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """The query with a default limit, unless it has one or gives a single row."""
    return df if has_limit(df) or is_scalar_aggregate(df) else df.limit(rows)


def crosses(df: DataFrame) -> bool:
    """Whether the physical plan joins every row with every row, in the query or in a subquery of it."""
    session = df.sparkSession._jsparkSession
    of_rows = df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    waiting = [df._jdf.queryExecution()]
    while waiting:
        execution = waiting.pop()
        stack = [execution.sparkPlan()]
        while stack:
            node = stack.pop()
            if node.getClass().getSimpleName() in ("CartesianProductExec", "BroadcastNestedLoopJoinExec"):
                return True
            stack.extend(node.children().apply(i) for i in range(node.children().size()))
        # Subqueries that the optimiser left are planned on their own.
        stack = [execution.optimizedPlan()]
        while stack:
            node = stack.pop()
            stack.extend(node.children().apply(i) for i in range(node.children().size()))
            waiting.extend(of_rows(session, node.subqueries().apply(i)).queryExecution() for i in range(node.subqueries().size()))
    return False


def refuse_crosses(df: DataFrame) -> None:
    """Raise for a query that joins without an equality."""
    try:
        found = crosses(df)
    except Exception as error:  # noqa: BLE001
        raise classify(error) from None
    if found:
        raise EngineError(ErrorClass.POLICY_VIOLATION, "a join without an equality condition is not permitted")


def run(df: DataFrame, caps: Caps = Caps()) -> Preview:
    """Collect at most ``caps.rows`` rows; TIMEOUT at the deadline whether or not Spark has stopped."""
    context, group = df.sparkSession.sparkContext, f"bounded-{uuid.uuid4()}"
    if not caps.allow_cross:
        refuse_crosses(df)
    box: dict = {}
    done = threading.Event()

    def work() -> None:
        rows, size = [], 0
        try:
            context.setJobGroup(group, "bounded query", interruptOnCancel=True)
            # Row by row: a result beyond the cap is never held whole.
            for row in df.limit(caps.rows + 1).toLocalIterator():
                size += len(json.dumps(tuple(row), default=str).encode()) if len(rows) < caps.rows else 0
                if size > caps.bytes:
                    raise EngineError(ErrorClass.RESULT_SHAPE_MISMATCH, f"the result is larger than {caps.bytes} bytes")
                rows.append(tuple(row))
            box["rows"] = rows
        except Exception as error:  # noqa: BLE001
            box["error"] = error
        finally:
            done.set()

    began = time.monotonic()
    InheritableThread(target=work, daemon=True).start()
    if not done.wait(caps.seconds):
        context.cancelJobGroup(group)
        raise EngineError(ErrorClass.TIMEOUT, f"no result within {caps.seconds:g} s")
    if "error" in box:
        raise (box["error"] if isinstance(box["error"], EngineError) else classify(box["error"])) from None
    rows = box["rows"]
    return Preview(tuple(df.columns), tuple(rows[: caps.rows]), len(rows) > caps.rows, time.monotonic() - began)
