"""Bounded repair of a rejected query."""

from __future__ import annotations

import time
from dataclasses import dataclass

from marlgrid.errors import ErrorClass
from marlgrid.validation import Report

#: Failures that no rewriting of the query mends.
FINAL = frozenset({ErrorClass.POLICY_VIOLATION, ErrorClass.TIMEOUT, ErrorClass.UNKNOWN_RUNTIME_ERROR})
GUIDANCE = {
    ErrorClass.SYNTAX_ERROR: "Write one complete query.",
    ErrorClass.UNKNOWN_TABLE: "Use registered tables only.",
    ErrorClass.UNKNOWN_COLUMN: "Take every column from the table that has it.",
    ErrorClass.AMBIGUOUS_COLUMN: "Qualify columns that several tables have.",
    ErrorClass.TYPE_OR_FUNCTION_ERROR: "Use Spark functions with arguments of their types.",
    ErrorClass.AGGREGATION_ERROR: "Group by every column that is not aggregated.",
    ErrorClass.RESULT_SHAPE_MISMATCH: "Return the rows and columns that were asked for.",
    ErrorClass.SEMANTIC_MISMATCH: "Resolve the listed conflicts and nothing else.",
}


def repairable(report: Report) -> bool:
    return not report.accepted and report.error not in FINAL


def guidance(report: Report) -> tuple[str, ...]:
    """What to change, without repetition: the class's advice, then the signals."""
    said = [GUIDANCE[report.error]] if report.error in GUIDANCE else []
    return tuple(dict.fromkeys([*said, *report.signals]))


@dataclass
class Budget:
    """Stops repair: attempts (two at the very most), time, and repetition."""

    repairs: int = 1
    seconds: float = 120.0
    hard_most: int = 2
    #: Calls of a model that one run may make in all, whoever makes them.
    calls: int = 6

    def __post_init__(self) -> None:
        self.began, self.used, self.called = time.monotonic(), 0, 0
        self.seen_sql: set[str] = set()
        self.seen_errors: list[tuple] = []

    def stop_reason(self, report: Report) -> str | None:
        """Why no repair is tried, or None."""
        if not repairable(report):
            return "NOT_REPAIRABLE"
        if self.used >= min(self.repairs, self.hard_most):
            return "REPAIRS_USED"
        if self.called >= self.calls:
            return "CALLS_USED"
        if time.monotonic() - self.began >= self.seconds:
            return "DEADLINE"
        key = (report.error, report.signals, report.message)
        if key in self.seen_errors:
            return "REPEATED_ERROR"
        self.seen_errors.append(key)
        return None

    def admit(self, fingerprint: str) -> bool:
        """Whether a candidate is new."""
        new = fingerprint not in self.seen_sql
        self.seen_sql.add(fingerprint)
        return new
