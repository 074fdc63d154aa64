"""What went wrong, in the engine's own classes."""

from __future__ import annotations

import re
from enum import Enum

from pyspark.errors import PySparkException


class ErrorClass(str, Enum):
    POLICY_VIOLATION = "POLICY_VIOLATION"
    SYNTAX_ERROR = "SYNTAX_ERROR"
    UNKNOWN_TABLE = "UNKNOWN_TABLE"
    UNKNOWN_COLUMN = "UNKNOWN_COLUMN"
    AMBIGUOUS_COLUMN = "AMBIGUOUS_COLUMN"
    AGGREGATION_ERROR = "AGGREGATION_ERROR"
    TYPE_OR_FUNCTION_ERROR = "TYPE_OR_FUNCTION_ERROR"
    TIMEOUT = "TIMEOUT"
    RESULT_SHAPE_MISMATCH = "RESULT_SHAPE_MISMATCH"
    SEMANTIC_MISMATCH = "SEMANTIC_MISMATCH"
    UNKNOWN_RUNTIME_ERROR = "UNKNOWN_RUNTIME_ERROR"


#: Spark's condition (or how it begins) -> class.
CONDITIONS = [
    ("TABLE_OR_VIEW_NOT_FOUND", ErrorClass.UNKNOWN_TABLE),
    ("UNRESOLVED_COLUMN", ErrorClass.UNKNOWN_COLUMN),
    ("AMBIGUOUS_REFERENCE", ErrorClass.AMBIGUOUS_COLUMN),
    ("MISSING_GROUP_BY", ErrorClass.AGGREGATION_ERROR),
    ("MISSING_AGGREGATION", ErrorClass.AGGREGATION_ERROR),
    ("GROUP_BY_AGGREGATE", ErrorClass.AGGREGATION_ERROR),
    ("PARSE_", ErrorClass.SYNTAX_ERROR),
    ("UNRESOLVED_ROUTINE", ErrorClass.TYPE_OR_FUNCTION_ERROR),
    ("WRONG_NUM_ARGS", ErrorClass.TYPE_OR_FUNCTION_ERROR),
    ("CAST_INVALID_INPUT", ErrorClass.TYPE_OR_FUNCTION_ERROR),
    ("DIVIDE_BY_ZERO", ErrorClass.TYPE_OR_FUNCTION_ERROR),
    ("DATATYPE_MISMATCH", ErrorClass.TYPE_OR_FUNCTION_ERROR),
    ("ARITHMETIC_OVERFLOW", ErrorClass.TYPE_OR_FUNCTION_ERROR),
]


class EngineError(Exception):
    """A failure with its class and a message without paths."""

    def __init__(self, kind: ErrorClass, message: str):
        super().__init__(message)
        self.kind = kind


def redact_paths(message: str) -> str:
    return re.sub(r"(?:[A-Za-z]+:)?/(?:[\w.\-]+/)+[\w.\-]*", "<path>", message)


def classify(error: BaseException) -> EngineError:
    """The engine's error for anything that Spark raises."""
    if isinstance(error, EngineError):
        return error
    condition = (error.getCondition() if isinstance(error, PySparkException) else None) or ""
    if not condition:
        named = re.match(r"\[([A-Z_.]+)\]", str(error))
        condition = named[1] if named else ""
    text = redact_paths(str(error).split("JVM stacktrace")[0].strip())[:500]
    if "cancelled" in text.lower() and "job" in text.lower():
        return EngineError(ErrorClass.TIMEOUT, text)
    return EngineError(next((kind for start, kind in CONDITIONS if condition.startswith(start)), ErrorClass.UNKNOWN_RUNTIME_ERROR), text)
