"""The engine: register data, run governed SQL, answer questions, keep traces."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from marlgrid import correction, linking, policy, retrieval, validation
from marlgrid.catalog import Catalog, TableInfo, catalog, describe
from marlgrid.errors import EngineError, ErrorClass, classify
from marlgrid.executor import Caps, Preview, bounded, refuse_crosses, run
from marlgrid.plans.questions import Intent, LexicalPlanner, Planner, QuestionPlan, TemplateWriter, Writer, route
from marlgrid.trace import TraceStore

#: How an error ends a run; everything else is an execution error.
ENDS = {
    ErrorClass.POLICY_VIOLATION: "POLICY_BLOCKED",
    ErrorClass.TIMEOUT: "TIMEOUT",
    ErrorClass.SYNTAX_ERROR: "INVALID_SQL",
    ErrorClass.UNKNOWN_TABLE: "INVALID_SQL",
    ErrorClass.UNKNOWN_COLUMN: "INVALID_SQL",
    ErrorClass.AMBIGUOUS_COLUMN: "INVALID_SQL",
    ErrorClass.AGGREGATION_ERROR: "INVALID_SQL",
    ErrorClass.RESULT_SHAPE_MISMATCH: "VALIDATION_FAILED",
    ErrorClass.SEMANTIC_MISMATCH: "VALIDATION_FAILED",
}


_BINDING = threading.RLock()


@dataclass
class Answer:
    status: str
    question: str = ""
    sql: str = ""
    preview: Preview | None = None
    report: validation.Report | None = None
    run_id: str = ""
    attempts: int = 0
    events: list = field(default_factory=list)


class Engine:
    """Read-only answers over registered DataFrames."""

    def __init__(self, spark: SparkSession, caps: Caps = Caps(), planner: Planner | None = None, writer: Writer | None = None, trace: TraceStore | None = None):
        self.spark, self.caps, self.trace = spark, caps, trace
        self.planner, self.writer = planner or LexicalPlanner(), writer or TemplateWriter()
        self._catalogs: dict[str, Catalog] = {}
        self._domains: dict[str, str | None] = {}
        self._frames: dict[str, dict[str, DataFrame]] = {}

    def register(self, db_id: str, tables: dict[str, DataFrame], views: dict[str, DataFrame] | None = None, keys: dict[str, list[str]] | None = None, foreign: dict[str, list[tuple]] | None = None, domain: str | None = None) -> Catalog:
        """Make tables and views readable under their names; schemas are read, rows are not."""
        infos: list[TableInfo] = []
        for kind, group in (("table", tables), ("view", views or {})):
            for name, df in group.items():
                infos.append(describe(name, df, kind, (keys or {}).get(name, ()), (foreign or {}).get(name, ())))
        self._catalogs[db_id], self._domains[db_id] = catalog(db_id, infos), domain
        self._frames[db_id] = {**tables, **(views or {})}
        return self._catalogs[db_id]

    def catalog(self, db_id: str) -> Catalog:
        return self._catalogs[db_id]

    def sql(self, db_id: str, sql: str, limit: bool = True) -> DataFrame:
        """An approved query as a DataFrame, with the default limit unless it bounds itself."""
        decision = policy.check(self.spark, sql, self._catalogs[db_id])
        if not decision.allowed:
            raise EngineError(ErrorClass.POLICY_VIOLATION, decision.reason)
        # Names are bound per query, as databases of one session may share them.  The text is
        # analysed under the same lock; the plan holds the frames, whatever is bound later.
        with _BINDING:
            for name in decision.tables:
                self._frames[db_id][name].createOrReplaceTempView(name)
            try:
                df = self.spark.sql(sql.strip().rstrip(";"))
            except Exception as error:  # noqa: BLE001
                raise classify(error) from None
        if not self.caps.allow_cross:
            refuse_crosses(df)
        return bounded(df, self.caps.rows) if limit else df

    def validate(self, db_id: str, sql: str, question: str = "", plan: QuestionPlan | None = None) -> tuple[validation.Report, Preview | None]:
        """Policy, bounded execution, result checks and meaning, in this order."""
        try:
            preview = run(self.sql(db_id, sql), self.caps)
        except EngineError as error:
            return validation.Report(False, error.kind, message=str(error)), None
        report = validation.result_report(plan, preview)
        signals = validation.semantic_signals(self.spark, question, plan, sql, self._domains[db_id]) if plan and question else ()
        warnings = report.warnings + (("FAN_OUT_JOIN",) if validation.fan_out(self.spark, sql, self._catalogs[db_id]) else ())
        if signals:
            return validation.Report(False, ErrorClass.SEMANTIC_MISMATCH, tuple(dict.fromkeys((*report.signals, *signals))), warnings, "the query conflicts with the question"), preview
        return validation.Report(report.accepted, report.error, report.signals, warnings), preview

    def ask(self, db_id: str, question: str, budget: correction.Budget | None = None) -> Answer:
        """Route, plan, find the schema, write, validate, and repair within bounds."""
        began, text = time.monotonic(), " ".join(question.split())
        answer = Answer("", text, run_id=TraceStore.new_run())

        def note(layer: str, event: str, **details) -> None:
            answer.events.append((layer, event, (time.monotonic() - began) * 1000, details))

        intent = route(text) if text and len(text) <= 2000 else Intent.CLARIFY
        note("1", "ROUTED", intent=intent.value)
        if intent != Intent.QUERY:
            answer.status = {"WRITE_REQUEST": "WRITE_BLOCKED"}.get(intent.value, intent.value)
            return self._end(answer)
        calls_before = sum(getattr(x, "calls", 0) for x in (self.planner, self.writer))
        plan = self.planner.plan(text)
        note("1", "PLANNED", task=plan.task, metrics=plan.metrics, dimensions=plan.dimensions)
        known = self._catalogs[db_id]
        found = retrieval.search(self.spark, known, linking.expanded_query(plan))
        context = linking.link(plan, found, known) if found else None
        note("2", "SCHEMA_RETRIEVED", tables=context.tables if context else ())
        budget = budget or correction.Budget()
        advice: tuple[str, ...] = ()
        while True:
            try:
                answer.sql, fingerprint = validation.normalise(self.spark, self.writer.write(plan, context.text if context else "", advice))
            except EngineError as error:
                report, preview, fingerprint = validation.Report(False, error.kind, message=str(error)), None, answer.sql
            except ValueError as error:
                answer.status = "CLARIFY"
                note("3", "NOT_WRITTEN", reason=str(error))
                return self._end(answer)
            else:
                budget.called = sum(getattr(x, "calls", 0) for x in (self.planner, self.writer)) - calls_before
                note("3", "CANDIDATE_GENERATED", fingerprint=fingerprint)
                if not budget.admit(fingerprint):
                    note("5", "STOPPED", reason="REPEATED_SQL")
                    break
                report, preview = self.validate(db_id, answer.sql, text, plan)
            answer.attempts += 1
            answer.report, answer.preview = report, preview
            note("4", "VALIDATED", accepted=report.accepted, signals=report.signals, error=report.error)
            stop = None if report.accepted else budget.stop_reason(report)
            if report.accepted or stop:
                if stop:
                    note("5", "STOPPED", reason=stop)
                break
            budget.used += 1
            advice = correction.guidance(report)
        answer.status = "SUCCEEDED" if answer.report.accepted else ENDS.get(answer.report.error, "EXECUTION_ERROR")
        return self._end(answer)

    def events(self, run_id: str, after: int = 0) -> DataFrame:
        """The stored trace of a run, from an event on."""
        if self.trace is None:
            raise ValueError("the engine keeps no trace")
        return self.trace.events(run_id, after)

    def _end(self, answer: Answer) -> Answer:
        answer.events.append(("6", answer.status, 0.0, {"sql": answer.sql}))
        if self.trace:
            self.trace.append(answer.run_id, answer.events)
        return answer
