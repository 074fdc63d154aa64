"""Append-only traces of runs: events, latest states, and a stream over them."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "run_id string, sequence int, layer string, event string, elapsed_ms double, details_json string, created_at timestamp_ntz"


class TraceStore:
    """Events of runs in a folder of Parquet files; nothing is ever changed in place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def new_run() -> str:
        return uuid.uuid4().hex

    def append(self, run_id: str, events: list[tuple[str, str, float, dict]], first: int = 1) -> None:
        """Add (layer, event, elapsed_ms, details) in order, numbered from ``first``."""
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        rows = [(run_id, first + i, layer, event, float(ms), json.dumps(details, sort_keys=True, default=str), now) for i, (layer, event, ms, details) in enumerate(events)]
        self.spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(self.path)

    def events(self, run_id: str | None = None, after: int = 0) -> DataFrame:
        found = self.spark.read.schema(EVENTS).parquet(self.path).where(F.col("sequence") > after)
        return found.where(F.col("run_id") == run_id).orderBy("sequence") if run_id else found

    def latest(self) -> DataFrame:
        return latest(self.events())

    def stream(self) -> DataFrame:
        """Events as they are appended."""
        return self.spark.readStream.schema(EVENTS).parquet(self.path)


RUNS = "run_id string, version bigint, db_id string, question string, status string, config_json string, result_json string, at timestamp_ntz"
FEEDBACK = "run_id string, version bigint, rating int, comment string, at timestamp_ntz"


class VersionedStore:
    """Rows by key in a folder of Parquet files: a change is a new version, the latest one counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "run_id"):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.columns = [c.split(" ")[0] for c in schema.split(", ")]

    def put(self, **row) -> None:
        """Add a version of a row; columns that are not given keep their last value."""
        old = self.get(row[self.key]) or {}
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        full = {**old, **row, "version": (old.get("version") or 0) + 1, "at": now}
        self.spark.createDataFrame([tuple(full.get(c) for c in self.columns)], self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def versions(self) -> DataFrame:
        # An empty frame first: a store that nothing was put into has no folder yet.
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception:  # noqa: BLE001
            return self.spark.createDataFrame([], self.schema)

    def latest(self) -> DataFrame:
        return latest(self.versions(), self.key, "version")

    def get(self, key: str) -> dict | None:
        found = latest(self.versions().where(F.col(self.key) == key), self.key, "version").first()
        return found.asDict() if found else None


class RunStore(VersionedStore):
    """Runs with their state; a run that was under way when the process ended is failed by ``recover``."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, RUNS)

    def recover(self) -> int:
        open_ = [r["run_id"] for r in self.latest().where(F.col("status").isin("QUEUED", "RUNNING")).collect()]
        for run_id in open_:
            self.put(run_id=run_id, status="FAILED")
        return len(open_)

    def search(self, text: str = "", limit: int = 50) -> DataFrame:
        """Latest runs whose question holds a text; the results themselves are not read."""
        found = latest(self.versions().drop("result_json", "config_json"), self.key, "version")
        return found.where(F.lower("question").contains(text.lower())).orderBy(F.desc("at"), "run_id").limit(limit)


class FeedbackStore(VersionedStore):
    """One judgement per run; a later one replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, FEEDBACK)


def latest(events: DataFrame, key: str = "run_id", order: str = "sequence") -> DataFrame:
    """The last event of each run, in one aggregation without a sort."""
    others = [c for c in events.columns if c not in (key, order)]
    newest = events.groupBy(key).agg(F.max(F.struct(order, *others)).alias("_x"))
    return newest.select(key, F.col(f"_x.{order}").alias(order), *[F.col(f"_x.{c}").alias(c) for c in others])


def like_literal(text: str) -> str:
    """A LIKE pattern that finds the text itself anywhere, for use with ESCAPE '\\'."""
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
