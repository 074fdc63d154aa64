"""Registered data: tables, views, declared keys, and a hash of it all."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    data_type: str
    nullable: bool = True
    key_position: int = 0


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]


@dataclass(frozen=True)
class TableInfo:
    name: str
    kind: str
    columns: tuple[ColumnInfo, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()

    @property
    def primary_key(self) -> tuple[str, ...]:
        return tuple(c.name for c in sorted((c for c in self.columns if c.key_position), key=lambda c: c.key_position))


@dataclass(frozen=True)
class Catalog:
    db_id: str
    tables: tuple[TableInfo, ...]
    digest: str = field(default="")

    def table(self, name: str) -> TableInfo | None:
        return next((t for t in self.tables if t.name == name), None)

    @property
    def names(self) -> frozenset[str]:
        return frozenset(t.name for t in self.tables)

    def edges(self) -> list[tuple[str, ForeignKey]]:
        """(table, key) of every declared key between registered tables."""
        return [(t.name, k) for t in self.tables for k in t.foreign_keys if k.target in self.names]

    def subset(self, kinds: Iterable[str]) -> Catalog:
        """Only tables of those kinds, hashed anew."""
        kept = set(kinds)
        return catalog(self.db_id, [t for t in self.tables if t.kind in kept])

    def rows(self, spark: SparkSession) -> DataFrame:
        """The catalog as a table: one row per column."""
        data = [(self.db_id, t.name, t.kind, c.name, c.data_type, c.nullable, c.key_position) for t in self.tables for c in t.columns]
        return spark.createDataFrame(data, "db_id string, table_name string, kind string, column_name string, data_type string, nullable boolean, key_position int")


def catalog(db_id: str, tables: Iterable[TableInfo]) -> Catalog:
    ordered = tuple(sorted(tables, key=lambda t: t.name))
    plain = [[t.name, t.kind, [[c.name, c.data_type, c.nullable, c.key_position] for c in t.columns], [[list(k.columns), k.target, list(k.target_columns)] for k in t.foreign_keys]] for t in ordered]
    return Catalog(db_id, ordered, hashlib.sha256(json.dumps([db_id, plain], sort_keys=True).encode()).hexdigest())


def describe(name: str, df: DataFrame, kind: str = "table", keys: Iterable[str] = (), foreign: Iterable[tuple] = ()) -> TableInfo:
    """Table information from a DataFrame's schema; no row is read."""
    place = {k: i for i, k in enumerate(keys, 1)}
    columns = tuple(ColumnInfo(f.name, f.dataType.simpleString(), f.nullable and f.name not in place, place.get(f.name, 0)) for f in df.schema.fields)
    return TableInfo(name, kind, columns, tuple(ForeignKey(tuple(a), t, tuple(b)) for a, t, b in foreign))
