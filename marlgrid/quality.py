"""Data-quality checks as one table: check, actual, expected, passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one(name: str, actual: DataFrame, expected: DataFrame | int) -> DataFrame:
    """A check from a one-value table and its expected value (a number or a table)."""
    got = actual.select(F.col(actual.columns[0]).cast("bigint").alias("actual"))
    if isinstance(expected, DataFrame):
        want = expected.select(F.col(expected.columns[0]).cast("bigint").alias("expected"))
        both = got.crossJoin(F.broadcast(want))  # one row each
    else:
        both = got.withColumn("expected", F.lit(expected).cast("bigint"))
    return both.select(F.lit(name).alias("check_name"), "actual", "expected", F.col("actual").eqNullSafe(F.col("expected")).alias("passed"))


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.agg((F.count(F.lit(1)) - F.countDistinct(key)).alias("n"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """References without a parent."""
    return count(child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti"))


def readable(df: DataFrame) -> bool:
    """Whether a table's files can be opened under the schema that they state; their rows are not kept."""
    try:
        df.limit(1).collect()
    except Exception:  # noqa: BLE001
        return False
    return bool(df.columns)


def suite(checks: list[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
