"""Scalar functions of the source dialect, as built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(text: Column) -> Column:
    """Timestamp of a text in either notation: '2021-01-03 16:32:57' or '2021-01-03T16:32:57Z'."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, "T", " "), "Z$", "")).cast("timestamp_ntz")


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days from ``earlier`` to ``later``."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def cents(money: Column, strict: bool = False) -> Column:
    """Exact integer cents of a decimal text, rounded once, halves to even.

    Text that is no number gives null, or fails the query if ``strict``.
    """
    exact = money.cast("decimal(38,18)") if strict else money.try_cast("decimal(38,18)")
    return (F.bround(exact, 2) * 100).cast("bigint")


def month_bucket(text: Column) -> Column:
    """Year and month, 'yyyy-MM', of a timestamp text."""
    return F.substring(text, 1, 7)


def year_bucket(text: Column) -> Column:
    """Year of a timestamp text."""
    return F.substring(text, 1, 4)


def token_estimate(text: Column) -> Column:
    """Rough size of a text for a prompt budget: a third of its UTF-8 bytes, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 3)).cast("bigint")


def empty_to_null(text: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(text, F.lit(""))
