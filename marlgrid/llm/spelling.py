"""Misspelt words of a corpus, corrected to words that it uses far more often.

A word is corrected to another one an edit away (two edits from seven letters on;
a swap of neighbours is one) if that one is at least ``RATIO`` times as frequent.
The rule compares frequencies with each other and not with the table's size.
Pairs of words meet by the forms that they have after deletions, in one equi-join
of the distinct words, so neither a vocabulary nor a dictionary stands on the
driver.  Words of fewer than 3 or more than 24 letters, and numbers, stay as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgrid.llm.canonical import distance

#: A real word of the corpus can be an edit from one 20 times as frequent; a misspelling is rarer than that.
RATIO = 50
#: Letters from which two edits are allowed.
LONG = 7


def _without_one(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def _deletions(word: Column) -> Column:
    """The word, and what is left of it after one deletion, or two if it is long."""
    once = _without_one(word)
    twice = F.when(F.length(word) >= LONG, F.flatten(F.transform(once, _without_one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), once, twice))


@F.pandas_udf(T.IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y) for x, y in zip(a, b)], dtype="int32")


def corrections(words: DataFrame, column: str = "word") -> DataFrame:
    """(word, better) of the distinct words that have a correction; ``words`` has a row per occurrence."""
    counted = words.select(F.col(column).alias("word")).where(F.length("word").between(3, 24) & ~F.col("word").rlike("[0-9]")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    formed = counted.select("word", "n", F.explode(_deletions(F.col("word"))).alias("form"))
    frequent = formed.where(F.col("n") >= RATIO).select(F.col("word").alias("better"), F.col("n").alias("m"), "form")
    near = formed.join(frequent, "form").where((F.col("m") >= RATIO * F.col("n")) & (F.col("word") != F.col("better"))).select("word", "better", "m").distinct()
    near = near.withColumn("edits", _edits("word", "better")).where(F.col("edits") <= F.when(F.length("word") >= LONG, 2).otherwise(1))
    letters = lambda c: F.array_sort(F.split(c, ""))
    merit = F.struct("edits", letters(F.col("word")) != letters(F.col("better")), -F.col("m"), "better")
    return near.groupBy("word").agg(F.min_by("better", merit).alias("better"))


def corrected(records: DataFrame, words: str, keys: list[str]) -> DataFrame:
    """``records`` (keys and an array of words), with the misspelt words replaced.

    Records with equal keys must have equal words.
    """
    each = records.select(*keys, F.posexplode(words).alias("_at", "word"))
    better = corrections(each)
    said = each.join(better, "word", "left").select(*keys, F.struct("_at", F.coalesce("better", "word").alias("w")).alias("_w"))
    return said.groupBy(*keys).agg(F.transform(F.array_sort(F.array_distinct(F.collect_list("_w"))), lambda x: x["w"]).alias(words))
