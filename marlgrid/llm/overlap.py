"""Same or near-same records across splits: banded minwise hashes, exact checks.

Records come as token lists, a row per view (here: the SQL, the question's words,
the facts read from either); only rows of one view meet.  Equal token lists are
one class, so copies cost nothing after one shuffle.  Classes are shingled (five
tokens; a shorter list is one shingle), minwise hashed and cut into bands; classes
of different splits that share a band become candidates.  Exact Jaccard similarity
of the shingle sets decides, then the exact checks: ``marks`` (what must agree,
such as numbers) must be equal, and no slot that both have read may differ.  Pairs
of classes carry the result; they are expanded to pairs of records by two
equi-joins only where pairs are asked for, and ``links`` counts without it.

The marks are hashed into the bucket, so records of one template with different
values never meet, and no bucket needs a cap; what a bucket holds are classes, not
records.  Rows with a null id, split or view, or without tokens, give nothing.
Repeated ids give each pair once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlgrid.session import cut

SHINGLE = 5
SIMILARITY = 0.8
#: 20 bands of 5 hashes find a pair of similarity 0.8 with probability 0.9996.
BANDS, ROWS = 20, 5
_BETWEEN = "\x1f"


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 32, BANDS * ROWS, dtype="uint64") | 1, rng.integers(0, 1 << 63, BANDS * ROWS, dtype="uint64")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``SHINGLE`` token hashes of each list, and where each list's begin.

    ``tokens`` are the lists' token hashes one after another, ``ends`` the lists'
    ends (rising from 0, no list is empty).  A list shorter than a shingle is one.
    """
    sizes = np.diff(ends)
    count = np.maximum(sizes - (SHINGLE - 1), 1)
    starts = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(ends[:-1] - starts[:-1], count) + np.arange(starts[-1])
    left = np.repeat(ends[1:], count)
    out = np.zeros(len(at), dtype="uint64")
    for i in range(SHINGLE):
        inside = at + i < left
        out[inside] = _mixed(out[inside] * np.uint64(0x9E3779B97F4A7C15) + tokens[at[inside] + i])
    return out, starts


def band_hashes(tokens: np.ndarray, ends: np.ndarray, chunk: int = 20_000) -> np.ndarray:
    """For each list the hash of each band of its minwise signature: (lists, BANDS)."""
    a, b = _family()
    found = np.empty((len(ends) - 1, BANDS), dtype="uint64")
    begin = 0
    while begin < len(ends) - 1:
        stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + chunk, side="right")) - 1)
        base, starts = shingle_hashes(tokens[ends[begin] : ends[stop]], ends[begin : stop + 1] - ends[begin])
        low = np.full((BANDS * ROWS, stop - begin), np.iinfo("uint64").max, dtype="uint64")
        for i in range(BANDS * ROWS):
            low[i] = np.minimum.reduceat(_mixed(base * a[i] + b[i]), starts[:-1])
        band = np.arange(BANDS, dtype="uint64")[:, None].repeat(stop - begin, axis=1)
        for row in low.reshape(BANDS, ROWS, -1).transpose(1, 0, 2):
            band = _mixed(band * np.uint64(0x9E3779B97F4A7C15) + row)
        found[begin:stop] = band.T
        begin = stop
    return found


def _banded(similarity: float):
    """Batches of (class, hash of view and marks, tokens) -> (class, buckets).

    A list of so few shingles that one less would not be similar enough meets only
    equal ones: one band does for it.
    """
    few = similarity / (1 - similarity) if similarity < 1 else np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            listed = pc.split_pattern(batch.column(2), _BETWEEN)
            coded = listed.flatten().dictionary_encode()
            hashed = np.array([xxhash.xxh64_intdigest(t) for t in coded.dictionary.to_pylist()], dtype="uint64")
            ends = listed.offsets.to_numpy().astype("int64")
            bands = band_hashes(hashed[coded.indices.to_numpy()], ends - ends[0])
            said = batch.column(1).to_numpy().astype("uint64")
            buckets = _mixed(bands * np.uint64(0x9E3779B97F4A7C15) + said[:, None]).astype("int64")
            count = np.where(np.maximum(np.diff(ends) - (SHINGLE - 1), 1) < few - 1e-9, 1, BANDS)
            kept = np.arange(BANDS)[None, :] < count[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype("int32"), pa.array(buckets[kept]))], names=["class", "buckets"])

    return run


def _shingle_column(text: Column) -> Column:
    tokens = F.split(text, _BETWEEN)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - (SHINGLE - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.concat_ws(_BETWEEN, F.slice(tokens, i, F.lit(SHINGLE)))))


def members(records: DataFrame) -> DataFrame:
    """The records with their class, stored.

    ``records`` has id, is_train (boolean), tokens (array of strings) and, if
    wanted, view, marks (strings) and slots (map of strings, given by the tokens
    and marks).
    """

    def given(name: str, kind: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default).cast(kind)) if name in records.columns else F.lit(default).cast(kind)

    view, marks = given("view", "string", ""), given("marks", "string", "")
    slots = F.col("slots") if "slots" in records.columns else F.lit(None).cast("map<string,string>")
    # One text per list is a third of the list's size; half of a SHA-256 names a class.
    text = F.array_join(F.transform("tokens", lambda t: F.translate(t, _BETWEEN, " ")), _BETWEEN)
    kept = records.where("id IS NOT NULL AND is_train IS NOT NULL AND size(tokens) > 0").select("id", "is_train", text.alias("text"), view.alias("view"), marks.alias("marks"), slots.alias("slots"))
    name = F.substring(F.unhex(F.sha2(F.concat_ws("\x1e", "view", "text", "marks"), 256)), 1, 16)
    return cut(kept.withColumn("class", name))


def class_pairs(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(view, train_class, eval_class, similarity) of classes that are the same or near; by two routes, equal and bands."""
    classes = cut(rows.groupBy("class").agg(F.first(F.struct("view", "marks", "slots", "text")).alias("it"), F.max("is_train").alias("in_train"), F.max(~F.col("is_train")).alias("in_eval")))

    def buckets(kept: str, name: str) -> DataFrame:
        hashed = classes.where(kept).select("class", F.xxhash64("it.view", "it.marks").alias("said"), "it.text").mapInArrow(_banded(similarity), "class binary, buckets array<bigint>")
        return hashed.select(F.col("class").alias(name), F.explode("buckets").alias("bucket"))

    left, right = buckets("in_train", "train_class"), buckets("in_eval", "eval_class")
    near = left.join(right, "bucket").where("train_class != eval_class").select("train_class", "eval_class").distinct()

    # Only what became a candidate is shingled again for the exact check.
    shapes = classes.select("class", "it")
    checked = near.join(shapes.select(F.col("class").alias("train_class"), F.col("it").alias("a")), "train_class").join(shapes.select(F.col("class").alias("eval_class"), F.col("it").alias("b")), "eval_class")
    differs = F.exists(F.map_keys("a.slots"), lambda k: F.coalesce(F.try_element_at("a.slots", k) != F.try_element_at("b.slots", k), F.lit(False)))
    checked = checked.where((F.col("a.view") == F.col("b.view")) & (F.col("a.marks") == F.col("b.marks")) & ~F.coalesce(differs, F.lit(False)))
    checked = checked.select("train_class", "eval_class", F.col("a.view").alias("view"), _shingle_column(F.col("a.text")).alias("x"), _shingle_column(F.col("b.text")).alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    checked = checked.withColumn("similarity", common / (F.size("x") + F.size("y") - common)).where(F.col("similarity") >= similarity)
    same = classes.where("in_train AND in_eval").select("it.view", F.col("class").alias("train_class"), F.col("class").alias("eval_class"), F.lit(1.0).alias("similarity"))
    return same.unionByName(checked.select("view", "train_class", "eval_class", "similarity"))


def cross_pairs(records: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (train_id, eval_id, views, routes) of records that share a class or a near class in some view."""
    rows = members(records)
    pairs = class_pairs(rows, similarity).withColumn("route", F.when(F.col("train_class") == F.col("eval_class"), "equal").otherwise("bands"))
    train = rows.where("is_train").select(F.col("id").alias("train_id"), F.col("class").alias("train_class")).distinct()
    held = rows.where("NOT is_train").select(F.col("id").alias("eval_id"), F.col("class").alias("eval_class")).distinct()
    found = pairs.join(train, "train_class").join(held, "eval_class")
    return found.groupBy("train_id", "eval_id").agg(F.array_sort(F.collect_set("view")).alias("views"), F.array_sort(F.collect_set(F.concat_ws(":", "view", "route"))).alias("routes"))


def links(records: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(eval_id, view, n_links): training records that each evaluation record meets in a view, without listing them.

    A training id has one class in a view, so its classes' sizes add up.
    """
    rows = members(records)
    sizes = rows.where("is_train").groupBy(F.col("class").alias("train_class")).agg(F.countDistinct("id").alias("n"))
    met = class_pairs(rows, similarity).join(sizes, "train_class").groupBy("view", "eval_class").agg(F.sum("n").alias("n"))
    held = rows.where("NOT is_train").select(F.col("id").alias("eval_id"), F.col("class").alias("eval_class")).distinct()
    return met.join(held, "eval_class").groupBy("eval_id", "view").agg(F.max("n").alias("n_links"))
