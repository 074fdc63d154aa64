"""Percentiles of very large numeric columns from mergeable centroid digests.

``runs`` lays a column down once, as sorted arrays of values per group and
partition; everything else reads those.  A digest is a list of (mean, weight)
clusters in value order.  Cluster sizes follow a quantile-dependent size function:
with k(q) = size/(2 pi) * asin(2q-1) a cluster may span at most one unit of k, so
clusters are small near both ends and the list has at most about ``size`` entries
whatever the input.  Digests of partitions, files or days merge by putting their
clusters together and clustering again.

``certify`` is a second pass: it counts, for every estimate, the values below it
and the values equal to it.  Those counts are exact, so the rank error they give
is certified and not just a bound of the theory.  The estimates go to the values,
not the values to the estimates: as a broadcast while they are few (counted), else
by a join over salted runs; a run is a whole array, counted where it stands.

Usable values are finite and not negative; the others are counted apart.  A
null group key is a group of its own.  Ties are one long cluster boundary:
the certified interval [below, below + equal] is what a tie can answer for.
An empty table gives no rows, a group without usable values null percentiles.
Extra columns are ignored; a key may not have the name of a digest's column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marlgrid.session import cut

DIGEST_SIZE = 200
#: Values that a task gathers before it lays them down as runs, and clusters that it holds before it clusters them again.
BUFFER = 500_000
#: Partitions whose digests meet in one task of a merge; beyond it a round goes before.
FAN_IN = 64
#: Groups whose estimates may be broadcast, and shares of the runs where they are more.
MOST_BROADCAST, SALTS = 100_000, 64

_RUN = [("n_unusable", T.LongType()), ("values", T.ArrayType(T.DoubleType()))]
_DIGEST = [("n", T.LongType()), ("n_unusable", T.LongType()), ("low", T.DoubleType()), ("high", T.DoubleType()), ("means", T.ArrayType(T.DoubleType())), ("weights", T.ArrayType(T.DoubleType()))]


def _schema(df: DataFrame, keys: list[str], fields: list[tuple]) -> T.StructType:
    clash = {*keys} & {name for name, _ in [*_RUN, *_DIGEST, ("part", None)]}
    if clash:
        raise ValueError(f"a key may not be called {sorted(clash)}")
    return T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField(n, t) for n, t in fields])


def cluster(means: np.ndarray, weights: np.ndarray, size: int = DIGEST_SIZE, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster weighted values, of every group, into at most about ``size`` centroids: (means, weights, groups)."""
    if groups is None:
        groups = np.zeros(len(means), dtype="int64")
    if not len(means):
        return means, weights, groups
    order = np.lexsort((means, groups))
    means, weights, groups = means[order], weights[order], groups[order]
    begins = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1])
    lengths = np.diff(np.concatenate([begins, [len(means)]]))
    totals = np.add.reduceat(weights, begins)
    ends = np.cumsum(weights)
    ends -= np.repeat(ends[begins] - weights[begins], lengths)
    # The unit of k in which a value's middle lies; values of one unit form a cluster.
    middle = (ends - weights / 2) / np.repeat(totals, lengths)
    unit = np.floor(size / (2 * math.pi) * (np.arcsin(np.clip(2 * middle - 1, -1, 1)) + math.pi / 2))
    starts = np.concatenate([[0], np.flatnonzero((np.diff(unit) != 0) | (np.diff(groups) != 0)) + 1])
    summed = np.add.reduceat(weights, starts)
    centre = np.add.reduceat(means * weights, starts) / summed
    # Rounding must not carry a centre past the values it stands for.
    return np.clip(centre, means[starts], means[np.concatenate([starts[1:] - 1, [len(means) - 1]])]), summed, groups[starts]


def quantile(means: np.ndarray, weights: np.ndarray, low: float, high: float, q: float) -> float:
    """Value at rank q, between the two centroids around it."""
    if not len(means):
        return math.nan
    middle = np.cumsum(weights) - weights / 2
    return float(np.interp(q * weights.sum(), np.concatenate([[0], middle, [weights.sum()]]), np.concatenate([[low], means, [high]])))


def _coded(keys: list[pa.ChunkedArray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's group, and a row of each group."""
    codes = np.zeros(rows, dtype="int64")
    for column in keys:
        coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
        codes = np.unique(codes * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    return codes, first


def _lists(groups: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """A list per group of values that stand in order of their group."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(groups, minlength=n))]).astype("int32")
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in values]


def usable_value(column: Column) -> Column:
    """Whether a value counts towards percentiles."""
    return column.isNotNull() & ~F.isnan(column) & (column >= 0) & (column < F.lit(math.inf))


def runs(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The column, stored as rows (keys..., n_unusable, values): sorted values of one group and partition."""
    schema = _schema(df, keys, _RUN)
    n_keys, arrow = len(keys), to_arrow_schema(schema)

    def laid(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        codes, first = _coded(table.columns[:n_keys], table.num_rows)
        values = table.column(n_keys).to_numpy().astype("float64")
        good = np.isfinite(values) & (values >= 0)
        bad = np.bincount(codes[~good], minlength=len(first))
        codes, values = codes[good], values[good]
        order = np.lexsort((values, codes))
        keyed = [c.combine_chunks().take(pa.array(first)) for c in table.columns[:n_keys]]
        yield pa.RecordBatch.from_arrays([*keyed, pa.array(bad), *_lists(codes, len(first), values[order])], schema=arrow)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= BUFFER:
                yield from laid(held)
                held, n = [], 0
        if held:
            yield from laid(held)

    return cut(df.select(*keys, F.col(value).cast("double").alias("values")).mapInArrow(gather, schema))


def digests(stored: DataFrame, keys: list[str], size: int = DIGEST_SIZE) -> DataFrame:
    """One digest per combination of ``keys`` of stored runs; can be stored and merged later.

    A group of a third of all rows costs each partition one digest, and no task
    merges more than a share of the partitions' digests.
    """
    schema = _schema(stored, keys, _DIGEST)
    n_keys, arrow = len(keys), to_arrow_schema(schema)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            listed, n = batch.column(n_keys + 1), batch.num_rows
            values, ends = listed.flatten().to_numpy(), listed.offsets.to_numpy() - listed.offsets[0].as_py()
            lengths = np.diff(ends)
            means, weights, groups = cluster(values, np.ones(len(values)), size, np.repeat(np.arange(n), lengths))
            some = lengths > 0
            low, high = np.full(n, np.nan), np.full(n, np.nan)
            low[some], high[some] = values[ends[:-1][some]], values[ends[1:][some] - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], pa.array(lengths.astype("int64")), batch.column(n_keys), pa.array(low, mask=~some), pa.array(high, mask=~some), *_lists(groups, n, means, weights)], schema=arrow)

    parts = stored.rdd.getNumPartitions()
    partial = stored.select(*keys, "n_unusable", "values").mapInArrow(digested, schema)
    if parts > FAN_IN:
        # A round of its own, so that no task merges a hot group's digests of all partitions.
        salted = partial.withColumn("part", F.spark_partition_id() % FAN_IN)
        partial = _merged(salted, [*keys, "part"], size).drop("part")
    return merge(partial, keys, size)


def merge(stored: DataFrame, keys: list[str], size: int = DIGEST_SIZE) -> DataFrame:
    """Merge digests to one per combination of ``keys`` by clustering their clusters."""
    _schema(stored, keys, [])
    return _merged(stored, keys, size)


def _merged(stored: DataFrame, keys: list[str], size: int) -> DataFrame:
    schema = T.StructType([T.StructField(k, stored.schema[k].dataType) for k in keys] + [T.StructField(n, t) for n, t in _DIGEST])
    n_keys, arrow = len(keys), to_arrow_schema(schema)

    def compact(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        codes, first = _coded(table.columns[:n_keys], table.num_rows)
        n, bad, low, high = (table.column(n_keys + i).to_numpy() for i in range(4))
        means, weights = (table.column(n_keys + i).combine_chunks() for i in (4, 5))
        lengths = np.diff(means.offsets.to_numpy())
        m, w, groups = cluster(means.flatten().to_numpy(), weights.flatten().to_numpy(), size, np.repeat(codes, lengths))
        least, most = np.full(len(first), np.inf), np.full(len(first), -np.inf)
        some = n > 0
        np.minimum.at(least, codes[some], low[some])
        np.maximum.at(most, codes[some], high[some])
        total = np.bincount(codes, n, len(first)).astype("int64")
        keyed = [c.combine_chunks().take(pa.array(first)) for c in table.columns[:n_keys]]
        return pa.RecordBatch.from_arrays([*keyed, pa.array(total), pa.array(np.bincount(codes, bad, len(first)).astype("int64")), pa.array(least, mask=total == 0), pa.array(most, mask=total == 0), *_lists(groups, len(first), m, w)], schema=arrow)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, clusters, room = [], 0, BUFFER
        for batch in batches:
            if batch.num_rows:
                held.append(batch.cast(arrow))
                clusters += len(batch.column(n_keys + 4).flatten())
            if clusters > room:
                held = [compact(held)]
                clusters = len(held[0].column(n_keys + 4).flatten())
                room = max(BUFFER, 2 * clusters)
        if held:
            yield compact(held)

    shaped = stored.select(*keys, *[n for n, _ in _DIGEST])
    return (shaped.repartition(*keys) if keys else shaped.coalesce(1)).mapInArrow(together, schema)


def estimates(merged: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """Rows (keys..., q, n, n_unusable, estimate) of merged digests."""
    wanted = [float(q) for q in quantiles]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def at(n: pd.Series, low: pd.Series, high: pd.Series, means: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series(
            [[quantile(np.asarray(m), np.asarray(w), lo, hi, q) for q in wanted] if k else [None] * len(wanted) for k, lo, hi, m, w in zip(n, low, high, means, weights)]
        )

    listed = F.arrays_zip(F.array(*[F.lit(q) for q in wanted]).alias("q"), at("n", "low", "high", "means", "weights").alias("estimate"))
    return merged.select(*keys, "n", "n_unusable", F.explode(listed).alias("e")).select(*keys, "n", "n_unusable", F.col("e.q").alias("q"), F.col("e.estimate").alias("estimate"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, values, estimates) -> (group, below, equal): exact counts of a run, at each estimate."""
    for batch in batches:
        if not batch.num_rows:
            continue
        listed, asked = batch.column(1), batch.column(2)
        values, ends = listed.flatten().to_numpy(), listed.offsets.to_numpy() - listed.offsets[0].as_py()
        wide = np.array(asked.flatten().to_numpy(zero_copy_only=False), dtype="float64").reshape(batch.num_rows, -1)
        below, equal = np.empty(wide.shape, dtype="int64"), np.empty(wide.shape, dtype="int64")
        for i in range(wide.shape[1]):
            at = np.repeat(wide[:, i], np.diff(ends))
            below[:, i] = np.add.reduceat(values < at, ends[:-1], dtype="int64")
            equal[:, i] = np.add.reduceat(values == at, ends[:-1], dtype="int64")
        each = pa.array(np.arange(0, wide.size + 1, wide.shape[1]).astype("int32"))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(each, pa.array(x.ravel())) for x in (below, equal))], names=["group", "below", "equal"])


def certify(stored: DataFrame, keys: list[str], found: DataFrame, quantiles: list[float], most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Add to estimates the exact counts of stored runs below and at each of them, and the rank error they prove.

    ``rank_error`` is the distance of q*n from the ranks that the estimate holds,
    as a share of n.  Rows: keys..., q, n, n_unusable, estimate, n_below, n_equal, rank_error.
    """
    wanted = sorted(float(q) for q in quantiles)
    mine = [f"k{i}" for i in range(len(keys))]  # names of our own: any key may be called as any column
    listed = found.select(*[F.col(k).alias(m) for k, m in zip(keys, mine)], F.col("q").alias("asked"), F.col("estimate").alias("e"), "n", "n_unusable")
    listed = listed.groupBy(*mine).agg(F.max("n").alias("n"), F.max("n_unusable").alias("n_unusable"), F.array(*[F.max(F.when(F.col("asked") == q, F.col("e"))) for q in wanted]).alias("e"))
    listed = cut(listed.withColumn("group", F.monotonically_increasing_id()))

    values = stored.where(F.size("values") > 0).select(*[F.col(k).alias(f"v{m}") for k, m in zip(keys, mine)], "values")
    asked = listed.where("n > 0").select(*mine, "group", "e")
    same = [F.col(f"v{m}").eqNullSafe(F.col(m)) for m in mine] or [F.lit(True)]
    if not keys or asked.count() <= most_broadcast:
        joined = values.join(F.broadcast(asked), same)
    else:
        joined = values.withColumn("vsalt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).join(asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*same, F.col("vsalt") == F.col("salt")])
    counts = joined.select("group", "values", "e").mapInArrow(_counted, "group bigint, below array<bigint>, equal array<bigint>")
    counts = counts.groupBy(F.col("group").alias("counted")).agg(*[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("below", "equal") for i in range(len(wanted))])
    whole = listed.join(counts, F.col("group") == F.col("counted"), "left")
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col("e")[i].alias("e"), F.coalesce(f"below{i}", F.lit(0)).alias("below"), F.coalesce(f"equal{i}", F.lit(0)).alias("equal")) for i, q in enumerate(wanted)]))
    counted = whole.select(*mine, "n", "n_unusable", each.alias("x")).select(
        *[F.col(m).alias(k) for k, m in zip(keys, mine)], F.col("x.q").alias("q"), "n", "n_unusable", F.col("x.e").alias("estimate"), F.col("x.below").alias("n_below"), F.col("x.equal").alias("n_equal")
    )
    rank = F.col("q") * F.col("n")
    error = F.greatest(F.lit(0.0), F.col("n_below") - rank, rank - (F.col("n_below") + F.col("n_equal"))) / F.nullif(F.col("n"), F.lit(0))
    return counted.withColumn("rank_error", error)
