"""Lay items of varying size into containers of fixed capacity: bulk-synchronous best-fit.

Items are range-sorted by size over the cluster and stored; an item's place in
that order is its rank.  Gaps are kept sorted too.  One bulk step takes all items
of a size, from the largest size down: they sweep to their successor gap (the
smallest that holds them), of items that want the same gap the ranks decide who
gets which container, a container takes as many as fit, gaps are updated, and what
finds no gap opens containers.  The steps repeat down to the smallest size; the
result is that of best-fit-decreasing over all items at once.

Sizes are whole numbers, so at most ``capacity`` different items and gaps exist,
and those of one size are interchangeable.  A step therefore moves counts: the
items of a size are an interval of ranks, the containers with one gap are intervals
of container numbers.  The sweep over both sorted lists runs on a histogram with
at most ``capacity`` entries a kind, whatever the number of items; its outcome, a
list of (first rank, first container, items a container), places every item where
it stands, without a further exchange.  No task holds more than a partition of
the range sort, and equal sizes may fill many partitions.

An item is cut only if it is larger than the capacity: into full pieces and a
rest.  Items of size 0 or null need no room: they come out with a null container.
Repeated keys are items of their own.  Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgrid.session import cut


class Sweep:
    """Best-fit of a histogram of sizes: which ranks go to which containers.

    ``counts[s]`` is the number of items of size s; ranks rise with the size.
    """

    def __init__(self, counts: np.ndarray, capacity: int):
        ranks = np.concatenate([[0], np.cumsum(counts)])
        self.gaps: list[int] = []  # different gaps, rising
        self.holders: dict[int, list[tuple[int, int]]] = {}  # gap -> intervals (first container, containers)
        self.n_containers = 0
        moves = []
        for size in np.flatnonzero(counts)[::-1].tolist():
            rank, stop = int(ranks[size]), int(ranks[size + 1])
            while rank < stop:
                gap, first, held = self._successor(size, stop - rank, capacity)
                each = gap // size
                placed = min(held * each, stop - rank)
                full, rest = divmod(placed, each)
                moves.append((rank, first, each))
                self._release(gap - each * size, first, full)
                self._release(gap - rest * size, first + full, 1 if rest else 0)
                self._release(gap, first + full + (rest > 0), held - full - (rest > 0))
                rank += placed
        moves.sort()
        self.first_rank, self.first_container, self.each = (np.array([m[i] for m in moves], dtype="int64") for i in range(3))

    def _successor(self, size: int, items: int, capacity: int) -> tuple[int, int, int]:
        """Containers of the smallest gap that holds the size; new ones where no gap does."""
        at = bisect_left(self.gaps, size)
        if at < len(self.gaps):
            gap = self.gaps[at]
            first, held = self.holders[gap].pop()
            if not self.holders[gap]:
                del self.gaps[at], self.holders[gap]
            return gap, first, held
        opened = -(-items // (capacity // size))
        self.n_containers += opened
        return capacity, self.n_containers - opened, opened

    def _release(self, gap: int, first: int, held: int) -> None:
        if gap and held:
            if gap not in self.holders:
                self.holders[gap] = []
                self.gaps.insert(bisect_left(self.gaps, gap), gap)
            self.holders[gap].append((first, held))

    def container(self, rank: np.ndarray) -> np.ndarray:
        move = np.searchsorted(self.first_rank, rank, side="right") - 1
        return self.first_container[move] + (rank - self.first_rank[move]) // self.each[move]


def _place(sweeps: dict[int, Sweep], before: dict[tuple[int, int], int]):
    """Stored rows (part, kind, key, piece, size) in order of rank -> their containers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            container = np.empty(len(kind), dtype="int64")
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(kind) != 0) | (np.diff(part) != 0)) + 1, [len(kind)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                at = (int(part[a]), int(kind[a]))
                done = seen.get(at, 0)
                container[a:b] = sweeps[at[1]].container(before[at] + done + np.arange(b - a))
                seen[at] = done + int(b - a)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(1, 5)] + [pa.array(container)], names=["kind", "key", "piece", "size", "container"])

    return run


def pack(items: DataFrame, key: str, size: str, containers: DataFrame) -> DataFrame:
    """Rows (pack_name, key, piece, size, pack_id) of every item in every kind of container.

    ``containers`` has pack_name and capacity_tokens (a small table of kinds of
    containers; it is read by the driver); ``items`` is read several times and
    should be stored.
    """
    kinds = [(r["pack_name"], int(r["capacity_tokens"])) for r in containers.select("pack_name", "capacity_tokens").where("pack_name IS NOT NULL AND capacity_tokens > 0").orderBy("pack_name").collect()]
    plain = items.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("int").alias("n"))
    key_type = plain.schema["key"].dataType
    if not kinds:
        return items.sparkSession.createDataFrame([], T.StructType([T.StructField("pack_name", T.StringType()), T.StructField(key, key_type), T.StructField("piece", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("pack_id", T.StringType())]))
    kind = F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(name).alias("pack_name"), F.lit(capacity).alias("capacity")) for i, (name, capacity) in enumerate(kinds)])
    spread = plain.select("key", "n", F.explode(kind).alias("k")).select("key", "n", "k.*")
    full, rest = F.floor(F.col("n") / F.col("capacity")).cast("int"), (F.col("n") % F.col("capacity")).cast("int")

    # Pieces that fill a container need no matching.
    filled = spread.where(full > 0).select("kind", "pack_name", "key", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), F.col("capacity").alias("size"))
    filled = filled.select("pack_name", "key", "piece", "size", F.concat_ws("-", F.lit("full"), F.col("key").cast("string"), F.col("piece"), F.monotonically_increasing_id()).alias("container"))
    empty = spread.where("n = 0").select("pack_name", "key", F.lit(0).alias("piece"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("container"))

    # The range sort; stored, so that ranks do not change between counting and placing.
    todo = spread.where(rest > 0).select("kind", "key", full.alias("piece"), rest.alias("size"), F.xxhash64("key", F.lit("rank")).alias("tie"))
    order = ["kind", "size", "tie", "key"]
    ranged = cut(todo.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "kind", "key", "piece", "size"))
    # A size stands in neighbouring parts: as many rows as there are parts and sizes, whatever the items.
    counted = sorted((r["kind"], r["part"], r["size"], r["n"]) for r in ranged.groupBy("part", "kind", "size").agg(F.count(F.lit(1)).alias("n")).collect())
    counts = [np.zeros(capacity + 1, dtype="int64") for _, capacity in kinds]
    before: dict[tuple[int, int], int] = {}
    done = [0] * len(kinds)
    for k, part, s, n in counted:
        before.setdefault((part, k), done[k])
        done[k] += n
        counts[k][s] += n
    sweeps = {k: Sweep(counts[k], capacity) for k, (_, capacity) in enumerate(kinds)}
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", key_type), T.StructField("piece", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("container", T.LongType())])
    placed = ranged.mapInArrow(_place(sweeps, before), schema)
    names = F.array(*[F.lit(name) for name, _ in kinds])
    placed = placed.select(F.element_at(names, F.col("kind") + 1).alias("pack_name"), "key", "piece", "size", F.col("container").cast("string").alias("container"))
    out = placed.unionAll(filled).unionAll(empty)
    return out.select("pack_name", F.col("key").alias(key), "piece", "size", F.when(F.col("container").isNotNull(), F.concat_ws(":", "pack_name", "container")).alias("pack_id"))


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: containers used, the fewest that could do, and the share of room used."""
    each = packed.where("pack_id IS NOT NULL").groupBy("pack_name", "pack_id").agg(F.sum("size").alias("held"))
    total = each.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_packs"), F.sum("held").alias("n_tokens"), F.max("held").alias("fullest"))
    sized = containers.select("pack_name", F.col("capacity_tokens").alias("capacity"))
    joined = sized.join(total, "pack_name", "left")
    return joined.select("pack_name", "capacity", "n_packs", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("fewest_packs"), (F.col("n_tokens") / (F.col("n_packs") * F.col("capacity"))).alias("share_used"), (F.col("fullest") <= F.col("capacity")).alias("all_fit"))


def laws(packed: DataFrame, key: str, items: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: items placed, and how often a rule is broken (never, in a right packing).

    ``items`` has key and size, each key once.
    """
    room = F.broadcast(containers.select(F.col("pack_name").alias("kind"), F.col("capacity_tokens").alias("capacity")))  # one row a kind
    held = packed.where("pack_id IS NOT NULL").groupBy("pack_name", "pack_id").agg(F.sum("size").alias("held"))
    over = held.join(room, F.col("pack_name") == F.col("kind")).groupBy("kind").agg(F.count_if(F.col("held") > F.col("capacity")).alias("n_overfull"))
    pieces = packed.groupBy("pack_name", F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("total"))
    sized = items.select("key", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).alias("own"))
    judged = pieces.join(sized, "key", "left").join(room, F.col("pack_name") == F.col("kind"))
    each = judged.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(~F.col("total").eqNullSafe(F.col("own"))).alias("n_incomplete"),
        F.count_if(F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("own") / F.col("capacity")))).alias("n_cut_needlessly"),
    )
    return each.join(over, "kind", "left").select(F.col("kind").alias("pack_name"), "n_items", "n_incomplete", "n_cut_needlessly", F.coalesce("n_overfull", F.lit(0)).alias("n_overfull"))
