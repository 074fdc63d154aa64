"""References to records that do not exist, were deleted, or arrive later.

Keys are placed on the line of 64-bit hashes and that line is cut into ranges, so
ranges are even whatever the keys look like.  A histogram over a fixed number of
cells of the line lays the ranges out; it is all that the driver ever holds, and
the layout goes into the plan as constants.  Each range's parents stand as one
sorted array; the references of the range come in bounded batches and are probed by
vectorised binary search, then compared as strings.  A range that a hot key has
made heavy is cut into salted shares of references, each with its own copy of that
range's parents.

Keys match without regard to case and surrounding spaces.  A null reference is
no case; a parent with a null key is ignored.  Copies of a parent count as one
record: it was loaded when the first copy was, and it is deleted only if every
copy is, at the last of their times.  A null time decides nothing.  An empty
parent table makes every reference missing; an empty child table gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING, DELETED, LATE = "missing", "deleted", "late"
#: Binary digits of the hash that number the cells of its line, and the cells.
CELL_BITS = 12
CELLS = 1 << CELL_BITS


def reference_key(column: Column) -> Column:
    """The form in which keys are compared."""
    return F.lower(F.trim(column.cast("string")))


def _cell(hashed: Column) -> Column:
    """Number of the cell of a signed 64-bit hash, in order of the hash."""
    return (F.shiftright(hashed, 64 - CELL_BITS) + F.lit(CELLS // 2)).cast("int")


def _numbers(values: np.ndarray) -> Column:
    """An array as one constant of the plan."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def lay_out(load: np.ndarray, parents: int, slot_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Per cell (first slot, ranges, shares of a range), and the slots of all.

    Light neighbours share a slot.  A cell with too many parents for one is cut into
    equal ranges; what its references have beyond their ranges is hot keys, and every
    range of it is shared, each share with its own copy of the range's parents.
    """
    each = parents / len(load)
    ranges = np.full(len(load), max(1, int(np.ceil(each / slot_rows))), dtype="int64")
    shares = np.maximum(1, -(-load // (ranges * slot_rows)))
    first, slots, held = np.zeros(len(load), dtype="int64"), 0, 0.0
    for i in range(len(load)):
        alone = ranges[i] * shares[i] > 1
        if i and (alone or ranges[i - 1] * shares[i - 1] > 1 or held + each + load[i] > slot_rows):
            slots += int(ranges[i - 1] * shares[i - 1])
            held = 0.0
        first[i] = slots
        held += each + float(load[i])
    return first, ranges, shares, slots + int(ranges[-1] * shares[-1])


def _probe(hashes: np.ndarray, keys: pa.Array, wanted_hash: np.ndarray, wanted: pa.Array) -> np.ndarray:
    """Position of each wanted key in the sorted parent arrays, or -1."""
    found = np.full(len(wanted_hash), -1, dtype="int64")
    if not len(hashes):
        return found
    at = np.searchsorted(hashes, wanted_hash, side="left")
    open_ = np.flatnonzero(at < len(hashes))
    open_ = open_[hashes[at[open_]] == wanted_hash[open_]]
    while len(open_):  # further rounds only for keys whose hashes collide
        same = pc.equal(keys.take(pa.array(at[open_])), wanted.take(pa.array(open_))).to_numpy(zero_copy_only=False).astype(bool)
        found[open_[same]] = at[open_[same]]
        open_ = open_[~same]
        at[open_] += 1
        open_ = open_[at[open_] < len(hashes)]
        open_ = open_[hashes[at[open_]] == wanted_hash[open_]]
    return found


def _prober(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ordered by (slot, parent first, hash): parents fill the arrays, references are probed."""
    slot, held = None, []
    hashes, keys, loaded, deleted = np.empty(0, "int64"), pa.array([], pa.string()), None, None

    def settle() -> None:
        nonlocal hashes, keys, loaded, deleted, held
        if held:
            parents = pa.Table.from_batches(held).combine_chunks()
            hashes = parents.column("hash").to_numpy()
            keys, loaded, deleted = (parents.column(c).combine_chunks() for c in ("key", "loaded", "deleted"))
            held = []

    for batch in batches:
        slots, child = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        marks = slots * 2 + child
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(marks)) + 1, [len(marks)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if slots[a] != slot:
                slot, held = slots[a], []
                hashes, keys, loaded, deleted = np.empty(0, "int64"), pa.array([], pa.string()), None, None
            if child[a] == 0:
                held.append(part)
                continue
            settle()
            wanted = part.column("key")
            at = _probe(hashes, keys, part.column("hash").to_numpy(), wanted)
            hit = np.flatnonzero(at >= 0)
            reasons = [(np.flatnonzero(at < 0), MISSING)]
            if len(hit):
                now, place = part.column("loaded").take(pa.array(hit)), pa.array(at[hit])
                gone = pc.fill_null(pc.less_equal(deleted.take(place), now), False).to_numpy(zero_copy_only=False)
                late = pc.fill_null(pc.greater(loaded.take(place), now), False).to_numpy(zero_copy_only=False)
                reasons += [(hit[gone], DELETED), (hit[late], LATE)]
            for rows, reason in reasons:
                if len(rows):
                    rows_ = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([part.column("row_key").take(rows_), part.column("loaded").take(rows_), pa.array([reason] * len(rows))], names=["row_key", "loaded_at", "reason"])


def unresolved(
    child: DataFrame,
    parent: DataFrame,
    *,
    reference: Column,
    row_key: Column,
    parent_key: Column,
    child_loaded: Column | None = None,
    parent_loaded: Column | None = None,
    parent_deleted: Column | None = None,
    slot_rows: int = 150_000,
) -> DataFrame:
    """Rows (row_key, loaded_at, reason) of ``child`` whose reference does not resolve.

    A reference may be both deleted and late; it then gives two rows.  Repeated
    child rows give repeated results.  ``slot_rows`` is the wanted number of
    parents, and of references, that a task holds at a time.
    """
    none = F.lit(None).cast("timestamp_ntz")

    def moment(column: Column | None) -> Column:
        return none if column is None else column.cast("timestamp_ntz")

    refs = child.select(reference_key(reference).alias("key"), moment(child_loaded).alias("loaded"), row_key.cast("string").alias("row_key")).where("key IS NOT NULL")
    known = (
        parent.select(reference_key(parent_key).alias("key"), moment(parent_loaded).alias("loaded"), moment(parent_deleted).alias("deleted"))
        .where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("loaded").alias("loaded"), F.when(F.count("deleted") == F.count(F.lit(1)), F.max("deleted")).alias("deleted"))
    )
    refs, known = (x.withColumn("hash", F.xxhash64("key")) for x in (refs, known))

    # One pass over the references' keys: rows per cell of the hash line, a fixed number
    # of cells.  Parents are counted before their copies are merged, and spread evenly.
    load = np.zeros(CELLS, dtype="int64")
    for r in refs.groupBy(_cell(F.col("hash")).alias("cell")).count().collect():
        load[r["cell"]] = r["count"]
    first, ranges, shares, slots = lay_out(load, parent.count(), slot_rows)
    cell = _cell(F.col("hash")) + 1
    # The 32 binary digits behind the cell's, as a place within the cell.
    place = F.shiftrightunsigned(F.shiftleft(F.col("hash"), CELL_BITS), 32)
    refs, known = (
        x.withColumn("share", F.element_at(_numbers(shares), cell)).withColumn("base", F.element_at(_numbers(first), cell) + F.shiftright(place * F.element_at(_numbers(ranges), cell), 32) * F.col("share"))
        for x in (refs, known)
    )
    refs = refs.withColumn("slot", F.col("base") + F.pmod(F.xxhash64("row_key", "loaded"), F.col("share")))
    known = known.withColumn("slot", F.explode(F.sequence("base", F.col("base") + F.col("share") - 1)))

    shape = ["slot", "child", "hash", "key", "loaded", "deleted", "row_key"]
    rows = known.select("slot", F.lit(0).alias("child"), "hash", "key", "loaded", "deleted", F.lit(None).cast("string").alias("row_key")).select(shape).unionAll(
        refs.select("slot", F.lit(1).alias("child"), "hash", "key", "loaded", none.alias("deleted"), "row_key").select(shape)
    )
    return (
        rows.repartitionById(slots, F.col("slot").cast("int"))
        .sortWithinPartitions("slot", "child", "hash")
        .mapInArrow(_prober, T.StructType([T.StructField("row_key", T.StringType()), T.StructField("loaded_at", T.TimestampNTZType()), T.StructField("reason", T.StringType())]))
    )


def by_period(found: DataFrame, *keys: str, time: str = "loaded_at") -> DataFrame:
    """Counts of distinct unresolved references per ``keys``, month and reason."""
    return found.groupBy(*keys, F.date_format(time, "yyyy-MM").alias("month"), "reason").agg(F.countDistinct("row_key").alias("n_rows"))
