import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from marlgrid.operators import references
from marlgrid.operators.references import CELLS, by_period, lay_out, unresolved

DAY = dt.datetime(2024, 1, 10)
C = "ref string, row string, loaded_at timestamp_ntz, reason string, hash string"
P = "k string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, slot int"


def day(n):
    return DAY + dt.timedelta(days=n)


def check(spark, child, parent, **more):
    c, p = spark.createDataFrame(child, C), spark.createDataFrame(parent, P)
    found = unresolved(c, p, reference=F.col("ref"), row_key=F.col("row"), parent_key=F.col("k"), child_loaded=F.col("loaded_at"), parent_loaded=F.col("loaded_at"), parent_deleted=F.col("deleted_at"), **more)
    return sorted((r.row_key, r.reason) for r in found.collect())


def test_reasons(spark):
    parent = [("A1", day(0), None, 1), ("b2", day(0), day(3), 1), ("c3", day(9), None, 1), (None, day(0), None, 1), ("d4", day(8), day(1), 1), ("e5", day(0), day(2), 1), ("e5", day(0), None, 1)]
    child = [
        (" a1 ", "ok", day(1), "x", "y"), ("B2", "before", day(2), "x", "y"), ("b2", "gone", day(3), "x", "y"), ("c3", "early", day(8), "x", "y"), ("c3", "same", day(9), "x", "y"),
        (None, "null", day(1), "x", "y"), ("zz", "lost", day(1), "x", "y"), ("b2", "no time", None, "x", "y"), ("d4", "both", day(2), "x", "y"), ("e5", "half", day(9), "x", "y"), ("", "empty", day(1), "x", "y"),
    ]
    want = [("both", "deleted"), ("both", "late"), ("early", "late"), ("empty", "missing"), ("gone", "deleted"), ("lost", "missing")]
    assert check(spark, child, parent) == want
    assert check(spark, child, parent, slot_rows=2) == want


def test_hot_key_and_many_ranges(spark):
    parent = [(f"k{i}", day(0), None, 1) for i in range(300)] + [("hot", day(5), None, 1)]
    child = [("hot", f"h{i}", day(i % 9), "x", "y") for i in range(900)] + [(f"k{i}", f"r{i}", day(1), "x", "y") for i in range(0, 600, 2)]
    got = check(spark, child, parent, slot_rows=40)
    assert [x for x in got if x[1] == "late"] == sorted((f"h{i}", "late") for i in range(900) if i % 9 < 5)
    assert [x for x in got if x[1] == "missing"] == sorted((f"r{i}", "missing") for i in range(300, 600, 2))


def test_empty_and_copies(spark):
    child = [("a", "r1", day(1), "x", "y")] * 2
    assert check(spark, child, []) == [("r1", "missing")] * 2
    assert check(spark, [], [("a", day(0), None, 1)]) == []


def test_by_period(spark):
    found = spark.createDataFrame([("t", "r1", day(0), "late"), ("t", "r1", day(0), "late"), ("t", "r2", day(40), "late")], "name string, row_key string, loaded_at timestamp_ntz, reason string")
    assert sorted(tuple(r) for r in by_period(found, "name").collect()) == [("t", "2024-01", "late", 1), ("t", "2024-02", "late", 1)]


def test_layout():
    """Light cells share slots; many parents give ranges, a hot key shares; no slot beyond its rows."""
    load = np.full(CELLS, 10)
    first, ranges, shares, slots = lay_out(load, CELLS * 10, 1000)
    assert slots == -(-CELLS * 20 // 1000) and (np.diff(first) >= 0).all() and first[-1] == slots - 1 and set(ranges) == set(shares) == {1}
    load[7] = 1_000_000
    first, ranges, shares, slots = lay_out(load, CELLS * 10, 1000)
    assert shares[7] == 1000 and first[8] - first[7] == 1000 and first[7] == 1
    first, ranges, shares, slots = lay_out(load, CELLS * 5000, 1000)
    assert set(ranges) == {5} and shares[7] == 200 and slots == 5 * (CELLS - 1) + 1000 and first[8] - first[7] == 1000


def test_many_ranges_in_a_cell(spark, monkeypatch):
    monkeypatch.setattr(references, "CELL_BITS", 2)
    monkeypatch.setattr(references, "CELLS", 4)
    parent = [(f"k{i}", day(0), None, 1) for i in range(300)]
    child = [(f"k{i}", f"r{i}", day(1), "x", "y") for i in range(0, 600, 3)] + [("k0", f"h{i}", day(1), "x", "y") for i in range(300)]
    assert check(spark, child, parent, slot_rows=20) == sorted((f"r{i}", "missing") for i in range(300, 600, 3))
