import itertools
import random

import numpy as np
import pytest

from marlgrid.operators.spatial import great_circle_m, near_join, near_joins, plan, region_join

SCHEMA = "id bigint, lat double, lng double, left_id string"


def brute(left, right, radius):
    return {(a[0], b[0]) for a in left for b in right if great_circle_m(*map(np.float64, (a[1], a[2], b[1], b[2]))) <= radius}


def usable(rows):
    return [r for r in rows if None not in r[:3] and abs(r[1]) <= 90 and abs(r[2]) <= 180]


def rows_of(df):
    return sorted((r.left_id, r.right_id) for r in df.collect())


@pytest.fixture(scope="module")
def points():
    rng = random.Random(3)
    rows = [(i, rng.uniform(-0.02, 0.02) - 20, rng.uniform(-0.02, 0.02) - 45, "x") for i in range(700)]
    rows += [(1000 + i, -20.0, -45.0, "same") for i in range(30)]  # ties: one place many times
    rows += [(2000 + i, rng.uniform(-89.99, 89.99), rng.choice([179.9999, -179.9999]), "line") for i in range(60)]
    rows += [(3000 + i, 89.9995, rng.uniform(-180, 180), "pole") for i in range(20)]
    return rows


@pytest.mark.parametrize("tile_rows", [50, 100_000])
def test_self_join(spark, points, tile_rows):
    bad = [(None, -20.0, -45.0, "n"), (9001, None, -45.0, "n"), (9002, float("nan"), -45.0, "n"), (9003, -20.0, float("inf"), "n"), (9004, 95.0, 0.0, "n")]
    df = spark.createDataFrame(points + bad, SCHEMA)
    got = rows_of(near_join(df, None, 300.0, left_cols=("id", "lat", "lng"), tile_rows=tile_rows))
    want = sorted((a, b) for a, b in brute(points, points, 300.0) if a < b)
    assert got == want and len(want) > 500


@pytest.mark.parametrize("tile_rows", [40, 100_000])
def test_two_tables(spark, points, tile_rows):
    left, right = spark.createDataFrame(points, SCHEMA), spark.createDataFrame(points[::7], SCHEMA)
    got = rows_of(near_join(left, right, 900.0, left_cols=("id", "lat", "lng"), tile_rows=tile_rows))
    assert got == sorted(brute(points, points[::7], 900.0))


def test_text_ids_and_repeated_rows(spark):
    rows = [("b", 1.0, 1.0, "k"), ("a", 1.0, 1.0, "k"), ("a", 1.0, 1.0, "k")]
    df = spark.createDataFrame(rows, "id string, lat double, lng double, left_id string")
    assert rows_of(near_join(df, None, 5.0, left_cols=("id", "lat", "lng"))) == [("a", "b"), ("a", "b")]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, 1.0, 1.0, "a")], SCHEMA)
    for a, b in itertools.product((none, some), repeat=2):
        assert near_join(a, b, 5.0, left_cols=("id", "lat", "lng")).count() == (a is some and b is some)
    assert near_join(none, None, 5.0, left_cols=("id", "lat", "lng")).count() == 0
    with pytest.raises(ValueError):
        near_join(some, None, 0.0, left_cols=("id", "lat", "lng"))


def test_one_place_many_times_and_two_joins(spark):
    """A place that holds a third of all rows is shared by a grid of tasks; both joins come from one pass."""
    rng = random.Random(5)
    rows = [(i, -20.0, -45.0, "hot") for i in range(90)] + [(100 + i, -20.0 + rng.uniform(-0.3, 0.3), -45.0 + rng.uniform(-0.3, 0.3), "x") for i in range(180)]
    other = [(i, lat + 1e-5, lng, "o") for i, lat, lng, _ in rows[::4]]
    left, right = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, "id int, lat double, lng double, left_id string")
    got = [tuple(r) for r in near_joins(left, ("id", "lat", "lng"), [(None, None, 40.0), (right, ("id", "lat", "lng"), 2000.0)], tile_rows=30).collect()]
    want = [(0, a, b) for a, b in brute(rows, rows, 40.0) if a < b] + [(1, a, b) for a, b in brute(rows, other, 2000.0)]
    assert sorted(got) == sorted(want)


def test_plan_follows_both_sides(spark):
    """One probe row against many build rows is no single task, and a heavy strip is cut by longitude."""
    one = spark.createDataFrame([(-20.0, -45.0)], "lat double, lng double")
    many = spark.range(3000).selectExpr("-20.0D + id / 1e9 AS lat", "-60.0D + id / 100 AS lng")
    tiles = plan(one, [many], 0.001, lambda lat: np.full(len(lat), 0.001), 100)
    assert len(tiles) >= 30
    at, task = tiles.owners(np.array([-20.0]), np.array([-45.0]))
    assert len(task) == 1
    _, near = tiles.near(np.full(1, -20.001), np.full(1, -19.999), np.full(1, -45.001), np.full(1, -44.999))
    assert set(task) <= set(near) and len(near) <= 4


@pytest.mark.parametrize("tile_rows", [60, 100_000])
def test_regions(spark, points, tile_rows):
    boxes = [(i, -20.02 + i / 1000, -20.015 + i / 1000, -45.01, -44.99) for i in range(12)] + [(50, -90.0, 90.0, 179.0, -179.0), (51, None, 1.0, 0.0, 1.0), (None, -90.0, 90.0, -180.0, 180.0), (52, 5.0, 1.0, 0.0, 1.0)]
    df = spark.createDataFrame(points, SCHEMA)
    regions = spark.createDataFrame(boxes, "region int, south double, north double, west double, east double")
    got = rows_of(region_join(df, regions, point_cols=("id", "lat", "lng"), region_cols=("region", "south", "north", "west", "east"), tile_rows=tile_rows))

    def holds(p, b):
        if None in b or b[1] > b[2] or not b[1] <= p[1] <= b[2]:
            return False
        return b[3] <= p[2] <= b[4] if b[3] <= b[4] else p[2] >= b[3] or p[2] <= b[4]

    assert got == sorted((p[0], b[0]) for p in points for b in boxes if holds(p, b)) and len(got) > 100
    assert region_join(df, regions.limit(0), point_cols=("id", "lat", "lng"), region_cols=("region", "south", "north", "west", "east")).count() == 0
