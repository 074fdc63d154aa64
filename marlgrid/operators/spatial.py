"""Points near other points or in regions: a distributed sweep over latitude strips.

Latitude is cut into strips of about equal row counts by an exact histogram over
at most ``CELLS`` equal cells, none lower than twice the reach of the join.  A strip
that stays too heavy is cut by longitude in the same way, and a tile that is heavy
where it cannot be cut any more (one place many times) is shared by a grid of tasks,
each with a share of its probe rows and a share of its build rows.  So no task holds
more than its wanted rows, whichever side is large, and the plan's size is that of
the task list and not of the data.

A probe row belongs to exactly one tile; a build row is copied into every tile
within the radius, at most two strips high.  Inside a tile the build rows are
ordered by latitude band and longitude, and a sweep over the active bands takes the
longitude window of each probe row; great-circle distance then decides.  A pair is
found only in the tile that owns its probe row, so no pair comes out twice and no
de-duplication shuffle is needed.  Several joins of one probe table share one
histogram, one exchange and one sort.

Rows with a null, NaN or infinite coordinate, a latitude beyond +-90, a longitude
beyond +-180 or a null id take no part.  Repeated rows are rows of their own.  Empty
inputs give an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

EARTH_RADIUS_M = 6_371_008.8
#: Candidate pairs verified at a time inside one task.
CHUNK = 2_000_000
#: Latitude cells of the histogram, and longitude cells per wanted piece of a heavy strip.
CELLS, FINER = 1 << 16, 16
#: Wanted rows of a task, and tasks beyond which it gets more.
TILE_ROWS, MOST_TILES = 150_000, 50_000
PROBE = 0  # the kind of a row; build rows of the k-th join are k + 1


def usable(lat: Column, lng: Column) -> Column:
    """Whether a coordinate can be placed on the sphere."""
    return lat.between(-90.0, 90.0) & lng.between(-180.0, 180.0)


def great_circle_m(lat1, lng1, lat2, lng2):
    """Haversine distance in metres of arrays of degrees."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def longitude_reach(lat, radius_m: float):
    """Degrees of longitude that a circle around each latitude can span."""
    margin = radius_m / EARTH_RADIUS_M
    top = np.minimum(np.radians(np.abs(lat)) + margin, np.pi / 2)
    ratio = np.sin(min(margin, np.pi / 2)) / np.maximum(np.cos(top), 1e-12)
    return np.where(ratio >= 1, 360.0, np.degrees(np.arcsin(np.minimum(ratio, 1.0)))) * (1 + 1e-9) + 1e-9


@dataclass(frozen=True)
class Tiles:
    """Strips of latitude, cut by longitude where they are heavy, and the tasks of each piece.

    ``south`` holds the strips' lower edges but the first; ``keys`` holds, in order,
    strip * ``TURN`` + the western edge of every piece; ``first`` is a piece's first
    task, which has ``probes`` x ``builds`` of them.
    """

    south: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    probes: np.ndarray
    builds: np.ndarray

    def __len__(self) -> int:
        return int((self.probes * self.builds).sum())

    def strip(self, lat) -> np.ndarray:
        return np.searchsorted(self.south, lat, side="right")

    def piece(self, strip, lng) -> np.ndarray:
        return np.searchsorted(self.keys, strip * TURN + lng, side="right") - 1

    def owners(self, lat, lng) -> tuple[np.ndarray, np.ndarray]:
        """All tasks of each probe row: (position, task); one but in shared pieces."""
        piece = self.piece(self.strip(lat), lng)
        share = np.arange(len(lat)) % self.probes[piece]
        at, step = _repeated(self.builds[piece])
        return at, (self.first[piece] + share * self.builds[piece])[at] + step

    def near(self, south, north, west, east) -> tuple[np.ndarray, np.ndarray]:
        """All tasks that meet each rectangle: (position, task); one per share of the probe rows."""
        low = self.strip(south)
        at, step = _repeated(self.strip(north) - low + 1)
        strip = low[at] + step
        left = self.piece(strip, west[at])
        each, step = _repeated(self.piece(strip, east[at]) - left + 1)
        piece = left[each] + step
        share = np.arange(len(south))[at[each]] % self.builds[piece]
        every, step = _repeated(self.probes[piece])
        return at[each][every], (self.first[piece] + share)[every] + step * self.builds[piece][every]


#: More than any two longitudes, shifted copies included, can differ.
TURN = 4000.0


def _repeated(count) -> tuple[np.ndarray, np.ndarray]:
    """Positions repeated by their count, and the step within each repetition."""
    at = np.repeat(np.arange(len(count)), count)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)


def _grouped(counts: np.ndarray, wanted: int) -> np.ndarray:
    """First cells of groups of neighbouring cells that hold ``wanted`` rows at most, or are one cell."""
    starts, held = [0], 0
    for cell in np.flatnonzero(counts).tolist():
        n = int(counts[cell])
        if held and held + n > wanted and cell != starts[-1]:
            starts.append(cell)
            held = 0
        held += n
    return np.array(starts, dtype="int64")


def plan(probe: DataFrame, builds: Sequence[DataFrame], margin: float, reach_of, tile_rows: int = TILE_ROWS) -> Tiles:
    """Tiles for rows with columns lat and lng: one pass over both sides, a second over heavy strips only.

    ``margin`` is how far in latitude, ``reach_of`` (of an array of latitudes) how
    far in longitude a build row is copied.
    """
    height = max(180.0 / CELLS, 2 * margin)
    cells = int(np.ceil(180.0 / height)) + 1
    rows = None
    for df, side in ((probe, "p"), *((b, "b") for b in builds)):
        one = df.select("lat", "lng", F.lit(side).alias("side"))
        rows = one if rows is None else rows.unionAll(one)
    counted = rows.groupBy(F.floor((F.col("lat") + 90.0) / height).cast("int").alias("cell"), "side").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {side: np.zeros(cells, dtype="int64") for side in "pb"}
    for r in counted:
        counts[r["side"]][min(r["cell"], cells - 1)] += r["n"]
    whole = counts["p"] + counts["b"]
    wanted = max(tile_rows, -(-int(whole.sum()) // MOST_TILES))
    starts = _grouped(whole, wanted)
    south = starts[1:] * height - 90.0
    held = {side: np.add.reduceat(c, starts) for side, c in counts.items()}
    total = held["p"] + held["b"]

    heavy = np.flatnonzero(total > wanted)
    middle = np.concatenate([[-90.0], south]) + height / 2
    width = np.maximum(2 * reach_of(np.minimum(np.abs(middle) + height, 90.0)), 360.0 / (FINER * np.maximum(1, -(-total // wanted))))
    found: dict[int, dict[str, np.ndarray]] = {int(i): {side: np.zeros(int(np.ceil(360.0 / width[i])) + 1, dtype="int64") for side in "pb"} for i in heavy}
    if len(heavy):
        is_heavy = np.isin(np.arange(len(starts)), heavy)

        def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows per (strip, cell of longitude, side), of heavy strips."""
            for batch in batches:
                lat, lng = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                strip = np.searchsorted(south, lat, side="right")
                kept = is_heavy[strip]
                is_probe = np.asarray(batch.column(2).to_pylist(), dtype=object)[kept] == "p"
                strip, lng = strip[kept], lng[kept]
                if len(strip):
                    cell = np.floor((lng + 180.0) / width[strip]).astype("int64")
                    keys, n = np.unique(np.stack([strip, cell, is_probe.astype("int64")]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(keys[2]), pa.array(n.astype("int64"))], names=["strip", "cell", "probe", "n"])

        for r in rows.mapInArrow(along, "strip bigint, cell bigint, probe bigint, n bigint").groupBy("strip", "cell", "probe").agg(F.sum("n").alias("n")).collect():
            line = found[r["strip"]]["p" if r["probe"] else "b"]
            line[min(r["cell"], len(line) - 1)] += r["n"]

    keys, probes, shares = [], [], []
    for i in range(len(starts)):
        if i in found:
            line = found[i]
            cuts = _grouped(line["p"] + line["b"], wanted)
            p, b = (np.add.reduceat(line[side], cuts) for side in "pb")
            over = p + b > wanted
            keys += [i * TURN - 1500.0, *(i * TURN - 180.0 + cuts[1:] * width[i])]
            probes += np.where(over, np.maximum(1, -(-p // wanted)), 1).tolist()
            shares += np.where(over, np.maximum(1, -(-b // wanted)), 1).tolist()
        else:
            keys.append(i * TURN - 1500.0)
            probes.append(1)
            shares.append(1)
    probes, shares = np.array(probes, dtype="int64"), np.array(shares, dtype="int64")
    return Tiles(south, np.array(keys), np.concatenate([[0], np.cumsum(probes * shares)[:-1]]), probes, shares)


def _batch(task, kind: int, ids: pa.Array, at, *columns) -> pa.RecordBatch:
    names = ["lat", "lng"] if len(columns) == 2 else ["south", "north", "west", "east"]
    return pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), pa.array(np.full(len(task), kind, "int8")), ids.take(pa.array(at)), *(pa.array(c) for c in columns)], names=["task", "kind", "id", *names])


def _probes(tiles: Tiles, box: bool = False):
    """Batches of (id, lat, lng) -> the row in the tasks that own it; as a box without extent if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lat, lng = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                at, task = tiles.owners(lat, lng)
                yield _batch(task, PROBE, batch.column(0), at, *((lat[at], lat[at], lng[at], lng[at]) if box else (lat[at], lng[at])))

    return run


def _builds(tiles: Tiles, kind: int, radius_m: float, same: bool):
    """Batches of (id, lat, lng) -> the row in every task within the radius.

    Of a table joined with itself the probe rows are build rows where they stand,
    so only copies for other tasks are made.
    """
    margin = _margin(radius_m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            lat, lng = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            reach = longitude_reach(np.minimum(np.abs(lat) + margin, 90.0), radius_m) * 1.01 + 1e-6
            # Beyond the date line the same place lies 360 degrees on.
            for shift, edge in ((0.0, np.full(len(lat), True)), (360.0, lng < -180 + reach), (-360.0, lng > 180 - reach)):
                which = np.flatnonzero(edge)
                if not len(which):
                    continue
                moved = lng[which] + shift
                at, task = tiles.near(lat[which] - margin, lat[which] + margin, moved - reach[which], moved + reach[which])
                if same and not shift:
                    piece = tiles.piece(tiles.strip(lat[which]), lng[which])
                    home = (tiles.probes[piece] == 1) & (tiles.builds[piece] == 1)
                    other = ~(home[at] & (task == tiles.first[piece][at]))
                    at, task = at[other], task[other]
                if len(at):
                    yield _batch(task, kind, ids, which[at], lat[which][at], moved[at])

    return run


def _margin(radius_m: float) -> float:
    return float(np.degrees(radius_m / EARTH_RADIUS_M)) * (1 + 1e-9) + 1e-12


def sweep(p_lat, p_lng, b_lat, b_lng, radius_m: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (probe, build) of all pairs within the radius, in bounded chunks.

    Build rows stand in bands one radius high, ordered by longitude; the active
    set of a probe row is its own band and the two beside it.
    """
    if not len(p_lat) or not len(b_lat):
        return
    band_height = np.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9) + 1e-12
    base = min(p_lat.min(), b_lat.min()) - 2 * band_height
    b_band, p_band = np.floor((b_lat - base) / band_height), np.floor((p_lat - base) / band_height)
    b_key = b_band * TURN + b_lng
    order = np.argsort(b_key, kind="stable")
    b_key = b_key[order]
    reach = longitude_reach(p_lat, radius_m)
    slack = 4 * np.spacing(max(abs(b_key[0]), abs(b_key[-1]), 1.0))
    for side in (-1, 0, 1):
        middle = (p_band + side) * TURN + p_lng
        low = np.searchsorted(b_key, middle - reach - slack, side="left")
        high = np.searchsorted(b_key, middle + reach + slack, side="right")
        count = np.maximum(high - low, 0)
        ends = np.cumsum(count)
        begin = 0
        while begin < len(count):
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
            part = count[begin:stop]
            total = int(part.sum())
            # A single row with a very long window is still taken in pieces.
            for piece in range(0, total, CHUNK) if stop == begin + 1 else (0,):
                size = min(CHUNK, total - piece) if stop == begin + 1 else total
                if not size:
                    continue
                if stop == begin + 1:
                    probe = np.full(size, begin)
                    build = low[begin] + piece + np.arange(size)
                else:
                    probe = np.repeat(np.arange(begin, stop), part)
                    build = np.arange(size) - np.repeat(np.cumsum(part) - part, part) + low[probe]
                build = order[build]
                near = great_circle_m(p_lat[probe], p_lng[probe], b_lat[build], b_lng[build]) <= radius_m
                # Of a build row and its copies beyond the date line, the nearest in longitude counts.
                turn = b_lng[build] - p_lng[probe]
                near &= (turn > -180.0) & (turn <= 180.0)
                if near.any():
                    yield probe[near], build[near]
            begin = stop


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Batches ordered by task -> each task's rows."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        task = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if current is not None and task[a] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = int(task[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def _sweeper(radii: list[float], same: list[bool], shared: np.ndarray):
    """Batches ordered by task -> (join, left_id, right_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, group in _tasks(batches):
            kind = group.column("kind").to_numpy()
            lat, lng = group.column("lat").to_numpy(), group.column("lng").to_numpy()
            ids = group.column("id").combine_chunks()
            probe_at = np.flatnonzero(kind == PROBE)
            ordered = None
            for n, (radius_m, own) in enumerate(zip(radii, same)):
                # Where a piece is one task, the probe rows of a self-join are build rows too.
                build_at = np.flatnonzero((kind == n + 1) | ((kind == PROBE) & (own and not shared[task])))
                if own and ordered is None:
                    ordered = ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.asarray(ids.to_pylist(), dtype=object)
                for p, b in sweep(lat[probe_at], lng[probe_at], lat[build_at], lng[build_at], radius_m):
                    p, b = probe_at[p], build_at[b]
                    if own:
                        first = (ordered[p] < ordered[b]).astype(bool)
                        p, b = p[first], b[first]
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), n, "int32")), ids.take(pa.array(p)), ids.take(pa.array(b))], names=["target", "left_id", "right_id"])

    return run


def _common(types: list[T.DataType]) -> T.DataType:
    """One type for the ids of all sides."""
    if all(t == types[0] for t in types):
        return types[0]
    return T.LongType() if all(isinstance(t, T.IntegralType) for t in types) else T.StringType()


def _points(df: DataFrame, cols: tuple[str, str, str]) -> DataFrame:
    key, lat, lng = (df[c] for c in cols)
    lat, lng = lat.cast("double"), lng.cast("double")
    return df.where(key.isNotNull() & usable(lat, lng)).select(key.alias("id"), lat.alias("lat"), lng.alias("lng"))


def near_joins(left: DataFrame, left_cols: tuple[str, str, str], targets: Sequence[tuple[DataFrame | None, tuple[str, str, str] | None, float]], *, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs (target, left_id, right_id) of several joins of one table, in one pass.

    Each target is (right, its columns, radius in metres); ``target`` is its
    position.  Columns name (id, latitude, longitude).  With ``right`` None the
    table is joined with itself: each unordered pair once, the smaller id left; a
    row is no partner of itself or of rows with its id.  The ids come in one type:
    that of all sides, bigint for integers of different width, else string.
    ``tile_rows`` is the wanted number of rows in a task.
    """
    if not targets or not all(radius > 0 for _, _, radius in targets):
        raise ValueError("radii must be positive")
    probe = _points(left, left_cols)
    builds = [(None if right is None else _points(right, cols or left_cols)) for right, cols, _ in targets]
    common = _common([probe.schema["id"].dataType, *(b.schema["id"].dataType for b in builds if b is not None)])
    probe, builds = probe.withColumn("id", F.col("id").cast(common)), [None if b is None else b.withColumn("id", F.col("id").cast(common)) for b in builds]
    widest = max(radius for _, _, radius in targets)
    tiles = plan(probe, [b for b in builds if b is not None], _margin(widest), lambda lat: longitude_reach(lat, widest), tile_rows)

    schema = T.StructType([T.StructField("task", T.LongType()), T.StructField("kind", T.ByteType()), T.StructField("id", common), T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])
    own = [(n, radius) for n, (right, _, radius) in enumerate(targets) if right is None]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = [_probes(tiles), *(_builds(tiles, n + 1, radius, True) for n, radius in own)]
        for batch in batches:
            for make in makers:
                yield from make(iter([batch]))

    rows = probe.mapInArrow(spread, schema)
    for n, (b, (_, _, radius)) in enumerate(zip(builds, targets)):
        if b is not None:
            rows = rows.unionAll(b.mapInArrow(_builds(tiles, n + 1, radius, False), schema))
    found = T.StructType([T.StructField("target", T.IntegerType()), T.StructField("left_id", common), T.StructField("right_id", common)])
    shared = np.repeat(tiles.probes * tiles.builds > 1, tiles.probes * tiles.builds)
    # The task number is the partition number, so the exchange needs no sampling pass.
    return (
        rows.repartitionById(len(tiles), F.col("task").cast("int"))
        .sortWithinPartitions("task")
        .mapInArrow(_sweeper([radius for _, _, radius in targets], [right is None for right, _, _ in targets], shared), found)
    )


def near_join(left: DataFrame, right: DataFrame | None, radius_m: float, *, left_cols: tuple[str, str, str], right_cols: tuple[str, str, str] | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs (left_id, right_id) at most ``radius_m`` apart; see ``near_joins``."""
    pairs = near_joins(left, left_cols, [(right, right_cols, radius_m)], tile_rows=tile_rows)
    other = (left if right is None else right).schema[(right_cols or left_cols)[0]].dataType
    return pairs.select(F.col("left_id").cast(left.schema[left_cols[0]].dataType).alias("left_id"), F.col("right_id").cast(other).alias("right_id"))


def _boxes(tiles: Tiles):
    """Batches of (id, south, north, west, east) -> a row per task that the box meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sides = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)]
                at, task = tiles.near(*sides)
                yield _batch(task, PROBE + 1, batch.column(0), at, *(v[at] for v in sides))

    return run


def _box_sweeper(left_type: pa.DataType, right_type: pa.DataType):
    """Batches ordered by task -> (point, region) where the box holds the point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _tasks(batches):
            kind, ids = group.column("kind").to_numpy(), group.column("id").combine_chunks()
            south, north, west, east = (group.column(c).to_numpy() for c in ("south", "north", "west", "east"))
            points, boxes = np.flatnonzero(kind == PROBE), np.flatnonzero(kind != PROBE)
            points = points[np.argsort(west[points], kind="stable")]
            lng, lat = west[points], south[points]
            low, high = np.searchsorted(lng, west[boxes], side="left"), np.searchsorted(lng, east[boxes], side="right")
            # Windows of many boxes at a time, in pieces of bounded size.
            ends = np.cumsum(np.maximum(high - low, 0))
            total = int(ends[-1]) if len(ends) else 0
            for begin in range(0, total, CHUNK):
                place = np.arange(begin, min(total, begin + CHUNK))
                box = np.searchsorted(ends, place, side="right")
                at = low[box] + place - (ends[box] - (high - low)[box])
                inside = (lat[at] >= south[boxes[box]]) & (lat[at] <= north[boxes[box]])
                if inside.any():
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(points[at[inside]])).cast(left_type), ids.take(pa.array(boxes[box[inside]])).cast(right_type)], names=["left_id", "right_id"])

    return run


def region_join(points: DataFrame, regions: DataFrame, *, point_cols: tuple[str, str, str], region_cols: tuple[str, str, str, str, str], tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs (left_id, right_id) of points and the bounding boxes that hold them, edges included.

    ``region_cols`` names (id, south, north, west, east).  A box whose west lies
    east of its east crosses the date line.  Boxes with a null, NaN or unordered
    latitude hold nothing; points are as in ``near_joins``.  A region of another
    shape is its box here and a test of the pairs afterwards.
    """
    probe = _points(points, point_cols)
    name, south, north, west, east = (regions[c] for c in region_cols)
    south, north, west, east = (c.cast("double") for c in (south, north, west, east))
    sound = name.isNotNull() & (south <= north) & ~F.isnan(north) & west.between(-180, 180) & east.between(-180, 180)
    span = F.when(west <= east, F.array(F.struct(west.alias("w"), east.alias("e")))).otherwise(F.array(F.struct(west.alias("w"), F.lit(180.0).alias("e")), F.struct(F.lit(-180.0).alias("w"), east.alias("e"))))
    build = regions.where(sound).select(name.alias("id"), south.alias("south"), north.alias("north"), F.explode(span).alias("s")).select("id", "south", "north", F.col("s.w").alias("west"), F.col("s.e").alias("east"))
    left_type, right_type = probe.schema["id"].dataType, build.schema["id"].dataType
    common = _common([left_type, right_type])
    probe, build = (x.withColumn("id", F.col("id").cast(common)) for x in (probe, build))
    # A box is counted where its south-west corner lies; it is copied into what it meets, whatever the plan.
    corners = build.select(F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("south"))).alias("lat"), F.col("west").alias("lng"))
    tiles = plan(probe, [corners], 0.0, lambda lat: np.zeros(len(lat)), tile_rows)
    schema = T.StructType([T.StructField("task", T.LongType()), T.StructField("kind", T.ByteType()), T.StructField("id", common)] + [T.StructField(c, T.DoubleType()) for c in ("south", "north", "west", "east")])
    spread = probe.mapInArrow(_probes(tiles, box=True), schema).unionAll(build.mapInArrow(_boxes(tiles), schema))
    found = T.StructType([T.StructField("left_id", left_type), T.StructField("right_id", right_type)])
    return spread.repartitionById(len(tiles), F.col("task").cast("int")).sortWithinPartitions("task").mapInArrow(_box_sweeper(to_arrow_type(left_type), to_arrow_type(right_type)), found)
