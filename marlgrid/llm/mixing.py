"""Mix sources to target shares of the total size by Poisson replication.

Every document draws its count of copies from a Poisson distribution by inverting
it at a uniform number that a seeded hash of its key gives, so the draw is the
same wherever and whenever it runs.  A count never exceeds the source's cap; the
distribution's mean is chosen so that the capped draw has the wanted mean.  Since
a source's size is a rising step function of that mean, a few passes of sums over
the stored sizes then settle each source's mean on its target, whatever its
sizes' spread.  The documents are exploded by their counts and shuffled globally
by another hash of key and copy.

Sources without documents cannot contribute: their share is divided among the
others in proportion, and the report says so.  Documents of sources that are not
asked for, and of no source, are not drawn; empty documents are drawn and weigh
nothing.  A target of 0 or a cap of 0 draws nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Means tried per source and pass, and passes.
TRIES, PASSES = 32, 3


def _uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from a seeded hash."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def capped_mean(rate: float, cap: int) -> float:
    """Mean of a Poisson draw of ``rate`` that is cut at ``cap``."""
    p, below, mean = math.exp(-rate), 0.0, 0.0
    for k in range(cap):
        mean += k * p
        below += p
        p *= rate / (k + 1)
    return mean + cap * (1.0 - below)


def rate_for(mean: float, cap: int) -> float:
    """The Poisson rate whose draw, cut at ``cap``, has that mean."""
    if mean <= 0:
        return 0.0
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < mean and high < 700:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if capped_mean(middle, cap) < mean else (low, middle)
    return high


def thresholds(rate: float, cap: int) -> list[float]:
    """Values of the distribution function: a uniform u draws as many copies as values lie below it."""
    p, total, out = math.exp(-min(rate, 700.0)), 0.0, []
    for k in range(cap):
        total += p
        out.append(min(1.0, total))
        p *= rate / (k + 1)
    return out


def _draw(uniform: Column, limits: Column) -> Column:
    """Copies that a uniform number draws."""
    return F.size(F.filter(limits, lambda x: x < uniform))


def _by_source(spark, limits: dict[str, object], kind: str) -> DataFrame:
    """A row per source (as few as there are targets) with its limits."""
    return F.broadcast(spark.createDataFrame(list(limits.items()), f"for_source string, limits {kind}"))


def plan(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: str = "mix") -> tuple[dict[str, tuple[float, int, float]], float]:
    """Per source (rate, cap, target share) and the total size aimed at.

    ``sized`` has key, source, size; ``targets`` source, target_share,
    max_repeats: one row per source, read by the driver.  Without ``total`` the
    largest total is taken that every source with documents can serve.
    """
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").collect()}
    # Sums of the listed sources only: as many rows as there are targets.
    listed = sized.where(F.col("source").isin(list(wanted)) if wanted else F.lit(False))
    weight = {r["source"]: float(r["w"] or 0) for r in listed.groupBy("source").agg(F.sum("size").alias("w")).collect()}
    present = {s: v for s, v in wanted.items() if weight.get(s, 0) > 0}
    whole = sum(share for share, _ in present.values())
    if not present:
        return {}, 0.0
    reachable = min(cap * weight[s] * whole / share for s, (share, cap) in present.items())
    aim = reachable if total is None else min(float(total), reachable)
    goal = {s: aim * share / whole for s, (share, _) in present.items()}
    rates = {s: rate_for(goal[s] / weight[s], present[s][1]) for s in present}
    bounds = {s: (rates[s] * 0.5, rates[s] * 2.0) if goal[s] < weight[s] * present[s][1] * (1 - 1e-9) else None for s in present}

    for _ in range(PASSES):
        open_ = {s: b for s, b in bounds.items() if b}
        if not open_:
            break
        grid = {s: [b[0] + (b[1] - b[0]) * i / (TRIES - 1) for i in range(TRIES)] for s, b in open_.items()}
        tried = _by_source(sized.sparkSession, {s: [thresholds(x, present[s][1]) for x in grid[s]] for s in open_}, "array<array<double>>")
        drawn = listed.join(tried, F.col("source") == F.col("for_source")).withColumn("u", _uniform(F.col("key"), seed))
        drawn = drawn.select("source", F.transform("limits", lambda x: _draw(F.col("u"), x) * F.col("size")).alias("t"))
        found = drawn.groupBy("source").agg(*[F.sum(F.col("t")[i]).alias(f"t{i}") for i in range(TRIES)]).collect()
        for row in found:
            s, sums_ = row["source"], [float(row[f"t{i}"] or 0) for i in range(TRIES)]
            above = next((i for i, x in enumerate(sums_) if x >= goal[s]), TRIES - 1)
            below = max(0, above - 1)
            rates[s] = grid[s][above if abs(sums_[above] - goal[s]) <= abs(sums_[below] - goal[s]) else below]
            bounds[s] = (grid[s][below], grid[s][above]) if above else None
    return {s: (rates[s] if bounds[s] is not None or goal[s] < weight[s] * present[s][1] * (1 - 1e-9) else math.inf, present[s][1], present[s][0] / whole) for s in present}, aim


def replicate(sized: DataFrame, chosen: dict[str, tuple[float, int, float]], seed: str = "mix") -> DataFrame:
    """Rows (key, source, size, copy) of the mix: each document as often as it draws."""
    # A source that must be taken as often as its cap allows draws at limits below every uniform number.
    limits = {s: [-1.0] * cap if math.isinf(rate) else thresholds(rate, cap) for s, (rate, cap, _) in chosen.items()}
    counted = sized.join(_by_source(sized.sparkSession, limits, "array<double>"), F.col("source") == F.col("for_source")).withColumn("copies", _draw(_uniform(F.col("key"), seed), F.col("limits"))).where("copies > 0")
    return counted.select("key", "source", "size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def shuffled(mix: DataFrame, seed: str = "order", partitions: int | None = None) -> DataFrame:
    """The mix in one global random order, range-partitioned and sorted by ``order_key``."""
    keyed = mix.withColumn("order_key", F.xxhash64("key", "copy", F.lit(seed)))
    ranged = keyed.repartitionByRange(partitions, "order_key", "key", "copy") if partitions else keyed.repartitionByRange("order_key", "key", "copy")
    return ranged.sortWithinPartitions("order_key", "key", "copy")


def shares(mix: DataFrame, sized: DataFrame, targets: DataFrame, chosen: dict[str, tuple[float, int, float]]) -> DataFrame:
    """Per source: wanted and reached share of the mix, documents, copies and the most repeats."""
    spark = mix.sparkSession
    each = mix.groupBy("source", "key").agg(F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"))
    drawn = each.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_repeats"))
    served = spark.createDataFrame([(s, float(share)) for s, (_, _, share) in chosen.items()], "served string, served_share double")
    total = drawn.agg(F.sum("n_tokens").alias("all_tokens"))
    asked = targets.select("source", "target_share", "max_repeats")
    joined = asked.join(drawn, "source", "left").join(served, F.col("source") == F.col("served"), "left").crossJoin(F.broadcast(total))
    return joined.select(
        "source", "target_share", F.coalesce("served_share", F.lit(0.0)).alias("served_share"), (F.coalesce("n_tokens", F.lit(0)) / F.col("all_tokens")).alias("actual_share"),
        F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats",
    )
