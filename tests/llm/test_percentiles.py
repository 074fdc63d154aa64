import math

import numpy as np
import pytest

from marlgrid.llm import percentiles as P

SCHEMA = "g string, v double, n int, means string"
Q = [0.5, 0.9, 0.99]


def certified(spark, rows, keys=("g",), parts=5, **kwargs):
    stored = P.runs(spark.createDataFrame(rows, SCHEMA).repartition(parts), "v", list(keys))
    found = P.estimates(P.digests(stored, list(keys)), list(keys), Q)
    return P.certify(stored, list(keys), found, Q, **kwargs).collect()


def test_rank_error_is_small_and_true(spark):
    rng = np.random.default_rng(1)
    values = rng.lognormal(3, 2, 40_000)
    rows = [("a" if i % 3 else "b", float(v), 1, "x") for i, v in enumerate(values)] + [("a", 5.0, 1, "x")] * 9_000
    got = certified(spark, rows)
    assert len(got) == 6
    for r in got:
        own = np.array([v for g, v, _, _ in rows if g == r.g])
        assert r.n == len(own) and r.n_below == (own < r.estimate).sum() and r.n_equal == (own == r.estimate).sum()
        assert r.rank_error <= 0.01


def test_unusable_values_nulls_and_ties(spark):
    bad = [None, float("nan"), math.inf, -math.inf, -1.0]
    rows = [(None, v, 1, "x") for v in bad] + [("t", 7.0, 1, "x")] * 50 + [("t", None, 1, "x")]
    got = {(r.g, r.q): r for r in certified(spark, rows)}
    assert got[(None, 0.5)].estimate is None and got[(None, 0.5)].n == 0 and got[(None, 0.5)].n_unusable == 5
    assert got[("t", 0.5)].estimate == 7.0 and got[("t", 0.5)].n_unusable == 1 and got[("t", 0.5)].rank_error == 0


def test_empty_and_no_keys(spark):
    assert certified(spark, []) == []
    got = certified(spark, [("a", float(i), 1, "x") for i in range(1001)], keys=())
    assert [r.estimate for r in sorted(got, key=lambda r: r.q)] == pytest.approx([500, 900, 990], abs=2)


def test_days_merge(spark):
    rng = np.random.default_rng(2)
    rows = [(f"d{i % 9}", float(v), 1, "x") for i, v in enumerate(rng.exponential(100, 20_000))]
    df = spark.createDataFrame(rows, SCHEMA)
    stored = P.digests(P.runs(df, "v", ["g"]), ["g"])
    merged = P.merge(stored, []).collect()[0]
    exact = np.quantile([r[1] for r in rows], 0.9)
    assert merged.n == 20_000 and P.quantile(np.array(merged.means), np.array(merged.weights), merged.low, merged.high, 0.9) == pytest.approx(exact, rel=0.03)


def test_cluster_sizes():
    means, weights, _ = P.cluster(np.arange(100_000.0), np.ones(100_000))
    assert len(means) <= P.DIGEST_SIZE and weights.sum() == 100_000 and weights[0] < weights[len(weights) // 2]


def test_groups_cluster_as_alone():
    rng = np.random.default_rng(3)
    values, groups = rng.exponential(9, 5000), rng.integers(0, 7, 5000)
    means, weights, own = P.cluster(values, np.ones(5000), 50, groups)
    for g in range(7):
        alone = P.cluster(values[groups == g], np.ones((groups == g).sum()), 50)
        assert np.allclose(means[own == g], alone[0]) and np.array_equal(weights[own == g], alone[1])


def test_hot_group_many_parts_and_no_broadcast(spark, monkeypatch):
    """One layer with a third of all rows; more partitions than one merge takes; estimates joined over salted runs."""
    monkeypatch.setattr(P, "BUFFER", 500)
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 3 == 0 else f"g{i % 50}", float(v), 1, "x") for i, v in enumerate(rng.lognormal(2, 1, 6000))] + [(None, 1.0, 1, "x")]
    some, other = certified(spark, rows, parts=70), certified(spark, rows, parts=70, most_broadcast=0)
    assert {(r.g, r.q): r.n_below for r in some}.keys() == {(r.g, r.q): r.n_below for r in other}.keys()
    for r in other:
        own = np.array([v for g, v, _, _ in rows if g == r.g])
        assert r.n == len(own) and r.n_below == (own < r.estimate).sum() and r.n_equal == (own == r.estimate).sum() and r.rank_error <= 0.01 + 1 / len(own)


def test_key_names(spark):
    with pytest.raises(ValueError, match="means"):
        P.runs(spark.createDataFrame([("a", 1.0, 1, "x")], SCHEMA), "v", ["means"])
