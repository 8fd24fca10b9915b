"""Statistics of whole tables and long series against plain versions."""

import math

import numpy as np
import pytest

from tidewheel.functions import series as S
from tidewheel.operators import analysis, anomaly


def tau(x, y):
    ok = ~(np.isnan(x) | np.isnan(y))
    a, b = np.sign(x[ok][:, None] - x[ok]), np.sign(y[ok][:, None] - y[ok])
    return (a * b).sum() / math.sqrt((a != 0).sum() * (b != 0).sum())


def test_weighted_inversions_by_pairs():
    r = np.random.default_rng(5)
    rank, w = r.integers(0, 9, 80), r.integers(0, 5, 80)
    plain = lambda w: sum(int(w[i]) * int(w[j]) for i in range(80) for j in range(i) if rank[j] > rank[i])
    assert S.inversions(rank, w) == plain(w) and S.inversions(rank) == plain(np.ones(80, int))
    assert S.inversions(rank, w * 10**9) == plain(w) * 10**18


@pytest.mark.parametrize("rows", [30, 200, 10_000])
def test_kendall_of_a_whole_table_by_pairs(spark, rows):
    """A frequent value on each axis, ties, repeated rows, missing values; parts within parts with ``rows`` of 30."""
    r = np.random.default_rng(rows)
    x, y = r.normal(size=900).round(2), r.normal(size=900).round(2)
    y += x.round(1)
    x[r.random(900) < 0.3] = 0.5
    y[r.random(900) < 0.3] = -1.0
    y[:10] = np.nan
    table = spark.createDataFrame([(float(a), None if i % 97 == 20 else float(b)) for i, (a, b) in enumerate(zip(x, y))], "a double, b double")
    y[[i for i in range(900) if i % 97 == 20]] = np.nan
    (got,) = analysis._kendall_of_all(table, ["a", "b"], rows).collect()
    assert (got["a"], got["b"]) == ("a", "b") and abs(got["corr"] - tau(x, y)) < 1e-12


def test_kendall_of_a_whole_table_without_pairs(spark):
    for rows in ([], [(1.0, 2.0)], [(1.0, 2.0), (1.0, 3.0)], [(None, 2.0), (1.0, None)]):
        (got,) = analysis.correlation(spark.createDataFrame(rows, "a double, b double"), "k", "t", ["a", "b"], "kendall").collect()
        assert math.isnan(got["corr"])


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_long_autocorrelation_by_direct_sums(spark, block):
    """Two series, one with gaps, over blocks shorter than the series; a constant series is NULL."""
    r = np.random.default_rng(block)
    rows = [("a", i, float(v)) for i, v in enumerate(r.normal(size=50))] + [("b", i, float(v)) for i, v in enumerate(r.normal(size=31)) if i % 5] + [("c", i, 1.0) for i in range(6)] + [("a", 50, None)]
    got = {(x["k"], x["lag"]): x["acf"] for x in analysis.acf_long(spark.createDataFrame(rows, "k string, p long, v double"), "k", "p", "v", 4, block).collect()}
    for k in "abc":
        at = {p: v for key, p, v in rows if key == k and v is not None}
        mean = np.mean(list(at.values()))
        whole = sum((v - mean) ** 2 for v in at.values())
        for lag in range(5):
            met = [(at[p] - mean) * (at[p + lag] - mean) for p in at if p + lag in at]
            want = sum(met) / whole if whole else None
            assert (k, lag) in got and (got[k, lag] is want or abs(got[k, lag] - want) < 1e-9)
    assert analysis.acf_long(spark.createDataFrame([], "k string, p long, v double"), "k", "p", "v", 4).collect() == []


@pytest.mark.parametrize(("bound", "error"), [(1, 0.1), (5, 0.02), (100_000, 1e-3)])
def test_percentiles_of_a_whole_table(spark, bound, error):
    """A value in a third of the rows, infinite values, missing ones and NaN, an empty column; many passes with a small bound."""
    r = np.random.default_rng(bound)
    x, y = np.exp(r.normal(size=700) * 20), r.integers(0, 4, 700).astype(float)
    x[r.random(700) < 0.34] = 1.0
    x[:3], x[3:5] = np.inf, -np.inf
    rows = [(float(a), float(b), None) for a, b in zip(x, y)] + [(None, float("nan"), None)] * 9
    shares = (0.0, 0.003, 0.25, 0.5, 0.77, 1.0)
    table = spark.createDataFrame(rows, "x double, y double, z double")
    got = {(g["column"], g["share"]): g["value"] for g in analysis.percentiles(table, ["x", "y", "z"], shares, bound, error).collect()}
    for name, v in (("x", np.sort(x)), ("y", np.sort(y))):
        for p in shares:
            k = p * (len(v) - 1)
            low, high = v[int(k)], v[math.ceil(k)]
            want = low if low == high else low + (high - low) * (k - int(k))
            assert got[name, p] == want or abs(got[name, p] - want) <= 1e-9 * abs(want)
    assert all(got["z", p] is None for p in shares) and len(got) == 18


def test_window_outliers_ask_few_chunks(spark):
    """What is shuffled stays a few times the windows, however many cells there are (F1)."""
    v = np.random.default_rng(5).exponential(40, (20_000, 4))
    d = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, v array<double>").repartition(4).persist()
    d.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = {r.id: r.score for r in anomaly.window_outliers(d, "id", "v", chunk=128).collect()}
    assert written() - before < 50 * v.nbytes
    for i in range(0, 20_000, 400):
        assert np.isclose(got[i], np.sort(np.sqrt(((v - v[i]) ** 2).sum(1)))[5])
