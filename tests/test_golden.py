"""Operators against small frames with known results. The frames and results are fixed values that must match."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import anomaly, calendar, ensemble, folds, forecast, grid, metrics, samples, series_ml, transforms
from tidewheel.panel import Panel
from tidewheel.sources import io

DAY0 = dt.datetime(2022, 1, 1)


def series(spark, *columns, key=0, step=dt.timedelta(1), start=DAY0, names=("v", "w", "x")):
    rows = [(key, start + i * step, *[None if v is None else float(v) for v in vs]) for i, vs in enumerate(zip(*columns, strict=True))]
    return spark.createDataFrame(rows, "k long, ts timestamp, " + ", ".join(f"{n} double" for n in names[: len(columns)]))


def values(df, col, order="ts"):
    return [None if r[0] is None else round(r[0], 6) for r in df.orderBy(order).select(col).collect()]


Y = [1, None, 3, 4, 5, 6, 7, 8, 9, 10, 11, None, None, 14, 15, 16]


@pytest.mark.parametrize(
    "method,window,at",
    [("max", 10, [11, 11]), ("min", 10, [3, 3]), ("mean", 3, [10.5, 10.75]), ("median", 4, [10, 10])],
)
def test_cascading_fill(spark, method, window, at):
    got = values(transforms.fill(series(spark, Y), "k", "ts", ["v"], method, window_size=window), "v")
    assert got[11:13] == at and got[1] == 1 and got[13:] == [14, 15, 16]


def test_simple_fills(spark):
    d = series(spark, [None, 1, None, 3, None])
    assert values(transforms.fill(d, "k", "ts", ["v"], "pre"), "v") == [None, 1, 1, 3, 3]
    assert values(transforms.fill(d, "k", "ts", ["v"], "next"), "v") == [1, 1, 3, 3, None]
    assert values(transforms.fill(d, "k", "ts", ["v"], "zero", value=5), "v") == [5, 1, 5, 3, 5]
    assert values(transforms.fill_isolated(d, "k", "ts", "v", "mean", 3), "v") == [None, 1, 1, 3, 3]


def test_ksigma_bounds(spark):
    d = series(spark, [90, 80, 70, 80, 85], [10, 20, 10, 20, 15])
    stats = transforms.ksigma(d, ["v", "w"], 3).stats
    assert np.allclose(stats["v"], [58.751404, 103.248595, 81]) and np.allclose(stats["w"], [0, 30, 15])


def test_lag_and_difference(spark):
    d = series(spark, [1, 2, 3, 4, 5])
    lagged = transforms.lag(d, "k", "ts", ["v"], 4, 2)
    assert values(lagged, "v_before_2") == [None, None, 1, 2, 3] and values(lagged, "v_before_4") == [None, None, None, None, 1]
    diff = transforms.difference(d, "k", "ts", ["v"], 4, 2)
    assert values(diff, "v_diff_2") == [None, None, 2, 2, 2] and values(diff, "v_diff_4") == [None, None, None, None, 4]
    with pytest.raises(ValueError):
        transforms.difference(d, "k", "ts", ["v"], 1, targets=("v",))


def test_rolling_stats(spark):
    d = series(spark, [12.5, 16.5, 20.5, 24.5, 28.5])
    got = transforms.rolling_stats(d, "k", "ts", ["v"], 0, 2)
    assert values(got, "v_mean") == [None, 14.5, 18.5, 22.5, 26.5] and values(got, "v_min") == [None, 12.5, 16.5, 20.5, 24.5]
    one_three = transforms.rolling_stats(series(spark, [1, 2, 3, 4]), "k", "ts", ["v"], 1, 3, ("mean",))
    assert values(one_three, "v_mean") == [None, None, 1.5, 2.5]


def test_time_features(spark):
    d = calendar.time_features(series(spark, range(8), start=dt.datetime(2021, 1, 1)), "ts", ["weekday", "weekofyear"])
    assert values(d, "weekday") == [4, 5, 6, 0, 1, 2, 3, 4]
    assert values(d, "weekofyear") == [round(w / 51 - 0.5, 6) for w in [53, 53, 53, 1, 1, 1, 1, 1]]
    assert calendar.extend_time(d, "k", "ts", 3, "1 day").count() == 11
    with pytest.raises(TypeError):
        calendar.time_features(spark.createDataFrame([(0, 1, 1.0)], "k long, ts long, v double"), "ts", ["year"])


def test_holidays(spark):
    assert calendar.easter(2024) == dt.date(2024, 3, 31) and calendar.HOLIDAYS["Thanksgiving"](2023) == dt.date(2023, 11, 23)
    got = calendar.holiday_distance(series(spark, [1, 2]), "ts", ["New Years Day"], scale=False)
    assert values(got, "`New Years Day`") == [0, 1]


def test_encoders(spark):
    d = spark.createDataFrame([("male",), ("female",), ("male",), ("female",), ("female",)], "sex string")
    hot = transforms.one_hot(d, ["sex"]).transform(d)
    assert [tuple(r) for r in hot.select("OneHotEncoder_sex_0", "OneHotEncoder_sex_1").collect()][:2] == [(0, 1), (1, 0)]
    code = transforms.ordinal(d, ["sex"])
    assert [r[0] for r in code.transform(d).collect()] == [1, 0, 1, 0, 0]
    assert code.inverse(code.transform(d)).collect() == d.collect()
    new = spark.createDataFrame([("other",)], "sex string")
    with pytest.raises(Exception, match="unknown category"):
        code.transform(new).collect()
    ignoring = transforms.one_hot(d, ["sex"], handle_unknown="ignore").transform(new)
    assert [r[1:] for r in map(tuple, ignoring.collect())] == [(0, 0)]


def test_scalers_round_trip(spark):
    d = series(spark, [1, 2, None, 4], [5, 5, 5, 5])
    for fitted in (transforms.standard_scale(d, ["v", "w"]), transforms.minmax_scale(d, ["v", "w"], (-1, 1)), transforms.standard_scale(d, ["v", "w"], by="k")):
        scaled = fitted.transform(d)
        assert values(fitted.inverse(scaled), "v") == [1, 2, None, 4]
        assert len(set(values(scaled, "w"))) == 1
    assert np.allclose(np.std([x for x in values(transforms.standard_scale(d, ["v"]).transform(d), "v") if x is not None]), 1)


def test_regularize_takes_the_next_row(spark):
    d = series(spark, range(100))
    out = grid.regularize(d, "k", "ts", "12 hours")
    assert out.count() == 199 and values(out, "v")[:4] == [0, 1, 1, 2]
    month_ends = grid.full_grid(series(spark, range(70)), "k", "ts", "month end")
    assert [str(r.ts.date()) for r in month_ends.orderBy("ts").collect()] == ["2022-01-31", "2022-02-28"]
    tuesdays = grid.full_grid(series(spark, range(10)), "k", "ts", "week tue")
    assert [str(r.ts.date()) for r in tuesdays.collect()] == ["2022-01-04"]


def test_split_keeps_known_columns(spark):
    p = Panel(series(spark, range(10), range(10, 20)), "k", "ts", {"v": "target", "w": "known"})
    first, second = grid.split(p, 4)
    assert values(first.df, "v") == [0, 1, 2, 3, None, None, None, None, None, None] and values(first.df, "w") == list(range(10, 20))
    assert values(second.df, "v") == [4, 5, 6, 7, 8, 9]


def test_windows(spark):
    p = Panel(series(spark, range(11)), "k", "ts", {"v": "target"})
    s = samples.make_samples(p, 4, 2, 3).orderBy("tail").collect()
    assert [(r.past_v, r.future_v) for r in s] == [([0, 1, 2, 3], [7, 8]), ([1, 2, 3, 4], [8, 9]), ([2, 3, 4, 5], [9, 10])]
    same = samples.make_samples_by_window(p, 4, 2, 3, 1).orderBy("tail").collect()
    assert [(r.past_v, r.future_v) for r in same] == [(r.past_v, r.future_v) for r in s]
    assert samples.predict_samples(p, 4).first().past_v == [7, 8, 9, 10]
    long = Panel(series(spark, range(250), range(250)), "k", "ts", {"v": "target", "w": "known"})
    m = samples.lag_matrix(long, 10, 3, 0, 10)
    assert m.count() == 25 and len(m.columns) == 2 + 23


def test_fold_ranges(spark):
    d = series(spark, range(12))
    parts = lambda f: {(r.fold, r.part): (r.lo, r.hi) for r in f.collect()}
    e = parts(folds.expanding(d, "k", 5))
    assert e[0, "train"] == (0, 2) and e[0, "test"] == (2, 4) and e[4, "test"] == (10, 12)
    s = parts(folds.sliding(d, "k", 5, 2))
    assert s[0, "train"] == (0, 5) and s[0, "test"] == (5, 7) and s[3, "test"] == (11, 12)
    assert parts(folds.holdout(d, "k", 0.25, 1)) == {(0, "train"): (0, 9), (0, "test"): (10, 12)}


def test_metrics(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.8), (1, 0.8)], "y int, p double")
    assert round(d.agg(metrics.logloss("y", "p")).first()[0], 5) == 0.16425
    c = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "y int, p int")
    assert c.agg(metrics.acc("y", "p")).first()[0] == 0.6
    q = spark.createDataFrame([(1.0, 0.0, 0.0)] * 3, "`t` double, `t@1` double, `t@2` double")
    assert {r.q: round(r.loss, 6) for r in metrics.quantile_loss(q, "t").collect()} == {0.1: 0.1, 0.5: 0.5, 0.9: 0.9}


def test_ridge_learns_a_line(spark):
    p = Panel(series(spark, range(60)), "k", "ts", {"v": "target"})
    model = forecast.fit_ridge(samples.design_matrix(samples.make_samples(p, 4, 2), p), 4, 2, alpha=1e-6)
    assert np.allclose(values(forecast.predict(model, p, "1 day"), "v"), [60, 61], atol=1e-3)
    assert np.allclose(values(forecast.recursive_predict(model, p, "1 day", 5), "v"), [60, 61, 62, 63, 64], atol=1e-2)


def test_point_adjust_and_vote(spark):
    real, pred = [0, 1, 1, 1, 0, 1, 0], [0, 0, 1, 0, 1, 0, 0]
    d = series(spark, real, pred)
    assert values(anomaly.point_adjust(d, "k", "ts", "w", "v"), "w") == [0, 1, 1, 1, 1, 0, 0]
    assert [r.length for r in anomaly.anomaly_segments(d, "k", "ts", "v").orderBy("start").collect()] == [3, 1]
    votes = series(spark, [0, 0]).unionAll(series(spark, [1, 1])).withColumn("v", F.col("v").cast("int"))
    assert values(anomaly.ensemble_vote(votes, "k", "ts", "v"), "v") == [0, 0]


def test_epsilon_threshold_separates(spark):
    d = series(spark, [1.0 + 0.01 * (i % 7) for i in range(400)][:399] + [50.0])
    t = anomaly.epsilon_threshold(d, "k", "ts", "v").first()[0]
    assert 1.1 < t <= 50


def test_ensembles(spark):
    long = spark.createDataFrame([(m, 0, DAY0 + dt.timedelta(i), float(i + e)) for i in range(4) for m, e in (("a", 1), ("b", -1), ("c", 3))], "model string, k long, ts timestamp, y double")
    truth = series(spark, range(4), names=("y",))
    assert ensemble.ensemble_search(long, truth, "k", "ts", ["a", "b", "c"]) == (("a", "b"), 0.0)
    assert values(ensemble.ensemble_weight(long, "k", "ts", mode="median"), "y") == [1, 2, 3, 4]


def test_validate_and_roles(spark):
    d = spark.createDataFrame([(0, 1, 1.0, "x"), (0, 1, 2.0, "y"), (0, 4, 3.0, "x")], "k long, ts long, v double, s string")
    rules = {r.rule: r.n for r in io.validate(Panel(d, "k", "ts", {"v": "target", "s": "static"})).collect()}
    assert rules == {"repeated time": 1, "gap in the index": 2, "static s varies": 1}
    with pytest.raises(ValueError):
        io.load_df(d, "k", "ts", target_cols="v", label_col="v")
    with pytest.raises(ValueError):
        io.load_df(d, "k", "ts", target_cols="missing")
    assert io.load_df(d, "k", "ts").columns("target") == ["v", "s"]


def test_save_and_load(spark, tmp_path):
    p = Panel(series(spark, range(5)), "k", "ts", {"v": "target"}, "1 day")
    io.save(p, str(tmp_path / "p"))
    back = io.load(spark, str(tmp_path / "p"))
    assert back.roles == p.roles and values(back.df, "v") == [0, 1, 2, 3, 4]


def test_concat_keeps_first_or_last(spark):
    a, b = series(spark, [1, 2]), series(spark, [8, 9, 10])
    assert values(grid.concat_rows([a, b], "k", "ts"), "v") == [1, 2, 10]
    assert values(grid.concat_rows([a, b], "k", "ts", keep="last"), "v") == [8, 9, 10]
    with pytest.raises(Exception, match="two tables"):
        grid.concat_rows([a, b], "k", "ts", drop_duplicates=False).collect()


def test_classes_and_padding(spark):
    rows = [(i, [float(i % 2), float(i % 2) + 0.1], "even" if i % 2 == 0 else "odd") for i in range(40)]
    d = spark.createDataFrame(rows, "id long, features array<double>, label string")
    got = series_ml.classify(d, d.drop("label"), "id", trees=3).join(d.select("id", F.col("label").alias("t")), "id")
    assert got.agg(series_ml.accuracy("t", "label")).first()[0] == 1.0
    padded = samples.pad_series(series(spark, [1, None, 3]), "k", "ts", "v", 5).first()
    assert padded["values"] == [1, 0, 3, 0, 0] and padded["mask"] == [1, 1, 1, 0, 0]


def test_window_outliers_by_all_pairs(spark):
    r = np.random.default_rng(4)
    v = np.round(r.normal(size=(400, 3)), 1)
    v[100:160] = v[0]  # copies
    v[399] = 50.0
    d = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "id long, v array<double>")
    far = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    want = np.sort(far, axis=1)[:, 4]
    for pivots, chunk in ((256, 2048), (20, 16), (1, 50)):
        got = {x.id: (x.score, x.pred) for x in anomaly.window_outliers(d, "id", "v", 5, 0.05, pivots, chunk).collect()}
        assert np.allclose([got[i][0] for i in range(400)], want) and got[399][1] == 1
    few = anomaly.window_outliers(d.limit(2), "id", "v", 5)
    assert few.count() == 2 and anomaly.window_outliers(d.limit(0), "id", "v").count() == 0
