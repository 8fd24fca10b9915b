"""Fold-wise fits, scores, search and stacking against separate plain fits; recursion with known columns against a plain loop."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import folds, foldwise, forecast
from tidewheel.panel import Panel

DAY0 = datetime.datetime(2024, 1, 1)


def made_panel(spark, lengths=(40, 33, 52), seed=1, gap=True):
    """Columns named as an operator's own might be: targets a and b, known c, observed d, static x and a category n."""
    r = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(lengths):
        c, d = r.normal(size=n), r.normal(size=n)
        a = np.cumsum(r.normal(size=n)) + c
        for i in range(n):
            rows.append((k, DAY0 + datetime.timedelta(days=i), float(a[i]) if not gap or (k, i) != (1, 11) else None, float(2 * a[i] + d[i]), float(c[i]), float(d[i]), float(k) / 2, k % 2))
    df = spark.createDataFrame(rows, "origin long, tail timestamp, a double, b double, c double, d double, x double, n int")
    return Panel(df, "origin", "tail", {"a": "target", "b": "target", "c": "known", "d": "observed", "x": "static", "n": "static"}, "1 day"), rows


def plain_windows(rows, size, out, skip=0):
    """(series, tail, x, y) of every window, made row by row."""
    for k in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == k]
        length = size + skip + out
        for t in range(length - 1, len(own)):
            w = own[t - length + 1 : t + 1]
            past, ahead = w[:size], w[size + skip :]
            x = [r[2] for r in past] + [r[3] for r in past] + [r[4] for r in past] + [r[4] for r in ahead] + [r[5] for r in past] + [own[0][6], own[0][7]]
            yield k, t, np.array(x, float), np.array([r[2] for r in ahead] + [r[3] for r in ahead], float)


def plain_fit(samples, alpha):
    z = np.array([np.r_[1, x] for x, y in samples if not np.isnan(x).any() and not np.isnan(y).any()])
    y = np.array([y for x, y in samples if not np.isnan(x).any() and not np.isnan(y).any()])
    penalty = alpha * np.eye(z.shape[1])
    penalty[0, 0] = 0
    return np.linalg.solve(z.T @ z + penalty, z.T @ y)


def plain_scores(rows, table, size, out, alpha, skip=0):
    """Mean over targets, over series, over rounds, of each fold's model, fitted to that fold's training windows alone."""
    result = {}
    every = list(plain_windows(rows, size, out, skip))
    length = size + skip + out
    for f in sorted({f for _, f in table}):
        train = [(x, y) for k, t, x, y in every if (k, f) in table and t - length + 1 >= table[k, f][0] and t < table[k, f][1]]
        w = plain_fit(train, alpha)
        rounds = {}
        for k, t, x, y in every:
            if (k, f) not in table:
                continue
            _, hi, lo, end = table[k, f]
            start, origin = lo if lo == hi else lo + size + skip, t - out + 1
            if origin >= start and (origin - start) % out == 0 and t < end:
                gap = (y - np.r_[1, x] @ w).reshape(2, out)
                for j in range(2):
                    if not np.isnan(gap[j]).all():
                        rounds.setdefault((j, k), []).append(np.nanmean(gap[j] ** 2))
        each = {j: np.mean([np.mean(v) for (i, _), v in rounds.items() if i == j]) for j in range(2)}
        result[f] = np.mean(list(each.values()))
    return result


def fold_table(df, key):
    table = {}
    for r in df.collect():
        table.setdefault((r[key], r["fold"]), [0] * 4)
        table[r[key], r["fold"]][0 if r["part"] == "train" else 2] = r["lo"]
        table[r[key], r["fold"]][1 if r["part"] == "train" else 3] = r["hi"]
    return table


@pytest.mark.parametrize(("kind", "skip"), [("expanding", 0), ("sliding", 0), ("apart", 1)])
def test_cross_validation_equals_separate_fits(spark, kind, skip):
    p, rows = made_panel(spark)
    f = {"expanding": lambda: folds.expanding(p.df, "origin", 3), "sliding": lambda: folds.sliding(p.df, "origin", 20, 6), "apart": lambda: folds.expanding(p.df, "origin", 2, skip_size=2)}[kind]()
    got = {r.fold: r.mse for r in foldwise.cross_validate(p, f, 3, 2, 0.5, skip).collect()}
    want = plain_scores(rows, fold_table(f, "origin"), 3, 2, 0.5, skip)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 * max(1, want[k]) for k in want)


def test_search_equals_separate_fits(spark):
    p, rows = made_panel(spark)
    f = folds.expanding(p.df, "origin", 2)
    space = {"in_chunk_len": [2, 5, 3], "alpha": [0.1, 10.0]}
    best, scored, model = foldwise.grid_search(p, f, space, 2)
    for t, s in scored:
        assert abs(s - np.mean(list(plain_scores(rows, fold_table(f, "origin"), t["in_chunk_len"], 2, t["alpha"]).values()))) < 1e-8 * s
    assert best == min(scored, key=lambda x: x[1])[0]
    w = plain_fit([(x, y) for *_, x, y in plain_windows(rows, best["in_chunk_len"], 2)], best["alpha"])
    assert np.allclose(np.vstack([model.intercept, model.weights]), w)  # the best, fitted to all rows
    assert len(foldwise.grid_search(p, f, space, 2, n_trials=2)[1]) == 2


def test_no_row_is_forecast_by_a_model_that_saw_it(spark):
    p, rows = made_panel(spark)
    f = folds.expanding(p.df, "origin", 3)
    table, setting = fold_table(f, "origin"), foldwise.Setting(3, 1.0)
    made, bases = foldwise.out_of_fold(p, f, {"m": setting}, 2)
    every = list(plain_windows(rows, 3, 2))
    seen = 0
    for fold in {f for _, f in table}:
        outside = [(x, y) for k, t, x, y in every if (k, fold) in table and (t < table[k, fold][2] or t - 4 >= table[k, fold][3])]
        w = plain_fit(outside, 1.0)
        for r in made.filter(F.col("fold") == fold).collect():
            x = next(x for k, t, x, _ in every if (k, t - 1) == (r.series, r.origin))
            p_ = (np.r_[1, x] @ w)[(0 if r.target == "a" else 2) + r.h]
            assert table[r.series, fold][2] <= r.origin + r.h < table[r.series, fold][3]
            assert (r.p is None and np.isnan(p_)) or abs(r.p - p_) < 1e-8
            seen += 1
    assert seen > 100 and np.allclose(bases["m"].weights, plain_fit([(x, y) for *_, x, y in every], 1.0)[1:])


def test_stack_by_plain_least_squares(spark):
    p, _ = made_panel(spark)
    f = folds.expanding(p.df, "origin", 3)
    settings = {"s": foldwise.Setting(2), "l": foldwise.Setting(5, 3.0)}
    model = foldwise.stack(p, f, settings, 2, alpha=0.5)
    made, _ = foldwise.out_of_fold(p, f, settings, 2)
    for target in ("a", "b"):
        cells = {}
        for r in made.filter(F.col("target") == target).collect():
            cells.setdefault((r.series, r.fold, r.origin, r.h), {"y": r.y})[r.model] = r.p
        whole = [c for c in cells.values() if len(c) == 3 and None not in c.values()]
        z = np.array([[1, c["l"], c["s"]] for c in whole])
        want = np.linalg.solve(z.T @ z + np.diag([0, 0.5, 0.5]), z.T @ np.array([c["y"] for c in whole]))
        assert np.allclose(model.final[target], want)


def test_backtest_of_a_model_takes_all_columns(spark):
    p, rows = made_panel(spark)
    w = np.random.default_rng(3).normal(size=(3 * 4 + 2 + 2, 4))
    model = forecast.Ridge(w, np.arange(4.0), 3, 2)
    got = {(r.origin, r["target"], r[2], r.h): (r.y, r.p) for r in forecast.backtest(p.on(p.df.withColumnRenamed("origin", "key")).__class__(p.df.withColumnRenamed("origin", "key"), "key", "tail", p.roles, "1 day"), model, 3, 2).withColumnRenamed("key", "k").select(F.col("origin"), "target", "k", "h", "y", "p").collect()}
    want = {(t - 1, "ab"[j], k, h): (y[2 * j + h], (np.r_[1, x] @ np.vstack([np.arange(4.0), w]))[2 * j + h]) for k, t, x, y in plain_windows(rows, 3, 2) if (t - 4) % 2 == 0 for j in range(2) for h in range(2)}
    assert got.keys() == want.keys()
    for k, (y, pred) in want.items():
        assert (got[k][1] is None and np.isnan(pred)) or abs(got[k][1] - pred) < 1e-9
        assert (got[k][0] is None and np.isnan(y)) or abs(got[k][0] - y) < 1e-12
    with pytest.raises(ValueError, match="input"):
        forecast.backtest(p, forecast.by_model(model), 3, 2).collect()


def test_recursion_by_a_plain_loop(spark):
    p, rows = made_panel(spark, gap=False)
    features = {"diff": forecast.Feature("a", "diff", 2), "mean": forecast.Feature("b", "mean", 3), "again": forecast.Feature("mean", "lag", 1)}
    cut = 30
    history = [r for r in rows if (r[1] - DAY0).days < cut]
    base = Panel(p.df.filter(F.col("tail") < F.lit(DAY0 + datetime.timedelta(days=cut))).drop("d"), "origin", "tail", {"a": "target", "b": "target", "c": "known", "x": "static", "n": "static"}, "1 day")
    whole = forecast.with_features(base, features)
    future = spark.createDataFrame([(k, DAY0 + datetime.timedelta(days=cut + i), float(i * (k + 1))) for k in range(3) for i in range(8)], "origin long, tail timestamp, c double")
    r = np.random.default_rng(5)
    model = forecast.Ridge(r.normal(size=(2 * 2 + 2 + 2 + 3 * 2 + 2, 4)) / 5, r.normal(size=4), 2, 2)
    got = {(x.origin, x.ts): (x.a, x.b) for x in forecast.recursive_predict(model, whole, "1 day", 5, future, features).collect()}
    for k in range(3):
        own = [x for x in history if x[0] == k]
        a, b, c = ([x[i] for x in own] for i in (2, 3, 4))
        c = c + [float(i * (k + 1)) for i in range(8)]
        while len(a) < cut + 5:
            n = len(a)
            diff, mean = [a[i] - a[i - 2] for i in (n - 2, n - 1)], [np.mean(b[i - 2 : i + 1]) for i in (n - 3, n - 2, n - 1)]
            x = np.r_[a[-2:], b[-2:], c[n - 2 : n], c[n : n + 2], diff, mean[1:], mean[:2], own[0][6], own[0][7]]
            y = x @ model.weights + model.intercept
            a, b = a + y[:2].tolist(), b + y[2:].tolist()
        for i in range(5):
            assert np.allclose(got[k, DAY0 + datetime.timedelta(days=cut + i)], (a[cut + i], b[cut + i]))
    assert len(got) == 15
    with pytest.raises(Exception, match="known values are missing"):
        forecast.recursive_predict(model, whole, "1 day", 5, future.filter("c != 3"), features).collect()
    with pytest.raises(ValueError, match="isn't forecast"):
        forecast.recursive_predict(model, whole, "1 day", 5, future, {"diff": features["diff"]})
    with pytest.raises(ValueError, match="future rows"):
        forecast.recursive_predict(model, whole, "1 day", 5, None, features)
