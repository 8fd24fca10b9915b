"""Windowed regression forecasts and rolling evaluation. Cross-validation and search are in foldwise.py."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import following
from ..panel import Panel, in_order
from .grid import locate
from .samples import column_order, design_matrix, make_samples, predict_samples


@dataclass(frozen=True)
class Ridge:
    """A direct multi-step linear model: weights (inputs x steps) and intercepts."""

    weights: np.ndarray
    intercept: np.ndarray
    in_chunk_len: int
    out_chunk_len: int
    skip_chunk_len: int = 0

    def expression(self, x: Column, step: int) -> Column:
        """The forecast of one step as a JVM expression over the array ``x``."""
        w = F.array(*[F.lit(float(v)) for v in self.weights[:, step]])
        return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(self.intercept[step])), lambda s, v: s + v)


def fit_ridge(samples: DataFrame, in_chunk_len: int, out_chunk_len: int, skip_chunk_len: int = 0, alpha: float = 1.0) -> Ridge:
    """All steps at once from one Gram matrix: each task adds up X'X and X'Y of its rows, the sums are added.

    ``samples`` has arrays ``x`` and ``y``; rows with a NULL are left out.
    """

    def gram(batches):
        total = None
        for pdf in batches:
            x, y = (np.array([np.asarray(v, float) for v in pdf[c]]) for c in ("x", "y"))
            if not len(x):
                continue
            z = np.c_[np.ones(len(x)), x]
            part = z.T @ np.c_[z, y]
            total = part if total is None else total + part
        if total is not None:
            import pandas as pd

            yield pd.DataFrame({"i": np.arange(len(total)), "row": [r.tolist() for r in total]})

    whole_rows = samples.filter(~F.exists("x", lambda v: v.isNull()) & ~F.exists("y", lambda v: v.isNull()))
    parts = whole_rows.select("x", "y").mapInPandas(gram, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not cells:
        raise ValueError("no whole sample to learn from")
    size, width = max(c["i"] for c in cells) + 1, max(c["j"] for c in cells) + 1
    m = np.zeros((size, width))
    for c in cells:
        m[c["i"], c["j"]] = c["v"]
    penalty = alpha * np.eye(size)
    penalty[0, 0] = 0
    w = np.linalg.solve(m[:, :size] + penalty, m[:, size:])
    return Ridge(w[1:], w[0], in_chunk_len, out_chunk_len, skip_chunk_len)


def fit_forecaster(samples: DataFrame, estimator, out_chunk_len: int) -> list:
    """One ML model for each step, over features made and kept once (``x`` and ``y`` arrays)."""
    base = samples.filter(~F.exists("x", lambda v: v.isNull())).withColumn("features", array_to_vector("x")).persist()
    models = [estimator.copy({estimator.labelCol: "label"}).fit(base.withColumn("label", F.get("y", F.lit(h))).filter("label is not null")) for h in range(out_chunk_len)]
    base.unpersist()
    return models


def residual_quantiles(model: Ridge, samples: DataFrame, quantiles: tuple[float, ...]) -> dict[float, list[float]]:
    """For each quantile, of each output of the model, that of what the samples were above its forecast: one aggregate."""
    width = model.weights.shape[1]
    whole_rows = samples.filter(~F.exists("x", lambda v: v.isNull()) & ~F.exists("y", lambda v: v.isNull()))
    row = whole_rows.agg(*[F.percentile(F.get("y", F.lit(o)) - model.expression(F.col("x"), o), F.lit(q)).alias(f"{q}_{o}") for q in quantiles for o in range(width)]).first()
    return {q: [row[f"{q}_{o}"] for o in range(width)] for q in quantiles}


def predict(model: Ridge, panel: Panel, step: str, spread: dict[float, list[float]] | None = None) -> DataFrame:
    """``key, ts`` and each target's forecast after each series' end; with ``spread`` its quantiles as ``<target>@<q>``."""
    last = predict_samples(panel, model.in_chunk_len)
    x, out = design_matrix(last, panel), model.out_chunk_len
    of = lambda j, add: F.array(*[model.expression(F.col("x"), j * out + h) + F.lit(add[j * out + h]) for h in range(out)])
    columns = {}
    for j, target in enumerate(panel.columns("target")):
        columns[target] = of(j, [0.0] * model.weights.shape[1])
        columns |= {f"{target}@{q}": of(j, add) for q, add in (spread or {}).items()}
    rows = x.select(panel.key, "last_ts", F.posexplode(F.arrays_zip(*[c.alias(f"c{i}") for i, c in enumerate(columns.values())])).alias("h", "v"))
    return rows.select(panel.key, following(F.col("last_ts"), F.col("h") + model.skip_chunk_len + 1, step).alias("ts"), *[F.col(f"v.c{i}").alias(n) for i, n in enumerate(columns)])


@dataclass(frozen=True)
class Feature:
    """A column made of another's values up to a row: ``lag`` or ``diff`` of k rows, ``mean``, ``sum``, ``min`` or ``max`` of the last k."""

    source: str
    kind: str
    k: int

    def expression(self, key: str, ts: str) -> Column:
        """The column over a whole table; NULL while there are too few rows."""
        w = in_order(key, ts)
        if self.kind in ("lag", "diff"):
            before = F.lag(self.source, self.k).over(w)
            return before if self.kind == "lag" else F.col(self.source) - before
        last = w.rowsBetween(1 - self.k, 0)
        fold = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[self.kind]
        return F.when(F.count(self.source).over(last) == self.k, fold(self.source).over(last))

    def tail(self, values: np.ndarray, size: int) -> np.ndarray:
        """The last ``size`` values of each row of ``values``, whose last ``size + k`` are there."""
        n = values.shape[1]
        if self.kind == "lag":
            return values[:, n - size - self.k : n - self.k]
        if self.kind == "diff":
            return values[:, n - size :] - values[:, n - size - self.k : n - self.k]
        near = np.lib.stride_tricks.sliding_window_view(values, self.k, axis=1)[:, -size:]
        return getattr(near, self.kind)(axis=2)


def with_features(panel: Panel, features: dict[str, Feature]) -> Panel:
    """The panel with these columns as observed ones, each made of columns that are there before it."""
    df = panel.df
    for name, f in features.items():
        df = df.withColumn(name, f.expression(panel.key, panel.ts))
    return panel.on(df, **dict.fromkeys(features, "observed"))


def _ahead(panel: Panel, last: DataFrame, future: DataFrame, step: str, length: int) -> DataFrame:
    """``last`` with ``_ahead``, the known values of the next ``length`` rows; an error where a row or a value is missing."""
    key, ts, known = panel.key, panel.ts, panel.columns("known")
    ends = last.select(F.col(key).alias("_key"), F.col("last_ts").alias("_last"))
    rows = future.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.array(*[F.col(c).cast("double") for c in known]).alias("_v"))
    near = rows.join(ends, "_key").filter((F.col("_ts") > F.col("_last")) & (F.col("_ts") <= following(F.col("_last"), F.lit(length), step)))
    got = near.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_ts", "_v"))).alias("_ahead"))  # ``length`` rows
    whole = (F.size("_ahead") == length) & F.forall("_ahead", lambda r: F.forall(r["_v"], lambda v: v.isNotNull()))
    told = F.when(F.coalesce(whole, F.lit(False)), F.col("_ahead")["_v"]).otherwise(F.raise_error(F.concat(F.lit(f"known values are missing in the {length} rows after series "), F.col(key).cast("string"))))
    return last.join(got, F.col(key) == F.col("_key"), "left").withColumn("_ahead", told).drop("_key")


def recursive_predict(model: Ridge, panel: Panel, step: str, length: int, future: DataFrame | None = None, features: dict[str, Feature] | None = None) -> DataFrame:
    """``key, ts`` and each target's forecast: rounds of forecasts appended as history.

    Known columns are read from ``future``, which has their rows after each series' end, as many as the
    rounds reach; a missing one is an error. Observed columns must be ``features`` (with_features()) of
    targets or of each other, which each round makes anew from the tail. A skip can't be recursive.
    """
    features = features or {}
    if model.skip_chunk_len:
        raise ValueError("a skip can't be recursive")
    if unforecast := [c for c in panel.columns("observed") if c not in features]:
        raise ValueError(f"the future of {unforecast} isn't forecast; drop them, or say which features they are")
    targets, known, statics, out = panel.columns("target"), panel.columns("known"), panel.columns("static"), model.out_chunk_len
    if known and future is None:
        raise ValueError(f"the future rows of {known} are needed")
    rounds = -(-length // out)
    weights, intercept, size, key, order = model.weights, model.intercept, model.in_chunk_len, panel.key, column_order(panel)
    reach = size + sum(f.k for f in features.values())  # a feature of a feature looks back over both
    last = predict_samples(panel.on(panel.df.drop(*features)), reach) if features else predict_samples(panel, size)
    if known:
        last = _ahead(panel, last, future, step, rounds * out)
    kind = dict(panel.df.dtypes)[key]

    def run(batches):
        for pdf in batches:
            n = len(pdf)
            matrix = lambda c, n=n, pdf=pdf: np.array([np.asarray(v, float) for v in pdf[c]]).reshape(n, -1)
            past = {c: matrix(f"past_{c}") for c in targets + known}
            ahead = np.array([[np.asarray(r, float) for r in v] for v in pdf["_ahead"]]).reshape(n, rounds * out, len(known)) if known else None
            fixed = {c: pdf[c].to_numpy(float)[:, None] for c in statics}
            done = np.zeros((len(targets), n, 0))
            for turn in range(rounds):
                at = slice(turn * out, (turn + 1) * out)
                tail = dict(past)
                for name, f in features.items():
                    tail[name] = f.tail(tail[f.source], tail[f.source].shape[1] - f.k)
                x = []
                for c, role in order:
                    x.append(fixed[c] if role == "static" else tail[c][:, -size:])
                    if role == "known":
                        x.append(ahead[:, at, known.index(c)])
                y = (np.concatenate(x, axis=1) @ weights + intercept).reshape(n, len(targets), out).transpose(1, 0, 2)
                done = np.concatenate([done, y], axis=2)
                new = {c: y[j] for j, c in enumerate(targets)} | {c: ahead[:, at, j] for j, c in enumerate(known)}
                past = {c: np.concatenate([v, new[c]], axis=1)[:, -reach:] for c, v in past.items()}
            import pandas as pd

            yield pd.DataFrame({"series": pdf[key], "last_ts": pdf["last_ts"]} | {f"c{j}": list(done[j, :, :length]) for j in range(len(targets))})

    schema = f"series {kind}, last_ts {dict(panel.df.dtypes)[panel.ts]}, " + ", ".join(f"c{j} array<double>" for j in range(len(targets)))
    rows = last.select(key, "last_ts", *[f"past_{c}" for c in targets + known], *statics, *(["_ahead"] if known else [])).mapInPandas(run, schema)
    rows = rows.select("series", "last_ts", F.posexplode(F.arrays_zip(*[f"c{j}" for j in range(len(targets))])).alias("h", "v"))
    return rows.select(F.col("series").alias(key), following(F.col("last_ts"), F.col("h") + 1, step).alias("ts"), *[F.col(f"v.c{j}").alias(t) for j, t in enumerate(targets)])


# -- rolling evaluation ---------------------------------------------------------------------------

#: A forecaster for windows: gives from a row with ``past_<target>`` the array of its next values.
Forecaster = Callable[[DataFrame, str, int], Column]


def last_value(samples: DataFrame, target: str, out: int) -> Column:
    return F.array_repeat(F.element_at(f"past_{target}", -1), out)


def mean_value(samples: DataFrame, target: str, out: int) -> Column:
    a = F.filter(f"past_{target}", lambda v: v.isNotNull())
    return F.array_repeat(F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(a)), out)


def by_model(model: Ridge) -> Forecaster:
    """Forecasts of a lone target without covariates by its past values; for other panels give backtest() the model itself."""

    def forecast(samples: DataFrame, target: str, out: int) -> Column:
        if others := [c for c in samples.columns if c.startswith("past_") and c != f"past_{target}"]:
            raise ValueError(f"{others} aren't in this forecaster's input; give the model itself")
        return F.array(*[model.expression(F.transform(f"past_{target}", lambda v: v.cast("double")), h) for h in range(out)])

    return forecast


def backtest(panel: Panel, forecaster: Forecaster | Ridge, in_chunk_len: int, predict_window: int, stride: int | None = None, start: int | float | str | None = None, skip_chunk_len: int = 0) -> DataFrame:
    """``key, origin, h, y, p``: forecasts from every origin of every series, in one pass.

    Origins run from ``start`` (a row, a share of the rows, or a time; default in + skip), ``stride``
    apart; all are windows of one frame. A forecaster looks at the first target; a model, at all that
    it was fitted on, known rows ahead included, and its rows have one more column, ``target``.
    """
    if isinstance(forecaster, Ridge) and (forecaster.in_chunk_len, forecaster.out_chunk_len, forecaster.skip_chunk_len) != (in_chunk_len, predict_window, skip_chunk_len):
        raise ValueError("the window's lengths are the model's")
    if isinstance(start, (float, str)):
        stride, least = stride or predict_window, in_chunk_len + skip_chunk_len
        begin = locate(panel.df, panel.key, panel.ts, start).withColumn("_start", F.greatest("pos", F.lit(least))).drop("pos")
        origin = F.col("tail") - predict_window + 1
        every = make_samples(panel, in_chunk_len, predict_window, skip_chunk_len).join(begin, panel.key)
        s = every.filter((origin >= F.col("_start")) & ((origin - F.col("_start")) % stride == 0))
        return _forecasts(s, panel, forecaster, predict_window)
    start = in_chunk_len + skip_chunk_len if start is None else start
    stride = stride or predict_window
    first_tail = start + predict_window - 1
    s = make_samples(panel, in_chunk_len, predict_window, skip_chunk_len, stride, (first_tail, 2**31 - 1))
    return _forecasts(s, panel, forecaster, predict_window)


def _forecasts(s: DataFrame, panel: Panel, forecaster: Forecaster | Ridge, predict_window: int) -> DataFrame:
    if isinstance(forecaster, Ridge):
        targets, one = panel.columns("target"), design_matrix(s.withColumnsRenamed({c: f"static_{c}" for c in ("x", "y") if c in s.columns}), _renamed(panel))
        at = one.select(F.col(panel.key), (F.col("tail") - predict_window + 1).alias("origin"), "x", "y")
        p = F.array(*[forecaster.expression(F.col("x"), o) for o in range(len(targets) * predict_window)])
        rows = at.select(panel.key, "origin", F.posexplode(F.arrays_zip("y", p.alias("p"))).alias("o", "v"))
        name = F.element_at(F.array(*[F.lit(t) for t in targets]), (F.floor(F.col("o") / predict_window) + 1).cast("int"))
        return rows.select(panel.key, name.alias("target"), "origin", (F.col("o") % predict_window).cast("int").alias("h"), F.col("v.y").alias("y"), F.col("v.p").alias("p"))
    target = panel.columns("target")[0]
    both = F.arrays_zip(F.col(f"future_{target}").alias("y"), forecaster(s, target, predict_window).alias("p"))
    return s.select(panel.key, (F.col("tail") - predict_window + 1).alias("origin"), F.posexplode(both).alias("h", "v")).select(panel.key, "origin", "h", F.col("v.y").alias("y"), F.col("v.p").alias("p"))


def _renamed(panel: Panel) -> Panel:
    """The panel with its static columns of the names x and y under others, as design_matrix() takes them."""
    to = {c: f"static_{c}" for c in ("x", "y") if panel.roles.get(c) == "static"}
    return replace(panel, df=panel.df.withColumnsRenamed(to), roles={to.get(c, c): r for c, r in panel.roles.items()})


def backtest_score(forecasts: DataFrame, key: str, reduction: str | None = "mean") -> DataFrame:
    """``key, rounds, mse, mae``: metrics of each round, then their mean, median, min or max (not pooled); without one, ``key, origin, mse, mae``. For each ``target``, if there is one."""
    by = [key, "target"] if "target" in forecasts.columns else [key]
    rounds = forecasts.groupBy(*by, "origin").agg(F.avg(F.pow(F.col("y") - F.col("p"), F.lit(2.0))).alias("mse"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    rounds = rounds.filter("mse is not null")
    if reduction is None:
        return rounds
    f = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5)), "min": F.min, "max": F.max}[reduction]
    return rounds.groupBy(*by).agg(F.count("*").alias("rounds"), f("mse").alias("mse"), f("mae").alias("mae"))


def seasonal_naive(df: DataFrame, key, ts: str, col: str, period: int) -> DataFrame:
    """``<col>_pred``: the value one period earlier."""
    return df.withColumn(f"{col}_pred", F.lag(col, period).over(in_order(key, ts)))

