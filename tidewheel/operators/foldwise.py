"""Fitting and scoring of windowed linear models over folds, all models and folds in one pass each.

Every window of the longest input is made once, with the whole design vector: past targets, known
columns before and ahead, observed and static ones. For each fold and input length it is known which
windows train (none that reaches out of the fold's training rows) and where forecasts start in its
test rows. One pass sums a Gram matrix for each set of (fold, length) pairs that windows train for;
those sets cut the windows into disjoint ranges, whose sums make up every fold's. A shorter input is
a sub-matrix, and a penalty is added on the driver, so a search over lengths and penalties needs no
further pass. A second pass forecasts for all of them. The driver holds matrices of the design's size.

Defined results: a window with a missing value in what a model takes trains no model and has a NULL
forecast; a horizon without a true value isn't scored; folds without a whole training window are an
error; a panel may have columns of any names.
"""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..panel import Panel, in_order
from .forecast import Ridge, predict
from .samples import column_order


@dataclass(frozen=True)
class Setting:
    """A model to fit: its input length and its penalty."""

    in_chunk_len: int
    alpha: float = 1.0


def windows(panel: Panel, longest: int, out: int, skip: int) -> tuple[DataFrame, list[tuple[str, int]]]:
    """``series, tail, last_ts, rows, x, y`` of every window (``rows`` is its number of rows, shorter at a series' start), and what each value of x is: (``past``, rows back), or (``other``, 0).

    Missing values are NULL in both arrays; x has NULLs in place of rows before the series' start.
    """
    cols = panel.columns("target", "observed", "known")
    length = longest + skip + out
    order = in_order(panel.key, panel.ts)
    held = F.collect_list(F.struct(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])).over(order.rowsBetween(-(length - 1), 0))
    at = panel.df.select(
        F.col(panel.key).alias("series"), (F.row_number().over(order) - 1).cast("long").alias("tail"), F.col(panel.ts).alias("last_ts"), held.alias("held"),
        F.array(*[F.col(c).cast("double") for c in panel.columns("static")]).cast("array<double>").alias("fixed"),
    )
    short = F.array_repeat(F.lit(None).cast("double"), F.lit(length) - F.size("held"))
    of = {c: F.concat(short, F.col("held")[f"v{i}"]) for i, c in enumerate(cols)}
    x, what = [], []
    for c, role in column_order(panel):
        if role == "static":
            x.append(F.slice("fixed", panel.columns("static").index(c) + 1, 1))
            what.append(("other", 0))
            continue
        x.append(F.slice(of[c], 1, longest))
        what += [("past", longest - i) for i in range(longest)]
        if role == "known":
            x.append(F.slice(of[c], longest + skip + 1, out))
            what += [("other", 0)] * out
    y = F.concat(*[F.slice(of[c], longest + skip + 1, out) for c in panel.columns("target")])
    return at.select("series", "tail", "last_ts", F.size("held").alias("rows"), F.concat(*x).alias("x"), y.alias("y")), what


def with_folds(frame: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """``frame`` with ``folds``: the ranges of each fold of the series, an array of a few structs."""
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    rows = folds.groupBy(F.col(key).alias("series"), "fold").agg(of("train", "lo").alias("train_lo"), of("train", "hi").alias("train_hi"), of("test", "lo").alias("test_lo"), of("test", "hi").alias("test_hi"))
    table = rows.groupBy("series").agg(F.collect_list(F.struct("fold", "train_lo", "train_hi", "test_lo", "test_hi")).alias("folds"))
    return frame.join(table, "series")


def _trains(f: Column, span: int, left_out: bool) -> Column:
    first = F.col("tail") - span + 1
    if left_out:  # no row of the window is one of the test's
        return (first >= 0) & ((F.col("tail") < f["test_lo"]) | (first >= f["test_hi"]))
    return (first >= f["train_lo"]) & (F.col("tail") < f["train_hi"])


def _tests(f: Column, length: int, out: int, skip: int, left_out: bool) -> Column:
    """Whether a forecast of fold ``f`` starts at the window: right after training rows, or once the test's own rows fill an input."""
    origin = F.col("tail") - out + 1
    after = f["test_lo"] if left_out else F.when(f["train_hi"] == f["test_lo"], f["test_lo"]).otherwise(f["test_lo"] + length + skip)
    return (origin >= after) & ((origin - after) % out == 0) & (F.col("tail") < f["test_hi"]) & (origin - skip - length >= 0)


def _folds(holds: Callable[[Column], Column]) -> Column:
    """The numbers of a window's folds for which this holds."""
    return F.transform(F.filter("folds", lambda f: holds(f)), lambda f: f["fold"])


def places(what: list[tuple[str, int]], length: int) -> np.ndarray:
    """Where the design vector of a shorter input lies in that of the longest."""
    return np.array([i for i, (kind, back) in enumerate(what) if kind == "other" or back <= length], int)


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    return np.concatenate(values.to_numpy()).astype(float).reshape(len(values), width)


def grams(frame: DataFrame, what: list[tuple[str, int]], lengths: list[int], outputs: int, out: int, skip: int, left_out: bool = False) -> dict[tuple[int, int], np.ndarray]:
    """(1, x)'(1, x, y) over the training windows of each (fold, input length); fold -1 are all windows."""
    used = [places(what, n) for n in lengths]

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            x, y = _matrix(b["x"], len(what)), _matrix(b["y"], outputs)
            known = ~np.isnan(x)
            whole = [known[:, u].all(1) & ~np.isnan(y).any(1) for u in used]
            z = np.c_[np.ones(len(x)), np.nan_to_num(x)]
            # windows of the same folds and missing values are one group: a few, whatever the rows
            code, folds = pd.factorize(b["train"])
            groups, at = np.unique(np.c_[code, np.array(whole).T], axis=0, return_inverse=True)
            for g, (of, *can) in enumerate(groups):
                of = json.loads(folds[of])
                name = repr(tuple(sorted((int(f), n) for k, n in enumerate(lengths) if can[k] for f in of[k])))
                if name != "()":
                    mine = at.ravel() == g
                    part = z[mine].T @ np.c_[z[mine], np.nan_to_num(y[mine])]
                    total[name] = total[name] + part if name in total else part
        for name, m in total.items():
            yield pd.DataFrame({"takes": name, "i": np.arange(len(m)), "row": [r.tolist() for r in m]})

    def member(n: int) -> Column:
        every = F.when(F.col("rows") >= n + skip + out, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        return F.concat(_folds(lambda f: _trains(f, n + skip + out, left_out)), every)

    rows = frame.select("x", "y", F.to_json(F.array(*map(member, lengths))).alias("train"))
    cells = rows.mapInPandas(run, "takes string, i int, row array<double>").select("takes", "i", F.posexplode("row").alias("j", "v")).groupBy("takes", "i", "j").agg(F.sum("v").alias("v")).collect()
    wide, found = len(what) + 1, {}
    for c in cells:
        found.setdefault(c["takes"], np.zeros((wide, wide + outputs)))[c["i"], c["j"]] = c["v"]
    out_of: dict[tuple[int, int], np.ndarray] = {}
    for takes, m in found.items():
        for fold, n in _pairs(takes):
            own = np.r_[0, places(what, n) + 1]
            part = m[np.ix_(own, np.r_[own, np.arange(wide, wide + outputs)])]
            out_of[fold, n] = out_of.get((fold, n), 0) + part
    return out_of


def _pairs(takes: str) -> list[tuple[int, int]]:
    numbers = [int(x) for x in takes.replace("(", " ").replace(")", " ").replace(",", " ").split()]
    return list(zip(numbers[::2], numbers[1::2], strict=True))


def solve(gram: np.ndarray, setting: Setting, out: int, skip: int) -> Ridge:
    size = len(gram)
    penalty = setting.alpha * np.eye(size)
    penalty[0, 0] = 0
    w = np.linalg.lstsq(gram[:, :size] + penalty, gram[:, size:], rcond=None)[0] if not setting.alpha else np.linalg.solve(gram[:, :size] + penalty, gram[:, size:])
    return Ridge(w[1:], w[0], setting.in_chunk_len, out, skip)


def fit(panel: Panel, folds: DataFrame, settings: dict[str, Setting], out: int, skip: int = 0, left_out: bool = False) -> dict[tuple[str, int], Ridge]:
    """A model for each setting and fold, and (fold -1) for all rows: one pass for all. ``left_out``: a fold trains on all that its test rows aren't part of."""
    lengths = sorted({s.in_chunk_len for s in settings.values()})
    frame, what = windows(panel, lengths[-1], out, skip)
    outputs = out * len(panel.columns("target"))
    sums = grams(with_folds(frame, folds, panel.key), what, lengths, outputs, out, skip, left_out)
    models = {(name, fold): solve(gram, s, out, skip) for name, s in settings.items() for (fold, n), gram in sums.items() if n == s.in_chunk_len}
    for (fold,) in folds.select("fold").distinct().collect():
        if missing := [name for name in settings if (name, fold) not in models]:
            raise ValueError(f"fold {fold} has no whole window to learn from for {missing}")
    return models


def forecasts(panel: Panel, folds: DataFrame, models: dict[tuple[str, int], Ridge], left_out: bool = False) -> DataFrame:
    """``model, fold, series, origin, last_ts, target, h, y, p``: every model's forecasts in the test rows of its folds, in one pass."""
    one = next(iter(models.values()))
    out, skip, targets = one.out_chunk_len, one.skip_chunk_len, panel.columns("target")
    longest = max(m.in_chunk_len for m in models.values())
    frame, what = windows(panel, longest, out, skip)
    lengths = sorted({m.in_chunk_len for m in models.values()})
    outputs, series = out * len(targets), dict(panel.df.dtypes)[panel.key]
    time = dict(panel.df.dtypes)[panel.ts]
    used = {n: places(what, n) for n in lengths}

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            x, y = _matrix(b["x"], len(what)), _matrix(b["y"], outputs)
            code, folds = pd.factorize(b["test"])
            of = [json.loads(t) for t in folds]
            for (name, fold), m in models.items():
                k = lengths.index(m.in_chunk_len)
                at = np.array([fold in t[k] for t in of])[code]
                if at.any():
                    p = x[at][:, used[m.in_chunk_len]] @ m.weights + m.intercept
                    yield pd.DataFrame({"model": name, "fold": fold, "series": b["series"][at], "origin": b["tail"][at] - out + 1, "last_ts": b["last_ts"][at], "y": list(y[at]), "p": list(p)})

    test = F.array(*[_folds(partial(_tests, length=n, out=out, skip=skip, left_out=left_out)) for n in lengths])
    rows = with_folds(frame, folds, panel.key).select("series", "tail", "last_ts", "x", "y", test.alias("test")).filter(F.exists("test", lambda t: F.size(t) > 0)).withColumn("test", F.to_json("test"))
    schema = f"model string, fold long, series {series}, origin long, last_ts {time}, y array<double>, p array<double>"
    found = rows.mapInPandas(run, schema).select("model", "fold", "series", "origin", "last_ts", F.posexplode(F.arrays_zip("y", "p")).alias("o", "v"))
    target = F.element_at(F.array(*[F.lit(t) for t in targets]), (F.floor(F.col("o") / out) + 1).cast("int"))
    whole = lambda c: F.when(~F.isnan(c), F.col(c))
    return found.select("model", "fold", "series", "origin", "last_ts", target.alias("target"), (F.col("o") % out).cast("int").alias("h"), whole("v.y").alias("y"), whole("v.p").alias("p"))


def scores(made: DataFrame) -> DataFrame:
    """``model, fold, target, mse, mae``: the mean over rounds of each series, then over series."""
    gap = F.col("y") - F.col("p")
    rounds = made.groupBy("model", "fold", "series", "target", "origin").agg(F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae")).filter("mse is not null")
    each = rounds.groupBy("model", "fold", "series", "target").agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"))
    return each.groupBy("model", "fold", "target").agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"))


def cross_validate(panel: Panel, folds: DataFrame, in_chunk_len: int, out_chunk_len: int, alpha: float = 1.0, skip_chunk_len: int = 0) -> DataFrame:
    """``fold, mse, mae``, means over targets: a model for each fold, scored by rolling origins in its test rows. Two passes, whatever the folds."""
    models = fit(panel, folds, {"model": Setting(in_chunk_len, alpha)}, out_chunk_len, skip_chunk_len)
    return scores(forecasts(panel, folds, {k: m for k, m in models.items() if k[1] >= 0})).groupBy("fold").agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"))


def grid_search(panel: Panel, folds: DataFrame, space: dict[str, list], out_chunk_len: int, n_trials: int | None = None, metric: str = "mse", seed: int = 1, skip_chunk_len: int = 0) -> tuple[dict, list[tuple[dict, float]], Ridge]:
    """The best of all (or ``n_trials`` random) settings of ``in_chunk_len`` and ``alpha``, every trial's score, and the best fitted to all rows: two passes, whatever the trials."""
    trials = [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]
    if n_trials is not None and n_trials < len(trials):
        trials = random.Random(seed).sample(trials, n_trials)
    settings = {str(i): Setting(**t) for i, t in enumerate(trials)}
    models = fit(panel, folds, settings, out_chunk_len, skip_chunk_len)
    found = scores(forecasts(panel, folds, {k: m for k, m in models.items() if k[1] >= 0}))
    by_fold = found.groupBy("model", "fold").agg(F.avg(metric).alias("s")).groupBy("model").agg(F.avg("s").alias("s"))
    score = {r["model"]: r["s"] for r in by_fold.collect()}  # one number a trial
    scored = [(t, score.get(str(i), float("inf"))) for i, t in enumerate(trials)]
    best = min(range(len(trials)), key=lambda i: scored[i][1])
    return trials[best], scored, models[str(best), -1]


# -- stacking -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stack:
    """Base models fitted to all rows, and for each target the final model over their forecasts (a weight a base, and an intercept)."""

    bases: dict[str, Ridge]
    final: dict[str, np.ndarray]
    out_chunk_len: int


def out_of_fold(panel: Panel, folds: DataFrame, settings: dict[str, Setting], out: int, skip: int = 0, left_out: bool = True) -> tuple[DataFrame, dict[str, Ridge]]:
    """``model, fold, series, origin, last_ts, target, h, y, p`` by models that saw none of these rows, and the models of all rows.

    With ``left_out`` a fold's model learns from every window without a row of the fold; else from the
    fold's training rows, as for expanding folds.
    """
    models = fit(panel, folds, settings, out, skip, left_out)
    made = forecasts(panel, folds, {k: m for k, m in models.items() if k[1] >= 0}, left_out)
    return made, {name: m for (name, fold), m in models.items() if fold < 0}


def stack(panel: Panel, folds: DataFrame, settings: dict[str, Setting], out: int, skip: int = 0, alpha: float = 1.0, left_out: bool = True) -> Stack:
    """A final linear model for each target over the base models' out-of-fold forecasts, from one aggregate."""
    made, bases = out_of_fold(panel, folds, settings, out, skip, left_out)
    names = sorted(settings)
    wide = made.groupBy("series", "fold", "origin", "target", "h").pivot("model", names).agg(F.first("p")).join(
        made.groupBy("series", "fold", "origin", "target", "h").agg(F.first("y").alias("_y")), ["series", "fold", "origin", "target", "h"]
    ).dropna()
    z = [F.lit(1.0), *[F.col(f"`{n}`") for n in names], F.col("_y")]
    sums = [F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i in range(len(z) - 1) for j in range(len(z))]
    final = {}
    for r in wide.groupBy("target").agg(*sums).collect():  # a row a target
        m = np.array([[r[f"s{i}_{j}"] for j in range(len(z))] for i in range(len(z) - 1)])
        penalty = alpha * np.eye(len(m))
        penalty[0, 0] = 0
        final[r["target"]] = np.linalg.solve(m[:, :-1] + penalty, m[:, -1])
    return Stack(bases, final, out)


def stacked(panel: Panel, model: Stack, step: str) -> DataFrame:
    """``key, ts`` and each target's forecast after each series' end."""
    names = sorted(model.bases)
    targets = panel.columns("target")
    made = None
    for i, n in enumerate(names):  # a few base models
        one = predict(model.bases[n], panel, step).select(panel.key, "ts", *[F.col(t).alias(f"_{i}_{j}") for j, t in enumerate(targets)])
        made = one if made is None else made.join(one, [panel.key, "ts"])
    value = lambda j, t: sum((F.col(f"_{i}_{j}") * float(w) for i, w in enumerate(model.final[t][1:])), F.lit(float(model.final[t][0])))
    return made.select(panel.key, "ts", *[value(j, t).alias(t) for j, t in enumerate(targets)])
