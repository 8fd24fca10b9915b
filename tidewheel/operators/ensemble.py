"""Combining several models' predictions."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMBINE = {"mean": F.avg, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, F.lit(0.5))}


def ensemble_weight(preds: DataFrame, key: str, ts: str, value: str = "y", mode: str = "mean") -> DataFrame:
    """``key, ts, value`` of long predictions (model, key, ts, value)."""
    return preds.groupBy(key, ts).agg(COMBINE[mode](value).alias(value))


def ensemble_stack(oof: DataFrame, truth: DataFrame, new: DataFrame, key: str, ts: str, models: list[str], value: str = "y", depth: int = 5, rounds: int = 20) -> DataFrame:
    """``key, ts, value``: a boosted-tree regressor over the models' out-of-fold predictions."""
    wide = lambda p: p.groupBy(key, ts).pivot("model", models).agg(F.first(value))
    features = VectorAssembler(inputCols=models, outputCol="features", handleInvalid="skip")
    train = features.transform(wide(oof).join(truth.select(key, ts, F.col(value).cast("double").alias("label")), [key, ts]).filter("label is not null"))
    model = GBTRegressor(maxDepth=depth, maxIter=rounds, seed=1).fit(train)
    return model.transform(features.transform(wide(new))).select(key, ts, F.col("prediction").alias(value))


def error_products(preds: DataFrame, truth: DataFrame, key: str, ts: str, models: list[str], value: str = "y") -> dict[tuple[str, str], float]:
    """Mean product of each two models' errors: one aggregate over all rows."""
    wide = preds.groupBy(key, ts).pivot("model", models).agg(F.first(value)).join(truth.select(key, ts, F.col(value).alias("_y")), [key, ts])
    e = {m: F.col(m) - F.col("_y") for m in models}
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i:]]
    row = wide.agg(*[F.avg(e[a] * e[b]).alias(f"p_{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {p: row[f"p_{i}"] for i, p in enumerate(pairs)}


def ensemble_search(preds: DataFrame, truth: DataFrame, key: str, ts: str, models: list[str], value: str = "y") -> tuple[tuple[str, ...], float]:
    """The subset whose mean has the least squared error, of all subsets, and that error.

    One aggregate over all rows gives the models' error products; best_subset() works on these.
    """
    g = error_products(preds, truth, key, ts, models, value)
    at = np.array([[g.get((a, b), g.get((b, a))) for b in models] for a in models], float)
    places, error = best_subset(at)
    return tuple(models[i] for i in places), error


def best_subset(products: np.ndarray) -> tuple[tuple[int, ...], float]:
    """The places S that minimise the mean of products[S, S], exactly, by branch and bound; of equal ones the smallest, then the first.

    A subset's error is x'Gx with equal weights x. Over all weights that sum to 1 and are zero for
    models left out it can't be less: this convex lower bound, the least error of any weighted mean,
    ends most branches. Each branch decides on one model, the heaviest in the bound's weights.
    """
    n = len(products)
    score = lambda s: float(products[np.ix_(s, s)].sum()) / len(s) ** 2
    rank = lambda s: (score(s), len(s), s)
    best, now = min(rank((i,)) for i in range(n)), []
    for _ in range(n):  # a good start: add the model that helps most
        now = min((sorted([*now, i]) for i in range(n) if i not in now), key=score)
        best = min(best, rank(tuple(now)))
    slack = 1e-12 * max(1.0, float(np.abs(products).max(initial=0)))
    todo = [((), tuple(range(n)))]
    while todo:
        chosen, free = todo.pop()
        if chosen:
            best = min(best, rank(tuple(sorted(chosen))))
        if not free:
            continue
        bound, weights = _least_of_equal(products, chosen, free)
        if bound > best[0] + slack:
            continue
        pick = free[int(np.argmax(weights))]
        rest = tuple(i for i in free if i != pick)
        todo += [(chosen, rest), ((*chosen, pick), rest)]  # with it first
    return best[2], best[0]


def _least_of_equal(g: np.ndarray, chosen: tuple[int, ...], free: tuple[int, ...], steps: int = 200) -> tuple[float, np.ndarray]:
    """A lower bound of the error of every subset with ``chosen`` and some of ``free``, and the weights of ``free`` near it.

    In any such subset of m models the chosen have 1/m each and a free one 1/m or nothing, so for
    each m the bound is of a quadratic over a box and a sum; conditional-gradient steps end with a
    certified bound: the value less the gap.
    """
    k, low, weights = len(chosen), np.inf, np.zeros(len(free))
    c, f = list(chosen), list(free)
    inner, cross, own = g[np.ix_(f, f)], g[np.ix_(f, c)].sum(1) if c else np.zeros(len(f)), float(g[np.ix_(c, c)].sum()) if c else 0.0
    for m in range(max(1, k), k + len(f) + 1):
        y = np.full(len(f), (m - k) / len(f))  # in units of 1/m: 0 to 1 each, m - k together
        bound = -np.inf
        for _ in range(steps if 0 < m - k < len(f) else 1):
            slope = 2 * (inner @ y + cross)
            corner = np.zeros(len(f))
            corner[np.argsort(slope, kind="stable")[: m - k]] = 1
            d = corner - y
            value = own + 2 * cross @ y + y @ inner @ y
            bound = max(bound, (value + slope @ d) / m**2)
            curve = d @ inner @ d
            gap = -(slope @ d)
            if gap <= 1e-9 * max(1.0, abs(value)) or bound > low:
                break
            y = y + d * (1.0 if curve <= 0 else min(1.0, gap / (2 * curve)))
        if bound < low:
            low, weights = bound, y
    return low, weights


def attribution_rollup(df: DataFrame, value: str = "attribution") -> DataFrame:
    """Sums of attributions (out_step, in_step, feature) by (out, in), (out, feature) and (in, feature), in one pass."""
    sets = [["out_step", "in_step"], ["out_step", "feature"], ["in_step", "feature"]]
    cols = [F.col(c) for c in ("out_step", "in_step", "feature")]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.sum(value).alias(value), F.grouping_id().cast("long").alias("grouping"))
