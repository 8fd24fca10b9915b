"""Column transforms of series: fill, clip, lag, difference, rolling statistics, scale, encode.

What has statistics is fitted by one aggregate and becomes a ``Fitted`` with ``transform`` and,
where it has one, ``inverse``. Statistics are over all series unless ``by`` names the key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series as numeric
from ..panel import in_order, with_blocks

Change = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Fitted:
    """A fitted transform."""

    transform: Change
    inverse: Change | None = None
    stats: dict | None = None


# -- fill ---------------------------------------------------------------------------------------


def fill(df: DataFrame, key: str, ts: str, cols: list[str], method: str = "pre", value: float = 0.0, window_size: int = 10, min_num_non_missing_values: int = 1) -> DataFrame:
    """NULLs filled from before, from after, by a value, or by a statistic of the trailing window.

    ``max``, ``min``, ``mean`` and ``median`` cascade: a value just filled counts in later windows.
    """
    w = in_order(key, ts)
    if method == "pre":
        back = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in cols})
    if method == "next":
        ahead = w.rowsBetween(0, Window.unboundedFollowing)
        return df.withColumns({c: F.first(c, ignorenulls=True).over(ahead) for c in cols})
    if method in ("zero", "default"):
        return df.withColumns({c: F.coalesce(c, F.lit(value).cast(dict(df.dtypes)[c])) for c in cols})
    if method not in ("max", "min", "mean", "median"):
        raise ValueError(f"no fill method {method}")
    marked = df.withColumns({c: F.col(c).cast("double") for c in cols})

    def per_series(pdf):
        pdf = pdf.sort_values(ts)
        for c in cols:
            pdf[c] = numeric.cascading_fill(pdf[c].to_numpy(float), method, window_size, min_num_non_missing_values)
        return pdf

    filled = marked.groupBy(key).applyInPandas(per_series, marked.schema)
    return filled.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def fill_in_blocks(df: DataFrame, key: str, ts: str, step: str, cols: list[str], method: str = "pre", block: int = 100_000) -> DataFrame:
    """As fill() ``pre`` or ``next`` for series of any length, in two passes over blocks of ``block`` steps.

    A block is filled by itself; what its first or last gap lacks comes from the nearest block with a
    value, found among one row a block.
    """
    if method not in ("pre", "next"):
        raise ValueError(f"no fill method {method} in blocks")
    at, back = with_blocks(df, key, ts, step, block), method == "pre"
    reach = lambda w: w.rowsBetween(Window.unboundedPreceding, 0) if back else w.rowsBetween(0, Window.unboundedFollowing)
    near = F.last if back else F.first
    inner = reach(in_order([key, "_block"], ts))
    at = at.withColumns({c: near(c, ignorenulls=True).over(inner) for c in cols})
    edge = F.max_by if back else F.min_by
    ends = at.groupBy(key, "_block").agg(*[edge(c, ts).alias(f"_{c}") for c in cols])
    over = in_order(key, "_block")
    beyond = over.rowsBetween(Window.unboundedPreceding, -1) if back else over.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.select(key, "_block", *[near(f"_{c}", ignorenulls=True).over(beyond).alias(f"_{c}") for c in cols])
    joined = at.join(ends, [key, "_block"])
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in cols}).select(*df.columns)


def fill_isolated(df: DataFrame, key: str, ts: str, col: str, method: str, window_size: int) -> DataFrame:
    """As fill() where no two gaps lie within one window: a frame aggregate does, without Python."""
    frame = in_order(key, ts).rowsBetween(-(window_size - 1), 0)
    stat = {"max": F.max, "min": F.min, "mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5))}[method]
    return df.withColumn(col, F.coalesce(F.col(col).cast("double"), stat(col).over(frame).cast("double")))


# -- clip, lag, difference, rolling --------------------------------------------------------------


def ksigma(df: DataFrame, cols: list[str], k: float = 3.0) -> Fitted:
    """Values beyond k sample standard deviations from the mean become the mean; NULLs stay."""
    numbers = [c for c in cols if dict(df.dtypes)[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or dict(df.dtypes)[c].startswith("decimal")]
    if not numbers:
        return Fitted(lambda d: d, stats={})
    row = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(numbers) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    stats = {c: (row[f"m_{i}"] - k * row[f"s_{i}"], row[f"m_{i}"] + k * row[f"s_{i}"], row[f"m_{i}"]) for i, c in enumerate(numbers) if row[f"s_{i}"] is not None}
    clip = lambda c, b: F.when((F.col(c) < b[0]) | (F.col(c) > b[1]), F.lit(b[2])).otherwise(F.col(c))
    return Fitted(lambda d: d.withColumns({c: clip(c, b) for c, b in stats.items()}), stats=stats)


def points(n: int, step: int) -> list[int]:
    return list(range(step, n + 1, step))


def lag(df: DataFrame, key, ts: str, cols: list[str], lag_points: int, down_samples: int = 1, suffix: str = "_before") -> DataFrame:
    """``<col><suffix>_<i>``: the value i rows earlier, all from one sort."""
    w = in_order(key, ts)
    return df.select("*", *[F.lag(c, i).over(w).alias(f"{c}{suffix}_{i}") for c in cols for i in points(lag_points, down_samples)])


def difference(df: DataFrame, key, ts: str, cols: list[str], difference_points: int, down_samples: int = 1, suffix: str = "_diff", targets: tuple[str, ...] = ()) -> DataFrame:
    """``<col><suffix>_<i>``: the value less that i rows earlier; targets can't be differenced."""
    if set(cols) & set(targets):
        raise ValueError("a target can't be differenced")
    w = in_order(key, ts)
    return df.select("*", *[(F.col(c) - F.lag(c, i).over(w)).alias(f"{c}{suffix}_{i}") for c in cols for i in points(difference_points, down_samples)])


_STATS: dict[str, Callable[[str], Column]] = {"median": lambda c: F.percentile(c, F.lit(0.5)), "mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp}


def rolling_stats(df: DataFrame, key, ts: str, cols: list[str], start: int = 0, end: int = 1, statistics: tuple[str, ...] = ("median", "mean", "max", "min", "std")) -> DataFrame:
    """Statistics of the rows t-end+1 … t-start; NULL until that window is full, NULLs in it are skipped."""
    w = in_order(key, ts)
    frame = w.rowsBetween(-(end - 1), -start)
    full = F.row_number().over(w) >= end
    return df.select("*", *[F.when(full, _STATS[s](c).over(frame)).alias(f"{c}_{s}") for c in cols for s in statistics])


# -- encode and scale -----------------------------------------------------------------------------


def _categories(df: DataFrame, cols: list[str], most: int) -> dict[str, list]:
    """Sorted distinct values of each column; more than ``most`` are an error, not a flood."""
    out = {}
    for c in cols:
        out[c] = [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).limit(most + 1).collect()]
        if len(out[c]) > most:
            raise ValueError(f"{c} has more than {most} categories; join a dictionary table instead")
    return out


def _unknown(c: str, known: list, then: Column, handle: str) -> Column:
    bad = F.col(c).isNotNull() & ~F.col(c).isin(known) if known else F.col(c).isNotNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), F.col(c).cast("string"))).cast("double")).otherwise(then) if handle == "error" else then


def one_hot(df: DataFrame, cols: list[str], drop: bool = False, handle_unknown: str = "error", most: int = 1000) -> Fitted:
    """``OneHotEncoder_<col>_<i>`` for the i-th sorted category."""
    known = _categories(df, cols, most)

    def transform(d: DataFrame) -> DataFrame:
        new = [_unknown(c, v, F.coalesce((F.col(c) == x).cast("double"), F.lit(0.0)), handle_unknown).alias(f"OneHotEncoder_{c}_{i}") for c, v in known.items() for i, x in enumerate(v)]
        return d.select(*[c for c in d.columns if not drop or c not in cols], *new)

    return Fitted(transform, stats=known)


def ordinal(df: DataFrame, cols: list[str], drop: bool = True, handle_unknown: str = "error", unknown_value: float | None = None, most: int = 10_000) -> Fitted:
    """Codes 0.0 … in sorted order, in place if ``drop``, else as ``OrdinalEncoder_<cols>_<i>``; works for static columns as well."""
    known = _categories(df, cols, most)

    def code(c: str) -> Column:
        if not known[c]:
            return F.lit(unknown_value).cast("double")
        pairs = F.create_map(*[x for i, v in enumerate(known[c]) for x in (F.lit(v), F.lit(float(i)))])
        found = F.try_element_at(pairs, F.col(c))
        return _unknown(c, known[c], F.when(F.col(c).isNotNull(), F.coalesce(found, F.lit(unknown_value).cast("double"))), handle_unknown)

    def transform(d: DataFrame) -> DataFrame:
        if drop:
            return d.withColumns({c: code(c) for c in cols})
        return d.select("*", *[code(c).alias(f"OrdinalEncoder_{'-'.join(cols)}_{i}") for i, c in enumerate(cols)])

    def inverse(d: DataFrame) -> DataFrame:
        back = {c: F.get(F.array(*map(F.lit, v)), F.col(c).cast("int")) for c, v in known.items() if v}
        return d.withColumns(back)

    return Fitted(transform, inverse if drop else None, known)


def _linear(df: DataFrame, cols: list[str], stats: list[tuple[str, Callable]], scale: Callable, back: Callable, by: str | None) -> Fitted:
    """Scaling from a few aggregates: as literals, or joined by key when fitted for each series."""
    aggs = [f(c).alias(f"_{n}_{i}") for i, c in enumerate(cols) for n, f in stats]
    if by is None:
        row = df.agg(*aggs).first()
        of = lambda i: [F.lit(row[f"_{n}_{i}"]).cast("double") for n, _ in stats]
        apply = lambda d, f: d.withColumns({c: f(F.col(c), *of(i)) for i, c in enumerate(cols)})
        return Fitted(lambda d: apply(d, scale), lambda d: apply(d, back), row.asDict())
    table = df.groupBy(by).agg(*aggs)
    of = lambda i: [F.col(f"_{n}_{i}") for n, _ in stats]
    apply = lambda d, f: d.join(table, by, "left").withColumns({c: f(F.col(c), *of(i)) for i, c in enumerate(cols)}).select(*d.columns)
    return Fitted(lambda d: apply(d, scale), lambda d: apply(d, back), {"table": table})


def _or_one(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(x)


def standard_scale(df: DataFrame, cols: list[str], with_mean: bool = True, with_std: bool = True, by: str | None = None) -> Fitted:
    """(x - mean) / population deviation; a deviation of 0 counts as 1."""
    m = lambda a: a if with_mean else F.lit(0.0)
    s = lambda b: _or_one(b) if with_std else F.lit(1.0)
    return _linear(df, cols, [("mean", F.avg), ("std", F.stddev_pop)], lambda x, a, b: (x - m(a)) / s(b), lambda x, a, b: x * s(b) + m(a), by)


def minmax_scale(df: DataFrame, cols: list[str], f_range: tuple[float, float] = (0.0, 1.0), clip: bool = False, by: str | None = None) -> Fitted:
    """To a range by the least and greatest value; an empty span counts as 1."""
    lo, hi = map(float, f_range)

    def scale(x: Column, a: Column, b: Column) -> Column:
        y = (x - a) / _or_one(b - a) * (hi - lo) + lo
        return F.when(x.isNotNull(), F.least(F.greatest(y, F.lit(lo)), F.lit(hi))) if clip else y

    return _linear(df, cols, [("min", F.min), ("max", F.max)], scale, lambda x, a, b: (x - lo) / (hi - lo) * _or_one(b - a) + a, by)


def ud_transform(df: DataFrame, key: str, ts: str, fn: Callable, in_cols: list[str], out_cols: list[str] | None = None, ordered: bool = False, drop_origin_columns: bool = False, name: str = "UserTransform") -> DataFrame:
    """A caller's function of a pandas frame of ``in_cols`` to an array of as many rows.

    Row by row by default (batches); ``ordered`` gives it one whole series in time order. Results
    are doubles named ``out_cols``, else as the input if that is dropped and equally wide.
    """
    names = out_cols or (in_cols if drop_origin_columns else [f"{name}_{'-'.join(in_cols)}_{i}" for i in range(len(in_cols))])
    kept = [c for c in df.columns if not (drop_origin_columns and c in in_cols) and c not in names]
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{n}` double" for n in names])

    def change(pdf):
        import numpy as np

        out = np.asarray(fn(pdf[in_cols]), float).reshape(len(pdf), -1)
        if out.shape[1] != len(names):
            raise ValueError(f"{out.shape[1]} columns came back for {len(names)} names")
        new = pdf[kept].copy()
        for i, n in enumerate(names):
            new[n] = out[:, i]
        return new

    if ordered:
        return df.groupBy(key).applyInPandas(lambda pdf: change(pdf.sort_values(ts)), schema)
    return df.mapInPandas(lambda batches: map(change, batches), schema)


def fit_pipeline(df: DataFrame, steps: list[Callable[[DataFrame], Fitted]]) -> Fitted:
    """Steps fitted one after the other on the training rows only; the inverse goes backwards and skips steps without one."""
    fitted = []
    for step in steps:
        fitted.append(step(df))
        df = fitted[-1].transform(df)

    def run(d: DataFrame) -> DataFrame:
        for f in fitted:
            d = f.transform(d)
        return d

    def back(d: DataFrame) -> DataFrame:
        for f in reversed(fitted):
            d = f.inverse(d) if f.inverse else d
        return d

    return Fitted(run, back, {"steps": fitted})


def transform_tail(df: DataFrame, key: str, ts: str, n_rows: int, need: int, transform: Change) -> DataFrame:
    """``transform`` for the last ``n_rows`` of each series only, with ``need`` rows before them (-1: all)."""
    from_end = F.row_number().over(Window.partitionBy(key).orderBy(F.col(ts).desc()))
    at = df.withColumn("_end", from_end)
    recent = at if need < 0 else at.filter(F.col("_end") <= n_rows + need)
    return transform(recent).filter(F.col("_end") <= n_rows).drop("_end")
