"""Exploration: summaries, correlation, autocorrelation, seasonality, spectra."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import series as numeric
from ..panel import in_order, whole

QUANTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


def summary(df: DataFrame, cols: list[str], by: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """``column, missing, count, mean, std, min, 25%, 50%, 75%, max`` (long in column), from one aggregate."""
    q = F.approx_percentile if approximate else F.percentile
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        parts = [
            (F.sum(v.isNull().cast("double")) / F.count("*")).alias("missing"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
            *[q(v, F.lit(p)).alias(n) for n, p in QUANTILES.items()], F.max(v).alias("max"),
        ]
        aggs.append(F.struct(F.lit(c).alias("column"), *parts).alias(c))
    table = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return table.select(*(by or []), F.explode(F.array(*[F.col(f"`{c}`") for c in cols])).alias("r")).select(*(by or []), "r.*")


def percentiles(df: DataFrame, cols: list[str], shares: tuple[float, ...] = tuple(QUANTILES.values()), bound: int = 100_000, error: float = 1e-3) -> DataFrame:
    """``column, share, value``: exact percentiles of a whole table, between rows by interpolation; no task holds a column.

    A sketch brackets the rows asked for between two values of the data, one aggregate counts what lies
    below, at and between them, and brackets of over ``bound`` rows are cut again; a value that makes up
    much of a bracket becomes one of its ends. Each pass leaves about ``2 error`` of a bracket, so a
    few passes serve any table. Values are taken as doubles; NULL and NaN are left out; a column
    without values has NULL.
    """
    names = {c: f"v{i}" for i, c in enumerate(cols)}
    data = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(v) for c, v in names.items()])
    total = data.agg(*[F.count(v).alias(v) for v in names.values()]).first()
    at = {(c, p): p * (total[names[c]] - 1) for c in cols for p in shares if total[names[c]]}
    rows = {(names[c], k) for (c, _), x in at.items() for k in (math.floor(x), math.ceil(x))}
    ends = {r: (-math.inf, math.inf) for r in rows}
    wider, found = dict(ends), {}
    while ends:
        spans = sorted({(v, *ends[v, k]) for v, k in ends})
        inside = lambda v, lo, hi: (F.col(v) > lo) & (F.col(v) < hi)
        counts = data.agg(*[F.struct(*[F.count_if(x).alias(n) for n, x in (("below", F.col(v) < lo), ("low", F.col(v) == lo), ("mid", inside(v, lo, hi)), ("high", F.col(v) == hi))]).alias(f"s{i}") for i, (v, lo, hi) in enumerate(spans)]).first()
        seen = dict(zip(spans, counts, strict=True))
        few = [s for s in spans if 0 < seen[s]["mid"] <= bound]
        lists = data.agg(*[F.sort_array(F.collect_list(F.when(inside(*s), F.col(s[0])))).alias(f"s{i}") for i, s in enumerate(few)]).first() if few else []  # ``bound`` values each
        short, cut = dict(zip(few, lists, strict=True)), {}
        for v, k in list(ends):
            lo, hi = ends[v, k]
            s = seen[v, lo, hi]
            x = k - s["below"] - s["low"]
            if k < s["below"] or x >= s["mid"] + s["high"]:  # beside the bracket, where the sketch erred
                ends[v, k] = (wider[v, k][0], lo) if k < s["below"] else (hi, wider[v, k][1])
                continue
            if x < 0 or x >= s["mid"]:
                found[v, k] = lo if x < 0 else hi
            elif (v, lo, hi) in short:
                found[v, k] = short[v, lo, hi][x]
            else:
                cut.setdefault((v, lo, hi), []).append((k, (x + 0.5) / s["mid"]))
                continue
            del ends[v, k]
        for (v, lo, hi), asked in cut.items():
            probes = [min(1.0, max(0.0, q + e)) for _, q in asked for e in (-error, error)]
            got = data.filter(inside(v, lo, hi)).approxQuantile(v, probes, error / 2)
            for i, (k, _) in enumerate(asked):
                wider[v, k], ends[v, k] = (lo, hi), (got[2 * i], got[2 * i + 1])

    def value(c: str, p: float) -> float | None:
        if (c, p) not in at:
            return None
        k = math.floor(at[c, p])
        low, high = found[names[c], k], found[names[c], math.ceil(at[c, p])]
        return low if low == high else low + (high - low) * (at[c, p] - k)

    return df.sparkSession.createDataFrame([(c, p, value(c, p)) for c in cols for p in shares], "column string, share double, value double")


def maxima(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    aggs = [F.max(c).alias(c) for c in cols]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


# -- per series, in numpy ------------------------------------------------------------------------


def per_series(df: DataFrame, key: str, ts: str, cols: list[str], fn: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """``key, column`` and the rows that ``fn`` makes (arrays by name) of each column of each series in time order.

    Spark deals and sorts the series; a task goes through them batch by batch, as a call and a frame for
    each of many short series would cost more than their work. It holds one series and one batch.
    """
    kind = dict(df.dtypes)[key]
    out_schema = f"`{key}` {kind}, column string, {schema}"

    fields = to_arrow_schema(StructType.fromDDL(out_schema))

    def run(batches):
        held = None

        def made(t: pa.Table, starts: list[int], ends: list[int]):
            values = [t.column(2 + i).to_numpy() for i in range(len(cols))]
            parts = [(lo, c, fn(values[i][lo:hi])) for lo, hi in zip(starts, ends, strict=True) for i, c in enumerate(cols)]
            many = [len(next(iter(p.values()))) for _, _, p in parts]
            some = [p for (_, _, p), n in zip(parts, many, strict=True) if n]
            if some:
                at = np.repeat([lo for lo, _, _ in parts], many)
                rest = [pa.array(np.concatenate([np.asarray(p[f.name]) for p in some]), f.type, from_pandas=True) for f in list(fields)[2:]]
                yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks().take(pa.array(at)), pa.array(np.repeat([c for _, c, _ in parts], many), pa.string()), *rest], schema=fields)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            k = t.column(0).combine_chunks()
            a, z = k[:-1], k[1:]
            differ = pc.and_not(pc.fill_null(pc.not_equal(a, z), True), pc.and_(pc.is_null(a), pc.is_null(z)))
            edge = np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1
            if len(edge):
                yield from made(t, [0, *edge[:-1].tolist()], edge.tolist())
            held = t.slice(int(edge[-1]) if len(edge) else 0)  # the last series may go on
        if held is not None:
            yield from made(held, [0], [held.num_rows])

    rows = df.select(key, ts, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    return rows.repartition(key).sortWithinPartitions(F.asc(key), F.asc_nulls_last(ts)).mapInArrow(run, out_schema)


def acf(df: DataFrame, key: str, ts: str, cols: list[str], nlags: int = 300, alpha: float = 0.05) -> DataFrame:
    """``lag, acf, width`` of each series; ``nlags`` is cut to its length less one."""

    def one(x: np.ndarray) -> dict:
        n = min(nlags, len(x) - 1)
        r = numeric.acf(x, n)
        width = numeric.acf_widths(r, len(x), alpha) if n else np.zeros(0)
        return {"lag": np.arange(n + 1), "acf": r, "width": np.r_[np.nan, width[:n]]}

    return per_series(df, key, ts, cols, one, "lag long, acf double, width double")


def acf_long(df: DataFrame, key: str, pos: str, col: str, nlags: int, block: int = 100_000) -> DataFrame:
    """``key, lag, acf`` of series of any length, by whole positions.

    Each block of positions, with the ``nlags`` rows before it copied in, sums its own products of all
    lags; one small aggregate adds them up. So a row moves once or twice, whatever the number of lags,
    and no task holds a series. Lags for which no two rows are that far apart have no row; a constant
    series has NULL; rows with a NULL key, position or value are left out; equal positions count each.
    """
    kind, block = dict(df.dtypes)[key], max(block, nlags, 1)
    mean = df.groupBy(key).agg(F.avg(col).alias("_m"), (F.var_pop(col) * F.count(col)).alias("_v"))
    d = df.join(mean, key).select(key, F.col(pos).cast("long").alias("_p"), (F.col(col) - F.col("_m")).alias("_d"), "_v").filter("_d is not null and _p is not null")
    own = F.floor(F.col("_p") / block)
    both = F.when(F.pmod("_p", F.lit(block)) >= block - nlags, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = d.withColumn("_b", F.explode(both))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf["_b"].iloc[0]) * block - nlags
        at = pdf["_p"].to_numpy() - start
        x, many = np.bincount(at, pdf["_d"], block + nlags), np.bincount(at, minlength=block + nlags)
        there = many > 0
        last = len(x)
        own = slice(nlags, last)
        total = [float(x[own] @ x[nlags - k : last - k]) for k in range(nlags + 1)]
        met = [bool((there[own] & there[nlags - k : last - k]).any()) for k in range(nlags + 1)]
        out = pd.DataFrame({"lag": np.arange(nlags + 1, dtype=np.int32), "s": total, "_v": pdf["_v"].iloc[0]})[met]
        out.insert(0, key, pdf[key].iloc[0])
        return out

    parts = dealt.groupBy(key, "_b").applyInPandas(sums, f"`{key}` {kind}, lag int, s double, _v double")
    return parts.groupBy(key, "lag").agg((F.sum("s") / F.nullif(F.first("_v"), F.lit(0.0))).alias("acf"))


def seasonality(df: DataFrame, key: str, ts: str, cols: list[str], period: int | None = None, nlags: int = 300, alpha: float = 0.05, mode: str = "additive", order: int = 1) -> DataFrame:
    """``period, phase, value``: the seasonal profile of each series; no rows where none is found."""

    def one(x: np.ndarray) -> dict:
        x = x[~np.isnan(x)]
        p = period or (numeric.find_period(x, nlags, alpha, order) if len(x) > 2 else None)
        s = numeric.seasonal(x, p, mode) if p else None
        return {"period": [p] * len(s), "phase": np.arange(len(s)), "value": s} if s is not None else {"period": [], "phase": [], "value": []}

    return per_series(df, key, ts, cols, one, "period long, phase long, value double")


def fft(df: DataFrame, key: str, ts: str, cols: list[str], fs: float = 0, norm: bool = True, half: bool = True) -> DataFrame:
    def one(x: np.ndarray) -> dict:
        at, amplitude, phase = numeric.fft(np.nan_to_num(x), fs, norm, half)
        return {"i": np.arange(len(at)), "x": at, "amplitude": amplitude, "phase": phase}

    return per_series(df, key, ts, cols, one, "i long, x double, amplitude double, phase double")


def stft(df: DataFrame, key: str, ts: str, cols: list[str], **options) -> DataFrame:
    def one(x: np.ndarray) -> dict:
        f, t, z = numeric.stft(np.nan_to_num(x), **options)
        return {"f": np.repeat(f, len(t)), "t": np.tile(t, len(f)), "re": z.real.ravel(), "im": z.imag.ravel()}

    return per_series(df, key, ts, cols, one, "f double, t double, re double, im double")


def cwt(df: DataFrame, key: str, ts: str, cols: list[str], scales: int = 64, name: str = "cgau8", fs: float = 1.0) -> DataFrame:
    def one(x: np.ndarray) -> dict:
        c, f = numeric.cwt(np.nan_to_num(x), np.arange(1, scales), name, 1 / fs)
        t = np.linspace(0, 1, len(x))
        return {"scale": np.repeat(np.arange(1, scales), len(t)), "f": np.repeat(f, len(t)), "t": np.tile(t, len(f)), "re": c.real.ravel(), "im": c.imag.ravel()}

    return per_series(df, key, ts, cols, one, "scale long, f double, t double, re double, im double")


def top_periods(df: DataFrame, key: str, ts: str, cols: list[str], k: int = 2) -> DataFrame:
    """``i, amplitude, period``: the k strongest frequencies of the amplitude spectrum, averaged over series and columns of one length."""

    def one(x: np.ndarray) -> dict:
        a = np.abs(np.fft.rfft(np.nan_to_num(x)))
        return {"n": [len(x)] * len(a), "i": np.arange(len(a)), "amplitude": a}

    mean = per_series(df, key, ts, cols, one, "n long, i long, amplitude double").filter("i > 0").groupBy("n", "i").agg(F.avg("amplitude").alias("amplitude"))
    return mean.orderBy(F.desc("amplitude"), "n", "i").limit(k).select("i", "amplitude", F.floor(F.col("n") / F.col("i")).cast("long").alias("period"))


def decompose(df: DataFrame, key, ts: str, col: str, kernel: int = 25) -> DataFrame:
    """``<col>_trend`` (centred moving average, ends padded with the first and last value) and ``<col>_rest``."""
    h = (kernel - 1) // 2
    w, all_rows = in_order(key, ts), in_order(key, ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.row_number().over(w)
    n = F.count("*").over(whole(key))
    left, right = F.greatest(F.lit(h + 1) - at, F.lit(0)), F.greatest(at + h - n, F.lit(0))
    mean = (F.sum(col).over(w.rowsBetween(-h, h)) + left * F.first(col).over(all_rows) + right * F.last(col).over(all_rows)) / F.lit(kernel)
    return df.withColumn(f"{col}_trend", mean).withColumn(f"{col}_rest", F.col(col) - F.col(f"{col}_trend"))


# -- correlation ----------------------------------------------------------------------------------


def correlation(df: DataFrame, key: str, ts: str, cols: list[str], method: str = "pearson", lag: int = 0, lag_cols: tuple[str, ...] = (), by: list[str] | None = None) -> DataFrame:
    """``a, b, corr`` of all pairs of columns, NULL pairs dropped; ``lag_cols`` are moved ``lag`` rows first.

    By the groups of ``by``, or over the whole table.
    """
    if len(cols) < 2:
        raise ValueError("two columns at least")
    if lag:
        df = df.withColumns({c: F.lag(c, lag).over(in_order(key, ts)) for c in lag_cols})
    if method == "kendall":
        return _kendall(df, by, cols) if by else _kendall_of_all(df, cols)
    if method == "spearman":
        rows = []
        for a, b in combinations(cols, 2):
            both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
            if by:
                ranked = both.select(*by, *[_average_rank(c, by).alias(n) for c, n in ((a, "x"), (b, "y"))])
            else:
                ranked = both.select(a, b).join(_global_rank(both, a, "x"), a).join(_global_rank(both, b, "y"), b)
            table = (ranked.groupBy(*by) if by else ranked.groupBy()).agg(F.corr("x", "y").alias("corr"))
            rows.append(table.select(*(by or []), F.lit(a).alias("a"), F.lit(b).alias("b"), "corr"))
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out
    pairs = list(combinations(cols, 2))
    aggs = [F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    table = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return table.select(*(by or []), F.explode(rows).alias("r")).select(*(by or []), "r.*")


def _below(df: DataFrame, c: str, parts: int = 64) -> DataFrame:
    """``c, _n, _below``: how often each distinct value of a whole table occurs, and how many rows are smaller, from counts in ranges of values; no task sorts it all."""
    counts = df.groupBy(c).agg(F.count("*").alias("_n"))
    bounds = sorted(set(counts.approxQuantile(c, [i / parts for i in range(1, parts)], min(0.001, 0.1 / parts))))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(c).cast("double"))) if bounds else F.lit(0)
    dealt = counts.withColumn("_p", part)
    before, at = 0, {}
    for r in sorted(dealt.groupBy("_p").agg(F.sum("_n").alias("n")).collect()):  # ``parts`` rows at most
        at[r["_p"]], before = before, before + r["n"]
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in (at or {0: 0}).items() for x in pair]), F.col("_p"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.select(c, "_n", (offset + below).alias("_below"))


def _global_rank(df: DataFrame, c: str, name: str) -> DataFrame:
    """``c, name``: the average rank of each distinct value of a whole table."""
    return _below(df, c).select(c, (F.col("_below") + (F.col("_n") + 1) / 2).alias(name))


def _average_rank(c: str, by: list[str]):
    """Rank with ties averaged: a value's rank, from counts of distinct values, needs no order among ties."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2


def _kendall(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = [pdf[c].iloc[0] for c in by]
        rows = [(*group, a, b, numeric.kendall(pdf[a].to_numpy(float), pdf[b].to_numpy(float))) for a, b in combinations(cols, 2)]
        return pd.DataFrame(rows, columns=[*by, "a", "b", "corr"])

    return df.select(*by, *cols).groupBy(*by).applyInPandas(run, f"{kinds}, a string, b string, corr double")


#: Distinct points of a part of a table in Kendall's tau.
PART = 1_000_000


def _discordant(points: DataFrame, rows: int) -> int:
    """Pairs of the points (``x, y, n``: n rows each) that x and y order differently.

    Both axes are cut into ranges of values, a frequent value into a range of its own. A pair lies in
    one range of x, or in one range of y but not of x (then the range of x stands for x), or in none:
    then only the cell counts, and the cells are the points of the next round, a quarter as many at
    most. A part holds ``2 rows`` points, or ``8 sqrt(n)`` of n points where that is more; ranges of one
    value have no such pairs within and are never put into one part.
    """
    points = points.persist()
    try:
        n = points.count()
        parts = min(-(-n // rows), int(n**0.5) // 4)

        def inverted(table: DataFrame, *by: str) -> int:
            def count(pdf: pd.DataFrame) -> pd.DataFrame:
                x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
                order = np.lexsort((y, x))
                found = numeric.inversions(np.unique(y, return_inverse=True)[1][order], pdf["n"].to_numpy()[order])
                return pd.DataFrame({"d": [str(found)]})

            each = table.withColumn("all", F.lit(0)).groupBy("all", *by).applyInPandas(count, "d string")
            return int(each.agg(F.sum(F.col("d").cast("decimal(38,0)"))).first()[0] or 0)

        if n <= rows or parts < 2:
            return inverted(points)
        dealt = points
        for axis in ("x", "y"):
            often = F.col("_n") * parts > n
            at = _below(points, axis, int(min(1000, 64 + n // 10_000_000)))
            at = at.select(axis, (2 * F.floor(F.col("_below") * parts / n) + often.cast("long")).alias(f"{axis}_part"), often.alias(f"{axis}_often"))
            dealt = dealt.join(at, axis)
        dealt = dealt.persist()
        try:
            within_x = inverted(dealt.filter("not x_often").select("x", "y", "n", "x_part"), "x_part")
            within_y = inverted(dealt.filter("not y_often").select(F.col("x_part").alias("x"), "y", "n", "y_part"), "y_part")
            cells = dealt.groupBy(F.col("x_part").alias("x"), F.col("y_part").alias("y")).agg(F.sum("n").alias("n"))
            return within_x + within_y + _discordant(cells, rows)
        finally:
            dealt.unpersist()
    finally:
        points.unpersist()


def _kendall_of_all(df: DataFrame, cols: list[str], rows: int = PART) -> DataFrame:
    """``a, b, corr``: tau-b over a whole table, exact: ties from counts, the rest from discordant pairs.

    Values are taken as doubles. NaN where a column has one value only, or no row both values.
    """
    pairs = lambda n: F.sum(n.cast("decimal(19,0)") * (n - 1).cast("decimal(19,0)") / 2).cast("decimal(38,0)")
    found = []
    for a, b in combinations(cols, 2):
        both = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
        points = both.groupBy("x", "y").agg(F.count("*").alias("n"))
        equal = [int(points.groupBy(*by).agg(F.sum("n").alias("n")).agg(pairs(F.col("n"))).first()[0] or 0) for by in ((), ("x",), ("y",), ("x", "y"))]
        every, x, y, same = equal
        if every == x or every == y:
            found.append((a, b, float("nan")))
            continue
        agree = every - x - y + same - 2 * _discordant(points, rows)
        found.append((a, b, agree / ((every - x) * (every - y)) ** 0.5))
    return df.sparkSession.createDataFrame(found, "a string, b string, corr double")


def report(results: dict[str, DataFrame], key: str) -> DataFrame:
    """Long results ``analyzer, key, column, metric, value`` of several per-series analyses (key, column, numbers)."""
    out = None
    for name, df in results.items():
        numbers = [c for c, t in df.dtypes if c not in (key, "column") and t in ("double", "bigint", "int", "float")]
        long = df.select(F.lit(name).alias("analyzer"), F.col(key).cast("string").alias("key"), "column", *[F.col(c).cast("double") for c in numbers]).unpivot(["analyzer", "key", "column"], numbers, "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out
