"""Sliding windows over series: samples for models, lag matrices, window normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import following
from ..panel import Panel, in_order, whole


def _arrays(panel: Panel, length: int, roles: tuple[str, ...]) -> tuple[list[str], Column]:
    cols = panel.columns(*roles)
    w = in_order(panel.key, panel.ts).rowsBetween(-(length - 1), 0)
    return cols, F.collect_list(F.struct(*[F.col(c) for c in cols])).over(w)


def make_samples(panel: Panel, in_chunk_len: int, out_chunk_len: int, skip_chunk_len: int = 0, sampling_stride: int = 1, time_window: tuple[int, int] | None = None) -> DataFrame:
    """One row a window, by its tail position t: ``past_<target>``, ``future_<target>``, ``past_<observed>``,
    ``past_/future_<known>`` as arrays, static columns by name.

    Tails run from in+skip+out-1 to the end, ``sampling_stride`` apart; windows are gathered only at
    these rows, from one frame of in+skip+out rows.
    """
    length = in_chunk_len + skip_chunk_len + out_chunk_len
    cols, frame = _arrays(panel, length, ("target", "observed", "known"))
    lo, hi = time_window or (length - 1, None)
    at = F.row_number().over(in_order(panel.key, panel.ts)) - 1
    tail = panel.df.withColumn("_t", at).withColumn("_n", F.count("*").over(whole(panel.key)))
    keep = (F.col("_t") >= max(lo, length - 1)) & ((F.col("_t") - lo) % sampling_stride == 0)
    if hi is not None:
        keep = keep & (F.col("_t") <= hi)
    rows = tail.withColumn("_rows", F.when(keep, frame)).filter(keep)
    part = lambda c, start, n: F.slice(F.col("_rows")[c], start, n)
    out: list[Column] = []
    for c in cols:
        role = panel.roles[c]
        out.append(part(c, 1, in_chunk_len).alias(f"past_{c}"))
        if role in ("target", "known"):
            out.append(part(c, in_chunk_len + skip_chunk_len + 1, out_chunk_len).alias(f"future_{c}"))
    return rows.select(panel.key, F.col(panel.ts).alias("tail_ts"), F.col("_t").cast("long").alias("tail"), *out, *sorted(panel.columns("static")))


def make_samples_by_window(panel: Panel, in_chunk_len: int, out_chunk_len: int, skip_chunk_len: int, sampling_stride: int) -> DataFrame:
    """``key, tail, past_/future_<target>``, as make_samples(), for long windows far apart: each row goes to the windows that hold it."""
    length = in_chunk_len + skip_chunk_len + out_chunk_len
    key, ts = panel.key, panel.ts
    at = panel.df.withColumn("_t", F.row_number().over(in_order(key, ts)) - 1).withColumn("_n", F.count("*").over(whole(key)))
    first = F.greatest(F.lit(0), F.ceil((F.col("_t") - length + 1) / sampling_stride))
    last = F.least(F.floor(F.col("_t") / sampling_stride), F.floor((F.col("_n") - length) / sampling_stride))
    held = at.filter(first <= last).withColumn("_w", F.explode(F.sequence(first, last)))
    cols = panel.columns("target")
    got = held.groupBy(key, "_w").agg(F.sort_array(F.collect_list(F.struct("_t", *cols))).alias("_rows"))
    part = lambda c, start, n: F.slice(F.col("_rows")[c], start, n)
    out = [x for c in cols for x in (part(c, 1, in_chunk_len).alias(f"past_{c}"), part(c, in_chunk_len + skip_chunk_len + 1, out_chunk_len).alias(f"future_{c}"))]
    return got.select(key, (F.col("_w") * sampling_stride + length - 1).cast("long").alias("tail"), *out)


def predict_samples(panel: Panel, in_chunk_len: int) -> DataFrame:
    """The last window of each series: ``past_<col>`` arrays of its last ``in_chunk_len`` rows."""
    cols = panel.columns("target", "observed", "known")
    back = Window.partitionBy(panel.key).orderBy(F.col(panel.ts).desc())
    last = panel.df.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= in_chunk_len)
    got = last.groupBy(panel.key).agg(F.max(panel.ts).alias("last_ts"), F.sort_array(F.collect_list(F.struct(panel.ts, *cols))).alias("_rows"), *[F.first(c, True).alias(c) for c in sorted(panel.columns("static"))])
    return got.filter(F.size("_rows") == in_chunk_len).select(panel.key, "last_ts", *[F.col("_rows")[c].alias(f"past_{c}") for c in cols], *sorted(panel.columns("static")))


def fill_last_value(panel: Panel, in_chunk_len: int, out_chunk_len: int, skip_chunk_len: int, sampling_stride: int, step: str, value: float) -> Panel:
    """Rows of a constant after each series, so that the last stride lands on its end."""
    length = in_chunk_len + skip_chunk_len + out_chunk_len
    ends = panel.df.groupBy(panel.key).agg(F.max(panel.ts).alias("_end"), F.count("*").alias("_n"), *[F.first(c, True).alias(c) for c in panel.columns("static")])
    short = F.pmod(-(F.col("_n") - length), F.lit(sampling_stride))
    add = ends.filter((F.col("_n") >= length) & (short > 0)).withColumn("_i", F.explode(F.sequence(F.lit(1), short)))
    kinds = dict(panel.df.dtypes)
    new = add.select(panel.key, following(F.col("_end"), F.col("_i"), step).alias(panel.ts), *[F.lit(value).cast(kinds[c]).alias(c) for c in panel.columns("target", "observed", "known")], *panel.columns("static"))
    return panel.on(panel.df.select(*new.columns).unionByName(new))


def coverage_violations(panel: Panel, in_chunk_len: int, out_chunk_len: int, skip_chunk_len: int = 0) -> DataFrame:
    """``key, column, problem``: covariates that don't reach over the samples of the target."""
    length = in_chunk_len + skip_chunk_len + out_chunk_len
    at = panel.df.withColumn("_t", F.row_number().over(in_order(panel.key, panel.ts)) - 1)
    target = F.coalesce(*[F.col(c).cast("string") for c in panel.columns("target")])
    aggs = [F.min(F.when(target.isNotNull(), F.col("_t"))).alias("lo"), F.max(F.when(target.isNotNull(), F.col("_t"))).alias("hi")]
    cols = panel.columns("observed", "known")
    aggs += [f(F.when(F.col(c).isNotNull(), F.col("_t"))).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]
    got = at.groupBy(panel.key).agg(*aggs)
    end = {c: F.col("hi") - (out_chunk_len + skip_chunk_len if panel.roles[c] == "observed" else 0) for c in cols}
    late = lambda c: F.coalesce(F.col(f"lo_{c}") > F.col("lo"), F.lit(True))
    early = lambda c: F.coalesce(F.col(f"hi_{c}") < end[c], F.lit(True))
    rows = [F.when(late(c), F.struct(F.lit(c).alias("column"), F.lit("starts late").alias("problem"))) for c in cols]
    rows += [F.when(early(c), F.struct(F.lit(c).alias("column"), F.lit("ends early").alias("problem"))) for c in cols]
    rows.append(F.when(F.col("hi") - F.col("lo") + 1 < length, F.struct(F.lit("target").alias("column"), F.lit("too short").alias("problem"))))
    return got.select(panel.key, F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("r")).select(panel.key, "r.*")


def column_order(panel: Panel) -> list[tuple[str, str]]:
    """Columns and roles in the order of a design vector: targets; then numeric known, observed, static; then categorical ones (whole numbers)."""
    kinds = dict(panel.df.dtypes)
    whole_number = lambda c: kinds[c] in ("int", "bigint", "smallint", "tinyint")
    rest = [(c, role) for wanted in (False, True) for role in ("known", "observed", "static") for c in panel.columns(role) if whole_number(c) == wanted]
    return [(c, "target") for c in panel.columns("target")] + rest


def design_matrix(samples: DataFrame, panel: Panel) -> DataFrame:
    """``x`` (past targets; then numeric known, observed, static; then categorical ones) and ``y``, flat arrays."""
    flat = []
    for c, role in column_order(panel):
        flat += [F.array(c)] if role == "static" else [F.col(f"past_{c}")] + ([F.col(f"future_{c}")] if role == "known" and f"future_{c}" in samples.columns else [])
    doubles = lambda arrays: F.concat(*[F.transform(a, lambda v: v.cast("double")) for a in arrays])
    y = [F.col(f"future_{c}") for c in panel.columns("target") if f"future_{c}" in samples.columns]
    return samples.withColumn("x", doubles(flat)).withColumn("y", doubles(y) if y else F.array().cast("array<double>"))


def lag_matrix(panel: Panel, in_chunk_len: int, out_chunk_len: int, skip_chunk_len: int = 0, sampling_stride: int = 1) -> DataFrame:
    """Wide rows ``<col>:<role>_lag_<i>``, kept from the tail backwards, ``sampling_stride`` apart."""
    w = in_order(panel.key, panel.ts)
    out: list[Column] = []
    for role in ("target", "observed"):
        out += [F.lag(c, i - 1).over(w).alias(f"{c}:{role}_lag_-{i}") for c in panel.columns(role) for i in range(in_chunk_len, 0, -1)]
    for c in panel.columns("known"):
        out += [F.lag(c, i - 1).over(w).alias(f"{c}:known_lag_-{i}") for i in range(in_chunk_len, 0, -1)]
        out += [F.lead(c, i).over(w).alias(f"{c}:known_lag_{i}") for i in range(1, out_chunk_len + skip_chunk_len + 1)]
    out += [F.col(c).alias(f"{c}:static_lag_0") for c in panel.columns("static")]
    n = F.count("*").over(whole(panel.key))
    back = n - F.row_number().over(w)
    at = panel.df.select(panel.key, panel.ts, *out, back.alias("_b"), n.alias("_n"))
    return at.filter((F.col("_b") % sampling_stride == 0) & (F.col("_b") <= F.col("_n") - in_chunk_len)).drop("_b", "_n")


def lag_matrix_to_series(matrix: DataFrame, key: str, ts: str, step: str) -> DataFrame:
    """``key, sample_ts, ts`` and a column for each name: the small series of each wide row."""
    wide = [c for c in matrix.columns if "_lag_" in c]
    long = matrix.select(key, F.col(ts).alias("sample_ts"), *[F.col(f"`{c}`").cast("double").alias(c) for c in wide]).unpivot([key, "sample_ts"], wide, "name", "value")
    names = sorted({c.rpartition(":")[0] for c in wide})
    parsed = long.select(key, "sample_ts", F.regexp_extract("name", "^(.*):", 1).alias("column"), F.regexp_extract("name", "_lag_(-?[0-9]+)$", 1).cast("int").alias("lag"), "value")
    shifted = parsed.withColumn("ts", following(F.col("sample_ts"), F.col("lag") + F.when(F.col("lag") < 0, 1).otherwise(0), step))
    return shifted.groupBy(key, "sample_ts", "ts").pivot("column", names).agg(F.first("value", True))


def pad_series(df: DataFrame, key: str, ts: str, col: str, max_len: int) -> DataFrame:
    """``key, values, mask``: each series cut or padded with 0 to ``max_len``."""
    head = df.withColumn("_r", F.row_number().over(in_order(key, ts))).filter(F.col("_r") <= max_len)
    got = head.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_r", F.coalesce(F.col(col).cast("double"), F.lit(0.0)).alias("v"))))["v"].alias("v"))
    pad = lambda a, x: F.concat(a, F.array_repeat(x, F.lit(max_len) - F.size("v")))
    return got.select(key, pad(F.col("v"), F.lit(0.0)).alias("values"), pad(F.transform("v", lambda x: F.lit(1)), F.lit(0)).alias("mask"))


def window_normalise(samples: DataFrame, past: str, mode: str = "instance") -> DataFrame:
    """``past`` less its last value, or standardised by its own mean and deviation; both are kept for the inverse."""
    a = F.col(past)
    if mode == "last_value":
        at = samples.withColumn("_mean", F.element_at(a, -1)).withColumn("_sd", F.lit(1.0))
    else:
        total = lambda f: F.aggregate(F.transform(a, f), F.lit(0.0), lambda s, v: s + v)
        at = samples.withColumn("_mean", total(lambda v: v.cast("double")) / F.size(a))
        at = at.withColumn("_sd", F.sqrt(total(lambda v: F.pow(v - F.col("_mean"), F.lit(2.0))) / F.size(a) + F.lit(1e-5)))
    return at.withColumn(past, F.transform(a, lambda v: (v - F.col("_mean")) / F.col("_sd")))


def window_denormalise(samples: DataFrame, forecast: str) -> DataFrame:
    return samples.withColumn(forecast, F.transform(forecast, lambda v: v * F.col("_sd") + F.col("_mean"))).drop("_mean", "_sd")


def patches(a: Column, length: int, stride: int) -> Column:
    """Sub-windows of an array, ``stride`` apart."""
    starts = F.when(F.size(a) >= length, F.sequence(F.lit(1), F.size(a) - length + 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i, length))


def pool_encode(df: DataFrame, key: str, ts: str, cols: list[str], mode: str = "full_series", scales: int = 3) -> DataFrame:
    """``key, code``: the maxima of each channel over the series, or over the last 2^p+1 rows for p below ``scales``."""
    if mode == "full_series":
        return df.groupBy(key).agg(F.array(*[F.max(c).cast("double") for c in cols]).alias("code"))
    back = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(ts).desc())))
    near = [F.max(F.when(F.col("_r") <= 2**p + 1, F.col(c))).cast("double") for p in range(scales) for c in cols]
    return back.filter(F.col("_r") <= 2 ** (scales - 1) + 1).groupBy(key).agg(F.array(*near).alias("code"))
