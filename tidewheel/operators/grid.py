"""Grids, alignment, slicing and projection of series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import bin_start, following, grid, micros
from ..panel import Panel, in_order, whole


#: Steps of a block of a series.
BLOCK = 100_000


def full_grid(df: DataFrame, key: str, ts: str, step: str, block: int = BLOCK) -> DataFrame:
    """``key, ts``: every step between the first and last time of each series.

    Fixed steps come in two levels, blocks of a series and the steps of a block, so no row holds a
    whole series, whatever its length; calendar steps are at most a few for each week.
    """
    lo_hi = df.groupBy(key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    if (length := micros(step)) is None:
        return lo_hi.select(key, F.explode(grid(F.col("_lo"), F.col("_hi"), step)).alias(ts))
    last = F.floor((F.unix_micros("_hi") - F.unix_micros("_lo")) / length)
    blocks = lo_hi.filter("_lo is not null").select(key, "_lo", last.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / block))).alias("_b"))
    steps = blocks.select(key, "_lo", F.explode(F.sequence(F.col("_b") * block, F.least(F.col("_n"), (F.col("_b") + 1) * block - 1))).alias("_i"))
    return steps.select(key, F.timestamp_micros(F.unix_micros("_lo") + F.col("_i") * length).alias(ts))


def regularize(df: DataFrame, key: str, ts: str, step: str, block: int = BLOCK) -> DataFrame:
    """The full grid; a time that the input lacks takes the whole next input row.

    As-of matching without a range join: grid and input are stacked, and a window over each block of
    ``block`` steps looks ahead; what the end of a block lacks is the first input row of the next block
    that has one, carried back among one row a block. No task holds a series.
    """
    cols = [c for c in df.columns if c not in (key, ts)]
    length = micros(step)
    at = F.lit(0).cast("long") if length is None else F.floor(F.unix_micros(ts) / (length * block))
    rows = df.select(key, ts, F.struct(*cols).alias("_row"), F.lit(1).alias("_in"), at.alias("_b"))
    marks = full_grid(df, key, ts, step, block).select(key, ts, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(0).alias("_in"), at.alias("_b"))
    ahead = Window.partitionBy(key, "_b").orderBy(ts, "_in").rowsBetween(0, Window.unboundedFollowing)
    own = rows.unionByName(marks).withColumn("_next", F.first("_row", ignorenulls=True).over(ahead)).filter("_in = 0")
    firsts = rows.groupBy(key, "_b").agg(F.min_by("_row", ts).alias("_first"))
    empty = marks.select(key, "_b").distinct().join(firsts, [key, "_b"], "full")
    later = empty.select(key, "_b", F.first("_first", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    found = own.join(later, [key, "_b"], "left").withColumn("_next", F.coalesce("_next", "_later"))
    return found.select(key, ts, *[F.col("_next")[c].alias(c) for c in cols])


def fill_missing_dates(df: DataFrame, key: str, ts: str, step: str, cols: list[str], method: str = "pre", **options) -> DataFrame:
    from .transforms import fill

    return fill(regularize(df, key, ts, step), key, ts, cols, method, **options)


def resample(df: DataFrame, key: str, ts: str, step: str, cols: list[str]) -> DataFrame:
    """Left-closed bins with the first non-NULL value of each column; empty bins are NULL rows."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in cols]
    bins = df.groupBy(key, bin_start(F.col(ts), step).alias(ts)).agg(*first)
    return full_grid(bins, key, ts, step).join(bins, [key, ts], "left")


def locate(df: DataFrame, key: str, ts: str, point, after: bool = True) -> DataFrame:
    """``key, pos`` of a point: a share of the rows, a row number, or a time (else the next or the one before)."""
    if isinstance(point, float):
        return df.groupBy(key).agg(F.floor((F.count("*") - 1) * F.lit(point)).cast("long").alias("pos"))
    at = df.withColumn("_pos", (F.row_number().over(in_order(key, ts)) - 1).cast("long"))
    if isinstance(point, int):
        return at.filter(F.col("_pos") == point).select(key, F.col("_pos").alias("pos"))
    p = F.lit(point).cast("timestamp")
    inside = at.groupBy(key).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.min(F.when(F.col(ts) >= p, F.col("_pos"))).alias("next"), F.max(F.when(F.col(ts) <= p, F.col("_pos"))).alias("prev"))
    return inside.filter((F.col("lo") <= p) & (p <= F.col("hi"))).select(key, F.col("next" if after else "prev").alias("pos"))


def split(panel: Panel, point, after: bool = True) -> tuple[Panel, Panel]:
    """Two parts: a time or share goes to the first part, an int is its number of rows.

    Known columns reach ahead, so the first part keeps the rows after the cut with known and static
    columns only, marked ``is_future``.
    """
    key, ts, known = panel.key, panel.ts, panel.columns("known", "static")
    cut = panel.df.groupBy(key).agg(F.lit(point).cast("long").alias("cut")) if isinstance(point, int) else locate(panel.df, key, ts, point, after).select(key, (F.col("pos") + 1).alias("cut"))
    at = panel.df.withColumn("_pos", F.row_number().over(in_order(key, ts)) - 1).join(cut, key)
    later = F.col("_pos") >= F.col("cut")
    first = at if panel.columns("known") else at.filter(~later)
    first = first.select(key, ts, *[(F.col(c) if c in known else F.when(~later, F.col(c))).alias(c) for c in panel.columns()], later.alias("is_future"))
    return panel.on(first), panel.on(at.filter(later).drop("_pos", "cut"))


def union_times(key: str, ts: str, *tables: DataFrame) -> DataFrame:
    """``key, ts, pos, length``: the distinct times of all tables, counted."""
    times = reduce(DataFrame.unionByName, [t.select(key, ts) for t in tables]).distinct()
    return times.withColumn("pos", F.row_number().over(in_order(key, ts)) - 1).withColumn("length", F.count("*").over(whole(key)))


def split_union_index(key: str, ts: str, point: int, *tables: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Each table cut at the position ``point`` of the union of all times."""
    last = union_times(key, ts, *tables).filter(F.col("pos") < point).groupBy(key).agg(F.max(ts).alias("_last"))
    joined = [t.join(last, key, "left") for t in tables]
    return [t.filter(F.col(ts) <= F.col("_last")).drop("_last") for t in joined], [t.filter(F.col(ts) > F.col("_last")).drop("_last") for t in joined]


def slice_rows(df: DataFrame, key: str, ts: str, start=None, end=None) -> DataFrame:
    """Rows from ``start`` to ``end``: positions (end excluded) or times (both included)."""
    if isinstance(start, int) or isinstance(end, int):
        at = df.withColumn("_pos", F.row_number().over(in_order(key, ts)) - 1)
        return at.filter((F.col("_pos") >= (start or 0)) & (F.lit(end is None) | (F.col("_pos") < (end or 0)))).drop("_pos")
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        inside = inside & (F.col(ts) <= F.lit(end).cast("timestamp"))
    return df.filter(inside)


def concat_rows(tables: list[DataFrame], key: str, ts: str, drop_duplicates: bool = True, keep: str = "first") -> DataFrame:
    """Tables stacked in order; of rows with one (key, time) the first or last table's stays, or it is an error."""
    stacked = reduce(DataFrame.unionByName, [t.withColumn("_from", F.lit(i)) for i, t in enumerate(tables)])
    if not drop_duplicates:
        n = F.count("*").over(Window.partitionBy(key, ts))
        return stacked.withColumn("_n", F.when(n > 1, F.raise_error(F.lit("a time is in two tables")).cast("long")).otherwise(n)).filter("_n = 1").drop("_from", "_n")
    order = F.col("_from") if keep == "first" else F.col("_from").desc()
    return stacked.withColumn("_n", F.row_number().over(Window.partitionBy(key, ts).orderBy(order))).filter("_n = 1").drop("_from", "_n")


def concat_columns(tables: list[DataFrame], key: str, ts: str, keep: str = "first") -> DataFrame:
    """Tables side by side on (key, time); of columns with one name the first or last table's stays."""
    owner: dict[str, int] = {}
    for i, t in enumerate(tables):
        for c in t.columns:
            if c not in (key, ts) and (keep == "last" or c not in owner):
                owner[c] = i
    kept = [t.select(key, ts, *[c for c in t.columns if owner.get(c) == i]) for i, t in enumerate(tables)]
    return reduce(lambda a, b: a.join(b, [key, ts], "full_outer"), kept)


def reindex(df: DataFrame, index: DataFrame, key: str, ts: str, fill_value=None) -> DataFrame:
    """Rows of ``index`` (key, ts); times without a row get ``fill_value`` in every column."""
    cols = [c for c in df.columns if c not in (key, ts)]
    out = index.select(key, ts).join(df.withColumn("_here", F.lit(True)), [key, ts], "left")
    return out.select(key, ts, *[F.when(F.col("_here"), F.col(c)).otherwise(F.lit(fill_value)).alias(c) for c in cols])


def drop_tail_nulls(df: DataFrame, key: str, ts: str, cols: list[str]) -> DataFrame:
    """Without the rows after the last one that has a value; a series without values goes."""
    last = F.max(F.when(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull(), F.col(ts))).over(whole(key))
    return df.withColumn("_last", last).filter(F.col(ts) <= F.col("_last")).drop("_last")


def set_column(panel: Panel, name: str, value, role: str = "known") -> Panel:
    """A new or replaced column: a table ``key, ts, name`` aligned on the panel's times, or one value or expression."""
    if isinstance(value, DataFrame):
        df = panel.df.drop(name).join(value.select(panel.key, panel.ts, name), [panel.key, panel.ts], "left")
    else:
        df = panel.df.withColumn(name, value if isinstance(value, Column) else F.lit(value))
    return panel.on(df, **{name: role})


def drop_columns(panel: Panel, columns: list[str]) -> Panel:
    if missing := set(columns) - set(panel.roles):
        raise ValueError(f"no columns {sorted(missing)}")
    return panel.on(panel.df.drop(*columns))


def get_columns(panel: Panel, columns: list[str]) -> DataFrame:
    if missing := set(columns) - set(panel.roles):
        raise ValueError(f"no columns {sorted(missing)}")
    return panel.df.select(panel.key, panel.ts, *columns)


def sort_columns(panel: Panel, ascending: bool = True) -> Panel:
    """Columns sorted by name within their role."""
    names = [c for r in ("target", "observed", "known", "static") for c in sorted(panel.columns(r), reverse=not ascending)]
    return panel.on(panel.df.select(panel.key, panel.ts, *names))


def astype(panel: Panel, dtype: str | dict[str, str]) -> Panel:
    """Casts by column or role name; what can't be cast becomes NULL. ``bigint`` is categorical, ``float`` numeric."""
    casts = {c: dtype for c in panel.roles} if isinstance(dtype, str) else {}
    for k, kind in (dtype.items() if isinstance(dtype, dict) else ()):
        named = [k] if k in panel.roles else panel.columns(k) if k in ("target", "observed", "known", "static") else []
        if not named:
            raise ValueError(f"no column or role {k}")
        casts |= dict.fromkeys(named, kind)
    return panel.on(panel.df.withColumns({c: F.col(c).try_cast(k) for c, k in casts.items()}))


def check_finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column, n_missing, n_infinite`` of each column, from one aggregate."""
    kinds = dict(df.dtypes)
    real = [c for c in cols if kinds[c] in ("float", "double")]
    bad = lambda c: F.isnan(c) if c in real else F.lit(False)
    aggs = [F.sum((F.col(c).isNull() | bad(c)).cast("long")).alias(f"m_{i}") for i, c in enumerate(cols)]
    aggs += [F.sum((F.abs(F.col(c)) == float("inf")).cast("long") if c in real else F.lit(0)).alias(f"i_{i}") for i, c in enumerate(cols)]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("n_missing"), F.coalesce(f"i_{i}", F.lit(0)).cast("long").alias("n_infinite")) for i, c in enumerate(cols)])
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def check_continuity(a: DataFrame, b: DataFrame, key: str, ts: str, step: str) -> DataFrame:
    """``key, continuous``: whether b starts one step after a ends."""
    ends = a.groupBy(key).agg(F.max(ts).alias("end")).join(b.groupBy(key).agg(F.min(ts).alias("start")), key)
    return ends.select(key, (following(F.col("end"), 1, step) == F.col("start")).alias("continuous"))


def align(true: DataFrame, pred: DataFrame, key: str, ts: str, cols: list[str]) -> DataFrame:
    """``key, ts``, each column and its prediction (``<column>_pred``) at the times that both have."""
    return true.select(key, ts, *cols).join(pred.select(key, ts, *[F.col(c).alias(f"{c}_pred") for c in cols]), [key, ts])


def coverage(true: DataFrame, pred: DataFrame, key: str, ts: str) -> DataFrame:
    """``n_true, n_pred, n_both`` times."""
    flags = true.select(key, ts, F.lit(1).alias("t")).join(pred.select(key, ts, F.lit(1).alias("p")), [key, ts], "full_outer")
    return flags.agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.count(F.col("t") + F.col("p")).alias("n_both"))
