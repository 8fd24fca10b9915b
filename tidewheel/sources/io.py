"""Reading, checking and writing panels (tables of series)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import drop_tail_nulls, regularize
from ..panel import ROLES, Panel, in_order


def load_df(df: DataFrame, group_id: str | None = None, time_col: str = "ts", target_cols=None, observed_cov_cols=None, known_cov_cols=None, static_cov_cols=None, label_col=None, feature_cols=None, freq: str | None = None, fill_missing_dates: bool = False, fillna_method: str = "pre", fillna_window_size: int = 10, drop_tail_nan: bool = False, dtype: dict[str, str] | str | None = None) -> Panel:
    """A panel of a table: roles, casts, NaN as NULL, and on request a full grid, fills, cut tails.

    ``label_col`` (exactly one) and ``feature_cols`` stand for target and observed columns and can't
    be mixed with these. Without any roles every column but key and time is a target. Without a key
    the table is one series.
    """
    listed = lambda c: [] if c is None else [c] if isinstance(c, str) else list(c)
    if label_col is not None and target_cols is not None or feature_cols is not None and observed_cov_cols is not None:
        raise ValueError("label_col and feature_cols replace target_cols and observed_cov_cols")
    if len(listed(label_col)) > 1:
        raise ValueError("label_col is one column")
    by_role = dict(zip(ROLES, (listed(target_cols) + listed(label_col), listed(observed_cov_cols) + listed(feature_cols), listed(known_cov_cols), listed(static_cov_cols)), strict=True))
    if group_id is None:
        group_id, df = "series_id", df.withColumn("series_id", F.lit(0))
    if not any(by_role.values()):
        by_role["target"] = [c for c in df.columns if c not in (group_id, time_col)]
    names = [c for cols in by_role.values() for c in cols]
    if len(set(names)) != len(names):
        raise ValueError("a column has one role")
    if missing := set(names) - set(df.columns):
        raise ValueError(f"no columns {sorted(missing)}")
    kinds = dict(df.dtypes)
    casts = dtype if isinstance(dtype, dict) else {c: dtype for c in names} if dtype else {}

    def value(c: str):
        v = F.col(c)
        if kinds[c] in ("float", "double"):
            v = F.when(~F.isnan(v), v)
        return (v.cast(casts[c]) if c in casts else v).alias(c)

    panel = Panel(df.select(group_id, time_col, *map(value, names)), group_id, time_col, {c: r for r, cols in by_role.items() for c in cols}, freq)
    if drop_tail_nan:
        panel = panel.on(drop_tail_nulls(panel.df, group_id, time_col, names))
    if freq:
        panel = panel.on(regularize(panel.df, group_id, time_col, freq))
    if fill_missing_dates:
        from ..operators.transforms import fill

        panel = panel.on(fill(panel.df, group_id, time_col, [c for c in names if panel.roles[c] != "static"], fillna_method, window_size=fillna_window_size))
    return panel


def load_csv(spark: SparkSession, path: str, schema: str | None = None, **options) -> Panel:
    """A panel of CSV files with a header; a schema saves reading them twice."""
    reader = spark.read.option("header", True)
    return load_df(reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path), **options)


def validate(panel: Panel) -> DataFrame:
    """Violations ``(key, rule, n)``: repeated times, gaps of an integer index, static columns that vary.

    One aggregate by key.
    """
    if len(set(panel.df.columns)) != len(panel.df.columns):
        raise ValueError("column names are repeated")
    key, ts = panel.key, panel.ts
    whole_number = dict(panel.df.dtypes)[ts] in ("int", "bigint", "smallint")
    static = panel.columns("static")
    counts = [F.count("*").alias("n"), F.count_distinct(ts).alias("distinct"), F.min(ts).alias("lo"), F.max(ts).alias("hi")]
    counts += [F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"s_{i}") for i, c in enumerate(static)]
    got = panel.df.groupBy(key).agg(*counts)
    rules = [F.struct(F.lit("repeated time").alias("rule"), (F.col("n") - F.col("distinct")).alias("n"))]
    if whole_number:
        rules.append(F.struct(F.lit("gap in the index").alias("rule"), (F.col("hi") - F.col("lo") + 1 - F.col("distinct")).cast("long").alias("n")))
    rules += [F.struct(F.lit(f"static {c} varies").alias("rule"), (F.col(f"s_{i}") - 1).alias("n")) for i, c in enumerate(static)]
    return got.select(key, F.explode(F.array(*rules)).alias("r")).select(key, "r.rule", "r.n").filter("n > 0")


def infer_freq(df: DataFrame, key: str, ts: str) -> DataFrame:
    """``key, seconds, regular``: the smallest step of each series and whether all steps are equal."""
    step = df.select(key, (F.unix_micros(F.lead(ts).over(in_order(key, ts))) - F.unix_micros(ts)).alias("s")).filter("s is not null")
    return step.groupBy(key).agg((F.min("s") / 1e6).alias("seconds"), (F.min("s") == F.max("s")).alias("regular"))


def to_dataframe(key: str, ts: str, **by_role: DataFrame) -> DataFrame:
    """Role tables aligned on (key, time): target, then observed, then known columns."""
    out = None
    for role in ("target", "observed", "known"):
        if (df := by_role.get(role)) is not None:
            out = df if out is None else out.join(df, [key, ts], "full_outer")
    return out


def extent(df: DataFrame, key: str, ts: str) -> DataFrame:
    """``key, start, end, length``."""
    return df.groupBy(key).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("length"))


def to_json(df: DataFrame, key: str, ts: str, cols: list[str], freq: str = "") -> DataFrame:
    """``key, json``: ``{"freq": …, "data": {column: {time: value}}}`` of each series; NULLs are left out."""
    at = F.date_format(ts, "yyyy-MM-dd HH:mm:ss") if dict(df.dtypes)[ts] == "timestamp" else F.col(ts).cast("string")
    maps = [F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(at.alias("k"), F.col(c).cast("double").alias("v")))))).alias(c) for c in cols]
    by_key = df.groupBy(key).agg(*maps)
    return by_key.select(key, F.to_json(F.struct(F.lit(freq).alias("freq"), F.struct(*cols).alias("data"))).alias("json"))


def from_json(df: DataFrame, key: str, cols: list[str], ts: str = "ts") -> DataFrame:
    """Rows ``key, ts, cols`` of the JSON of to_json()."""
    data = ", ".join(f"`{c}`: map<string, double>" for c in cols)
    read = df.select(key, F.from_json("json", f"struct<freq: string, data: struct<{data}>>")["data"].alias("d"))
    times = F.array_distinct(F.flatten(F.array(*[F.map_keys(F.col("d")[c]) for c in cols])))
    rows = read.select(key, "d", F.explode(times).alias(ts))
    return rows.select(key, F.to_timestamp(ts).alias(ts), *[F.try_element_at(F.col("d")[c], F.col(ts)).alias(c) for c in cols])


def save(panel: Panel, path: str, buckets: int | None = None) -> None:
    """The table as Parquet, the roles in a small JSON table beside it."""
    out = panel.df.repartition(buckets, panel.key) if buckets else panel.df
    out.sortWithinPartitions(panel.key, panel.ts).write.mode("overwrite").parquet(f"{path}/rows")
    meta = json.dumps({"key": panel.key, "ts": panel.ts, "roles": panel.roles, "freq": panel.freq})
    panel.df.sparkSession.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Panel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return Panel(spark.read.parquet(f"{path}/rows"), meta["key"], meta["ts"], meta["roles"], meta["freq"])


#: Named datasets: a path below a root, load_df() options, and row ranges of the splits.
Catalog = dict[str, dict]


def catalog_get(spark: SparkSession, catalog: Catalog, root: str, name: str, split: str | None = None, seq_len: int = 0) -> Panel:
    """A named dataset, or the rows of one of its splits; later splits start ``seq_len`` rows earlier."""
    conf = catalog[name]
    panel = load_df(spark.read.parquet(f"{root}/{conf['path']}"), **conf.get("options", {}))
    if split is None:
        return panel
    lo, hi = conf["split"][split]
    lo = max(0, lo - (0 if split == "train" else seq_len))
    at = panel.df.withColumn("_pos", F.row_number().over(in_order(panel.key, panel.ts)) - 1)
    return panel.on(at.filter(F.col("_pos").between(lo, hi - 1)).drop("_pos"))
