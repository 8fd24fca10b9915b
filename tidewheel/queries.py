"""The time-series operators as queries over the tables of one folder, with SQL for most.

The panel is ``events``: a series for each user, irregular times. Its daily form (first value of a
day, empty days NULL) is what most operators take.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jobs import anomaly_watch, forecast_evaluation, series_groups
from .operators import analysis, anomaly, calendar, ensemble, folds, foldwise, forecast, grid, metrics, samples, series_ml, transforms
from .panel import Panel, in_blocks, in_order, whole
from .sources import io
from .streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K, T = "user_id", "ts"

#: Common table expressions of the SQL side.
DAILY = """
WITH e0 AS (SELECT user_id, date_trunc('day', ts) AS d, arg_min(value, ts) AS v FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
b0 AS (SELECT user_id, min(date_trunc('day', ts)) AS lo, max(date_trunc('day', ts)) AS hi FROM events GROUP BY 1),
g0 AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM b0),
daily AS (SELECT g0.user_id, g0.d AS ts, e0.v AS value, row_number() OVER (PARTITION BY g0.user_id ORDER BY g0.d) - 1 AS pos FROM g0 LEFT JOIN e0 ON g0.user_id = e0.user_id AND g0.d = e0.d),
filled AS (SELECT user_id, ts, pos, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM daily)
"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL (``DAILY`` goes before one that starts with SELECT)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else DAILY + sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(K, F.col(T).cast("timestamp").alias(T), "value", "event_type", "event_id")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.resample(events(spark, sf_dir), K, T, "1 day", ["value"])


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.fill(daily(spark, sf_dir), K, T, ["value"], "pre")


def panel(df: DataFrame, **roles: str) -> Panel:
    return Panel(df, K, T, roles or {"value": "target"}, "1 day")


def r6(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def day(name: str = "day", ts: str = T):
    return F.date_format(ts, "yyyy-MM-dd").alias(name)


_DAY = "strftime(ts, '%Y-%m-%d') AS day"


# -- A: sources -----------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS n, count(value) AS n_value, round(sum(value), 4) AS total FROM events GROUP BY 1")
def a2_load_df(spark, sf_dir):
    p = io.load_df(events(spark, sf_dir), K, T, target_cols="value", observed_cov_cols="event_id", dtype={"value": "double"})
    return p.df.groupBy(K).agg(F.count("*").alias("n"), F.count("value").alias("n_value"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, 'static event_type varies' AS rule, count(DISTINCT event_type) - 1 AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def a3_validate(spark, sf_dir):
    return io.validate(Panel(events(spark, sf_dir), K, T, {"value": "target", "event_type": "static"}))


@query("SELECT user_id, 'gap in the index' AS rule, max(event_id) - min(event_id) + 1 - count(*) AS n FROM events GROUP BY 1 HAVING max(event_id) - min(event_id) + 1 > count(*)")
def a3_validate_integer_index(spark, sf_dir):
    return io.validate(Panel(events(spark, sf_dir), K, "event_id", {"value": "target"}))


@query("""SELECT user_id, min(s) / 1e6 AS seconds, min(s) = max(s) AS regular FROM (
SELECT user_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) AS s FROM events) WHERE s IS NOT NULL GROUP BY 1""")
def a4_infer_freq(spark, sf_dir):
    return io.infer_freq(events(spark, sf_dir), K, T)


@query(f"""SELECT coalesce(a.user_id, b.user_id) AS user_id, strftime(coalesce(a.ts, b.d), '%Y-%m-%d') AS day, a.value, b.n FROM (SELECT * FROM daily WHERE value IS NOT NULL) a
FULL JOIN (SELECT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS d, count(*) AS n FROM events GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts = b.d""")
def a5_to_dataframe(spark, sf_dir):
    counts = events(spark, sf_dir).groupBy(K, (F.date_trunc("day", T) + F.expr("interval 1 day")).alias(T)).agg(F.count("*").alias("n"))
    return io.to_dataframe(K, T, target=daily(spark, sf_dir).filter("value is not null"), observed=counts).select(K, day(), "value", "n")


@query(f"SELECT user_id, {_DAY}, value FROM daily WHERE value IS NOT NULL")
def a6_json_round_trip(spark, sf_dir):
    return io.from_json(io.to_json(daily(spark, sf_dir), K, T, ["value"], "1 day"), K, ["value"]).select(K, day(), "value")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below what the cluster shares."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root}/{name}-{uuid.uuid4().hex}"


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last FROM events GROUP BY 1")
def a1_load_csv(spark, sf_dir):
    folder = _folder(spark, "csv")
    events(spark, sf_dir).select(K, T, "value").write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(folder)
    p = io.load_csv(spark, folder, f"{K} long, {T} timestamp, value double", group_id=K, time_col=T, target_cols="value")
    return p.df.groupBy(K).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.date_format(F.max(T), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last"))


@query(f"SELECT user_id, {_DAY}, value, 'user_id ts value:target 1 day' AS meta FROM daily")
def a7_save_load(spark, sf_dir):
    folder = _folder(spark, "panel")
    io.save(panel(daily(spark, sf_dir)), folder, 8)
    p = io.load(spark, folder)
    return p.df.select(K, day(), "value", F.lit(f"{p.key} {p.ts} {' '.join(f'{c}:{r}' for c, r in p.roles.items())} {p.freq}").alias("meta"))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos FROM events) WHERE pos BETWEEN 7 AND 19")
def a8_catalog_split(spark, sf_dir):
    catalog = {"events": {"path": "events.parquet", "options": {"group_id": K, "time_col": T, "target_cols": "value"}, "split": {"train": (0, 10), "test": (10, 20)}}}
    p = io.catalog_get(spark, catalog, sf_dir, "events", "test", seq_len=3)
    return p.df.select(K, F.date_format(F.col(T).cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "value")


# -- B: grids -------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1), g AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 12 HOUR)) AS t FROM b)
SELECT g.user_id, strftime(g.t, '%Y-%m-%d %H:%M:%S') AS at, e.value, e.event_type FROM g ASOF LEFT JOIN events e ON g.user_id = e.user_id AND g.t <= e.ts""")
def b1_regularize(spark, sf_dir):
    return grid.regularize(events(spark, sf_dir).drop("event_id"), K, T, "12 hours").select(K, F.date_format(T, "yyyy-MM-dd HH:mm:ss").alias("at"), "value", "event_type")


@query(f"SELECT user_id, {_DAY}, value FROM filled")
def b2_fill_missing_dates(spark, sf_dir):
    return grid.fill_missing_dates(daily(spark, sf_dir), K, T, "1 day", ["value"], "pre").select(K, day(), "value")


@query(f"SELECT user_id, {_DAY}, value FROM daily")
def b3_resample(spark, sf_dir):
    return daily(spark, sf_dir).select(K, day(), "value")


@query("SELECT user_id, CAST(floor((count(*) - 1) * 0.7) AS BIGINT) AS pos FROM daily GROUP BY 1")
def b4_locate(spark, sf_dir):
    return grid.locate(daily(spark, sf_dir), K, T, 0.7)


@query("SELECT user_id, min(pos) FILTER (ts >= TIMESTAMP '2024-01-15 12:00:00') AS pos FROM daily GROUP BY 1 HAVING min(ts) <= TIMESTAMP '2024-01-15 12:00:00' AND max(ts) >= TIMESTAMP '2024-01-15 12:00:00'")
def b4_locate_time(spark, sf_dir):
    """A time that no row has: the next row."""
    return grid.locate(daily(spark, sf_dir), K, T, "2024-01-15 12:00:00")


@query(f"""SELECT user_id, {_DAY}, value, CASE WHEN pos <= floor((n - 1) * 0.7) THEN 'first' ELSE 'second' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM daily)""")
def b5_split(spark, sf_dir):
    a, b = grid.split(panel(daily(spark, sf_dir)), 0.7)
    part = lambda p, name: p.df.select(K, day(), "value", F.lit(name).alias("part"))
    return part(a, "first").unionByName(part(b, "second"))


@query(f"""SELECT user_id, {_DAY}, value, CASE WHEN ts <= (SELECT max(u.ts) FROM daily u WHERE u.user_id = daily.user_id AND u.pos < 10) THEN 'first' ELSE 'second' END AS part FROM daily WHERE value IS NOT NULL""")
def b6_split_union_index(spark, sf_dir):
    d = daily(spark, sf_dir)
    first, second = grid.split_union_index(K, T, 10, d, d.filter("value is not null"))
    part = lambda p, name: p[1].select(K, day(), "value", F.lit(name).alias("part"))
    return part(first, "first").unionByName(part(second, "second"))


@query(f"SELECT user_id, {_DAY}, value FROM daily WHERE pos >= 3 AND pos < 12")
def b7_slice(spark, sf_dir):
    return grid.slice_rows(daily(spark, sf_dir), K, T, 3, 12).select(K, day(), "value")


@query(f"SELECT user_id, {_DAY}, coalesce(value, -1.0) AS value FROM daily")
def b8_concat_rows(spark, sf_dir):
    d = daily(spark, sf_dir)
    a, b = d.filter("value is not null"), d.select(K, T, F.lit(-1.0).alias("value"))
    return grid.concat_rows([a, b], K, T).select(K, day(), "value")


@query(f"SELECT user_id, {_DAY}, value, value * 2 AS twice FROM daily")
def b9_concat_columns(spark, sf_dir):
    d = daily(spark, sf_dir)
    return grid.concat_columns([d, d.select(K, T, F.lit(0.0).alias("value"), (F.col("value") * 2).alias("twice"))], K, T).select(K, day(), "value", "twice")


@query(f"SELECT user_id, {_DAY}, CASE WHEN pos % 2 = 0 THEN value ELSE 0.0 END AS value FROM daily")
def b10_reindex(spark, sf_dir):
    d = daily(spark, sf_dir)
    even = d.withColumn("_p", F.row_number().over(in_order(K, T)) - 1).filter("_p % 2 = 0").drop("_p")
    return grid.reindex(even, d.select(K, T), K, T, 0.0).select(K, day(), "value")


@query(f"""SELECT user_id, {_DAY}, v AS value FROM (SELECT *, CASE WHEN value < 40 THEN value END AS v FROM daily) x WHERE ts <= (SELECT max(y.ts) FROM daily y WHERE y.user_id = x.user_id AND y.value < 40)""")
def b11_drop_tail_nulls(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("value", F.when(F.col("value") < 40, F.col("value")))
    return grid.drop_tail_nulls(d, K, T, ["value"]).select(K, day(), "value")


@query(f"""SELECT d.user_id, strftime(d.ts, '%Y-%m-%d') AS day, d.value, c.n FROM daily d LEFT JOIN (SELECT user_id, date_trunc('day', ts) AS t, count(*) AS n FROM events GROUP BY 1, 2) c ON d.user_id = c.user_id AND d.ts = c.t""")
def b12_set_column(spark, sf_dir):
    n = events(spark, sf_dir).groupBy(K, F.date_trunc("day", T).alias(T)).agg(F.count("*").alias("n"))
    return grid.set_column(panel(daily(spark, sf_dir)), "n", n, "observed").df.select(K, day(), "value", "n")


@query("SELECT user_id, CAST(trunc(value) AS BIGINT) AS value, event_type FROM events")
def b14_astype(spark, sf_dir):
    p = Panel(events(spark, sf_dir).drop("event_id"), K, T, {"value": "target", "event_type": "observed"})
    return grid.astype(p, {"target": "bigint"}).df.select(K, "value", "event_type")


@query("SELECT 'value' AS \"column\", CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_infinite FROM daily")
def b15_check_finite(spark, sf_dir):
    return grid.check_finite(daily(spark, sf_dir), ["value"])


@query("SELECT user_id, true AS continuous FROM daily GROUP BY 1 HAVING count(*) > 10")
def b16_check_continuity(spark, sf_dir):
    d = daily(spark, sf_dir)
    return grid.check_continuity(grid.slice_rows(d, K, T, 0, 10), grid.slice_rows(d, K, T, 10), K, T, "1 day")


@query(f"SELECT user_id, {_DAY}, value, value * 3 AS c, 'user_id,ts,value,a,c' AS columns FROM daily")
def b13_columns(spark, sf_dir):
    """Columns sorted within their role, some dropped, some taken."""
    d = daily(spark, sf_dir).select(K, T, (F.col("value") * 3).alias("c"), (F.col("value") * 2).alias("b"), F.lit(1).alias("a"), "value")
    p = grid.drop_columns(grid.sort_columns(panel(d, c="observed", b="observed", a="observed", value="target")), ["b"])
    return grid.get_columns(p, ["value", "c"]).select(K, day(), "value", "c", F.lit(",".join(p.df.columns)).alias("columns"))


@query(f"SELECT a.user_id, strftime(a.ts, '%Y-%m-%d') AS day, a.value, b.value AS value_pred FROM daily a JOIN daily b ON a.user_id = b.user_id AND a.ts = b.ts + INTERVAL 1 DAY")
def b17_align(spark, sf_dir):
    d = daily(spark, sf_dir)
    return grid.align(d, d.withColumn(T, F.col(T) + F.expr("interval 1 day")), K, T, ["value"]).select(K, day(), "value", "value_pred")


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last, count(*) AS length FROM daily GROUP BY 1")
def b18_extent(spark, sf_dir):
    return io.extent(daily(spark, sf_dir), K, T).select(K, day("first", "start"), day("last", "end"), "length")


# -- C: transforms --------------------------------------------------------------------------------


@query(f"SELECT user_id, {_DAY}, value FROM filled")
def c1_fill_pre(spark, sf_dir):
    return filled(spark, sf_dir).select(K, day(), "value")


@query(f"SELECT user_id, {_DAY}, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM daily")
def c1_fill_next(spark, sf_dir):
    return transforms.fill(daily(spark, sf_dir), K, T, ["value"], "next").select(K, day(), "value")


@query(f"SELECT user_id, {_DAY}, coalesce(value, 7.0) AS value FROM daily")
def c1_fill_value(spark, sf_dir):
    return transforms.fill(daily(spark, sf_dir), K, T, ["value"], "default", value=7.0).select(K, day(), "value")


@query(f"SELECT user_id, {_DAY}, value FROM filled")
def c1_fill_in_blocks(spark, sf_dir):
    """The same over blocks of eight days, as for series too long for one task."""
    return transforms.fill_in_blocks(daily(spark, sf_dir), K, T, "1 day", ["value"], "pre", 8).select(K, day(), "value")


@query(DAILY.replace("WITH", "WITH RECURSIVE", 1) + """, c AS (SELECT user_id, ts, pos, value, [value] AS seen FROM daily WHERE pos = 0
UNION ALL SELECT d.user_id, d.ts, d.pos, coalesce(d.value, list_avg(c.seen)), list_append(c.seen, coalesce(d.value, list_avg(c.seen)))[-4:] FROM c JOIN daily d ON d.user_id = c.user_id AND d.pos = c.pos + 1)
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, round(value, 6) AS value FROM c""")
def c1_fill_cascade(spark, sf_dir):
    return transforms.fill(daily(spark, sf_dir), K, T, ["value"], "mean", window_size=5).select(K, day(), r6("value", "value"))


@query(f"""SELECT user_id, {_DAY}, round(CASE WHEN value < m - 1.5 * s OR value > m + 1.5 * s THEN m ELSE value END, 6) AS value FROM daily, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM daily)""")
def c2_ksigma(spark, sf_dir):
    d = daily(spark, sf_dir)
    return transforms.ksigma(d, ["value"], 1.5).transform(d).select(K, day(), r6("value", "value"))


@query(f"SELECT user_id, {_DAY}, value, lag(value, 2) OVER w AS value_before_2, lag(value, 4) OVER w AS value_before_4 FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def c3_lag(spark, sf_dir):
    return transforms.lag(daily(spark, sf_dir), K, T, ["value"], 4, 2).select(K, day(), "value", "value_before_2", "value_before_4")


@query(f"SELECT user_id, {_DAY}, lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts) AS value_before_2 FROM daily")
def c3_lag_in_blocks(spark, sf_dir):
    """Lags over blocks with copied edges, as for series too long for one task."""
    lagged = in_blocks(daily(spark, sf_dir), K, T, "1 day", 2, 8, lambda d, keys: transforms.lag(d, keys, T, ["value"], 2, 2))
    return lagged.select(K, day(), "value_before_2")


@query(f"SELECT user_id, {_DAY}, round(value - lag(value, 1) OVER w, 6) AS value_diff_1, round(value - lag(value, 2) OVER w, 6) AS value_diff_2 FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def c4_difference(spark, sf_dir):
    d = transforms.difference(daily(spark, sf_dir), K, T, ["value"], 2)
    return d.select(K, day(), r6("value_diff_1", "value_diff_1"), r6("value_diff_2", "value_diff_2"))


@query(f"""SELECT user_id, {_DAY}, CASE WHEN pos >= 6 THEN round(median(value) OVER w, 6) END AS value_median, CASE WHEN pos >= 6 THEN round(avg(value) OVER w, 6) END AS value_mean,
CASE WHEN pos >= 6 THEN max(value) OVER w END AS value_max, CASE WHEN pos >= 6 THEN min(value) OVER w END AS value_min, CASE WHEN pos >= 6 THEN round(stddev_samp(value) OVER w, 6) END AS value_std
FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def c5_rolling_stats(spark, sf_dir):
    d = transforms.rolling_stats(daily(spark, sf_dir), K, T, ["value"], 0, 7)
    return d.select(K, day(), *[r6(f"value_{s}", f"value_{s}") for s in ("median", "mean", "max", "min", "std")])


@query(f"SELECT user_id, {_DAY}, CASE WHEN pos >= 6 THEN round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) END AS value_mean FROM daily")
def c5_rolling_in_blocks(spark, sf_dir):
    """The same over blocks with copied edges, as for series too long for one task."""
    rolled = in_blocks(daily(spark, sf_dir), K, T, "1 day", 6, 8, lambda d, keys: transforms.rolling_stats(d, keys, T, ["value"], 0, 7, ("mean",)).withColumn("value_mean", F.when(F.col("_pos") >= 6, F.col("value_mean"))))
    return rolled.select(K, day(), r6("value_mean", "value_mean"))


@query(f"""SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, isodow(ts) - 1 AS weekday, quarter(ts) AS quarter, round(minute(ts) / 59.0 - 0.5, 6) AS minuteofhour, round(hour(ts) / 23.0 - 0.5, 6) AS hourofday,
round((isodow(ts) - 1) / 6.0 - 0.5, 6) AS dayofweek, round(day(ts) / 30.0 - 0.5, 6) AS dayofmonth, round(dayofyear(ts) / 364.0 - 0.5, 6) AS dayofyear, round(weekofyear(ts) / 51.0 - 0.5, 6) AS weekofyear, round(month(ts) / 11.0 - 0.5, 6) AS monthofyear FROM events""")
def c6_time_features(spark, sf_dir):
    raw, scaled = ["year", "month", "day", "hour", "weekday", "quarter"], ["minuteofhour", "hourofday", "dayofweek", "dayofmonth", "dayofyear", "weekofyear", "monthofyear"]
    d = calendar.time_features(events(spark, sf_dir), T, raw + scaled)
    return d.select("event_id", *[F.col(c).cast("long").alias(c) for c in raw], *[r6(F.col(c).cast("double"), c) for c in scaled])


@query(f"SELECT user_id, {_DAY}, value FROM daily UNION ALL SELECT user_id, strftime(max(ts) + INTERVAL 1 DAY * i, '%Y-%m-%d'), NULL FROM daily, range(1, 4) r(i) GROUP BY user_id, i")
def c7_extend_time(spark, sf_dir):
    return calendar.extend_time(daily(spark, sf_dir), K, T, 3, "1 day").select(K, day(), "value")


@query(f"SELECT user_id, {_DAY}, CAST(isodow(ts) >= 6 AS BIGINT) AS is_holiday, CAST(isodow(ts) < 6 AS BIGINT) AS is_workday FROM daily")
def c8_work_days(spark, sf_dir):
    return calendar.work_days(daily(spark, sf_dir), T).select(K, day(), F.col("is_holiday").cast("long").alias("is_holiday"), F.col("is_workday").cast("long").alias("is_workday"))


_EASTER = """, y AS (SELECT unnest(range((SELECT min(year(ts)) FROM daily) - 1, (SELECT max(year(ts)) FROM daily) + 2)) AS y),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS k FROM e2), e4 AS (SELECT *, h + k - 7 * ((a + 11 * h + 22 * k) // 451) + 114 AS md FROM e3),
hol AS (SELECT 'easter' AS name, make_date(y, md // 31, md % 31 + 1) AS date FROM e4 UNION ALL SELECT 'new_year', make_date(y, 1, 1) FROM y) """


@query(DAILY + _EASTER + """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(CAST(ts AS DATE) - (SELECT min(date) FROM hol WHERE name = 'new_year' AND abs(date - CAST(ts AS DATE)) <= 200) AS DOUBLE) AS new_year,
CAST(CAST(ts AS DATE) - (SELECT min(date) FROM hol WHERE name = 'easter' AND abs(date - CAST(ts AS DATE)) <= 200) AS DOUBLE) AS easter FROM daily""")
def c9_holiday_distance(spark, sf_dir):
    names = ["New Years Day", "Easter Sunday"]
    d = calendar.holiday_distance(daily(spark, sf_dir), T, names, scale=False)
    return d.select(K, day(), F.col("`New Years Day`").alias("new_year"), F.col("`Easter Sunday`").alias("easter"))


_NTH = "make_date(y, {m}, 1) + CAST((({w} - isodow(make_date(y, {m}, 1)) + 7) % 7 + {d}) AS INT)"  # weekday 1 to 7 of a month, d days after the first one
_RULES = {
    "Easter Sunday": "make_date(y, md // 31, md % 31 + 1)", "Good Friday": "make_date(y, md // 31, md % 31 + 1) - 2", "Easter Monday": "make_date(y, md // 31, md % 31 + 1) + 1",
    "Columbus Day": _NTH.format(m=10, w=1, d=7), "Labor Day": _NTH.format(m=9, w=1, d=0), "Martin Luther King Jr": _NTH.format(m=1, w=1, d=14), "Presidents Day": _NTH.format(m=2, w=1, d=14),
    "Memorial Day": "make_date(y, 5, 31) - CAST((isodow(make_date(y, 5, 31)) - 1) AS INT)", "Thanksgiving": _NTH.format(m=11, w=4, d=21), "Black Friday": _NTH.format(m=11, w=4, d=22), "Cyber Monday": _NTH.format(m=11, w=4, d=25),
    "New Years Day": "make_date(y, 1, 1)", "Superbowl": _NTH.format(m=2, w=7, d=0), "Mothers Day": _NTH.format(m=5, w=7, d=7), "Independence Day": "make_date(y, 7, 4)",
    "Christmas Eve": "make_date(y, 12, 24)", "Christmas Day": "make_date(y, 12, 25)", "New Years Eve": "make_date(y, 12, 31)",
}


@query(DAILY + _EASTER + ", every AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({rule} AS DATE) AS date FROM e4" for n, rule in _RULES.items()) + """), d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM daily)
SELECT strftime(d, '%Y-%m-%d') AS day, name AS holiday, CAST(d - min(date) AS DOUBLE) AS days FROM d JOIN every ON abs(date - d) <= 200 GROUP BY d, name""")
def c9_holiday_distance_all(spark, sf_dir):
    """Days from each of all named holidays, a row for each day and holiday within reach."""
    days = daily(spark, sf_dir).select(T).distinct()
    names = list(calendar.HOLIDAYS)
    far = calendar.holiday_distance(days, T, names, scale=False)
    return far.unpivot(T, [F.col(f"`{n}`") for n in names], "holiday", "days").filter("days is not null").select(day(), F.trim("holiday", F.lit("`")).alias("holiday"), "days")


@query("""SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS hot, CAST(1 AS DOUBLE) AS ones, (SELECT count(DISTINCT event_type) FROM events) AS width FROM events""")
def c10_one_hot(spark, sf_dir):
    e = events(spark, sf_dir)
    d = transforms.one_hot(e, ["event_type"]).transform(e)
    new = [F.col(c) for c in d.columns if c.startswith("OneHotEncoder_event_type_")]
    hot = sum((F.lit(float(i)) * c for i, c in enumerate(new)), F.lit(0.0))
    return d.select("event_id", hot.alias("hot"), sum(new, F.lit(0.0)).alias("ones"), F.lit(len(new)).cast("long").alias("width"))


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS event_type FROM events")
def c11_ordinal(spark, sf_dir):
    e = events(spark, sf_dir)
    return transforms.ordinal(e, ["event_type"]).transform(e).select("event_id", "event_type")


@query(f"SELECT user_id, {_DAY}, round((value - m) / s, 6) AS value FROM daily, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM daily)")
def c12_standard_scale(spark, sf_dir):
    d = daily(spark, sf_dir)
    return transforms.standard_scale(d, ["value"]).transform(d).select(K, day(), r6("value", "value"))


@query(f"SELECT user_id, {_DAY}, round((value - lo) / (hi - lo) * 2 - 1, 6) AS value FROM daily, (SELECT min(value) AS lo, max(value) AS hi FROM daily)")
def c13_minmax_scale(spark, sf_dir):
    d = daily(spark, sf_dir)
    return transforms.minmax_scale(d, ["value"], (-1, 1)).transform(d).select(K, day(), r6("value", "value"))


@query(f"SELECT user_id, {_DAY}, round(sqrt(coalesce(value, 0)), 6) AS root FROM filled")
def c14_user_transform(spark, sf_dir):
    return transforms.ud_transform(filled(spark, sf_dir).fillna(0.0, ["value"]), K, T, lambda pdf: pdf**0.5, ["value"], ["root"]).select(K, day(), r6("root", "root"))


@query(f"SELECT user_id, {_DAY}, round(value, 4) AS value FROM daily")
def c15_pipeline_inverse(spark, sf_dir):
    d = daily(spark, sf_dir)
    p = transforms.fit_pipeline(d, [lambda x: transforms.standard_scale(x, ["value"]), lambda x: transforms.minmax_scale(x, ["value"])])
    return p.inverse(p.transform(d)).select(K, day(), F.round("value", 4).alias("value"))


@query(f"""SELECT user_id, {_DAY}, round(value - before, 6) AS value_diff_1 FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM daily) WHERE r <= 5""")
def c16_transform_tail(spark, sf_dir):
    d = transforms.transform_tail(daily(spark, sf_dir), K, T, 5, 1, lambda x: transforms.difference(x, K, T, ["value"], 1))
    return d.select(K, day(), r6("value_diff_1", "value_diff_1"))


# -- D: analysis ----------------------------------------------------------------------------------


@query("""SELECT user_id, 'value' AS "column", round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max FROM daily GROUP BY 1""")
def d1_summary(spark, sf_dir):
    s = analysis.summary(daily(spark, sf_dir), ["value"], [K])
    return s.select(K, "column", r6("missing", "missing"), "count", r6("mean", "mean"), r6("std", "std"), "min", r6("25%", "q1"), r6("50%", "q2"), r6("75%", "q3"), "max")


@query("SELECT user_id, max(value) AS value FROM daily GROUP BY 1")
def d2_max(spark, sf_dir):
    return analysis.maxima(daily(spark, sf_dir), ["value"], [K])


_ACF = """, s AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM daily WHERE value IS NOT NULL),
m AS (SELECT user_id, avg(value) AS m, var_pop(value) * count(*) AS v FROM s GROUP BY 1)
SELECT a.user_id, k AS lag, round(sum((a.value - m.m) * (b.value - m.m)) / nullif(max(m.v), 0), 6) AS acf FROM s a CROSS JOIN range(0, 4) r(k) JOIN s b ON a.user_id = b.user_id AND b.i = a.i + k JOIN m ON m.user_id = a.user_id GROUP BY 1, 2"""


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS share, round(quantile_cont({c}::DOUBLE, {p}), 6) AS value FROM lineitem" for c in ("l_extendedprice", "l_quantity", "l_discount") for p in (0.01, 0.5, 0.999)))
def d1_percentiles_of_all(spark, sf_dir):
    """Over the whole table, by passes that bracket the rows asked for."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return analysis.percentiles(lines, ["l_extendedprice", "l_quantity", "l_discount"], (0.01, 0.5, 0.999)).select("column", "share", r6("value", "value"))


@query(DAILY + _ACF)
def d3_acf(spark, sf_dir):
    return analysis.acf(daily(spark, sf_dir), K, T, ["value"], 3).filter("acf is not null and not isnan(acf)").select(K, "lag", r6("acf", "acf"))


@query(DAILY + _ACF)
def d3_acf_long(spark, sf_dir):
    """The same by blocks of positions, as for a series too long for one task."""
    d = daily(spark, sf_dir).filter("value is not null").withColumn("pos", F.row_number().over(in_order(K, T)))
    return analysis.acf_long(d, K, "pos", "value", 3).select(K, F.col("lag").cast("long").alias("lag"), r6("acf", "acf"))


@query()
def d4_seasonality(spark, sf_dir):
    return analysis.seasonality(filled(spark, sf_dir), K, T, ["value"], period=7).select(K, "period", "phase", r6("value", "value"))


@query("SELECT 'value' AS a, 'before' AS b, round(corr(value, before), 6) AS corr FROM (SELECT value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM daily)")
def d5_pearson(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("before", F.col("value"))
    return analysis.correlation(d, K, T, ["value", "before"], lag=1, lag_cols=("before",)).select("a", "b", r6("corr", "corr"))


@query("""SELECT user_id, 'value' AS a, 'pos' AS b, round(corr(x, y), 6) AS corr FROM (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0 AS x,
rank() OVER (PARTITION BY user_id ORDER BY ts) AS y FROM daily WHERE value IS NOT NULL) GROUP BY 1""")
def d5_spearman(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("pos", F.row_number().over(in_order(K, T)))
    return analysis.correlation(d, K, T, ["value", "pos"], "spearman", by=[K]).select(K, "a", "b", r6("corr", "corr"))


@query("""SELECT 'value' AS a, 'before' AS b, round(corr(x, y), 6) AS corr FROM (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS x,
rank() OVER (ORDER BY before) + (count(*) OVER (PARTITION BY before) - 1) / 2.0 AS y FROM (SELECT value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM daily) WHERE value IS NOT NULL AND before IS NOT NULL)""")
def d5_spearman_of_all(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("before", F.col("value"))
    return analysis.correlation(d, K, T, ["value", "before"], "spearman", lag=1, lag_cols=("before",)).select("a", "b", r6("corr", "corr"))


@query("""SELECT p.user_id, 'value' AS a, 'pos' AS b, round(sum(sign(x.value - p.value)) / sqrt(count(*) FILTER (x.value <> p.value) * count(*)::DOUBLE), 6) AS corr
FROM daily p JOIN daily x ON x.user_id = p.user_id AND x.pos > p.pos AND x.value IS NOT NULL AND p.value IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (x.value <> p.value) > 0""")
def d5_kendall(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("pos", F.row_number().over(in_order(K, T)))
    return analysis.correlation(d, K, T, ["value", "pos"], "kendall", by=[K]).filter("not isnan(corr)").select(K, "a", "b", r6("corr", "corr"))


_TAU = """SELECT '{a}' AS a, '{b}' AS b, round(sum(sign(x.{a} - p.{a}) * sign(x.{b} - p.{b})) / sqrt(count(*) FILTER (x.{a} <> p.{a}) * (count(*) FILTER (x.{b} <> p.{b}))::DOUBLE), 6) AS corr
FROM customer p JOIN customer x ON x.c_custkey > p.c_custkey"""


@query(" UNION ALL ".join(_TAU.format(a=a, b=b) for a, b in (("c_acctbal", "c_nationkey"), ("c_acctbal", "c_custkey"), ("c_nationkey", "c_custkey"))))
def d5_kendall_of_all(spark, sf_dir):
    """Over the whole table, without a key."""
    return analysis.correlation(spark.read.parquet(f"{sf_dir}/customer.parquet"), K, T, ["c_acctbal", "c_nationkey", "c_custkey"], "kendall").select("a", "b", r6("corr", "corr"))


@query("""SELECT user_id, i, round(sqrt(power(sum(value * cos(2 * pi() * i * pos / n)), 2) + power(sum(value * sin(2 * pi() * i * pos / n)), 2)) / max(n), 6) AS amplitude
FROM (SELECT user_id, pos, coalesce(value, 0) AS value, count(*) OVER (PARTITION BY user_id) AS n FROM filled) f JOIN range(0, (SELECT max(pos) + 1 FROM daily)) r(i) ON i < n // 2 GROUP BY 1, 2""")
def d6_fft(spark, sf_dir):
    return analysis.fft(filled(spark, sf_dir), K, T, ["value"]).select(K, "i", r6("amplitude", "amplitude"))


_FRAMES = """, s AS (SELECT user_id, count(*) AS n, least(8, count(*)) AS m, least(8, count(*)) // 2 AS h FROM filled GROUP BY 1), q AS (SELECT *, m - h AS step, n + 2 * h AS len FROM s WHERE m > 1),
fr AS (SELECT *, unnest(range(0, (len + (step - (len - m) % step) % step - m) // step + 1)) AS k FROM q), fi AS (SELECT *, unnest(range(0, m // 2 + 1)) AS i FROM fr), w AS (SELECT fi.*, j, 0.5 - 0.5 * cos(2 * pi() * j / m) AS w FROM fi JOIN range(0, 8) r(j) ON j < m)
SELECT w.user_id, round(i / m, 6) AS f, CAST(k * step AS DOUBLE) AS t, round(sum(coalesce(value, 0) * w * cos(2 * pi() * i * j / m)) / sum(w), 5) + 0.0 AS re, round(sum(coalesce(value, 0) * w * -sin(2 * pi() * i * j / m)) / sum(w), 5) + 0.0 AS im
FROM w LEFT JOIN filled v ON v.user_id = w.user_id AND v.pos = k * step + j - h GROUP BY w.user_id, i, m, k, step"""


@query(DAILY + _FRAMES)
def d7_stft(spark, sf_dir):
    enough = filled(spark, sf_dir).withColumn("_n", F.count("*").over(whole(K))).filter("_n > 1").drop("_n")
    r5 = lambda c: (F.round(c, 5) + F.lit(0.0)).alias(c)
    return analysis.stft(enough, K, T, ["value"], nperseg=8).select(K, r6("f", "f"), r6("t", "t"), r5("re"), r5("im"))


@query()
def d8_cwt(spark, sf_dir):
    return analysis.cwt(filled(spark, sf_dir), K, T, ["value"], 5).select(K, "scale", r6("t", "t"), r6("re", "re"), r6("im", "im"))


@query()
def d9_report(spark, sf_dir):
    d = daily(spark, sf_dir)
    return analysis.report({"summary": analysis.summary(d, ["value"], [K]), "seasonality": analysis.seasonality(d, K, T, ["value"], period=7)}, K)


@query("""SELECT i, n // i AS period, round(avg(a), 6) AS amplitude FROM (SELECT user_id, n, i, sqrt(power(sum(coalesce(value, 0) * cos(2 * pi() * i * pos / n)), 2) + power(sum(coalesce(value, 0) * sin(2 * pi() * i * pos / n)), 2)) AS a
FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM filled) f JOIN range(1, (SELECT max(pos) + 1 FROM daily)) r(i) ON i <= n // 2 GROUP BY 1, 2, 3) GROUP BY n, i ORDER BY avg(a) DESC, n, i LIMIT 2""")
def d10_top_periods(spark, sf_dir):
    return analysis.top_periods(filled(spark, sf_dir), K, T, ["value"]).select("i", "period", r6("amplitude", "amplitude"))


@query(f"""SELECT user_id, {_DAY}, round((coalesce(sum(value) OVER w, 0) + greatest(3 - (pos + 1), 0) * first_value(value) OVER a + greatest(pos + 1 + 2 - n, 0) * last_value(value) OVER a) / 5, 6) AS trend FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM filled)
WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), a AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def d11_decompose(spark, sf_dir):
    return analysis.decompose(filled(spark, sf_dir), K, T, "value", 5).select(K, day(), r6("value_trend", "trend"))


# -- E: windows -----------------------------------------------------------------------------------

_SAMPLES = """SELECT d.user_id, tail, CAST(i AS BIGINT) AS i, v.value FROM (SELECT user_id, pos AS tail FROM daily WHERE pos >= 8 AND (pos - 8) % 3 = 0) d CROSS JOIN range(0, 7) r(i)
JOIN daily v ON v.user_id = d.user_id AND v.pos = CASE WHEN i < 5 THEN tail - 8 + i ELSE tail - 6 + i END"""


def _sample_rows(s: DataFrame) -> DataFrame:
    return s.select(K, "tail", F.posexplode(F.concat("past_value", "future_value")).alias("i", "value")).select(K, "tail", F.col("i").cast("long").alias("i"), "value")


@query(_SAMPLES)
def e1_samples(spark, sf_dir):
    return _sample_rows(samples.make_samples(panel(daily(spark, sf_dir)), 5, 2, 2, 3))


@query(_SAMPLES)
def e1_samples_by_window(spark, sf_dir):
    return _sample_rows(samples.make_samples_by_window(panel(daily(spark, sf_dir)), 5, 2, 2, 3))


@query("SELECT user_id, CAST(5 - r AS BIGINT) AS i, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM daily) WHERE r <= 5 AND n >= 5")
def e2_predict_samples(spark, sf_dir):
    s = samples.predict_samples(panel(daily(spark, sf_dir)), 5)
    return s.select(K, F.posexplode("past_value").alias("i", "value")).select(K, F.col("i").cast("long").alias("i"), "value")


@query("SELECT user_id, n + CASE WHEN n >= 7 THEN (7 - n % 7) % 7 ELSE 0 END AS n FROM (SELECT user_id, count(*) AS n FROM daily GROUP BY 1)")
def e3_fill_last_value(spark, sf_dir):
    return samples.fill_last_value(panel(daily(spark, sf_dir)), 5, 2, 0, 7, "1 day", 0.0).df.groupBy(K).agg(F.count("*").alias("n"))


@query(DAILY + """, d AS (SELECT *, lag(value, 3) OVER (PARTITION BY user_id ORDER BY ts) AS seen FROM daily), g AS (SELECT user_id, min(pos) FILTER (value IS NOT NULL) AS lo, max(pos) FILTER (value IS NOT NULL) AS hi, min(pos) FILTER (seen IS NOT NULL) AS slo, max(pos) FILTER (seen IS NOT NULL) AS shi FROM d GROUP BY 1)
SELECT user_id, 'seen' AS "column", 'starts late' AS problem FROM g WHERE coalesce(slo > lo, true) UNION ALL SELECT user_id, 'seen', 'ends early' FROM g WHERE coalesce(shi < hi - 2, true) UNION ALL SELECT user_id, 'target', 'too short' FROM g WHERE hi - lo + 1 < 7""")
def e4_coverage(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("seen", F.lag("value", 3).over(in_order(K, T)))
    return samples.coverage_violations(panel(d, value="target", seen="observed"), 5, 2)


@query("""SELECT user_id, tail, round(sum(value) FILTER (i < 5), 6) AS x, round(sum(value) FILTER (i >= 5), 6) AS y FROM (""" + _SAMPLES.replace("daily", "filled") + ") GROUP BY 1, 2")
def e5_design_matrix(spark, sf_dir):
    p = panel(filled(spark, sf_dir))
    total = lambda c: F.aggregate(F.filter(c, lambda v: v.isNotNull()), F.lit(0.0), lambda s, v: s + v)
    some = lambda c: F.when(F.exists(c, lambda v: v.isNotNull()), total(c))
    return samples.design_matrix(samples.make_samples(p, 5, 2, 2, 3), p).select(K, "tail", r6(some("x"), "x"), r6(some("y"), "y"))


@query(f"""SELECT user_id, {_DAY}, lag(value, 2) OVER w AS a, lag(value, 1) OVER w AS b, value AS c FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM daily) WINDOW w AS (PARTITION BY user_id ORDER BY ts) QUALIFY (n - 1 - pos) % 4 = 0 AND n - 1 - pos <= n - 3""")
def e6_lag_matrix(spark, sf_dir):
    m = samples.lag_matrix(panel(daily(spark, sf_dir)), 3, 1, 0, 4)
    return m.select(K, day(), F.col("`value:target_lag_-3`").alias("a"), F.col("`value:target_lag_-2`").alias("b"), F.col("`value:target_lag_-1`").alias("c"))


@query("""SELECT d.user_id, strftime(d.ts, '%Y-%m-%d') AS sample, strftime(d.ts - INTERVAL 1 DAY * i, '%Y-%m-%d') AS day, v.value FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM daily) d CROSS JOIN range(0, 3) r(i)
JOIN daily v ON v.user_id = d.user_id AND v.pos = d.pos - i WHERE (n - 1 - d.pos) % 4 = 0 AND d.pos >= 2""")
def e7_lag_matrix_to_series(spark, sf_dir):
    m = samples.lag_matrix(panel(daily(spark, sf_dir)), 3, 1, 0, 4)
    return samples.lag_matrix_to_series(m, K, T, "1 day").select(K, day("sample", "sample_ts"), day(), "value")


@query("""SELECT u.user_id, CAST(i AS BIGINT) AS i, coalesce(d.value, 0) AS value, CAST(d.pos IS NOT NULL AS BIGINT) AS mask FROM (SELECT DISTINCT user_id FROM daily) u CROSS JOIN range(0, 28) r(i) LEFT JOIN daily d ON d.user_id = u.user_id AND d.pos = i""")
def e8_pad_series(spark, sf_dir):
    p = samples.pad_series(daily(spark, sf_dir), K, T, "value", 28)
    return p.select(K, F.posexplode(F.arrays_zip("values", "mask")).alias("i", "v")).select(K, F.col("i").cast("long").alias("i"), F.col("v.values").alias("value"), F.col("v.mask").cast("long").alias("mask"))


@query("""SELECT d.user_id, d.pos AS tail, round((v.value - avg(v.value) OVER w) / sqrt(var_pop(v.value) OVER w + 1e-5), 5) AS z FROM daily d JOIN filled v ON v.user_id = d.user_id AND v.pos BETWEEN d.pos - 4 AND d.pos - 1
WHERE d.pos >= 8 WINDOW w AS (PARTITION BY d.user_id, d.pos)""")
def e9_window_normalise(spark, sf_dir):
    p = panel(filled(spark, sf_dir))
    s = samples.make_samples(p, 4, 1).filter("tail >= 8")
    n = samples.window_normalise(s.filter(~F.exists("past_value", lambda v: v.isNull())), "past_value")
    return n.select(K, "tail", F.explode("past_value").alias("z")).select(K, "tail", F.round("z", 5).alias("z"))


@query("""SELECT user_id, CAST(patch AS BIGINT) AS patch, CAST(i AS BIGINT) AS i, value FROM (SELECT *, 12 - row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM daily), range(0, 5) p(patch), range(0, 4) r(i)
WHERE n >= 12 AND place = patch * 2 + i""")
def e10_patches(spark, sf_dir):
    s = samples.predict_samples(panel(daily(spark, sf_dir)), 12)
    at = s.select(K, F.posexplode(samples.patches(F.col("past_value"), 4, 2)).alias("patch", "values"))
    return at.select(K, F.col("patch").cast("long").alias("patch"), F.posexplode("values").alias("i", "value")).withColumn("i", F.col("i").cast("long"))


@query("SELECT user_id, max(value) AS full, max(CASE WHEN r <= 3 THEN value END) AS near FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM daily) GROUP BY 1")
def e11_pool_encode(spark, sf_dir):
    d = daily(spark, sf_dir)
    full = samples.pool_encode(d, K, T, ["value"]).select(K, F.get("code", F.lit(0)).alias("full"))
    return full.join(samples.pool_encode(d, K, T, ["value"], "multiscale", 2).select(K, F.get("code", F.lit(1)).alias("near")), K)


# -- F: folds -------------------------------------------------------------------------------------


@query("SELECT user_id, CAST(0 AS BIGINT) AS fold, part, CASE part WHEN 'train' THEN 0 ELSE n - 5 END AS lo, CASE part WHEN 'train' THEN n - 5 ELSE n END AS hi FROM (SELECT user_id, count(*) AS n FROM daily GROUP BY 1), (VALUES ('train'), ('test')) p(part) WHERE n > 5")
def f1_holdout(spark, sf_dir):
    return folds.holdout(daily(spark, sf_dir), K, 5)


@query("""SELECT user_id, CAST(k AS BIGINT) AS fold, part, CASE part WHEN 'train' THEN 0 ELSE n - t * (4 - k) END AS lo, CASE part WHEN 'train' THEN n - t * (4 - k) ELSE n - t * (3 - k) END AS hi
FROM (SELECT user_id, count(*) AS n, count(*) // 5 AS t FROM daily GROUP BY 1), range(0, 4) r(k), (VALUES ('train'), ('test')) p(part) WHERE t > 0""")
def f2_expanding(spark, sf_dir):
    return folds.expanding(daily(spark, sf_dir), K, 4)


@query("""SELECT user_id, CAST((s - 10) / 4 AS BIGINT) AS fold, part, CASE part WHEN 'train' THEN s - 10 ELSE s END AS lo, CASE part WHEN 'train' THEN s ELSE least(s + 4, n) END AS hi
FROM (SELECT user_id, n, unnest(range(10, n, 4)) AS s FROM (SELECT user_id, count(*) AS n FROM daily GROUP BY 1)), (VALUES ('train'), ('test')) p(part)""")
def f3_sliding(spark, sf_dir):
    return folds.sliding(daily(spark, sf_dir), K, 10, 4)


@query("SELECT user_id, part, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, CASE WHEN pos < n - 5 THEN 'train' ELSE 'test' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM daily) WHERE n > 5) GROUP BY 1, 2")
def f4_apply_folds(spark, sf_dir):
    d = daily(spark, sf_dir)
    return folds.apply_folds(panel(d), folds.holdout(d, K, 5)).groupBy(K, "part").agg(F.count("*").alias("n"), r6(F.sum("value"), "total"))


# -- G: metrics -----------------------------------------------------------------------------------

_PAIRS = ", p AS (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS value_pred FROM filled) "


def _pairs(spark, sf_dir):
    return forecast.seasonal_naive(filled(spark, sf_dir), K, T, "value", 1)


@query(DAILY + _PAIRS + "SELECT user_id, round(avg(power(value - value_pred, 2)), 6) AS mse_value, round(avg(abs(value - value_pred)), 6) AS mae_value FROM p GROUP BY 1")
def g1_mse_mae(spark, sf_dir):
    m = metrics.evaluate(_pairs(spark, sf_dir), ["value"], ["mse", "mae"], [K])
    return m.select(K, r6("mse_value", "mse_value"), r6("mae_value", "mae_value"))


@query("SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS loss FROM (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, least(greatest(value / (value + 50), 1e-15), 1 - 1e-15) AS q FROM events)")
def g2_logloss(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("event_type") == "error").cast("int").alias("y"), (F.col("value") / (F.col("value") + 50)).alias("p"))
    return e.agg(r6(metrics.logloss("y", "p"), "loss"))


def _samples_of(spark, sf_dir):
    d = filled(spark, sf_dir)
    return d.select(K, T, "value", *[F.lag("value", i).over(in_order(K, T)).alias(f"value@{i}") for i in (1, 2, 3, 4)]).filter("`value@4` is not null")


_SAMPLED = ", s AS (SELECT user_id, value, list_sort([lag(value, 1) OVER w, lag(value, 2) OVER w, lag(value, 3) OVER w, lag(value, 4) OVER w]) AS a, lag(value, 4) OVER w AS l FROM filled WINDOW w AS (PARTITION BY user_id ORDER BY ts)) "


@query(DAILY + _SAMPLED + "SELECT user_id, round(avg(abs(value - (a[2] + a[3]) / 2)), 6) AS mae FROM s WHERE l IS NOT NULL GROUP BY 1")
def g3_point_of_samples(spark, sf_dir):
    return metrics.point_of_samples(_samples_of(spark, sf_dir), "value").groupBy(K).agg(r6(metrics.mae("value", "value_pred"), "mae"))


@query(DAILY + _SAMPLED + "SELECT user_id, q, round(sum(greatest((q - 1) * (value - a[i]), q * (value - a[i]))) / nullif(sum(abs(value)), 0), 6) AS loss FROM s, (VALUES (0.1::DOUBLE, 1), (0.9::DOUBLE, 4)) v(q, i) WHERE l IS NOT NULL GROUP BY 1, 2")
def g4_quantile_loss(spark, sf_dir):
    return metrics.quantile_loss(_samples_of(spark, sf_dir), "value", (0.1, 0.9), [K]).select(K, "q", r6("loss", "loss"))


_FLAGS = "(SELECT user_id, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS real, CASE WHEN value > 60 THEN 1 ELSE 0 END AS pred FROM events)"


def _flags(spark, sf_dir):
    return events(spark, sf_dir).select(K, T, (F.col("event_type") == "error").cast("int").alias("real"), (F.col("value") > 60).cast("int").alias("pred"))


@query(f"""SELECT user_id, round(avg(CAST(real = pred AS DOUBLE)), 6) AS acc, round(coalesce(sum(real * pred) / nullif(sum(pred), 0), 0), 6) AS precision, round(coalesce(sum(real * pred) / nullif(sum(real), 0), 0), 6) AS recall,
round(coalesce(2.0 * sum(real * pred) / nullif(sum(real) + sum(pred), 0), 0), 6) AS f1 FROM {_FLAGS} GROUP BY 1""")
def g5_detection(spark, sf_dir):
    return _flags(spark, sf_dir).groupBy(K).agg(*[r6(metrics.METRICS[m]("real", "pred"), m) for m in ("acc", "precision", "recall", "f1")])


@query(DAILY + _PAIRS + "SELECT metric, 'value' AS \"column\", round(CASE metric WHEN 'mse' THEN avg(power(value - value_pred, 2)) ELSE avg(abs(value - value_pred)) END, 4) AS value FROM p, (VALUES ('mse'), ('mae')) m(metric) GROUP BY metric")
def g6_metric_container(spark, sf_dir):
    return metrics.metric_container(_pairs(spark, sf_dir), ["value"], ["mse", "mae"]).select("metric", "column", F.round("value", 4).alias("value"))


# -- H: forecasting -------------------------------------------------------------------------------


def _model(spark, sf_dir):
    p = panel(filled(spark, sf_dir).filter("value is not null"))
    return p, forecast.fit_ridge(samples.design_matrix(samples.make_samples(p, 7, 3), p), 7, 3)


@query()
def h2_fit_predict(spark, sf_dir):
    p, model = _model(spark, sf_dir)
    return forecast.predict(model, p, "1 day").select(K, day(), r6("value", "value"))


@query()
def h1_fit_forecaster(spark, sf_dir):
    """One ML model a step: mean forecast of each series' samples."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    p = panel(filled(spark, sf_dir).filter("value is not null"))
    x = samples.design_matrix(samples.make_samples(p, 7, 2), p)
    models = forecast.fit_forecaster(x, LinearRegression(regParam=0.1, labelCol="label"), 2)
    at = x.withColumn("features", array_to_vector("x"))
    for h, m in enumerate(models):
        at = m.setPredictionCol(f"p{h}").transform(at)
    return at.groupBy(K).agg(r6(F.avg("p0"), "p0"), r6(F.avg("p1"), "p1"))


@query()
def h3_recursive_predict(spark, sf_dir):
    p, model = _model(spark, sf_dir)
    return forecast.recursive_predict(model, p, "1 day", 8).select(K, day(), r6("value", "value"))


@query("""SELECT user_id, count(*) AS rounds, round(avg(mse), 6) AS mse, round(avg(mae), 6) AS mae FROM (SELECT o.user_id, o.pos AS origin, avg(power(v.value - l.value, 2)) AS mse, avg(abs(v.value - l.value)) AS mae FROM filled o
JOIN filled l ON l.user_id = o.user_id AND l.pos = o.pos - 1 JOIN filled v ON v.user_id = o.user_id AND v.pos BETWEEN o.pos AND o.pos + 2 JOIN (SELECT user_id, count(*) AS n FROM filled GROUP BY 1) c ON c.user_id = o.user_id
WHERE o.pos >= 7 AND (o.pos - 7) % 3 = 0 AND o.pos + 3 <= n GROUP BY 1, 2) WHERE mse IS NOT NULL GROUP BY 1""")
def h4_backtest(spark, sf_dir):
    """Rolling evaluation of the last value as a forecast of the next three days."""
    scored = forecast.backtest_score(forecast.backtest(panel(filled(spark, sf_dir)), forecast.last_value, 7, 3), K)
    return scored.select(K, "rounds", r6("mse", "mse"), r6("mae", "mae"))


_ROUNDS = """(SELECT o.user_id, o.pos AS origin, avg(power(v.value - l.value, 2)) AS mse, avg(abs(v.value - l.value)) AS mae FROM filled o
JOIN filled l ON l.user_id = o.user_id AND l.pos = o.pos - 1 JOIN filled v ON v.user_id = o.user_id AND v.pos BETWEEN o.pos AND o.pos + 2 JOIN (SELECT user_id, count(*) AS n, greatest(7, CAST(floor((count(*) - 1) * 0.5) AS BIGINT)) AS s FROM filled GROUP BY 1) c ON c.user_id = o.user_id
WHERE o.pos >= s AND (o.pos - s) % 3 = 0 AND o.pos + 3 <= n GROUP BY 1, 2)"""


@query("SELECT user_id, origin, round(mse, 6) AS mse, round(mae, 6) AS mae FROM " + _ROUNDS + " WHERE mse IS NOT NULL")
def h4_backtest_from_share(spark, sf_dir):
    """Rounds from the middle of each series on, not reduced."""
    scored = forecast.backtest_score(forecast.backtest(panel(filled(spark, sf_dir)), forecast.last_value, 7, 3, start=0.5), K, None)
    return scored.select(K, "origin", r6("mse", "mse"), r6("mae", "mae"))


@query("SELECT user_id, count(*) AS rounds, round(median(mse), 6) AS mse, round(median(mae), 6) AS mae FROM " + _ROUNDS + " WHERE mse IS NOT NULL GROUP BY 1")
def h4_backtest_median(spark, sf_dir):
    scored = forecast.backtest_score(forecast.backtest(panel(filled(spark, sf_dir)), forecast.last_value, 7, 3, start=0.5), K, "median")
    return scored.select(K, "rounds", r6("mse", "mse"), r6("mae", "mae"))


_LAST = ", z AS (SELECT user_id, max(ts) AS ts, arg_max(b, ts) AS a, arg_max(value, ts) AS b FROM (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM filled WHERE value IS NOT NULL) GROUP BY 1 HAVING count(*) >= 2) "


@query(DAILY + _LAST + """SELECT user_id, strftime(ts + INTERVAL 1 DAY * (h + 1), '%Y-%m-%d') AS day, round(CASE h WHEN 0 THEN 1 + a / 3 + b / 7 ELSE 2 + 0.1 * a + 0.2 * b + 0.3 * 2 * a END, 6) AS value,
round(CASE h WHEN 0 THEN 1 + a / 3 + b / 7 ELSE 2 + 0.1 * a + 0.2 * b + 0.3 * 2 * a END - 3, 6) AS low, round(CASE h WHEN 0 THEN 3 + 2 * b ELSE 4 + 0.4 * 2 * b END, 6) AS twice FROM z, range(0, 2) r(h)""")
def h2_predict_two_targets(spark, sf_dir):
    """Forecasts of two targets and a quantile by fixed weights."""
    d = filled(spark, sf_dir).filter("value is not null").withColumn("twice", F.col("value") * 2)
    weights = np.array([[1 / 3, 0.1, 0, 0], [1 / 7, 0.2, 0, 0], [0, 0.3, 0, 0], [0, 0, 1.0, 0.4]])  # value two days and a day ago, then twice
    model = forecast.Ridge(weights, np.array([1.0, 2, 3, 4]), 2, 2)
    out = forecast.predict(model, panel(d, value="target", twice="target"), "1 day", {0.1: [-3.0] * 4})
    return out.select(K, day(), r6("value", "value"), r6("`value@0.1`", "low"), r6("twice", "twice"))


@query(DAILY.replace("WITH", "WITH RECURSIVE", 1) + _LAST + """, c AS (SELECT user_id, ts, a, b, 0 AS h FROM z UNION ALL SELECT user_id, ts, b, 1 + a / 3 + b / 7, h + 1 FROM c WHERE h < 5)
SELECT user_id, strftime(ts + INTERVAL 1 DAY * h, '%Y-%m-%d') AS day, round(b, 6) AS value, round(2 * b, 6) AS twice FROM c WHERE h > 0""")
def h3_recursive_two_targets(spark, sf_dir):
    """Five days, a day at a time, of two targets by fixed weights."""
    d = filled(spark, sf_dir).filter("value is not null").withColumn("twice", F.col("value") * 2)
    model = forecast.Ridge(np.array([[1, 0], [3 / 7, 0], [0, 1], [0, 3 / 7]]) / 3, np.array([1.0, 2]), 2, 1)
    out = forecast.recursive_predict(model, panel(d, value="target", twice="target"), "1 day", 5)
    return out.select(K, day(), r6("value", "value"), r6("twice", "twice"))


#: Folds of h5: two expanding ones; ``lo`` and ``hi`` bound the test rows.
_FOLDS = """, s AS (SELECT user_id, ts, value, row_number() OVER w - 1 AS i, lag(value) OVER w AS x, lag(value, 2) OVER w AS x2 FROM filled WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, count(*) AS n, count(*) // 3 AS t FROM s GROUP BY 1),
f AS (SELECT user_id, fold, n - 2 * t + fold * t AS lo, n - 2 * t + (fold + 1) * t AS hi FROM n, range(0, 2) r(fold) WHERE t > 0) """


@query(DAILY + _FOLDS + """, m AS (SELECT fold, regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM s JOIN f USING (user_id) WHERE x IS NOT NULL AND i < lo GROUP BY 1),
e AS (SELECT fold, user_id, avg(power(value - a - b * x, 2)) AS mse, avg(abs(value - a - b * x)) AS mae FROM s JOIN f USING (user_id) JOIN m USING (fold) WHERE i >= lo AND i < hi AND x IS NOT NULL GROUP BY 1, 2)
SELECT fold, round(avg(mse), 4) AS mse, round(avg(mae), 4) AS mae FROM e GROUP BY 1""")
def h5_cross_validate(spark, sf_dir):
    """A least-squares model of the day before, fitted and scored on two expanding folds."""
    p = panel(filled(spark, sf_dir).filter("value is not null"))
    scored = foldwise.cross_validate(p, folds.expanding(p.df, K, 2), 1, 1, alpha=0.0)
    return scored.select("fold", F.round("mse", 4).alias("mse"), F.round("mae", 4).alias("mae"))


def _covariates(spark, sf_dir) -> Panel:
    """Two targets, a known and an observed column, under names of one letter."""
    d = filled(spark, sf_dir).filter("value is not null")
    d = d.select(K, T, F.col("value").alias("a"), (F.col("value") * 2 + F.dayofmonth(T)).alias("b"), F.dayofweek(T).cast("double").alias("c"), F.month(T).cast("double").alias("d"))
    return panel(d, a="target", b="target", c="known", d="observed")


#: Weights of a, b, c and d two days and a day before, c of the day itself between; a column a target.
_WEIGHTS = np.array([[0.2513794621, 0], [0.4937281153, 0.125], [0, 0.2491736583], [0, 0.5079142867], [1.0, 0], [0, 2.0], [0.5, -1.0], [0, 0.25], [-0.5, 0]])
_OF_MODEL = """, v AS (SELECT user_id, i, a, b, 1 + 0.2513794621 * a2 + 0.4937281153 * a1 + c2 + 0.5 * c - 0.5 * d1 AS pa, 2 + 0.125 * a1 + 0.2491736583 * b2 + 0.5079142867 * b1 + 2 * c1 - c + 0.25 * d2 AS pb FROM (
  SELECT *, lag(a) OVER w AS a1, lag(a, 2) OVER w AS a2, lag(b) OVER w AS b1, lag(b, 2) OVER w AS b2, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(d) OVER w AS d1, lag(d, 2) OVER w AS d2
  FROM (SELECT user_id, ts, i, value AS a, value * 2 + day(ts) AS b, dayofweek(ts) + 1 AS c, month(ts) AS d FROM s) WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE i >= 2),
p AS (SELECT user_id, i, 'a' AS target, a AS y, pa AS p FROM v UNION ALL SELECT user_id, i, 'b', b, pb FROM v) """


@query(DAILY + _FOLDS + _OF_MODEL + """, e AS (SELECT fold, user_id, target, avg(power(y - p - fold, 2)) AS mse, avg(abs(y - p - fold)) AS mae FROM p JOIN f USING (user_id) WHERE i >= lo AND i < hi GROUP BY ALL)
SELECT fold, target, round(avg(mse), 4) AS mse, round(avg(mae), 4) AS mae FROM e GROUP BY 1, 2""")
def h5_score_covariates(spark, sf_dir):
    """Scores of fixed models of two targets with known and observed columns, one a fold."""
    p = _covariates(spark, sf_dir)
    models = {("m", f): forecast.Ridge(_WEIGHTS, np.array([1.0, 2.0]) + f, 2, 1) for f in (0, 1)}
    scored = foldwise.scores(foldwise.forecasts(p, folds.expanding(p.df, K, 2), models))
    return scored.select("fold", "target", F.round("mse", 4).alias("mse"), F.round("mae", 4).alias("mae"))


@query(DAILY + _FOLDS + _OF_MODEL + """SELECT user_id, target, count(*) AS rounds, round(avg(power(y - p, 2)), 4) AS mse, round(avg(abs(y - p)), 4) AS mae FROM p GROUP BY 1, 2""")
def h4_backtest_model(spark, sf_dir):
    """Rolling evaluation of a fixed model of two targets with known and observed columns."""
    model = forecast.Ridge(_WEIGHTS, np.array([1.0, 2.0]), 2, 1)
    scored = forecast.backtest_score(forecast.backtest(_covariates(spark, sf_dir), model, 2, 1), K)
    return scored.select(K, "target", "rounds", F.round("mse", 4).alias("mse"), F.round("mae", 4).alias("mae"))


@query(DAILY.replace("WITH", "WITH RECURSIVE", 1) + """, s AS (SELECT user_id, ts, value, dayofweek(ts) + 1 AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM filled WHERE value IS NOT NULL),
z AS (SELECT a.user_id, a.i, b.value AS v2, a.value AS v1, b.c AS c2, a.c AS c1 FROM s a JOIN s b ON b.user_id = a.user_id AND b.i = a.i - 1 WHERE a.i = a.n - 5),
r AS (SELECT *, 0 AS h FROM z UNION ALL SELECT r.user_id, s.i, r.v1, 1 + 0.25 * v2 + 0.5 * v1 + 0.125 * (v1 - v2) + c2 - 2 * c1 + 3 * s.c, r.c1, s.c, h + 1 FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1 WHERE h < 5)
SELECT r.user_id, strftime(s.ts, '%Y-%m-%d') AS day, round(v1, 5) AS value FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i WHERE h > 0""")
def h3_recursive_known(spark, sf_dir):
    """The last five days of each series, a day at a time, from known days of the week and a difference made anew each round."""
    d = filled(spark, sf_dir).filter("value is not null").withColumn("c", F.dayofweek(T).cast("double"))
    at = d.withColumn("_back", F.row_number().over(Window.partitionBy(K).orderBy(F.desc(T))))
    past, future = at.filter("_back > 5").drop("_back"), at.filter("_back <= 5").drop("_back")
    features = {"step": forecast.Feature("value", "diff", 1)}
    p = forecast.with_features(panel(past, value="target", c="known"), features)
    model = forecast.Ridge(np.array([[0.25], [0.5], [1.0], [-2.0], [3.0], [0.0], [0.125]]), np.array([1.0]), 2, 1)
    ends = past.groupBy(K).agg(F.count("*").alias("_n")).filter("_n > 2").select(K)  # a difference needs one row more
    out = forecast.recursive_predict(model, p.on(p.df.join(ends, K, "left_semi")), "1 day", 5, future, features)
    short = past.join(ends, K, "left_anti").groupBy(K).agg(F.count("*").alias("n")).filter("n = 2").select(K)
    two = panel(past.join(short, K, "left_semi"), value="target", c="known")
    plain = forecast.Ridge(np.array([[0.25 - 0.125], [0.5 + 0.125], [1.0], [-2.0], [3.0]]), np.array([1.0]), 2, 1)
    return out.unionByName(forecast.recursive_predict(plain, two, "1 day", 5, future)).select(K, day(), F.round("value", 5).alias("value"))


@query(DAILY + _FOLDS + """, h AS (SELECT user_id, n - 6 AS lo, n AS hi FROM n WHERE n > 6),
g AS (SELECT alpha, count(*) AS k, covar_pop(value, x) * count(*) AS sy1, var_pop(x) * count(*) AS s11, avg(x) AS m1, avg(value) AS my FROM s JOIN h USING (user_id), (VALUES (0), (5000)) a(alpha) WHERE i >= 1 AND i < lo GROUP BY 1),
q AS (SELECT alpha, covar_pop(value, x) * count(*) AS sy1, covar_pop(value, x2) * count(*) AS sy2, var_pop(x) * count(*) + alpha AS s11, var_pop(x2) * count(*) + alpha AS s22, covar_pop(x, x2) * count(*) AS s12, avg(x) AS m1, avg(x2) AS m2, avg(value) AS my
  FROM s JOIN h USING (user_id), (VALUES (0), (5000)) a(alpha) WHERE i >= 2 AND i < lo GROUP BY 1),
w AS (SELECT 1 AS in_chunk_len, alpha, sy1 / (s11 + alpha) AS b1, 0 AS b2, my - m1 * sy1 / (s11 + alpha) AS a FROM g
  UNION ALL SELECT 2, alpha, b1, b2, my - b1 * m1 - b2 * m2 FROM (SELECT *, (sy1 * s22 - sy2 * s12) / (s11 * s22 - s12 * s12) AS b1, (sy2 * s11 - sy1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM q)),
e AS (SELECT in_chunk_len, alpha, user_id, avg(power(value - a - b1 * x - b2 * coalesce(x2, 0), 2)) AS mse FROM s JOIN h USING (user_id), w WHERE i >= lo AND i < hi AND i >= in_chunk_len GROUP BY ALL)
SELECT CAST(in_chunk_len AS BIGINT) AS in_chunk_len, CAST(alpha AS DOUBLE) AS alpha, round(avg(mse), 4) AS mse FROM e GROUP BY 1, 2""")
def h6_grid_search(spark, sf_dir):
    """Every trial's score on a holdout of six days."""
    p = panel(filled(spark, sf_dir).filter("value is not null"))
    _, scored, _ = foldwise.grid_search(p, folds.holdout(p.df, K, 6), {"in_chunk_len": [1, 2], "alpha": [0.0, 5000.0]}, 1)
    return spark.createDataFrame([(t["in_chunk_len"], t["alpha"], round(float(s), 4)) for t, s in scored], "in_chunk_len long, alpha double, mse double")


_MODELS = """, w AS (SELECT user_id, ts, value, lag(value, 1) OVER x AS a, lag(value, 2) OVER x AS b, lag(value, 7) OVER x AS c FROM filled WINDOW x AS (PARTITION BY user_id ORDER BY ts)), t AS (SELECT * FROM w WHERE c IS NOT NULL) """


def _predictions(spark, sf_dir):
    d = filled(spark, sf_dir)
    wide = d.select(K, T, "value", *[F.lag("value", i).over(in_order(K, T)).alias(n) for n, i in (("a", 1), ("b", 2), ("c", 7))]).filter("c is not null")
    long = wide.unpivot([K, T], ["a", "b", "c"], "model", "y")
    return long, wide.select(K, T, F.col("value").alias("y"))


@query(DAILY + _MODELS + "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, round(list_sort([a, b, c])[2], 6) AS y FROM t")
def h7_ensemble_weight(spark, sf_dir):
    return ensemble.ensemble_weight(_predictions(spark, sf_dir)[0], K, T, mode="median").select(K, day(), r6("y", "y"))


@query(DAILY + _FOLDS + """, t AS (SELECT fold, covar_pop(value, x) * count(*) AS sy, var_pop(x) * count(*) AS sx, avg(x) AS mx, avg(value) AS my FROM s JOIN f USING (user_id) WHERE x IS NOT NULL AND (i < lo OR i - 1 >= hi) GROUP BY 1),
m AS (SELECT fold, model, sy / (sx + alpha) AS b, my - mx * sy / (sx + alpha) AS a FROM t, (VALUES ('free', 0), ('held', 20000)) r(model, alpha))
SELECT fold, model, s.user_id, strftime(s.ts, '%Y-%m-%d') AS day, round(s.value, 6) AS y, round(a + b * s.x, 6) AS p FROM s JOIN f USING (user_id) JOIN m USING (fold) WHERE i >= lo AND i < hi AND x IS NOT NULL""")
def h8_out_of_fold(spark, sf_dir):
    """Forecasts of two models, each row's by a fit on all windows without a row of its fold."""
    p = panel(filled(spark, sf_dir).filter("value is not null"))
    made, _ = foldwise.out_of_fold(p, folds.expanding(p.df, K, 2), {"free": foldwise.Setting(1, 0.0), "held": foldwise.Setting(1, 20000.0)}, 1)
    return made.select("fold", "model", F.col("series").alias(K), day(ts="last_ts"), r6("y", "y"), r6("p", "p"))


@query()
def h8_ensemble_stack(spark, sf_dir):
    """Forecasts after each series' end by a final model over three base models, learned from their out-of-fold forecasts."""
    p = panel(filled(spark, sf_dir).filter("value is not null"))
    settings = {"day": foldwise.Setting(1), "week": foldwise.Setting(7), "stiff": foldwise.Setting(7, 1000.0)}
    model = foldwise.stack(p, folds.expanding(p.df, K, 3), settings, 2)
    return foldwise.stacked(p, model, "1 day").select(K, day(), r6("value", "value"))


@query(DAILY + _MODELS + """, m AS (SELECT 'a' AS best, avg(power(a - value, 2)) AS e FROM t UNION ALL SELECT 'b', avg(power(b - value, 2)) FROM t UNION ALL SELECT 'c', avg(power(c - value, 2)) FROM t UNION ALL SELECT 'a,b', avg(power((a + b) / 2 - value, 2)) FROM t
UNION ALL SELECT 'a,c', avg(power((a + c) / 2 - value, 2)) FROM t UNION ALL SELECT 'b,c', avg(power((b + c) / 2 - value, 2)) FROM t UNION ALL SELECT 'a,b,c', avg(power((a + b + c) / 3 - value, 2)) FROM t) SELECT best, round(e, 4) AS mse FROM m ORDER BY e LIMIT 1""")
def h9_ensemble_search(spark, sf_dir):
    long, truth = _predictions(spark, sf_dir)
    best, error = ensemble.ensemble_search(long, truth, K, T, ["a", "b", "c"])
    return spark.createDataFrame([(",".join(best), round(error, 4))], "best string, mse double")


@query("""SELECT out_step, in_step, feature, round(sum(a), 6) AS attribution, CAST(grouping(out_step, in_step, feature) AS BIGINT) AS "grouping" FROM (SELECT user_id % 3 AS out_step, hour(ts) % 4 AS in_step, event_type AS feature, value AS a FROM events)
GROUP BY GROUPING SETS ((out_step, in_step), (out_step, feature), (in_step, feature))""")
def h10_attribution_rollup(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col(K) % 3).alias("out_step"), (F.hour(T) % 4).cast("long").alias("in_step"), F.col("event_type").alias("feature"), F.col("value").alias("attribution"))
    return ensemble.attribution_rollup(e).withColumn("attribution", r6("attribution"))


# -- I: anomalies ---------------------------------------------------------------------------------


@query(f"""SELECT user_id, round(avg(power(value - trend, 2)), 6) AS score FROM (SELECT user_id, value, (coalesce(sum(value) OVER w, 0) + greatest(3 - (pos + 1), 0) * first_value(value) OVER a + greatest(pos + 1 + 2 - n, 0) * last_value(value) OVER a) / 5 AS trend
FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM filled) WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), a AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY 1""")
def i1_recon_score(spark, sf_dir):
    d = analysis.decompose(filled(spark, sf_dir), K, T, "value", 5)
    return anomaly.recon_score(d, ["value"], ["value_trend"], [K]).select(K, r6("score", "score"))


@query("SELECT user_id, round(quantile_cont(value, 0.95) * 1.1, 6) AS threshold FROM events GROUP BY 1")
def i2_percentile_threshold(spark, sf_dir):
    return anomaly.percentile_threshold(events(spark, sf_dir), "value", 95, 1.1, [K]).select(K, r6("threshold", "threshold"))


@query("SELECT round(quantile_cont(value, 0.98), 6) AS threshold FROM events")
def i3_ratio_threshold(spark, sf_dir):
    e = events(spark, sf_dir)
    return anomaly.ratio_threshold(e.filter("user_id % 2 = 0"), e.filter("user_id % 2 = 1"), 2.0, "value").select(r6("threshold", "threshold"))


@query("""WITH st AS (SELECT avg(value) AS m, stddev_pop(value) AS s, max(value) AS top, count(value) AS n FROM events), z AS (SELECT i, m + (2.5 + 0.5 * i) * s AS t FROM st, range(0, 19) r(i)),
d AS (SELECT i, t, value, max(CASE WHEN value >= t THEN 1 ELSE 0 END) OVER (PARTITION BY i, user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM events, z),
g AS (SELECT i, t, sum(near) AS c, avg(value) FILTER (value < t) AS pm, stddev_pop(value) FILTER (value < t) AS ps FROM d GROUP BY 1, 2),
v AS (SELECT i, t, ((m - pm) / m + (s - ps) / s) / c AS gain FROM g, st WHERE c > 0 AND c < n * 0.5 AND pm IS NOT NULL) SELECT round(coalesce((SELECT t FROM v ORDER BY round(gain, 10) DESC, i DESC LIMIT 1), top), 6) AS threshold FROM st""")
def i4_epsilon_threshold(spark, sf_dir):
    return anomaly.epsilon_threshold(events(spark, sf_dir), K, T, "value", reach=3).select(r6("threshold", "threshold"))


@query("SELECT event_id, CAST(value >= (SELECT quantile_cont(value, 0.9) FROM events) AS BIGINT) AS pred FROM events")
def i5_label(spark, sf_dir):
    e = events(spark, sf_dir)
    return anomaly.label(e, anomaly.percentile_threshold(e, "value", 90), "value").select("event_id", F.col("pred").cast("long").alias("pred"))


_RUNS = f", r AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM (SELECT *, CASE WHEN lag(real) OVER (PARTITION BY user_id ORDER BY ts) IS DISTINCT FROM real THEN 1 ELSE 0 END AS start FROM {_FLAGS})) "


@query(DAILY + _RUNS + "SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN real = 1 THEN hit ELSE pred END) AS BIGINT) AS pred FROM (SELECT *, max(pred) OVER (PARTITION BY user_id, run) AS hit FROM r) GROUP BY 1")
def i6_point_adjust(spark, sf_dir):
    return anomaly.point_adjust(_flags(spark, sf_dir), K, T, "pred", "real").groupBy(K).agg(F.count("*").alias("n"), F.sum("pred").alias("pred"))


@query(DAILY + _RUNS + "SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN real = 1 THEN hit ELSE pred END) AS BIGINT) AS pred FROM (SELECT *, max(pred) OVER (PARTITION BY user_id, run) AS hit FROM r) GROUP BY 1")
def i6_point_adjust_in_blocks(spark, sf_dir):
    """The same over blocks of two days, as for series too long for one task."""
    return anomaly.point_adjust_in_blocks(_flags(spark, sf_dir), K, T, "1 day", "pred", "real", 2).groupBy(K).agg(F.count("*").alias("n"), F.sum("pred").alias("pred"))


@query(DAILY + _RUNS + "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS length FROM r WHERE real = 1 GROUP BY user_id, run")
def i7_anomaly_segments(spark, sf_dir):
    at = lambda c, n: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n)
    return anomaly.anomaly_segments(_flags(spark, sf_dir), K, T, "real").select(K, at("start", "first"), at("end", "last"), "length")


@query(DAILY + _RUNS + """SELECT round(coalesce(sum(real * p) / nullif(sum(p), 0), 0), 6) AS precision, round(coalesce(sum(real * p) / nullif(sum(real), 0), 0), 6) AS recall, round(coalesce(2.0 * sum(real * p) / nullif(sum(real) + sum(p), 0), 0), 6) AS f1
FROM (SELECT real, CASE WHEN real = 1 THEN max(pred) OVER (PARTITION BY user_id, run) ELSE pred END AS p FROM r)""")
def i8_evaluate(spark, sf_dir):
    e = anomaly.evaluate(_flags(spark, sf_dir), K, T, "pred", "real")
    return e.select(*[r6(c, c) for c in e.columns])


@query(DAILY + _MODELS + ", l AS (UNPIVOT (SELECT user_id, ts, a, b, c FROM t) ON a, b, c INTO NAME model VALUE y) SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, round(max((y - m) / CASE WHEN s = 0 THEN 1 ELSE s END), 6) AS score FROM l JOIN (SELECT model, avg(y) AS m, stddev_pop(y) AS s FROM l GROUP BY 1) USING (model) GROUP BY user_id, ts")
def i9_ensemble_score(spark, sf_dir):
    long, _ = _predictions(spark, sf_dir)
    return anomaly.ensemble_score(long, K, T, score="y", mode="max").select(K, day(), r6("y", "score"))


@query("SELECT user_id, strftime(d, '%Y-%m-%d') AS day, label FROM (SELECT user_id, d, label, row_number() OVER (PARTITION BY user_id, d ORDER BY n DESC, label) AS r FROM (SELECT user_id, date_trunc('day', ts) AS d, CAST(value > 40 AS BIGINT) AS label, count(*) AS n FROM events GROUP BY 1, 2, 3)) WHERE r = 1")
def i10_ensemble_vote(spark, sf_dir):
    e = events(spark, sf_dir).select(K, F.date_trunc("day", T).alias(T), (F.col("value") > 40).cast("long").alias("label"))
    return anomaly.ensemble_vote(e, K, T).select(K, day(), "label")


@query(DAILY + """, w AS (SELECT user_id * 100000 + pos AS id, lag(value, 4) OVER x AS a, lag(value, 3) OVER x AS b, lag(value, 2) OVER x AS c, lag(value, 1) OVER x AS d FROM (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos FROM filled WHERE value IS NOT NULL) WINDOW x AS (PARTITION BY user_id ORDER BY ts)),
p AS (SELECT * FROM w WHERE a IS NOT NULL), n AS (SELECT p.id, sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2 + (p.c - q.c) ** 2 + (p.d - q.d) ** 2) AS far, row_number() OVER (PARTITION BY p.id ORDER BY (p.a - q.a) ** 2 + (p.b - q.b) ** 2 + (p.c - q.c) ** 2 + (p.d - q.d) ** 2) AS r FROM p JOIN p q ON p.id <> q.id),
s AS (SELECT id, far AS score FROM n WHERE r = 5) SELECT id, round(score, 6) AS score, CAST(score >= (SELECT quantile_cont(score, 0.9) FROM s) - 1e-12 AS INTEGER) AS pred FROM s""")
def i11_window_outliers(spark, sf_dir):
    s = samples.make_samples(panel(filled(spark, sf_dir).filter("value is not null")), 4, 1)
    rows = s.select((F.col(K) * 100_000 + F.col("tail")).alias("id"), F.col("past_value").alias("v"))
    return anomaly.window_outliers(rows, "id", "v").select("id", r6("score", "score"), "pred")


# -- J: series ------------------------------------------------------------------------------------


@query("SELECT user_id, round(avg(value), 6) AS value_mean, round(coalesce(stddev_samp(value), 0), 6) AS value_std, min(value) AS value_min, max(value) AS value_max, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END), 6) AS value_missing FROM daily GROUP BY 1")
def j1_series_features(spark, sf_dir):
    f = series_ml.series_features(daily(spark, sf_dir), K, T, ["value"])
    return f.select(K, *[r6(c, c) for c in ("value_mean", "value_std", "value_min", "value_max", "value_missing")])


@query()
def j2_cluster(spark, sf_dir):
    return series_groups.run(spark, sf_dir)


@query()
def j3_classify(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("embedding", "features")
    train, new = v.filter("vec_id % 4 != 0"), v.filter("vec_id % 4 = 0")
    scored = series_ml.classify(train, new, "vec_id", trees=8).withColumnRenamed("label", "pred")
    return scored.join(new.select("vec_id", "label"), "vec_id").agg(F.count("*").alias("n"), r6(series_ml.accuracy("label", "pred"), "accuracy"))


@query("""SELECT event_type, n, round(hits / n, 6) AS accuracy FROM (SELECT event_type, count(*) AS n, sum(CASE WHEN CASE WHEN p >= q THEN 'low' ELSE 'mid' END = CASE WHEN value < 30 THEN 'low' ELSE 'mid' END THEN 1 ELSE 0 END)::DOUBLE AS hits
FROM (SELECT event_type, value, 50 / (value + 50) AS p, value / (value + 50) AS q FROM events) GROUP BY 1)""")
def j4_label_and_accuracy(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("proba", F.array(50 / (F.col("value") + 50), F.col("value") / (F.col("value") + 50)))
    e = e.withColumn("pred", series_ml.label_from_proba(F.col("proba"), ["low", "mid"])).withColumn("truth", F.when(F.col("value") < 30, "low").otherwise("mid"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), r6(series_ml.accuracy("truth", "pred"), "accuracy"))


@query("SELECT DISTINCT user_id, CAST(user_id % 2 AS BIGINT) AS label FROM events")
def j5_extract_labels(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("label", F.col(K) % 2)
    return series_ml.extract_labels(panel(d, value="target", label="static"))[0]


@query()
def j6_repr_forecast(spark, sf_dir):
    d = filled(spark, sf_dir).filter("value is not null")
    f = transforms.lag(d, K, T, ["value"], 3).filter("value_before_3 is not null").select(K, T, F.array("value_before_1", "value_before_2", "value_before_3").alias("features"))
    out = series_ml.repr_forecast(panel(d), f, 2)
    return out.groupBy("h").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("y") - F.col("p"))), 4).alias("mae"))


# -- K: streams, and whole jobs -------------------------------------------------------------------


def _drained(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """A stream over the events' files run to its end; what it wrote, read back."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{root}/stream-{uuid.uuid4().hex}"
    out = make(source.select(K, F.col(T).cast("timestamp").alias(T), "value"))
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("SELECT user_id, strftime(d, '%Y-%m-%d') AS day, v AS value FROM e0 WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def k1_stream_resample(spark, sf_dir):
    return _drained(spark, sf_dir, lambda s: stream.stream_resample(s, K, T, "1 day", ["value"])).select(K, day(), "value")


@query("SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, round((CASE WHEN value < m - 2 * s OR value > m + 2 * s THEN m ELSE value END), 6) AS value FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)")
def k2_stream_ksigma(spark, sf_dir):
    frozen = transforms.ksigma(events(spark, sf_dir), ["value"], 2.0)
    return _drained(spark, sf_dir, lambda s: stream.stream_apply(s, frozen)).select(K, F.date_format(T, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), r6("value", "value"))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 6) AS diff FROM events")
def k3_stream_transform_tail(spark, sf_dir):
    def change(rows):
        return rows.assign(diff=rows["value"].diff())

    out = _drained(spark, sf_dir, lambda s: stream.stream_transform_tail(s, K, T, ["value"], 1, change, f"{K} long, {T} timestamp, value double, diff double"))
    return out.select(K, F.date_format(T, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), r6(F.when(~F.isnan("diff"), F.col("diff")), "diff"))


@query("""SELECT user_id, "at", diff FROM (SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, round(value - lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts), 6) AS diff, ts FROM events)
WHERE ts <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR""")
def k3_stream_event_time(spark, sf_dir):
    """Differences over two rows in event time; the last hour's rows still wait."""

    def change(rows):
        return rows.assign(diff=rows["value"].diff(2))

    out = _drained(spark, sf_dir, lambda s: stream.stream_in_event_time(s, K, T, ["value"], 2, change, f"{K} long, {T} timestamp, value double, diff double"))
    return out.select(K, F.date_format(T, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), r6(F.when(~F.isnan("diff"), F.col("diff")), "diff"))


@query("""SELECT user_id, strftime(s, '%Y-%m-%d') AS day, count(value) AS n, max(value) AS max FROM (SELECT user_id, value, date_trunc('day', ts) - INTERVAL 1 DAY * k AS s FROM events, range(0, 2) r(k))
WHERE s + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def k4_stream_rolling(spark, sf_dir):
    return _drained(spark, sf_dir, lambda s: stream.stream_rolling(s, K, T, "value", "2 days", "1 day")).select(K, day("day", "start"), "n", "max")


@query()
def w1_forecast_job(spark, sf_dir):
    return forecast_evaluation.run(spark, sf_dir)


@query()
def w2_anomaly_job(spark, sf_dir):
    return anomaly_watch.run(spark, sf_dir)
