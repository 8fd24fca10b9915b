"""Calendar features of the time column: scalar parts, work days, distances to named holidays."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.steps import following
from .transforms import standard_scale

_RAW: dict[str, object] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "weekday": F.weekday, "quarter": F.quarter,
}
_SCALED: dict[str, object] = {
    "minuteofhour": lambda t: F.minute(t) / 59.0 - 0.5, "hourofday": lambda t: F.hour(t) / 23.0 - 0.5, "dayofweek": lambda t: F.weekday(t) / 6.0 - 0.5,
    "dayofmonth": lambda t: F.dayofmonth(t) / 30.0 - 0.5, "dayofyear": lambda t: F.dayofyear(t) / 364.0 - 0.5, "weekofyear": lambda t: F.weekofyear(t) / 51.0 - 0.5,
    "monthofyear": lambda t: F.month(t) / 11.0 - 0.5,
}


def time_features(df: DataFrame, ts: str, features: list[str]) -> DataFrame:
    """Scalar calendar features as columns; they are known ahead. An integer time is an error."""
    if dict(df.dtypes)[ts] not in ("timestamp", "date", "timestamp_ntz"):
        raise TypeError("an integer index has no calendar")
    return df.select("*", *[(_RAW | _SCALED)[f](F.col(ts)).alias(f) for f in features])


def extend_time(df: DataFrame, key: str, ts: str, points: int, step: str) -> DataFrame:
    """The rows plus ``points`` grid times after each series' last, their values NULL."""
    last = df.groupBy(key).agg(F.max(ts).alias("_last"))
    ahead = last.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.lit(points)), lambda i: following(F.col("_last"), i, step))).alias(ts))
    return df.unionByName(ahead, allowMissingColumns=True)


def work_days(df: DataFrame, ts: str, calendar: DataFrame | None = None) -> DataFrame:
    """``is_holiday`` and ``is_workday`` from a table (date, is_holiday, is_workday); weekends where it has no row."""
    weekend = F.weekday(F.col(ts)) >= 5
    if calendar is None:
        return df.withColumn("is_holiday", weekend.cast("int")).withColumn("is_workday", (~weekend).cast("int"))
    days = calendar.select(F.col("date").alias("_d"), F.col("is_holiday").alias("_h"), F.col("is_workday").alias("_w"))
    joined = df.withColumn("_d", F.col(ts).cast("date")).join(days, "_d", "left")
    return joined.withColumn("is_holiday", F.coalesce("_h", weekend.cast("int"))).withColumn("is_workday", F.coalesce("_w", (~weekend).cast("int"))).drop("_d", "_h", "_w")


def easter(year: int) -> dt.date:
    """Gregorian Easter Sunday."""
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return dt.date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th weekday (Monday 0) of a month; -1 is the last."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    end = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return end - dt.timedelta((end.weekday() - weekday) % 7)


#: The named holidays, each with its rule.
HOLIDAYS = {
    "Christmas Eve": lambda y: dt.date(y, 12, 24),
    "Christmas Day": lambda y: dt.date(y, 12, 25),
    "New Years Eve": lambda y: dt.date(y, 12, 31),
    "New Years Day": lambda y: dt.date(y, 1, 1),
    "Martin Luther King Jr": lambda y: _nth(y, 1, 0, 3),
    "Presidents Day": lambda y: _nth(y, 2, 0, 3),
    "Memorial Day": lambda y: _nth(y, 5, 0, -1),
    "Independence Day": lambda y: dt.date(y, 7, 4),
    "Labor Day": lambda y: _nth(y, 9, 0, 1),
    "Columbus Day": lambda y: _nth(y, 10, 0, 2),
    "Thanksgiving": lambda y: _nth(y, 11, 3, 4),
    "Black Friday": lambda y: _nth(y, 11, 3, 4) + dt.timedelta(1),
    "Cyber Monday": lambda y: _nth(y, 11, 3, 4) + dt.timedelta(4),
    "Mothers Day": lambda y: _nth(y, 5, 6, 2),
    "Easter Sunday": easter,
    "Good Friday": lambda y: easter(y) - dt.timedelta(2),
    "Easter Monday": lambda y: easter(y) + dt.timedelta(1),
    "Superbowl": lambda y: _nth(y, 2, 6, 1),
}


def holiday_table(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """``holiday, date`` of a range of years: a few hundred rows."""
    return spark.createDataFrame([(n, rule(y)) for n, rule in HOLIDAYS.items() for y in range(first_year, last_year + 1)], "holiday string, date date")


def holiday_distance(df: DataFrame, ts: str, holidays: list[str] | None = None, reach: int = 200, scale: bool = True) -> DataFrame:
    """Days from the first occurrence of each named holiday within ``reach`` days to the row's time, standardised.

    Worked out once for each distinct date against the small holiday table, then joined on the date.
    """
    names = holidays or list(HOLIDAYS)
    lo, hi = df.agg(F.min(F.year(ts)), F.max(F.year(ts))).first()
    days = df.select(F.col(ts).cast("date").alias("_d")).distinct()
    if lo is None:
        return df.select("*", *[F.lit(None).cast("double").alias(n) for n in names])
    table = F.broadcast(holiday_table(df.sparkSession, lo - 1, hi + 1).filter(F.col("holiday").isin(names)))  # names x years rows
    near = days.join(table, F.col("date").between(F.date_sub("_d", reach), F.date_add("_d", reach)))
    far = near.groupBy("_d").pivot("holiday", names).agg(F.datediff(F.first("_d"), F.min("date")).cast("double"))
    out = df.withColumn("_d", F.col(ts).cast("date")).join(far, "_d", "left").drop("_d")
    return standard_scale(out, names).transform(out) if scale else out


def weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5
