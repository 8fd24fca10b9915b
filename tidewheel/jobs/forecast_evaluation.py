"""Feature build and rolling evaluation of daily forecasts for every series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar, forecast, grid, transforms
from ..panel import Panel


def features(events: DataFrame, key: str, ts: str, col: str) -> DataFrame:
    """Daily grid, fills, calendar, lags and rolling means: one shuffle and one sort by key."""
    daily = transforms.fill(grid.resample(events, key, ts, "1 day", [col]), key, ts, [col], "pre")
    lagged = transforms.lag(daily, key, ts, [col], 7)
    return calendar.time_features(transforms.rolling_stats(lagged, key, ts, [col], 0, 7, ("mean",)), ts, ["weekday", "dayofmonth"])


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, rounds, mse_last, mse_mean``: two forecasters' errors over all origins of each series."""
    f = features(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value"), "user_id", "ts", "value")
    panel = Panel(f, "user_id", "ts", {"value": "target"}, "1 day")
    score = lambda fc, name: forecast.backtest_score(forecast.backtest(panel, fc, 7, 3), "user_id").select("user_id", "rounds", F.round("mse", 6).alias(name))
    return score(forecast.last_value, "mse_last").join(score(forecast.mean_value, "mse_mean").drop("rounds"), "user_id")
