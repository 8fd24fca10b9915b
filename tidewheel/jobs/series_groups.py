"""Groups of alike series by their features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, series_ml


def run(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    """``user_id, cluster``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    f = series_ml.series_features(grid.resample(events, "user_id", "ts", "1 day", ["value"]), "user_id", "ts", ["value"])
    return series_ml.cluster(series_ml.features_vector(f, [c for c in f.columns if c != "user_id"]), "user_id", k)
