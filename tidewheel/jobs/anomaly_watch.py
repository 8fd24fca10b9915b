"""Scores, threshold, labels and evaluation of anomalies in every series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, anomaly, transforms


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``precision, recall, f1`` of errors found by the distance from a moving average, after scaling."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", (F.col("event_type") == "error").cast("int").alias("real"))
    scaled = transforms.standard_scale(rows, ["value"]).transform(rows)
    scored = anomaly.recon_score(analysis.decompose(scaled, "user_id", "ts", "value", 5), ["value"], ["value_trend"])
    flagged = anomaly.label(scored, anomaly.percentile_threshold(scored, "score", 95))
    return anomaly.evaluate(flagged, "user_id", "ts", "pred", "real").select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
