"""Whole-series features, clustering and classification."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..panel import Panel, in_order


def series_features(df: DataFrame, key: str, ts: str, cols: list[str]) -> DataFrame:
    """``key`` and, for each column, mean, deviation, extremes, quartiles, missing share and first autocorrelation: built-ins only."""
    w = in_order(key, ts)
    at = df.select(key, *cols, *[F.lag(c, 1).over(w).alias(f"_l_{c}") for c in cols])
    aggs: list[Column] = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [
            F.avg(v).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{c}_std"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max"),
            F.percentile(v, F.lit(0.25)).alias(f"{c}_q1"), F.percentile(v, F.lit(0.75)).alias(f"{c}_q3"), F.avg(v.isNull().cast("double")).alias(f"{c}_missing"),
            F.coalesce(F.nanvl(F.corr(c, f"_l_{c}"), F.lit(0.0)), F.lit(0.0)).alias(f"{c}_acf1"),
        ]
    return at.groupBy(key).agg(*aggs)


def features_vector(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip").transform(df)


def cluster(features: DataFrame, key: str, k: int = 8, seed: int = 1) -> DataFrame:
    """``key, cluster`` by k-means; ``features`` is a vector or an array."""
    at = _as_vector(features)
    return KMeans(k=k, seed=seed).fit(at).transform(at).select(key, F.col("prediction").cast("long").alias("cluster"))


def _as_vector(df: DataFrame) -> DataFrame:
    kind = dict(df.dtypes)["features"]
    return df.withColumn("features", array_to_vector(F.transform("features", lambda v: v.cast("double")))) if kind.startswith("array") else df


def classify(train: DataFrame, new: DataFrame, key: str, label: str = "label", trees: int = 20, seed: int = 1) -> DataFrame:
    """``key, proba, label``: boosted trees for two classes, a forest for more; labels of any kind."""
    train, new = _as_vector(train), _as_vector(new)
    index = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(train.withColumn("_label", F.col(label).cast("string")))
    names = index.labels
    indexed = index.transform(train.withColumn("_label", F.col(label).cast("string")))
    learner = GBTClassifier(labelCol="_y", maxIter=trees, seed=seed) if len(names) == 2 else RandomForestClassifier(labelCol="_y", numTrees=trees, seed=seed)
    scored = learner.fit(indexed).transform(new).select(key, vector_to_array("probability").alias("proba"))
    return scored.withColumn("label", label_from_proba(F.col("proba"), names))


def label_from_proba(proba: Column, names: list) -> Column:
    """The name of the greatest probability; the first among equals."""
    return F.get(F.array(*map(F.lit, names)), F.array_position(proba, F.array_max(proba)).cast("int") - 1)


def accuracy(truth: str, pred: str) -> Column:
    return F.avg((F.col(truth).cast("string") == F.col(pred).cast("string")).cast("double"))


def extract_labels(panel: Panel, label: str = "label") -> tuple[DataFrame, Panel]:
    """``key, label`` of each series, and the panel without that static column."""
    return panel.df.select(panel.key, label).distinct(), panel.on(panel.df.drop(label))


def repr_forecast(panel: Panel, features: DataFrame, steps: int, alpha: float = 0.5) -> DataFrame:
    """``key, ts, h, y, p``: ridge models from a row's embedding (``features``) to its target 1 … ``steps`` rows on."""
    key, ts, target = panel.key, panel.ts, panel.columns("target")[0]
    ahead = panel.df.select(key, ts, *[F.lead(target, h).over(in_order(key, ts)).cast("double").alias(f"_y{h}") for h in range(1, steps + 1)])
    at = _as_vector(features).join(ahead, [key, ts]).persist()
    out = None
    for h in range(1, steps + 1):
        rows = at.filter(F.col(f"_y{h}").isNotNull())
        model = LinearRegression(labelCol=f"_y{h}", regParam=alpha, elasticNetParam=0.0).fit(rows)
        part = model.transform(rows).select(key, ts, F.lit(h).cast("long").alias("h"), F.col(f"_y{h}").alias("y"), F.col("prediction").alias("p"))
        out = part if out is None else out.unionByName(part)
    at.unpersist()
    return out
