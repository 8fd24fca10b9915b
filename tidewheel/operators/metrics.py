"""Forecast and detection metrics of aligned rows; several at once are one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mse(y: str, p: str) -> Column:
    return F.avg(F.pow(F.col(y) - F.col(p), F.lit(2.0)))


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def logloss(y: str, p: str, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)))


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("double")), F.lit(0.0))


def acc(y: str, p: str) -> Column:
    return F.avg((F.col(y) == F.col(p)).cast("double"))


def precision(y: str, p: str) -> Column:
    return _rate(_count((F.col(y) == 1) & (F.col(p) == 1)), _count(F.col(p) == 1))


def recall(y: str, p: str) -> Column:
    return _rate(_count((F.col(y) == 1) & (F.col(p) == 1)), _count(F.col(y) == 1))


def f1(y: str, p: str) -> Column:
    return _rate(2 * _count((F.col(y) == 1) & (F.col(p) == 1)), _count(F.col(y) == 1) + _count(F.col(p) == 1))


METRICS = {"mse": mse, "mae": mae, "logloss": logloss, "acc": acc, "precision": precision, "recall": recall, "f1": f1}


def evaluate(aligned: DataFrame, columns: list[str], metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """``<metric>_<column>`` of each column against ``<column>_pred``, in one aggregate."""
    aggs = [METRICS[m](c, f"{c}_pred").alias(f"{m}_{c}") for m in metrics for c in columns]
    return aligned.groupBy(*by).agg(*aggs) if by else aligned.agg(*aggs)


def metric_container(aligned: DataFrame, columns: list[str], metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """As evaluate(), long: ``metric, column, value``."""
    wide = evaluate(aligned, columns, metrics, by)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(c).alias("column"), F.col(f"{m}_{c}").alias("value")) for m in metrics for c in columns])
    return wide.select(*(by or []), F.explode(rows).alias("r")).select(*(by or []), "r.*")


def sample_columns(df: DataFrame, target: str) -> list[str]:
    """The prediction columns ``<target>@<name>``."""
    return [c for c in df.columns if c.startswith(f"{target}@")]


def point_of_samples(df: DataFrame, target: str) -> DataFrame:
    """``<target>_pred``: the median of the sample columns, by sorting them within the row."""
    cols = sample_columns(df, target)
    a = F.array_sort(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]))
    n = len(cols)
    return df.withColumn(f"{target}_pred", (F.get(a, F.lit((n - 1) // 2)) + F.get(a, F.lit(n // 2))) / 2)


def quantile_loss(df: DataFrame, target: str, q: tuple[float, ...] = (0.1, 0.5, 0.9), by: list[str] | None = None) -> DataFrame:
    """``q, loss``: pinball loss of the nearest sample quantile, over the sum of absolute values."""
    cols = sample_columns(df, target)
    a = F.array_sort(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]))
    aggs = []
    for i, p in enumerate(q):
        e = F.col(target) - F.get(a, F.lit(round(p * (len(cols) - 1))))
        aggs.append((F.sum(F.greatest((p - 1) * e, p * e)) / F.nullif(F.sum(F.abs(target)), F.lit(0))).alias(f"_{i}"))
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(p).alias("q"), F.col(f"_{i}").alias("loss")) for i, p in enumerate(q)])
    return wide.select(*(by or []), F.explode(rows).alias("r")).select(*(by or []), "r.*")
