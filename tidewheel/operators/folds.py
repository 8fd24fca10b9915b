"""Holdout, expanding and sliding folds: small tables of row ranges, applied by filters; no data is copied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..panel import Panel, in_order


def lengths(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def _table(n: DataFrame, key: str, folds: Column) -> DataFrame:
    """``key, fold, part, lo, hi`` (hi excluded); folds with an empty test go."""
    one = n.select(key, F.posexplode(F.filter(folds, lambda f: f["test_lo"] < f["test_hi"])).alias("fold", "f"))
    rows = F.array(F.struct(F.lit("train").alias("part"), F.col("f.train_lo").alias("lo"), F.col("f.train_hi").alias("hi")), F.struct(F.lit("test").alias("part"), F.col("f.test_lo").alias("lo"), F.col("f.test_hi").alias("hi")))
    out = one.select(key, F.col("fold").cast("long").alias("fold"), F.explode(rows).alias("r"))
    return out.select(key, "fold", "r.part", F.col("r.lo").cast("long").alias("lo"), F.col("r.hi").cast("long").alias("hi"))


def _fold(train_lo, train_hi, test_lo, test_hi) -> Column:
    names = zip(("train_lo", "train_hi", "test_lo", "test_hi"), (train_lo, train_hi, test_lo, test_hi), strict=True)
    return F.struct(*[F.lit(v).cast("long").alias(n) if isinstance(v, int) else v.cast("long").alias(n) for n, v in names])


def holdout(df: DataFrame, key: str, test_size: int | float, skip_size: int = 0) -> DataFrame:
    """Train up to n - test, test from n - test + skip; series too short have no fold."""
    n = lengths(df, key)
    test = F.floor(F.col("n") * F.lit(test_size)) if isinstance(test_size, float) else F.lit(test_size)
    return _table(n.filter(F.col("n") > test + skip_size), key, F.array(_fold(0, F.col("n") - test, F.col("n") - test + skip_size, F.col("n"))))


def expanding(df: DataFrame, key: str, n_splits: int = 5, test_size: int | None = None, skip_size: int = 0, max_train_size: int | None = None) -> DataFrame:
    """Training rows from the start (at most the first ``max_train_size``), tests one after the other at the end."""
    n = F.col("n")
    test = F.lit(test_size) if test_size else F.floor(n / (n_splits + 1))
    first = n - test * n_splits - skip_size
    starts = F.when((first > 0) & (test > 0), F.sequence(first, n - 1, test)).otherwise(F.array().cast("array<bigint>"))
    cap = (lambda s: F.least(s, F.lit(max_train_size))) if max_train_size else (lambda s: s)
    return _table(lengths(df, key), key, F.transform(starts, lambda s: _fold(0, cap(s), s + skip_size, F.least(s + skip_size + test, n))))


def sliding(df: DataFrame, key: str, train_size: int, test_size: int, step_size: int | None = None, skip_size: int = 0) -> DataFrame:
    """Training windows of one length that move on by ``step_size``."""
    n, first = F.col("n"), train_size + skip_size
    starts = F.when(n > first, F.sequence(F.lit(first).cast("long"), n - 1, F.lit(step_size or test_size).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return _table(lengths(df, key), key, F.transform(starts, lambda s: _fold(s - train_size, s, s + skip_size, F.least(s + skip_size + test_size, n))))


def apply_folds(panel: Panel, folds: DataFrame) -> DataFrame:
    """Rows of each (fold, part); target and observed columns are NULL outside their part where known ones reach on.

    The folds of a key are a few rows, so a join on the key and a range filter do it.
    """
    at = panel.df.withColumn("pos", (F.row_number().over(in_order(panel.key, panel.ts)) - 1).cast("long"))
    inside = (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))
    joined = at.join(folds, panel.key)
    if not panel.columns("known"):
        return joined.filter(inside).drop("lo", "hi")
    own = panel.columns("target", "observed")
    return joined.withColumns({c: F.when(inside, F.col(c)) for c in own}).withColumn("inside", inside).drop("lo", "hi")
