"""Anomaly scores, thresholds, labels, segments and their evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..panel import in_order, whole, with_blocks
from . import metrics
from .analysis import percentiles


def recon_score(df: DataFrame, cols: list[str], recon: list[str], by: list[str] | None = None, name: str = "score") -> DataFrame:
    """Mean squared error over the channels: of each row, or of each window when ``by`` names it."""
    row = sum((F.pow(F.col(c) - F.col(r), F.lit(2.0)) for c, r in zip(cols, recon, strict=True)), F.lit(0.0)) / len(cols)
    return df.groupBy(*by).agg(F.avg(row).alias(name)) if by else df.withColumn(name, row)


def percentile_threshold(scores: DataFrame, score: str = "score", q: float = 100.0, coefficient: float = 1.0, by: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """``threshold``: a percentile of the scores times a coefficient."""
    f = (F.approx_percentile if approximate else F.percentile)(score, F.lit(q / 100))
    agg = (f * F.lit(coefficient)).alias("threshold")
    return scores.groupBy(*by).agg(agg) if by else scores.agg(agg)


def ratio_threshold(train: DataFrame, validation: DataFrame, anomaly_ratio: float, score: str = "score") -> DataFrame:
    """The percentile 100 - ratio of the scores of both sets."""
    return percentile_threshold(train.select(score).unionByName(validation.select(score)), score, 100 - anomaly_ratio)


def epsilon_threshold(scores: DataFrame, key: str, ts: str, score: str = "score", reg_level: int = 1, reach: int = 49) -> DataFrame:
    """``threshold``: mean + z deviations whose pruning lowers mean and deviation most, punished by how many rows (within ``reach``) it flags.

    One aggregate holds the conditional statistics of all 19 z; a second, over flags dilated by one
    frame, counts rows.
    """
    zs = [2.5 + 0.5 * i for i in range(19)]
    m, sd, top, n = scores.agg(F.avg(score), F.stddev_pop(score), F.max(score), F.count(score)).first()
    if not n:
        return scores.sparkSession.createDataFrame([(None,)], "threshold double")
    limits = [m + z * sd for z in zs]
    flags = [(F.col(score) >= t).cast("int").alias(f"f_{i}") for i, t in enumerate(limits)]
    frame = in_order(key, ts).rowsBetween(-reach, reach)
    wide = scores.select(key, ts, score, *flags).select(score, *[F.max(f"f_{i}").over(frame).alias(f"d_{i}") for i in range(len(zs))])
    aggs = [F.sum(f"d_{i}").alias(f"n_{i}") for i in range(len(zs))]
    aggs += [f(F.when(F.col(score) < t, F.col(score))).alias(f"{k}_{i}") for i, t in enumerate(limits) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    got = wide.agg(*aggs).first()
    best, chosen = -np.inf, float(top)
    for i, t in enumerate(limits):
        if not got[f"n_{i}"] or got[f"n_{i}"] >= n * 0.5 or got[f"m_{i}"] is None or not m or not sd:
            continue
        gain = (m - got[f"m_{i}"]) / m + (sd - got[f"s_{i}"]) / sd
        value = round(gain / (1, got[f"n_{i}"], got[f"n_{i}"] ** 2)[reg_level], 10)  # limits that part the same rows are equal
        if value >= best:
            best, chosen = value, t
    return scores.sparkSession.createDataFrame([(float(chosen),)], "threshold double")


def label(scores: DataFrame, threshold: DataFrame | float, score: str = "score", name: str = "pred", by: list[str] | None = None) -> DataFrame:
    """1 where the score reaches the threshold (a number, or a table of one row or one a key)."""
    if isinstance(threshold, DataFrame) and not by:
        threshold = threshold.first()[0]  # one number
    if not isinstance(threshold, DataFrame):
        return scores.withColumn(name, (F.col(score) >= F.lit(threshold)).cast("int"))
    joined = scores.join(threshold, by)
    return joined.withColumn(name, (F.col(score) >= F.col("threshold")).cast("int")).drop("threshold")


def _run_id(key: str, ts: str, flag: Column) -> Column:
    """Number of the run of equal flags that a row is in."""
    w = in_order(key, ts)
    change = (F.lag(flag, 1).over(w).isNull() | (F.lag(flag, 1).over(w) != flag)).cast("int")
    return change


def point_adjust(df: DataFrame, key: str, ts: str, pred: str, real: str) -> DataFrame:
    """Every row of a true anomalous run is predicted if one of it is."""
    starts = df.withColumn("_start", _run_id(key, ts, F.col(real)))
    runs = starts.withColumn("_run", F.sum("_start").over(in_order(key, ts).rowsBetween(Window.unboundedPreceding, 0)))
    hit = F.max(pred).over(Window.partitionBy(key, "_run"))
    return runs.withColumn(pred, F.when(F.col(real) == 1, hit).otherwise(F.col(pred))).drop("_start", "_run")


def point_adjust_in_blocks(df: DataFrame, key: str, ts: str, step: str, pred: str, real: str, block: int = 100_000) -> DataFrame:
    """As point_adjust() for series of any length: runs are numbered block by block, so no task holds a series."""
    at = with_blocks(df, key, ts, step, block)
    w = in_order([key, "_block"], ts)
    inner = (F.lag(real, 1).over(w).isNull() | (F.lag(real, 1).over(w) != F.col(real))).cast("long")
    at = at.withColumn("_new", inner).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a few rows a series: what each block starts and ends with, and how many runs it begins
    ends = at.groupBy(key, "_block").agg(F.min_by(real, ts).alias("_first"), F.max_by(real, ts).alias("_last"), F.max("_run").alias("_runs"))
    over = in_order(key, "_block")
    joins = (F.lag("_last", 1).over(over) == F.col("_first")).cast("long")
    ends = ends.withColumn("_less", F.coalesce(joins, F.lit(0))).withColumn("_new", F.col("_runs") - F.col("_less"))
    ends = ends.withColumn("_before", F.coalesce(F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_less"))
    runs = at.join(ends.select(key, "_block", "_before"), [key, "_block"]).withColumn("_run", F.col("_run") + F.col("_before"))
    hit = runs.filter(F.col(real) == 1).groupBy(key, "_run").agg(F.max(pred).alias("_hit"))
    return runs.join(hit, [key, "_run"], "left").withColumn(pred, F.when(F.col(real) == 1, F.col("_hit")).otherwise(F.col(pred))).select(*df.columns)


def anomaly_segments(df: DataFrame, key: str, ts: str, flag: str) -> DataFrame:
    """``key, start, end, length`` of the runs of 1."""
    starts = df.withColumn("_start", _run_id(key, ts, F.col(flag)))
    runs = starts.withColumn("_run", F.sum("_start").over(in_order(key, ts).rowsBetween(Window.unboundedPreceding, 0)))
    return runs.filter(F.col(flag) == 1).groupBy(key, "_run").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("length")).drop("_run")


def evaluate(df: DataFrame, key: str, ts: str, pred: str, real: str, by: list[str] | None = None) -> DataFrame:
    """``precision, recall, f1`` after point adjustment."""
    adjusted = point_adjust(df, key, ts, pred, real)
    aggs = [metrics.METRICS[m](real, pred).alias(m) for m in ("precision", "recall", "f1")]
    return adjusted.groupBy(*by).agg(*aggs) if by else adjusted.agg(*aggs)


def ensemble_score(scores: DataFrame, key: str, ts: str, model: str = "model", score: str = "score", mode: str = "mean", standardise: bool = True) -> DataFrame:
    """``key, ts, score``: each model's scores standardised over the set, then combined at each time."""
    from .ensemble import COMBINE

    if standardise:
        per = scores.groupBy(model).agg(F.avg(score).alias("_m"), F.stddev_pop(score).alias("_s"))
        scores = scores.join(per, model).withColumn(score, (F.col(score) - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")
    return scores.groupBy(key, ts).agg(COMBINE[mode](score).alias(score))


def contamination_threshold(train_scores: DataFrame, contamination: float, score: str = "score") -> DataFrame:
    """The greatest training score, or the percentile 100(1 - contamination)."""
    return percentile_threshold(train_scores, score, 100.0 * (1 - contamination))


def ensemble_vote(labels: DataFrame, key: str, ts: str, name: str = "label") -> DataFrame:
    """Majority label at each time; ties go to the smaller label."""
    n = labels.groupBy(key, ts, name).agg(F.count("*").alias("_n"))
    return n.groupBy(key, ts).agg(F.max(F.struct("_n", (-F.col(name)).alias("_l"))).alias("_b")).select(key, ts, (-F.col("_b._l")).alias(name))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(sum((x[:, i, None] - y[None, :, i]) ** 2 for i in range(x.shape[1])))


def _nearest(x: np.ndarray, y: np.ndarray, copies: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of x the k least distances to rows of y, each as often as it has copies; one copy of x itself is left out."""
    out = []
    for i in range(0, len(x), 256):
        d = _distances(x[i : i + 256], y)
        near = np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, : k + 1]
        for row, at in zip(d, near, strict=True):
            m = np.minimum(copies[at], k + 1) - (row[at] == 0)
            out.append(np.sort(np.repeat(row[at], m))[:k])
    return out


def _halves(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree that halves the sample ``depth`` times: of each inner node, level by level, the column and the value at which it is cut."""
    column, cut = np.zeros(2**depth - 1, int), np.zeros(2**depth - 1)
    parts = [sample]
    for node in range(2**depth - 1):
        part = parts[node]
        if len(part):
            column[node] = np.ptp(part, axis=0).argmax()
            x = part[:, column[node]]
            cut[node] = np.median(x)
            if cut[node] == x.min() and (x > cut[node]).any():  # many equal values: they are one half
                cut[node] = x[x > cut[node]].min()
        right = part[:, column[node]] >= cut[node]
        parts += [part[~right], part[right]]
        parts[node] = sample[:0]
    return column, cut


def _gaps(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance of each row of x from each box."""
    return np.sqrt(sum(np.maximum(np.maximum(low[None, :, i] - x[:, i, None], x[:, i, None] - high[None, :, i]), 0) ** 2 for i in range(x.shape[1])))


def window_outliers(vectors: DataFrame, row_id: str, vector: str, k: int = 5, contamination: float = 0.1, cells: int = 8192, chunk: int = 2048) -> DataFrame:
    """``id, score, pred``: each window's distance to its k-th nearest among all others (the farthest of fewer).

    Exact, without comparing all pairs. Equal windows are one with a count. A bounded sample cuts the
    space into cells of up to about ``chunk`` windows each (it decides where windows go, not what they
    score); larger cells are cut into chunks. The k-th best of a window's own chunk bounds its score,
    and only cells whose box (of all their windows) is nearer than that are asked, so a window asks a
    few chunks, however many there are. Windows that ask one chunk are dealt out by salts, to each of
    which the chunk is copied, so no group grows with the table.
    """
    names = vectors.select(F.col(row_id).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    points = names.groupBy("v").agg(F.count("*").alias("m")).persist()  # read for the sample, the boxes and the chunks
    n, least, width = points.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    kind = dict(vectors.dtypes)[row_id]
    if not n:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, score double, pred int")
    if least != width or width < 1:
        raise ValueError("the windows are of one length, of at least one value")
    matrix = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    depth = int(np.log2(max(1, min(cells, 2 * n // chunk, 1_000_000 // width))))
    share = min(1.0, 8 * 2**depth / n)  # a few rows a cell
    sample = matrix(points.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share * (1 << 30)).select("v").toArrow().column("v"))
    column, cut = _halves(sample, depth)

    def assign(batches):
        for b in batches:
            x = matrix(pa.chunked_array([b.column("v")]))
            at = np.zeros(len(x), int)
            for _ in range(depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), column[at]] >= cut[at])
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("m"), pa.array(at - (2**depth - 1))], ["v", "m", "cell"])

    dealt = points.mapInArrow(assign, "v array<double>, m long, cell long")
    ends = [f(F.col("v")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(width)]
    boxes = dealt.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect()  # ``cells`` rows at most
    cell_of, chunks = np.array([b["cell"] for b in boxes]), np.array([-(-b["n"] // chunk) for b in boxes])
    low, high = (np.array([[b[f"{name}{i}"] for i in range(width)] for b in boxes]) for name in ("low", "high"))
    number = vectors.sparkSession.createDataFrame(list(zip(cell_of.tolist(), chunks.tolist(), strict=True)), "cell long, chunks long")
    dealt = dealt.join(F.broadcast(number), "cell").withColumn("c", F.pmod(F.xxhash64("v", F.lit(1)), F.col("chunks"))).drop("chunks")
    lists = lambda found: pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(o) for o in found])].astype(np.int32), np.concatenate([*found, np.zeros(0)]))

    def ask(table: pa.Table) -> pa.Table:
        """What a chunk's windows find in it (cell -1), and the chunks beside it that each has to be compared with."""
        x, here = matrix(table.column("v")), (table.column("cell")[0].as_py(), table.column("c")[0].as_py())
        own = _nearest(x, x, table.column("m").to_numpy(), k)
        bound = np.array([o[k - 1] if len(o) == k else np.inf for o in own])
        order, rows, cells_asked, parts = np.argsort(bound), [np.arange(len(x))], [np.full(len(x), -1)], [np.zeros(len(x), int)]
        for i in range(0, len(x), 256):
            at = order[i : i + 256]
            far = bound[at] * (1 + 1e-9) + 1e-9
            q = x[at]
            beside = np.maximum(np.maximum(low - q.max(0), q.min(0) - high), 0)
            near = np.flatnonzero(np.sqrt((beside**2).sum(1)) <= far.max())
            for j in range(0, len(near), 512):
                some = near[j : j + 512]
                row, box = np.nonzero(_gaps(q, low[some], high[some]) <= far[:, None])
                many = chunks[some[box]]
                part = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                row, box = np.repeat(at[row], many), np.repeat(cell_of[some[box]], many)
                other = (box != here[0]) | (part != here[1])
                rows.append(row[other])
                cells_asked.append(box[other])
                parts.append(part[other])
        row = np.concatenate(rows)
        d = lists([*own, *[np.zeros(0)] * (len(row) - len(own))])
        v = table.column("v").combine_chunks().take(pa.array(row))
        return pa.Table.from_arrays([v, pa.array(np.concatenate(cells_asked)), pa.array(np.concatenate(parts)), pa.array(bound[row]), d], ["v", "cell", "c", "bound", "d"])

    asked = dealt.groupBy("cell", "c").applyInArrow(ask, "v array<double>, cell long, c long, bound double, d array<double>").persist()  # read for the salts, the answers and the questions
    own, asked = asked.filter("cell < 0").select("v", "d"), asked.filter("cell >= 0").drop("d")
    salts = asked.groupBy("cell", "c").agg(F.ceil(F.count("*") / F.lit(chunk)).alias("salts"))
    asked = asked.join(salts, ["cell", "c"]).withColumn("s", F.pmod(F.xxhash64("v", F.lit(2)), F.col("salts")))
    held = dealt.join(salts.toDF("cell", "c", "copies"), ["cell", "c"]).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))

    def compare(queries: pa.Table, there: pa.Table) -> pa.Table:
        """Distances below what a window has found at home; most have none."""
        found = _nearest(matrix(queries.column("v")), matrix(there.column("v")), there.column("m").to_numpy(), k) if len(queries) and len(there) else []
        better = [o[o < b] for o, b in zip(found, queries.column("bound").to_numpy(), strict=False)]
        some = [i for i, o in enumerate(better) if len(o)]
        return pa.Table.from_arrays([queries.column("v").combine_chunks().take(pa.array(some, pa.int64())), lists([better[i] for i in some])], ["v", "d"])

    found = asked.select("v", "cell", "c", "s", "bound").groupBy("cell", "c", "s").cogroup(held.select("v", "m", "cell", "c", "s").groupBy("cell", "c", "s")).applyInArrow(compare, "v array<double>, d array<double>")
    nearest = own.unionByName(found).groupBy("v").agg(F.slice(F.sort_array(F.flatten(F.collect_list("d"))), 1, k).alias("d"))
    scored = names.join(nearest, "v").select("id", F.when(F.size("d") > 0, F.element_at("d", -1)).alias("score")).persist()  # read for the threshold, and labelled
    limit = percentiles(scored, ["score"], (1.0 - contamination,)).first()["value"]
    return label(scored, limit)
