"""A stream in event time against the whole table at once, however its rows arrive."""

import datetime
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.streaming import stream

T0 = datetime.datetime(2024, 3, 1)
SCHEMA = "k string, ts timestamp, value double"


def run(spark, files, make):
    """Each list of rows is a file and a micro-batch of its own; what was emitted, and the rows that came too late."""
    folder = tempfile.mkdtemp(prefix="spark-")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/part={i:03}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    q = make(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    late = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    return spark.read.parquet(f"{folder}/out"), late


def made_change():
    return lambda rows: rows.assign(diff=rows["value"].diff(2), mean=rows["value"].rolling(3).mean())


@pytest.mark.parametrize("idle", [None, "30 minutes"])
def test_shuffled_rows_equal_the_batch(spark, idle):
    r = random.Random(3)
    rows = [(k, T0 + datetime.timedelta(minutes=i, microseconds=r.randint(0, 999_999)), r.random()) for k in "abc" for i in range(60) if k != "c" or i < 20]
    rows.sort(key=lambda x: x[1] + datetime.timedelta(minutes=r.uniform(0, 9)))  # no row comes ten minutes after a newer one
    files = [rows[i : i + 20] for i in range(0, len(rows), 20)]
    got, late = run(spark, files, lambda s: stream.stream_in_event_time(s, "k", "ts", ["value"], 2, made_change(), f"{SCHEMA}, diff double, mean double", "10 minutes", idle))
    mark = max(t for _, t, _ in rows).replace(microsecond=max(t for _, t, _ in rows).microsecond // 1000 * 1000) - datetime.timedelta(minutes=10)
    want = {}
    for k in "abc":
        own = pd.DataFrame(sorted((t, v) for key, t, v in rows if key == k), columns=["ts", "value"])
        want |= {(k, x.ts.to_pydatetime()): x for x in made_change()(own).itertuples() if x.ts.to_pydatetime() <= mark}
    told = {(x.k, x.ts): x for x in got.collect()}
    assert late == 0 and got.count() == len(told) and told.keys() == want.keys() and len(want) > 100
    near = lambda a, b: (a is None or a != a) and b != b or abs(a - b) < 1e-12
    assert all(x.value == want[i].value and near(x.diff, want[i].diff) and near(x.mean, want[i].mean) for i, x in told.items())


def test_rows_past_the_watermark_are_counted(spark):
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    files = [[("a", at(0), 1.0), ("a", at(60), 2.0)], [("b", at(61), 1.0)], [("a", at(5), 9.0), ("a", at(59), 3.0), ("a", at(62), 4.0)], [("b", at(200), 5.0)]]
    got, late = run(spark, files, lambda s: stream.stream_in_event_time(s, "k", "ts", ["value"], 2, made_change(), f"{SCHEMA}, diff double, mean double", "10 minutes"))
    assert late == 1
    assert [(x.ts, x.value) for x in got.filter("k = 'a'").orderBy("ts").collect()] == [(at(0), 1.0), (at(59), 3.0), (at(60), 2.0), (at(62), 4.0)]
    assert got.filter(F.col("ts") == at(62)).first().diff == 1.0
