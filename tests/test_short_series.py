"""Many short series in one task against a plain version."""

import numpy as np

from tidewheel.operators import analysis



def test_short_series_share_calls(spark):
    """Series that cross Arrow batches, of two columns, with a NULL key and missing values, without a call a series (F6)."""
    r = np.random.default_rng(6)
    rows = [(None if k == 7 else k, i, None if i == 3 else float(x), float(-x)) for k in range(40) for i, x in enumerate(r.normal(size=5 + k % 9).tolist())]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        d = spark.createDataFrame(rows, "k long, t long, a double, b double").repartition(5)
        out = analysis.per_series(d, "k", "t", ["a", "b"], lambda x: {"n": [len(x)], "s": [np.nansum(x * np.arange(len(x)))]} if len(x) > 5 else {"n": [], "s": []}, "n long, s double")
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(x.k, x.column): (x.n, x.s) for x in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, i, a, b in rows:
        for c, x in (("a", a), ("b", b)):
            n, s = want.get((k, c), (0, 0.0))
            want[k, c] = (n + 1, s + (x or 0.0) * i)
    want = {k: v for k, v in want.items() if v[0] > 5}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1]) for k in want)
