"""What a worker keeps for an operator goes when a task of another one starts there."""

import os

from tidewheel.llm import common


def held(spark, operator):
    """Of each task its worker, and what that has of which operators."""

    def make():
        made = common.kept(operator, "maker", os.getpid) if operator else 0
        return lambda ids: {"pid": [os.getpid()] * len(ids), "made": [made] * len(ids), "of": [sorted(common._KEPT)] * len(ids)}

    rows = common.per_batch(spark.range(0, 8, numPartitions=8), ["id"], "pid long, made long, of array<string>", make, operator=operator).collect()
    return {r.pid: r.of for r in rows}


def test_workers_drop_what_other_operators_keep(spark):
    one = held(spark, "one")
    assert all(of == ["one"] for of in one.values())
    for operator, of in (("one", ["one"]), ("two", ["two"]), ("", [])):
        now = held(spark, operator)
        assert one.keys() & now.keys(), "no worker is used again"
        assert all(x == of for x in now.values()), (operator, now)
