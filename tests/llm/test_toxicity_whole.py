"""The toxicity model learns from every labelled row, however few of them are examples: against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import toxicity
from tidewheel.llm.common import rows_of_ids


@pytest.fixture(scope="module")
def told():
    r = random.Random(4)
    bad = ["stupid", "trash", "scum", "moron"]
    text = lambda i: " ".join([f"w{r.randint(0, 120)}" for _ in range(12)] + (r.sample(bad, 2) if i % 5 == 0 else []))
    return [(i, None if i % 97 == 3 else text(i if r.random() < 0.9 else i + 1)) for i in range(500)]


def vectors(model, texts):
    """Dense rows of unit length."""
    text, term, n, *strange = toxicity.Terms(model["table"])(texts)
    _, w = model["weights"](text, term, n, *strange, len(texts))
    out = np.zeros((len(texts), model["table"].size))
    out[text, term] = w
    return out


def nearest(cosines, k):
    best = sorted((-round(float(c), 9), j) for j, c in enumerate(cosines) if round(float(c), 9) > 0)[:k]
    return [j for _, j in best], [-c for c, _ in best]


def test_all_labelled_rows_count(spark, told):
    docs, label = spark.createDataFrame(told, "doc_id long, text string"), {i: int(i % 5 == 0) for i, _ in told if i < 400}
    labels = spark.createDataFrame(list(label.items()), "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, examples=60, k=8)
    texts, ids, size = dict(told), model["ids"], 60
    assert len(ids) == size and model["rate"] == sum(label.values()) / 400
    # the weights come from the 2x2 tables of all labelled rows
    count, y = toxicity.Terms(model["table"]), np.array(list(label.values()), bool)
    has = lambda rows: np.array([np.bincount(count([t])[1], minlength=model["table"].size) > 0 for t in rows])
    with_it, df = has([texts[i] for i in label]), has([t for _, t in told]).sum(0)
    for t in range(0, model["table"].size, 7):
        a, b = (with_it[y, t].sum(), with_it[~y, t].sum())
        c, d = y.sum() - a, (~y).sum() - b
        chi2 = (a * d - b * c) ** 2 * 400 / ((a + b) * (c + d) * (a + c) * (b + d)) if (a + b) * (c + d) else 0
        assert np.isclose(model["weights"].weight[t], np.log(501 / (1 + df[t])) * (chi2 + 1) / 400)
    # every other row is indexed under its nearest example
    rows, others = vectors(model, [texts[i] for i in ids]), [i for i in label if i not in set(ids)]
    near = {i: nearest(rows @ v, 8) for i, v in zip(others, vectors(model, [texts[i] for i in others]), strict=True)}
    under = {j: [label[i]] for j, i in enumerate(ids)}
    none = [label[i] for i in ids if texts[i] is None] + [label[i] for i, (at, _) in near.items() if not at]
    for i, (at, _) in near.items():
        if at:
            under[at[0]].append(label[i])
    votes = np.array([np.mean(under[j]) for j in range(size)])
    assert max(map(len, under.values())) > 3 and np.allclose(model["labels"], votes) and np.isclose(model["empty"], np.mean(none))
    # and each is in the calibration, found without its own label
    raw = []
    for j, i in enumerate(ids):
        cos = rows @ rows[j]
        cos[j] = 0
        raw.append((toxicity._vote(*map(np.array, nearest(cos, 8)), votes, model["empty"], model["rate"]), label[i]))
    for i, (at, cos) in near.items():
        own = votes.copy()
        if at:
            own[at[0]] = (sum(under[at[0]]) - label[i]) / (len(under[at[0]]) - 1)
        raw.append((toxicity._vote(np.array(at, int), np.array(cos), own, model["empty"], model["rate"]), label[i]))
    xs = sorted({x for x, _ in raw})
    ys = [[v for x, v in raw if x == at] for at in xs]
    low, value = model["steps"]
    total, n = (np.r_[0, np.cumsum([f(y) for y in ys])] for f in (sum, len))
    off = []
    for i, x in enumerate(xs):  # the isotonic fit by its definition
        means = (total[None, i + 1 :] - total[: i + 1, None]) / (n[None, i + 1 :] - n[: i + 1, None])
        got = value[max(0, np.searchsorted(low, x + 1e-8, "right") - 1)]  # cosines are rounded
        if not np.isclose(got, means.min(1).max()):
            off.append((i, x, got, means.min(1).max(), float(np.abs(low - x).min())))
    assert not off, (len(xs), off)


def test_few_labelled_rows_are_all_examples(spark, told):
    docs = spark.createDataFrame(told, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic")).filter("doc_id < 100")
    one, other = toxicity.fit(docs, labels), toxicity.fit(docs, labels, examples=100)
    assert one["ids"] == other["ids"] and all(np.array_equal(*x) for x in zip(one["steps"], other["steps"], strict=True)) and np.array_equal(one["labels"], other["labels"])


def test_rows_of_ids(spark):
    df = spark.range(-500, 500).selectExpr("id doc_id", "id * 2 twice").union(spark.createDataFrame([(None, 1), (7, 9)], "a long, b long"))
    ids = spark.range(-600, 600, 7).selectExpr("id doc_id", "id % 2 y")
    for n in (1, ids.count(), 100_000):  # however few bits there are
        got = rows_of_ids(df, ids, n, "doc_id").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, df.join(ids, "doc_id").collect())) and len(got) > 140
