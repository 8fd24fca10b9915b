"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words. Its minimiser is the ``gram`` consecutive words in it with
the least hash; consecutive windows that share one form a run, a super-k-mer. A window that occurs
in two documents has the same minimiser in both, so:

1. Each document is cut into runs: minimiser, a fingerprint of the run's words, place. No text moves.
2. Runs whose minimiser occurs in one document only hold no repeated window and are left out.
3. Of runs with equal words one is the representative. Its words travel as one packed string to the
   bucket of its minimiser, where its windows are sorted; equal neighbours are counted exactly and
   the smallest document is found. Equal windows hold the minimiser at the same place, so a bucket
   is sorted place by place. A minimiser with more than ``hot`` representatives has no bucket: its
   windows are rows, of which the engine finds the smallest document by an aggregate that adds up
   before it shuffles, so no task holds them together.
4. What the buckets found is joined back to all runs, and by document to the texts.

A large group of copies thus becomes one representative each run, and its members only rows of
numbers in joins, which the engine may split.

Defined results: a null text has no words and keeps the empty string; texts shorter than a window
lose nothing; a window repeated within one document stays; rows with a null id lose nothing and
count for no other; rows with an equal id don't count for each other, each row of them is judged on
its own text; empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tokens, durable, mix64, per_batch, words_of

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RUN = "doc_id long, version long, first int, n int, at int, key long, sig long"


class Cutter:
    """Cuts lists of words into runs."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram
        self.powers = self.inverse = np.ones(1, np.uint64)

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """Of a text's words' hashes: each run's first window, number of windows, place of the minimiser in its first window, minimiser and fingerprint."""
        n, width, gram = len(h), self.width, self.gram
        if n < width:
            return None
        if len(self.powers) <= n:
            ones = np.ones(n * 2 + 1, np.uint64)
            self.powers, self.inverse = (np.cumprod(np.r_[ones[:1], ones[1:] * p], dtype=np.uint64) for p in (_P, _P_INV))
        total = np.r_[np.uint64(0), np.cumsum(h * self.powers[:n], dtype=np.uint64)]
        part = lambda s, e: mix64((total[e] - total[s]) * self.inverse[s])
        i = np.arange(n - gram + 1)
        grams = part(i, i + gram)
        place = np.lib.stride_tricks.sliding_window_view(grams, width - gram + 1).argmin(1)
        least = place + np.arange(len(place))
        first = np.r_[0, (least[1:] != least[:-1]).nonzero()[0] + 1]
        count = np.diff(np.r_[first, len(least)])
        sig = part(first, first + count + width - 1) + count.astype(np.uint64)
        return first, count, place[first], grams[least[first]].view(np.int64), sig.view(np.int64)


def runs(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """The runs of all documents (``doc_id, version, text``). No shuffle."""

    def make():
        cut = Cutter(width, gram)

        def f(ids, versions, texts):
            out: list[tuple] = []
            for i, v, h in zip(ids, versions, Tokens(texts, "exact").lists(), strict=True):
                if (found := cut(h)) is not None:
                    k = len(found[0])
                    out.append((np.full(k, i), np.full(k, v), *found))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 7
            return dict(zip(("doc_id", "version", "first", "n", "at", "key", "sig"), columns, strict=True))

        return f

    return per_batch(docs.filter("doc_id is not null"), ["doc_id", "version", "text"], _RUN, make)


def _packed(with_runs: DataFrame, width: int) -> DataFrame:
    """Rows (hot, key, sig, doc_id, base, at, words): a representative, or a window of a hot one."""

    def make():
        def f(ids, texts, lists):
            out = {k: [] for k in ("hot", "key", "sig", "doc_id", "base", "at", "words")}

            def add(*row):
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)

            for i, t, found in zip(ids, texts, lists, strict=True):
                words = words_of(t)
                for r in found:
                    if not r["hot"]:
                        add(False, r["key"], r["sig"], i, 0, r["at"], " ".join(words[r["first"] : r["first"] + r["n"] + width - 1]))
                        continue
                    for j in range(r["n"]):
                        add(True, r["key"], r["sig"], i, j, 0, " ".join(words[r["first"] + j : r["first"] + j + width]))
            return out

        return f

    return per_batch(with_runs, ["doc_id", "text", "runs"], "hot boolean, key long, sig long, doc_id long, base int, at int, words string", make)


def window_minima(rows: list[tuple], width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(key, sig, window, windows, smallest document) for stretches of windows of one bucket's rows."""
    bounds = []
    for row in rows:
        text, at, places = row[6], -1, [0]
        while (at := text.find(" ", at + 1)) >= 0:
            places.append(at + 1)
        bounds.append([*places, len(text) + 1])
    least: list[list[int]] = [[row[3]] * (len(b) - width) for row, b in zip(rows, bounds, strict=True)]
    for place in range(max(row[5] for row in rows) + 1):
        here = []
        for k, row in enumerate(rows):
            j = row[5] - place
            if 0 <= j < len(least[k]):
                here.append((row[6][bounds[k][j] : bounds[k][j + width] - 1], row[3], k, j))
        here.sort()
        for _, same in groupby(here, itemgetter(0)):
            same = list(same)
            for _, _, k, j in same:
                least[k][j] = same[0][1]
    for row, found in zip(rows, least, strict=True):
        at = 0
        for doc, stretch in groupby(found):
            n = len(list(stretch))
            yield row[1], row[2], row[4] + at, n, doc
            at += n


def _bucket_minima(packed: DataFrame, width: int) -> DataFrame:
    """``key, sig, window, n, least``: each representative's windows with the smallest document that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "sig", "window", "n", "least"])
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        for _, same in groupby(rows, itemgetter(1)):
            out += window_minima(list(same), width)
            if len(out) > 50_000:
                yield emit()
                out.clear()
        if out:
            yield emit()

    dealt = packed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, sig long, window int, n int, least long")


def _texts(docs: DataFrame, chosen: DataFrame, run: Column) -> DataFrame:
    """``doc_id, version, text, runs`` of the documents whose runs are representatives; of equal rows one."""
    by_doc = chosen.select("r.doc_id", "r.version", run.alias("run")).groupBy("doc_id", "version").agg(F.collect_list("run").alias("runs"))  # a document's own runs
    return docs.join(by_doc, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"])  # these are together already


def _hot_minima(windows: DataFrame) -> DataFrame:
    """As _bucket_minima() of single windows, by an aggregate over their words and a join that may be split."""
    least = durable(windows.groupBy("words").agg(F.min("doc_id").alias("least")))
    return windows.join(least, "words").select("key", "sig", F.col("base").alias("window"), F.lit(1).alias("n"), "least")


def removed(docs: DataFrame, width: int = 50, gram: int = 8, hot: int = 50_000) -> DataFrame:
    """``doc_id, version, first, n``: stretches of windows that start in a document with a smaller id."""
    found = runs(docs, width, gram)
    # a table of its own, so that the join's other side may be split where a minimiser is frequent
    shared = durable(found.groupBy("key").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).filter("_lo < _hi").select("key"))
    mine = durable(found.join(shared, "key"))
    of = F.struct("doc_id", "version", "first", "n", "at")
    chosen = durable(mine.groupBy("key", "sig").agg(F.min(of).alias("r"), F.max("doc_id").alias("last")))
    many = chosen.groupBy("key").agg(F.count("*").alias("_k")).filter(F.col("_k") > hot).select("key")
    run = F.struct("key", "sig", "r.first", "r.n", "r.at", F.lit(False).alias("hot"))
    minima = _bucket_minima(_packed(_texts(docs, chosen.join(many, "key", "left_anti"), run), width), width)
    if many.limit(1).count():  # only the documents that represent such runs are read again
        minima = minima.unionByName(_hot_minima(_packed(_texts(docs, chosen.join(many, "key", "left_semi"), run.withField("hot", F.lit(True))), width)))
    known = minima.join(chosen.select("key", "sig", "last"), ["key", "sig"]).filter("least < last").drop("last")
    back = mine.select("key", "sig", "doc_id", "version", F.col("first").alias("_f")).join(known, ["key", "sig"]).filter("least < doc_id")
    return back.select("doc_id", "version", (F.col("_f") + F.col("window")).alias("first"), "n")


def dedup(docs: DataFrame, width: int = 50, gram: int = 8, hot: int = 50_000, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed`` and the kept words joined by a space (``kept``), or their digest (``kept_sha256``)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    cut = removed(own, width, gram, hot).groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "n")).alias("cut"))  # equal rows give equal stretches
    last = "kept_sha256" if digest else "kept"

    def make():
        def f(ids, texts, cuts):
            out = {"doc_id": ids, "n_words": [], "n_removed": [], last: []}
            for t, c in zip(texts, cuts, strict=True):
                words = words_of(t)
                out["n_words"].append(len(words))
                if c:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for r in c:
                        edge[r["first"]] += 1
                        edge[r["first"] + r["n"] + width - 1] -= 1
                    stay = (np.cumsum(edge[:-1]) == 0).tolist()
                    n = len(words)
                    words = [w for w, s in zip(words, stay, strict=True) if s]
                    out["n_removed"].append(n - len(words))
                else:
                    out["n_removed"].append(0)
                kept = " ".join(words)
                out[last].append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest() if digest else kept)
            return out

        return f

    joined = own.join(cut, ["doc_id", "version"], "left")
    return per_batch(joined, ["doc_id", "text", "cut"], f"doc_id long, n_words long, n_removed long, {last} string", make)
