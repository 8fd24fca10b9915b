"""Source divergence audit: how the words of each source of a language differ from the others'.

Terms are runs of letters (ASCII ones, A-Z lower-cased, and all other characters from U+0080). A
language keeps the terms of at least ``least_docs`` of its documents. A term's price in a group (a
language and source, or the whole language) is ``1 + floor(10^9 (count + 5) / (N + 5 V))``; N sums the
group's counts of the V kept terms. Two sources differ by the sum of the differences of their prices;
a source's own terms are those whose price is above the language's.

Pairs of sources are compared by hash-consed segment trees. The terms of a language are cut into
blocks of ``leaves`` term ids, the block's terms in order of their counts, so that rare ones lie
together. In a block each source has a tree over the term ids; its leaves are counts, and nodes with
equal children are one node, whichever source they come from: all zeros of a source that lacks most
terms are a few nodes. Two trees are walked at once, level by level; a pair of nodes met again is
walked and priced once, and its price is taken from the memo on the way up. Blocks add up in Spark. A
task holds one block of two groups of ``sources`` sources at most, whatever their number.

All arithmetic is exact: whole numbers beyond 64 bits are Python's or decimals of 38 digits. Within a
task terms are counted by 64-bit hashes; between tasks they go by their characters.

Defined results: null text, language and source are empty strings; a source without terms has counts
of 0 throughout; a language that keeps no term has pairs of value 0 and no term rows; a language with
one source has no pairs; repeated rows count again, rows with equal or null ids are documents each;
empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tokens, durable, if_small, per_task

#: Counted (group, term) pairs that a task holds before it gives them on.
HELD = 2_000_000
BILLION = 10**9


class Counts:
    """Occurrences and documents of terms by group, in arrays: terms are known by 64-bit hashes, each spelt once."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.hashes, self.spelt = np.zeros(0, np.uint64), np.zeros(0, object)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, texts: list[str | None], langs: list[str | None], sources: list[str | None]) -> None:
        group = np.array([self.groups.setdefault((x or "", y or ""), len(self.groups)) for x, y in zip(langs, sources, strict=True)], np.int64)
        tokens = Tokens(texts, "term")
        names, first, term = np.unique(tokens.words(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, names)
        new = np.flatnonzero((at == len(self.hashes)) | (np.r_[self.hashes, np.uint64(0)][at] != names))
        if len(new):
            self.hashes = np.insert(self.hashes, at[new], names[new])
            self.spelt = np.insert(self.spelt, at[new], np.array([tokens.token(k) for k in first[new].tolist()], object))
        text = tokens.text()
        pair, n = np.unique(text * max(1, len(names)) + term, return_counts=True)  # of a document and a term
        text, term = np.divmod(pair, max(1, len(names)))
        self.parts.append(_summed(group[text], names[term], n, np.ones(len(n), np.int64)))
        self.held += len(self.parts[-1][0])
        if self.held > HELD and len(self.parts) > 1:
            self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.held = len(self.parts[0][0])

    def end(self) -> dict:
        """All counts as columns, with a row of the term '' for each group; then it is empty again."""
        group, name, n, docs = _summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True))) if self.parts else (np.zeros(0, np.int64),) * 4
        group = np.r_[np.arange(len(self.groups)), group]
        none = [0] * len(self.groups)
        place = np.r_[none, np.searchsorted(self.hashes, name.astype(np.uint64)) + 1].astype(np.int64)
        of = lambda k: pa.array([g[k] for g in self.groups], pa.string()).take(pa.array(group))
        out = {"lang": of(0), "source": of(1), "term": pa.array(["", *self.spelt], pa.string()).take(pa.array(place)), "n": np.r_[none, n].astype(np.int64), "docs": np.r_[none, docs].astype(np.int64)}
        self.__init__()
        return out


def _summed(group: np.ndarray, name: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """The counts of equal groups and terms added up."""
    order = np.lexsort((name, group))
    group, name = group[order], name[order]
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (name[1:] != name[:-1])]) if len(group) else np.zeros(0, int)
    add = lambda x: np.add.reduceat(x[order], first) if len(first) else x[:0]
    return group[first], name[first], add(n), add(docs)


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, counted. A row with the term '' stands for the group itself."""

    def make():
        counts = Counts()

        def f(texts, langs, sources):
            counts.add(texts, langs, sources)
            return counts.end() if counts.held > HELD else None

        return f, counts.end

    raw = per_task(docs, [text_col, lang_col, source_col], "lang string, source string, term string, n long, docs long", make)
    # one shuffle for both aggregates: rows of a term in a language lie together, so those of its sources do
    return durable(raw.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _price(count: str, total: str) -> str:
    """SQL of a term's price, exact as long as counts have 18 digits."""
    return f"1 + (cast({BILLION} as decimal(10, 0)) * cast({count} + 5 as decimal(20, 0))) div cast({total} + 5 * v as decimal(20, 0))"


def kept_terms(counts: DataFrame, least_docs: int, leaves: int) -> DataFrame:
    """``lang, term, total, block, leaf`` of the terms that each language keeps."""
    terms = durable(counts.filter("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs"))
    blocks = terms.groupBy("lang").agg(F.ceil(F.count("*") / leaves).cast("int").alias("blocks"))
    placed = terms.join(if_small(durable(blocks)), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).drop("blocks")
    own = Window.partitionBy("lang", "block").orderBy("total", "term")  # about ``leaves`` terms
    return durable(placed.withColumn("leaf", (F.row_number().over(own) - 1).cast("int")))


class Trees:
    """Segment trees of some sources over the leaves of a block, equal nodes shared."""

    def __init__(self, counts: np.ndarray):
        width = 1 << max(0, (counts.shape[1] - 1).bit_length())
        leaves = np.zeros((len(counts), width), np.int64)
        leaves[:, : counts.shape[1]] = counts
        #: Counts of the distinct leaves; of each level above them, left and right child of its distinct nodes.
        self.values, node = np.unique(leaves, return_inverse=True)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        node = node.reshape(leaves.shape)
        while node.shape[1] > 1:
            below = int(node.max()) + 1
            nodes, node = np.unique(node[:, ::2] * below + node[:, 1::2], return_inverse=True)
            node = node.reshape(len(leaves), -1)
            self.children.append((nodes // below, nodes % below))
        self.root = node[:, 0]

    def walk(self, a: np.ndarray, b: np.ndarray, price) -> np.ndarray:
        """The prices of pairs of sources a, b (places), where ``price(pair, left count, right count)`` prices leaves.

        Down: the distinct pairs of nodes of each level, each with its pair of sources, as prices differ
        between those. Up: a pair's price is the sum of its children's, read from the level below.
        """
        pair, left, right, memo = np.arange(len(a)), self.root[a], self.root[b], []
        for low, high in reversed(self.children):
            half = np.r_[low[left], high[left]], np.r_[low[right], high[right]]
            span = int(max(half[0].max(initial=0), half[1].max(initial=0))) + 1
            met, place = np.unique((np.r_[pair, pair] * span + half[0]) * span + half[1], return_inverse=True)
            memo.append(place.reshape(2, -1))
            pair, left, right = met // (span * span), met // span % span, met % span
        cost = price(pair, self.values[left], self.values[right])
        for place in reversed(memo):
            cost = cost[place[0]] + cost[place[1]]
        return cost


def exact_prices(counts: np.ndarray, totals: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 v)), in Python's numbers where 64 bits might not do."""
    if counts.max(initial=0) < 9 * 10**9 - 5 and totals.max(initial=0) < 2**62 - 5 * v:
        return 1 + BILLION * (counts + 5) // (totals + 5 * v)
    return 1 + BILLION * (counts.astype(object) + 5) // (totals.astype(object) + 5 * v)


#: Pairs of sources times leaves that are walked at once.
AT_ONCE = 1 << 20


def compared(block: pa.Table) -> Iterator[tuple[int, int, int]]:
    """(source a, source b, price of their difference) of one block and two groups of sources."""
    column = {c: block.column(c).to_numpy() for c in ("side", "id", "leaf", "n", "total", "v", "width")}
    heads = column["leaf"] < 0
    ids, first = np.unique(column["id"][heads], return_index=True)
    totals, side = column["total"][heads][first], column["side"][heads][first]
    v = int(column["v"][heads][0])
    width = int(column["width"][heads][0])
    counts = np.zeros((len(ids), max(1, width)), np.int64)
    counts[np.searchsorted(ids, column["id"][~heads]), column["leaf"][~heads]] = column["n"][~heads]
    trees = Trees(counts)
    unreal = (1 << len(trees.children)) - width  # leaves that no term has, of count 0 in all trees
    a, b = np.triu_indices(len(ids), 1) if not side.any() else (x.ravel() for x in np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij"))
    step = AT_ONCE // max(1, width) + 1
    for i in range(0, len(a) if v else 0, step):
        x, y = a[i : i + step], b[i : i + step]
        gap = lambda pair, p, q, x=x, y=y: np.abs(exact_prices(p, totals[x[pair]], v) - exact_prices(q, totals[y[pair]], v))
        none = np.zeros(len(x), np.int64)
        value = trees.walk(x, y, gap) - unreal * gap(np.arange(len(x)), none, none)
        yield from zip(ids[x].tolist(), ids[y].tolist(), value.tolist(), strict=True)
    if not v:  # no kept term, no difference
        yield from ((int(ids[x]), int(ids[y]), 0) for x, y in zip(a, b, strict=True))


def pair_values(kept: DataFrame, groups: DataFrame, blocks: DataFrame, sources: int) -> DataFrame:
    """``lang, a, b, value``: the sums of the differences of the sources' prices, by their ids.

    ``kept`` has ``lang, id, block, leaf, n``, ``groups`` has ``lang, id, total, v``, ``blocks`` has ``lang, block``
    and the number of the block's terms, ``width``. A row of each source and block, with the leaf -1,
    carries these, for a source may have no term there and still a price for each.
    """
    zero = F.lit(0).cast("long")
    heads = groups.select("lang", "id", "total", "v").join(if_small(durable(blocks)), "lang", "left").na.fill(0, ["block", "width"]).withColumns({"leaf": F.lit(-1), "n": zero})
    rows = heads.unionByName(kept.select("lang", "id", "block", "leaf", "n", zero.alias("total"), zero.alias("v"), zero.alias("width")))
    mine = F.floor(F.col("id") / sources).cast("int")
    chunks = groups.groupBy("lang").agg((F.floor(F.max("id") / sources) + 1).cast("int").alias("chunks"))
    met = rows.join(if_small(durable(chunks)), "lang")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    dealt = met.withColumn("mine", mine).select("*", other).select(
        "lang", "block", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "id", "leaf", "n", "total", "v", "width"
    )
    schema = "lang string, a long, b long, value long"

    def run(block: pa.Table) -> pa.Table:
        found = list(compared(block))
        a, b, value = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"lang": pa.array([block.column("lang")[0].as_py()] * len(found), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pa.array(value, pa.int64())})

    return dealt.groupBy("lang", "block", "low", "high").applyInArrow(run, schema).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, leaves: int = 256, sources: int = 128, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: of each source the other sources, and its ``top`` own terms."""
    counts = counted(docs, text_col, lang_col, source_col)
    terms = kept_terms(counts, least_docs, leaves)
    kept = durable(counts.drop("docs").join(terms, ["lang", "term"]))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")  # a row for each source of a language
    groups = durable(counts.filter("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v", "lang_total"]).withColumn("id", number))

    named = if_small(groups.select("lang", "source", "id"))
    of_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = kept.withColumnRenamed("total", "everywhere").join(if_small(groups.select("lang", "source", "id", "total", "v", "lang_total")), ["lang", "source"])
    blocks = terms.groupBy("lang", "block").agg(F.count("*").alias("width"))
    values = pair_values(ranked.select("lang", "id", "block", "leaf", "n"), groups, blocks, sources)
    both = values.select("lang", "a", "b", "value").union(values.select("lang", "b", "a", "value"))
    pairs = both.join(named.toDF("lang", "source", "a"), ["lang", "a"]).join(named.toDF("lang", "item", "b"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    priced = ranked.withColumn("p", F.expr(_price("n", "total"))).withColumn("q", F.expr(_price("everywhere", "lang_total"))).filter("p > q and n > 0")
    own = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(of_group).alias("rank")
    return pairs.select("*", rank).unionByName(own.select("*", rank).filter(F.col("rank") <= top))
