"""Fill-in-middle frames, source divergence and the n-gram join against plain versions; nulls, empties, ties, repeats, extra columns."""

import collections
import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import divergence, frames, ngram_join
from tidewheel.llm.common import words_of

SCHEMA = "doc_id long, text string, lang string, source string"
EDGES = [(1, None, "en", None), (2, "", None, "s"), (3, "\n\n", "en", "s"), (4, "no end", "en", "s"), (5, "ü\n" * 70_000, "en", "t"), (6, "x" * 200_000, "en", "t"), (7, "a<S>b\nc\n", "en", "t"), (None, "no id\nat all\n", "de", "s")]


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in ("n", "id", "h", "c", "own", "form", "value", "rank", "term", "version", "a", "b")})


# -- 12 fill-in-middle ------------------------------------------------------------------------------


def plain_middle(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def random_texts(count, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(["\n", "a", "é", "<", "P>", "S", "𝄞 ", "long line ", "\r\n"]) for _ in range(r.choice([0, 1, 2, 9, 40, 300]))) for _ in range(count)]


@pytest.mark.parametrize("size", [1, 2, 7, 64, frames.SIZE])
def test_frames_of_any_size(size):
    for i, t in enumerate(random_texts(150)):
        text = frames.Frames(t, size=size)
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        assert text.units == len(units) and b"".join(text.read()).decode() == t
        for k in range(0, len(units) + 1, max(1, len(units) // 5)):
            before = "".join(units[:k])
            assert text.cut(k) == (len(before.encode()), len(before))
        for mark in frames.MARKS:
            assert text.find(mark) == t.encode().find(mark)
        form, out, a, b = frames.transform_frames(text, i)
        assert (len(units), form, b"".join(out.read()).decode(), a, b) == plain_middle(i, t)
        assert b"".join(frames.restored(form, out)).decode() == t


def test_cut_opens_one_frame(monkeypatch):
    text = frames.Frames("some line\n" * 100_000)
    opened = []
    whole = frames.Frames.frame
    monkeypatch.setattr(frames.Frames, "frame", lambda self, k: opened.append(k) or whole(self, k))
    assert text.cut(77_777) == (777_770, 777_770) and len(opened) == 1 < len(text.frames)


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 0), (0, 50)])
def test_middle_of_documents(spark, rate, spm):
    rows = EDGES + [(i + 10, t, "en", "s") for i, t in enumerate(random_texts(60, 8))] + [EDGES[3]]
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    got = sorted((tuple(r) for r in frames.digests(docs, rate=rate, spm=spm).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, n, form, a, b, sha(out), sha(t or "")) for i, t, *_ in rows for n, form, out, a, b in [plain_middle(i, t, 7, rate, spm)]]
    assert got == sorted(want, key=repr)
    changed = frames.transform(docs, rate=rate, spm=spm)
    assert changed.columns == [*docs.columns, "_form"]
    outs = sorted((repr(r.doc_id), r.text, r._form) for r in changed.collect())
    assert outs == sorted((repr(i), out, form) for i, t, *_ in rows for _, form, out, _, _ in [plain_middle(i, t, 7, rate, spm)])
    back = frames.restore(changed, form_col="_form")
    assert sorted((repr(r.doc_id), r.text) for r in back.collect()) == sorted((repr(i), t or "") for i, t, *_ in rows)


def test_stored_frames(spark):
    kept = {r.doc_id: r for r in frames.store(spark.createDataFrame(EDGES, SCHEMA)).collect()}
    assert kept[5].n == 70_000 and kept[5].chars == [65536, 131072, 140_000] and kept[5].ends[-1] == 210_000 and len(kept[5].frames) == 3
    assert kept[1].n == kept[2].n == 0 and kept[6].n == 1
    assert not frames.digests(spark.createDataFrame([], SCHEMA)).count() and not frames.transform(spark.createDataFrame([], SCHEMA)).count()


# -- 11 divergence ----------------------------------------------------------------------------------


def plain_audit(rows, least_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans({i: i + 32 for i in range(65, 91)})
    count, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = term.findall((text or "").translate(low))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        sources = sorted(s for x, s in groups if x == lang)
        v, n = len(kept), {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 5) // (n[s] + 5 * v) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 5) // (sum(n.values()) + 5 * v) for t in kept}
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            own = [(q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o.decode(), -x, k + 1) for k, (x, o) in enumerate(sorted(pair))}
            out |= {(lang, s, "term", t.decode(), -x, k + 1) for k, (x, t) in enumerate(sorted(own)[:top])}
    return out


@pytest.mark.parametrize(("leaves", "sources", "top"), [(256, 128, 50), (4, 2, 3), (1, 1, 7)])
def test_audit_by_plain_counting(spark, leaves, sources, top):
    r = random.Random(5)
    words = [f"{a}{b}é" if a == "x" else f"{a}{b}" for a in "xyzW" for b in "abcdefgh"] + ["日本"]
    rows = [(i, " ".join(r.choice(words[: r.randint(1, 33)]) + r.choice([",", "7", "_"]) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None]), r.choice("pqrst")) for i in range(150)]
    rows += [(None, None, "fr", None), (3, "", "fr", "q"), (4, "only rare words", "fr", "r"), (5, "single", "it", "one"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("n", "id", "term", "docs", "value", "rank", "v", "leaf", "block")})
    got = [tuple(x) for x in divergence.audit(docs, 6, top, leaves, sources).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 6, top)


def test_audit_of_nothing(spark):
    assert not divergence.audit(spark.createDataFrame([], SCHEMA)).count()


def test_equal_subtrees_are_priced_once():
    counts = np.zeros((3, 1024), np.int64)
    counts[1, 1000:] = 7
    counts[2, 1000:] = 7
    trees = divergence.Trees(counts)
    assert len(trees.values) == 2 and trees.root[1] == trees.root[2] and len(trees.children) == 10
    priced = []
    cost = trees.walk(np.array([0, 1]), np.array([1, 2]), lambda pair, p, q: priced.append(len(p)) or np.abs(p - q))
    assert cost.tolist() == [24 * 7, 0] and priced == [4]  # of 2,048 leaves


def test_prices_beyond_64_bits():
    counts, totals = np.array([10**10, 0, 10**15]), np.array([10**16, 10**16, 10**16])
    assert divergence.exact_prices(counts, totals, 3).tolist() == [1 + 10**9 * (c + 5) // (10**16 + 15) for c in counts.tolist()]


# -- 13 n-gram join ---------------------------------------------------------------------------------


def plain_sets(text, size):
    w = words_of((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain_join(rows, size, similarity):
    sets = [plain_sets(t, size) for _, t in rows]
    ids = {i for i, _ in rows if i is not None}
    to = {i: i for i in ids}

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            common = len(sets[x] & sets[y])
            if common and i is not None and j is not None and common * similarity.denominator >= (len(sets[x]) + len(sets[y]) - common) * similarity.numerator:
                a, b = sorted((root(i), root(j)))
                to[b] = a
    return sorted(((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


def families(seed, similarity, change=1.6):
    """Copies with about as many words changed as a link allows, around shared passages, in sizes from 1 to 400 words."""
    r = random.Random(seed)
    text = lambda n: [f"w{r.randint(0, 4000)}" for _ in range(n)]
    licence, rows = text(60), []
    for k in range(14):
        base = text(r.choice([1, 2, 3, 5, 11, 12, 21, 40, 90, 200, 400]))
        for _ in range(r.choice([1, 2, 5, 25])):
            w = list(base)
            for _ in range(round(len(w) * r.uniform(0, change) * float(1 - similarity) / 3)):
                w[r.randrange(len(w))] = f"new{r.randint(0, 10**6)}"
            if r.random() < 0.3:
                w += text(max(1, round(len(w) * r.uniform(0, 1.3) * float(1 - similarity))))
            rows.append((len(rows) * 3 + 1, " ".join(w + licence if k % 3 == 0 else w)))
    rows += [(900 + i, " ".join(text(r.randint(30, 60)) + licence)) for i in range(25)]
    return rows


@pytest.mark.parametrize(("seed", "size", "similarity"), [(1, 3, Fraction(9, 10)), (3, 5, Fraction(4, 5)), (4, 1, Fraction(1, 2)), (5, 2, Fraction(7, 10))])
def test_join_by_all_pairs(spark, seed, size, similarity):
    rows = families(seed, similarity)
    rows += [rows[0], (rows[4][0], rows[20][1]), (None, rows[2][1]), (None, rows[2][1]), (5000, None), (5001, " \t"), (5002, "Two Words"), (5003, "two\x0bwords"), (5003, "two words"), (5004, "x " * 20_000)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((tuple(r) for r in ngram_join.join(docs, size, similarity).collect()), key=repr)
    want = plain_join(rows, size, similarity)
    assert len({c for *_, c in want}) < len({i for i, *_ in want}) - 10 and got == want


def test_combinations_alone_find_all_links(spark):
    """What is left between components is found without the stars: every linked pair meets under a rare token or two of a class."""
    for seed, similarity in ((7, Fraction(9, 10)), (8, Fraction(4, 5))):
        bounds = ngram_join.Bounds(similarity)
        rows = families(seed, similarity, 0.4)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("version", F.lit(0).cast("long"))
        members = docs.select(F.col("doc_id").alias("id"), "version", F.col("doc_id").alias("c"))
        got = {(r.a, r.b) for r in ngram_join.between_components(members, docs, 3, bounds).collect()}
        sets = {i: plain_sets(t, 3) for i, t in rows}
        linked = [(i, j) for i in sets for j in sets if i < j and sets[i] != sets[j] and len(sets[i] & sets[j]) * similarity.denominator >= len(sets[i] | sets[j]) * similarity.numerator]
        assert len(linked) > 50 and got >= set(linked)


def test_join_of_nothing(spark):
    assert not ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count()
    assert [tuple(r) for r in ngram_join.join(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1)]
