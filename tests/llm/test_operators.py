"""Document operators against brute force, round trips and held-out rows; nulls, empties, ties, repeats, extra columns."""

import collections
import hashlib
import json
import math
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import bpe, brown, decontaminate, language, neardup, pii, quality, secrets, substrings, toxicity
from tidewheel.llm.common import HashTable, Tokens, crc_mod, lower_az, words_of
from tidewheel.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(1000, None, "en", None, 0), (1001, "", None, "s", 0), (1002, " \n\t ", "en", "s", 4), (1003, "one", "en", "s", 3), (1004, "x " * 30_000, None, "s", 60_000), (1005, "= " * 7, "en", "s", 14), (None, "no id at all " * 9, "de", "s", 1)]


def rows_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def edges(spark):
    """Odd rows, a repeated row, and columns whose names clash with the operators' own."""
    d = spark.createDataFrame([*EDGES, EDGES[5], EDGES[3]], SCHEMA)
    return d.withColumns({c: F.lit(1) for c in ("n", "key", "id", "score", "kept", "version", "component", "word")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 1 BPE ------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, sf):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    e, lib = bpe.TrieEncoder(path), Tokenizer.from_file(path)
    r = random.Random(4)
    pools = [range(32, 127), range(0, 0x300), range(0x370, 0x400), range(0x4E00, 0x4F00), range(0x1F300, 0x1F650)]
    texts = ["", "Don't we'll 'sfoo ''s", "ΑΣ Σ İ", "a<|endoftext|>b <|startoftext|>", "=" * 3000, "a" * 500, "\x1c\x85\xa0 x"]
    texts += ["".join(chr(r.choice(r.choice(pools))) for _ in range(50)) for _ in range(150)]
    texts += [t for _, t in rows_of(spark, sf)[:100]]
    for t, (n, ids, decoded) in zip(texts, e.encode_batch(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want) and decoded == lib.decode(want, skip_special_tokens=False)
    assert e.decode(e.encode("Hello there")) == "hello</w> there</w>"


def test_bpe_text_of_many_words():
    e = bpe.TrieEncoder(bpe.default_path())
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    many = " ".join([letters(i) for i in range(100_000)])
    assert [n for n, _, _ in e.encode_batch(["aaaa"])] and len(set(many.split())) == 100_000
    _, ids, _ = e.encode_batch([many])[0]
    assert ids.split()[: len(e.encode("aaaa baaa"))] == [str(i) for i in bpe.TrieEncoder(bpe.default_path()).encode("aaaa baaa")]
    assert e.encode_batch([many])[0][1] == ids and len(e._known) <= bpe._REMEMBERED


def test_bpe_bytes_without_tokens(tmp_path):
    from tokenizers import Tokenizer

    with open(bpe.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    for token in ("q", "q</w>"):  # what needs them goes too
        del spec["model"]["vocab"][token]
    merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    keep = [m for m in merges if "q" not in m]
    gone = {m.replace(" ", "") for m in merges} - {m.replace(" ", "") for m in keep}
    spec["model"]["merges"] = keep
    spec["model"]["vocab"] = {t: i for t, i in spec["model"]["vocab"].items() if t not in gone}
    path = tmp_path / "few.json"
    path.write_text(json.dumps(spec))
    lib, own = Tokenizer.from_file(str(path)), bpe.TrieEncoder(str(path))
    for text in ("quick brown", "q", "aqa qq", "iraq is"):
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids, text


def test_bpe_edges(edges, empty):
    got = bpe.digests(edges)
    assert got.count() == edges.count() and bpe.digests(empty).count() == 0
    none = got.filter("doc_id = 1000").first()
    assert none.n_tokens == 0 and none.ids_sha256 == hashlib.sha256(b"").hexdigest() == none.decoded_sha256


# -- 2 quality --------------------------------------------------------------------------------------


def slow_measure(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_measures(spark, sf, edges, empty):
    got = {r.doc_id: tuple(r)[1:6] for r in quality.features(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == {i: slow_measure(t) for i, t in rows_of(spark, sf)}
    labels = spark.createDataFrame([(1003, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(edges, labels)
    assert out.count() == edges.count() and not out.filter("base_failed and kept").count()
    assert quality.judge(empty, labels).count() == 0


def test_binomial_and_cutoffs(spark):
    assert math.isclose(quality.binomial_at_most(2, 10, 0.3), sum(math.comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(3)))
    clean = [("en", 500, 2000, 0, 0, 0)] * 997 + [("en", 500, 2000, 900, 0, 0)] * 3 + [("de", 500, 2000, 0, 0, 0)] * 20
    good = spark.createDataFrame(clean, "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    chosen = quality.cutoffs(good, "lang")
    assert {s for s, _, _ in chosen} == {("en",)}  # twenty rows certify nothing
    assert dict((r, c) for _, r, c in chosen)["symbols"] < 0.45  # three of a thousand may be lost


def test_small_strata_are_pooled(spark):
    rows = [(lang, 500, 2000, 0, 0, 0) for lang in ("en", "de", None) for _ in range(150)]
    good = spark.createDataFrame(rows, "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    chosen = quality.cutoffs(good, "lang")
    assert {frozenset(s) for s, _, _ in chosen} == {frozenset(["en", "de", None])} and len(chosen) == len(quality.RULES)
    odd = spark.createDataFrame([(lang, 500, 2000, 1900, 0, 0, False) for lang in ("en", None, "fr")], "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    assert {r.lang: r.kept for r in quality.apply(odd, chosen, "lang").collect()} == {"en": False, None: False, "fr": True}


# -- 3 substrings -------------------------------------------------------------------------------------


def slow_removed(docs, width):
    first, out = {}, {}
    for i, t in sorted(docs):
        w = words_of(t)
        hit = [False] * len(w)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            if first.setdefault(g, i) < i:
                hit[k : k + width] = [True] * width
        out[i] = (len(w), sum(hit), " ".join(x for x, h in zip(w, hit, strict=True) if not h))
    return out


@pytest.mark.parametrize("hot", [50_000, 2])
def test_substrings_by_brute_force(spark, hot):
    r = random.Random(hot)
    passage = [r.choice("abcdefgh") for _ in range(40)]
    docs = []
    for i in range(60):
        own = [r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 50))]
        at = r.randint(0, len(own))
        docs.append((i, " ".join(own[:at] + (passage[r.randint(0, 10) :] if i % 2 else []) + own[at:])))
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string"), 6, 3, hot).collect()}
    assert got == slow_removed(docs, 6)


def test_substrings_edges(spark, edges, empty):
    got = substrings.dedup(edges, 5, 2)
    assert got.count() == edges.count() and not got.filter("doc_id is not null and doc_id < 1004 and n_removed > 0").count()
    assert substrings.dedup(empty).count() == 0
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "z a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.dedup(same, 5, 2).collect()) == [(1, 0), (1, 0), (2, 5)]


# -- 4 language model ---------------------------------------------------------------------------------


def test_brown_scores(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    model = brown.fit(docs.filter("not held_out"), 12, 64, 2000)
    got = {r.doc_id: r for r in brown.learn_and_score(docs, classes=12, top=64, head=2000).collect()}
    rows, counts = rows_of(spark, sf), collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words_of(lower_az(t)), " "])
    n, v, held = sum(counts.values()), len(counts), [0.0, 0.0]
    for i, t in rows:
        w = [*words_of(lower_az(t)), " "]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        g = got[i]
        assert math.isclose(base, g.base_score, rel_tol=1e-9) and (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(x in counts for x in w), n)
        if crc_mod(i, 7) == 2:
            held = [held[0] + base, held[1] + g.score]
    assert held[1] > held[0]
    total = collections.Counter()  # after any token all words and the unknown one sum to one
    for w, c in counts.items():
        if w != " ":
            k = model["class"][model["items"]([w])[3][1]]
            total[k] += (c - model["give"][k]) / (model["per"][k] + 1)
    for k in total:
        assert math.isclose(total[k] + (10 ** model["unknown"][k] if model["give"][k] else 1 / (model["per"][k] + 1)), 1, rel_tol=1e-9)
    assert np.allclose((10 ** model["step"]).sum(1), 1)


def test_brown_head_changes_no_score(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    one, other = ({r.doc_id: r for r in brown.learn_and_score(docs, classes=12, top=64, head=h).collect()} for h in (5000, 64))
    assert all(math.isclose(r.score, other[i].score, rel_tol=1e-9) and math.isclose(r.base_score, other[i].base_score, rel_tol=1e-9) and r.n_known == other[i].n_known for i, r in one.items())


def test_brown_edges(edges, empty):
    at = edges.withColumn("held_out", F.col("doc_id") == 1003)
    got = brown.learn_and_score(at, classes=4, top=8, head=20)
    assert got.count() == edges.count() and got.filter("doc_id = 1000").first().n_tokens == 1
    none = brown.learn_and_score(edges.withColumn("held_out", F.lit(True)), classes=4, top=8, head=20)
    assert none.count() == edges.count() and none.filter("score != 0 or train_tokens != 0").count() == 0
    assert brown.learn_and_score(empty.withColumn("held_out", F.lit(False)), classes=4, top=8, head=20).count() == 0


# -- 5 near-duplicates --------------------------------------------------------------------------------


def slow_components(docs, size, num, den):
    sets = {}
    for i, t in docs:
        w = words_of(lower_az(t or ""))
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = [i for i in sets if sets[i]]
    for x, a in enumerate(ids):
        for b in ids[:x]:
            n = len(sets[a] & sets[b])
            if n * den >= num * (len(sets[a]) + len(sets[b]) - n):
                a_, b_ = find(a), find(b)
                up[max(a_, b_)] = min(a_, b_)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("small", [100_000, 0])
def test_neardup_by_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL", small)  # 0: nothing is broadcast
    r = random.Random(2)
    base = [f"w{r.randint(0, 400)}" for _ in range(70)]
    docs = []
    for i in range(120):  # a continuum of copies around the threshold, copies of copies, and others
        w = list(base) if i % 3 else [f"u{r.randint(0, 4000)}" for _ in range(60)]
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = f"v{r.randint(0, 4000)}"
        docs.append((i, " ".join(w)))
        if i % 10 == 0:
            docs.append((1000 + i, docs[-1][1].upper()))
    docs += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A B"), (2004, "a"), (2005, "a")]
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.cluster(spark.createDataFrame(docs, "doc_id long, text string"), 3, Fraction(85, 100)).collect()}
    assert got == slow_components(docs, 3, 85, 100)


def test_neardup_edges(spark, edges, empty):
    got = neardup.cluster(edges)
    assert got.count() == edges.count() and got.filter("doc_id is null and not kept").count() == 0
    assert neardup.cluster(empty).count() == 0
    left = neardup.survivors(edges)
    assert left.columns == edges.columns and left.filter("doc_id = 1005").count() == 1
    assert neardup.least_matches(Fraction(85, 100), 64) == max(t for t in range(1, 65) if quality.binomial_at_most(t - 1, 64, 0.85) <= 1e-5)


# -- 6 secrets ----------------------------------------------------------------------------------------


def slow_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secret_base_spans(spark, sf):
    for t in [t for _, t in rows_of(spark, sf)] + ['TOKEN="abcdefgh" ApiKey: x api_key = longenough1 AKIAABCDEFGHIJKL12 ' + "0f" * 20, "pſssword=abcdefghi ſecret=abcdefghij"]:
        assert [s for s in secrets.spans(t) if s[1] < 3] == slow_spans(t)


def test_secret_lexing():
    of = lambda t: [t[s:e] for s, k, e in secrets.spans(t) if k == 3]
    assert of("k = 'Zx9#kQ2!vB7mP4wT'\ndb_pwd = k\n") == ["Zx9#kQ2!vB7mP4wT"]
    assert of("<credential>aB3dE6gH9jK2mN5p</credential>") == ["aB3dE6gH9jK2mN5p"]
    assert of("colour = 'Zx9#kQ2!vB7mP4wT'") == [] and of("password = 'hello'") == []


S = "aB3dE6gH9jK2mN5pQ8"


@pytest.mark.parametrize(("text", "want"), [
    (f'cfg["db_pwd"] = "{S}"', [S]), (f"db_pwd: |\n  {S}\n  {S}\nother: 1", [f"{S}\n  {S}"]), (f'pwd = """{S}"""', [S]), (f'pwd = "it\'s{S}"', [f"it's{S}"]), (f"pwd: str = '{S}'", [S]),
    ("k = 'Zx9#kQ2!'; pwd = k + 'vB7mP4wT'", ["Zx9#kQ2!", "vB7mP4wT"]), (f"pwd = k\nk = '{S}'", [S]), ("pwd = 'Zx9#kQ2!' 'vB7mP4wT'", ["Zx9#kQ2!", "vB7mP4wT"]), (f"don't set pwd={S} it's", [S]),
    (f"--db-pwd {S} x", [S]), (f"'pwd' => '{S}',", [S]), (f"x = f'{S}'\ny = x\nz = y\npwd = z", [S]), ("a" * 100 + f"_pwd = '{S}'", [S]), ("pwd = '" + S * 6000 + "'", [S * 6000]),
    ("pwd = os.getenv('FOO_BAR_123')", []), (f"if pwd == '{S}':", []), ("a = b\nb = a\npwd = a", []), ("author: John Smith, 1999", []), ("The key: a summary of what matters", []), ("a = b + b\n" * 500 + "pwd = a", []),
])
def test_secret_syntax(text, want):
    assert [text[s:e] for s, k, e in secrets.spans(text) if k == 3] == want


@pytest.mark.parametrize("text", [
    'author: "Jane Elizabeth Smith, 1999"', 'tokenizer: "word_bpe_49k.json"', 'secretary = "Ms. Anna Brown-Smith"', 'salty_food: "Chips 250g, Peanuts"', 'authority: "Department of Health 2020"',
    'monkey_house = "Vonnegut-1968, first"', 'turkey: "Ankara, Izmir 35000"', 'basalt = "Rock type IIb, dark"', 'keyboard_layout: "de-latin1-nodeadkeys"', 'passenger_list = "Row 12A, Row 14C"', 'hotkeys: "Ctrl+Alt+F7, Meta"',
    'compass: "NNE 22.5 degrees"', 'authored_by = "R. Miller, 2019-04"', 'tokenization: "Sentence-level v2"', 'secretion_rate = "0.5 ml/h at 37C"', 'donkey = "Equus asinus 1758"',
])
def test_ordinary_names_are_no_alarm(text):
    assert secrets.spans(text) == []


@pytest.mark.parametrize(("name", "least"), [("clientSecret_2", 1), ("DB_PASSWORDS", 1), ("userpasswd", 1), ("authToken", 0.9), ("x-api-key", 0.9), ("APIKey", 0.9), ("privateKeyPem", 1), ("aws.accessKey", 1), ("accessibility", 0), ("monkey", 0), ("tokenize", 0), ("secretariat", 0)])
def test_names_by_whole_words(name, least):
    assert secrets.name_score(name) == least


def test_long_chains_and_nested_blocks_take_linear_time():
    """Values put together over many lines, and blocks in blocks: no place is copied along a chain, no line is read once a level."""
    took = {}
    for n in (5_000, 40_000):
        chain = "token = 'aB3'\n" + "".join(f"token = token + '{i:05x}Kz9#'\n" for i in range(n))
        nested = "".join(" " * (i % 900) + f"name{i}: |\n" for i in range(n))
        began = time.perf_counter()
        assert len(secrets.lexed_spans(chain, 0.5)) == n + 1
        assert secrets.lexed_spans(nested + "pwd: ''", 0.5) == []
        took[n] = time.perf_counter() - began
    assert took[40_000] < 30 * took[5_000] + 1  # eight times the lines
    blocks = "a: |\n  b: |\n    c\n\n   d\n  e\nf: 1"
    assert [x for _, parts in secrets.assignments(blocks) for x in parts][0][1] == (7, len(blocks) - 5)
    deep = "".join(" " * i + f"pwd{i}: |\n" for i in range(700)) + " " * 700 + S
    assert len(secrets.lexed_spans(deep, 0.5)) == 1


def test_no_false_alarms_in_plain_texts(spark, sf):
    base = {i: len(secrets.base_spans(t or "")) for i, t in rows_of(spark, sf)}
    more = {i: len(secrets.spans(t)) - base[i] for i, t in rows_of(spark, sf)}
    assert sum(more.values()) <= 0.02 * len(more)


def test_long_secrets_masked_whole(spark):
    r = random.Random(4)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1700))
    forms = [f'{{"private_key": "{key}"}}', f"PRIVATE_KEY={key}\n", f"run --private-key {key} now", f"<credential>{key}</credential>"]
    d = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    got = [x.text for x in secrets.redact(d).orderBy("doc_id").collect()]
    assert got == [f.replace(key, "[SECRET]") for f in forms]


def test_secrets_masked(spark, edges, empty):
    d = spark.createDataFrame([(1, 'a token = "abcdef0123456789" b ' + "0f" * 20), (2, None)], "doc_id long, text string")
    masked = {r.doc_id: r.text for r in secrets.redact(d).collect()}
    assert masked == {1: 'a token = "[SECRET]" b [SECRET]', 2: None}
    assert secrets.redact(edges).columns == edges.columns and secrets.scan(empty).count() == 0
    assert secrets.scan(edges).filter("doc_id = 1000").first().spans == ""


# -- 7 toxicity ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("dense", [0.05, 0.2, 2.0])
def test_nearest_is_exact(dense):
    r = np.random.default_rng(5)
    rows = []
    for _ in range(500):
        t = np.sort(r.choice(40, r.integers(1, 6), replace=False))
        w = r.random(len(t))
        rows.append(dict(zip(t.tolist(), (w / np.linalg.norm(w)).astype(np.float32).astype(float).tolist(), strict=True)))
    flat = lambda rows: (np.cumsum([0, *map(len, rows)]), np.array([t for x in rows for t in x], np.int64), np.array([w for x in rows for w in x.values()]))
    bound, term, weight = flat(rows)
    index = toxicity.BlockMaxIndex(np.repeat(np.arange(500), np.diff(bound)), term, weight, 500, 40, kin=np.array([min(x) for x in rows]), dense=dense)
    queries = [*rows[:60], {}]
    for own in (None, np.arange(61)):
        for i, (q, (got, cos)) in enumerate(zip(queries, index.nearest(*flat(queries), 10, own, 7), strict=True)):
            want = sorted(((-round(sum(q[t] * x[t] for t in q if t in x), 9), j) for j, x in enumerate(rows) if own is None or j != i), key=lambda v: v)[:10]
            assert [j for v, j in want if v < 0] == got.tolist() and np.allclose([-v for v, _ in want if v < 0], cos, atol=1e-8)


def test_hashed_tokens(spark, sf):
    texts = [t for _, t in rows_of(spark, sf)[:150]] + [None, "", "İstanbul ΟΔΟΣ x_y²³ 中文字 \ud800 a", "b" * 3000]
    tokens, seen = Tokens(texts), {}
    words = [w for t in texts for w in re.findall(r"[^\W_]+", (t or "").lower())]
    assert len(tokens.start) == len(words) and np.diff(tokens.bound).tolist() == [len(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
    hashes = tokens.words()
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) and np.array_equal(Tokens(texts[70:]).words(), hashes[tokens.bound[70] :])
    at, first = tokens.beginnings(5)
    assert at.tolist() == [i for i, w in enumerate(words) if len(w) > 5] and len(set(first.tolist())) == len({w[:5] for w in words if len(w) > 5}) and not set(first.tolist()) & set(hashes.tolist())
    table = HashTable(np.unique(hashes))
    assert np.array_equal(table(np.unique(hashes)), np.arange(len(seen))) and (table(first) == -1).all() and HashTable(hashes[:0])(hashes).max() == -1


def test_toxicity_learns(spark, edges, empty):
    r = random.Random(9)
    word = lambda: f"w{r.randint(0, 300)}"
    docs = [(i, " ".join([word() for _ in range(30)] + (["stupid", "trash"] if i % 8 == 0 else []))) for i in range(600)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i, _ in docs if i < 400], "doc_id long, toxic int")
    model = toxicity.fit(d, labels)
    got = {x.doc_id: x for x in toxicity.predict(d, model).collect()}
    assert all(got[i].predicted == int(i % 8 == 0) for i, _ in docs) and len(got[0].evidence) == 3
    assert toxicity.reject(d, model).count() == 525
    assert toxicity.predict(edges, model).count() == edges.count() and toxicity.reject(edges, model).columns == edges.columns
    nothing = toxicity.fit(d, labels.limit(0))
    assert nothing is None and toxicity.predict(d, nothing).filter("score != 0").count() == 0 and toxicity.predict(empty, model).count() == 0


def test_toxicity_of_many_toxic_labels(spark):
    r = random.Random(3)
    bad = ["stupid", "trash", "scum", "moron"]
    text = lambda i: " ".join([f"w{r.randint(0, 300)}" for _ in range(30)] + (r.sample(bad, 2) if i % 20 < 9 else []))
    d = spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([(i, int(i % 20 < 9)) for i in range(400)], "doc_id long, toxic int"))
    got = {x.doc_id: x.predicted for x in toxicity.predict(d, model).collect()}
    assert [got[i] for i in range(600)] == [int(i % 20 < 9) for i in range(600)]
    # the length is that of the whole text: words that no example has count too
    score = toxicity.Scorer(model)
    short, long = score(["stupid trash", "stupid " + " ".join(f"strange{i}" for i in range(20_000))])
    assert short[0] > long[0]


def test_isotonic():
    low, value = toxicity.isotonic(np.array([1, 2, 3, 4.0]), np.array([0, 1, 0, 1.0]))
    assert value.tolist() == [0, 0.5, 1]


# -- 8 decontamination --------------------------------------------------------------------------------


def lcs_slow(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_bits():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randint(1, 25))] for _ in range(2))
        assert round(decontaminate.Item(0, " ".join(map(str, a)), a).lcs(b)[0] * len(a)) == lcs_slow(a, b)


def exact_hits(docs, items):
    """(document, item) pairs whose longest common subsequence in some stretch confirms them: all pairs are compared."""
    terms = decontaminate.Terms([t for _, t in items])
    every = [decontaminate.Item(i, t, w.tolist()) for (i, t), w in zip(items, terms.items, strict=True)]
    confirmed = lambda share, told: share >= 0.7 or share >= 0.5 and told >= 0.8
    out = set()
    for i, t in docs:
        words, _ = terms([t])
        out |= {(i, x.id) for x in every if len(set(words.tolist()) & set(x.words)) * 2 >= len(set(x.words)) and confirmed(*x.best(words, 0, len(words)))}
    return out


def test_decontamination(spark, edges, empty):
    r = random.Random(6)
    word = lambda: f"t{min(r.randint(0, 3000), r.randint(0, 3000))}"
    items = [(i, " ".join(word() for _ in range(r.randint(15, 50))) + ".") for i in range(30)]
    docs, want = [], set()
    for i in range(300):
        w = [word() for _ in range(r.randint(20, 200))]
        if i % 5 == 0:
            item = r.choice(items)
            part = item[1].rstrip(".").split()
            if i % 10 == 0:  # a paraphrase: every ninth word differs
                part = [word() if j % 9 == 4 else x for j, x in enumerate(part)]
            at = r.randint(0, len(w))
            w[at:at] = part
            want.add((i, item[0]))
        docs.append((i, " ".join(w)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.hits(d, b).collect()} == want
    assert decontaminate.clean(d, b).count() == 300 - len({i for i, _ in want})
    assert {(x.doc_id, x.item_id) for x in decontaminate.hits(d, b, block=10).collect()} == want
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "w1")], "item_id long, text string")
    assert decontaminate.hits(edges, odd).count() == 0 and decontaminate.hits(empty, b).count() == 0 and decontaminate.hits(d, odd.limit(0)).count() == 0
    assert decontaminate.clean(edges, b).columns == edges.columns


def test_decontamination_of_long_items(spark):
    r = random.Random(21)
    text = lambda n: " ".join(f"v{int(r.paretovariate(0.7))}" if r.random() < 0.4 else f"u{r.randint(0, 4000)}" for _ in range(n))
    items = {n: text(n) for n in (40, 100, 200, 500, 1000)}
    most = lambda t: " ".join(w for i, w in enumerate(t.split()) if i % 5 < 4)
    docs = [(i, text(300)) for i in range(40)]
    docs += [(100 + n, f"{text(130)} {t} {text(90)}") for n, t in items.items()] + [(5000 + n, f"{text(70)} {most(t)} {text(300)}") for n, t in items.items()]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.hits(d, b).collect()}
    assert got == {(k + n, n) for n in items for k in (100, 5000)}
    assert decontaminate.clean(d, b).count() == 40


def test_decontamination_recall_with_more_items_than_rank(spark):
    r = random.Random(22)
    text = lambda n: [f"u{r.randint(0, 2500)}" for _ in range(n)]
    items = [(i, text(r.randint(20, 60))) for i in range(320)]
    docs = []
    for i in range(60):
        held = [w for w in items[5 * i][1] if r.random() < 0.8]
        docs.append((i, " ".join(text(60) + held + text(r.randint(10, 80)))))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    exact = exact_hits(docs, [(i, " ".join(t)) for i, t in items])
    got = {(x.doc_id, x.item_id) for x in decontaminate.hits(d, b).collect()}
    print(f"recall {len(got & exact) / len(exact):.3f} of {len(exact)}")
    assert len(exact) > 40 and len(got & exact) >= 0.95 * len(exact)


def test_confirmation_wherever_the_passage_lies():
    """The share of the best stretch is the same at every offset, and that of comparing every stretch."""
    r = random.Random(12)
    item = decontaminate.Item(0, "x", [r.randint(0, 60) for _ in range(40)])
    part = [w if r.random() < 0.75 else -1 for w in item.words]
    around = [r.randint(0, 400) if r.random() < 0.3 else -1 for _ in range(200)]
    seen = set()
    for shift in range(60):
        words = np.array(around[:shift] + part + around[shift:])
        seen.add(item.best(words, 48, 96))
        size = 51
        every = [item.lcs(words[a : a + size].tolist()) for a in range(max(0, 48 - size + 1), 96)]
        rule = decontaminate.Rule()
        assert max((rule(*x), *x) for x in every)[1:] == item.best(words, 48, 96) or max(x[0] for x in every) < 0.5
    assert max(seen)[0] >= 0.7
    for shift in range(30):  # inside the passage wherever it begins: one verdict
        words = np.array([-1] * (60 + shift) + part + [-1] * 100)
        assert item.best(words, 48, 96) == item.best(np.array([-1] * 60 + part + [-1] * 100), 48, 96)


def test_passages_of_a_long_text_in_slices(monkeypatch):
    r = random.Random(2)
    ids = np.array([r.randint(-1, 30) for _ in range(5000)])
    rows = np.random.default_rng(1).normal(size=(31, 4)).astype(np.float32)
    known = np.flatnonzero(ids >= 0)
    got = decontaminate._sums(known // 16, rows, ids[known], 313)
    assert np.allclose(got, [rows[[w for w in ids[i * 16 : i * 16 + 16] if w >= 0]].sum(0) for i in range(313)], atol=1e-4)


# -- 9 PII --------------------------------------------------------------------------------------------


def test_long_texts_of_one_kind(spark):
    """No pattern takes a stack as deep as its text: dotted names, digits, marks, a megabyte each."""
    texts = ["x@" + "a." * 2000 + "com", "x@" + "a." * 500_000, "1" * 1_000_000, "@" * 1_000_000, "." * 1_000_000, "x@y" * 300_000, "1-" * 500_000, "a@" + "b-" * 500_000, "12 " * 300_000, "GB" * 500_000, "a@b." * 250_000]
    texts += ["a@" + "b." * 100 + "com and a@b.c1.example x@y..com"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    assert got[0] == texts[0] and got[1:5] == texts[1:5] and len(got) == len(texts) and got[-1] != texts[-1] and got[-1].endswith("x@y..com")


def test_pseudonyms(spark, edges, empty):
    text = "a the.72@mail3.example.com card 4785380592391139 4785-3805-9239-1139 ip 169.122.221.182. tel +1 (499) 555-6503% 123-45-6789 on 2021-02-28 not 2021-02-31 GB82WEST12345698765432 4785380592391138 999.1.1.1"
    d = spark.createDataFrame([(1, text), (2, "4785380592391139")], "doc_id long, text string")
    out = pii.pseudonymise(d, "k")
    got = {r.doc_id: r for r in out.collect()}
    t = got[1].text
    assert "169.122" not in t and "4785380592391139" not in t and "2021-02-31" in t and "4785380592391138" in t and "999.1.1.1" in t and "@mail3.example.com" in t
    cards = re.findall(r"\b\d{16}\b", t)
    assert got[2].text == cards[0] and re.search(r"(\d{4}-){3}\d{4}", t)[0].replace("-", "") == cards[0]  # linked, whatever the form
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(cards[0])))) % 10 == 0
    back = pii.pseudonymise(out.select("doc_id", "text"), "k", inverse=True)
    assert {r.doc_id: r.text for r in back.collect()} == {1: text, 2: "4785380592391139"}
    assert pii.pseudonymise(d, "other").filter("doc_id = 2").first().text != cards[0]
    assert (got[1].n_card, got[1].n_email, got[1].n_ip, got[1].n_phone, got[1].n_ssn, got[1].n_date, got[1].n_iban) == (2, 1, 1, 1, 1, 1, 1)
    same = pii.pseudonymise(edges, "k")
    assert sorted(map(str, same.select("doc_id", "text").collect())) == sorted(map(str, edges.select("doc_id", "text").collect()))
    assert pii.pseudonymise(empty, "k").count() == 0


def test_spaced_ibans_and_dates_with_slashes(spark):
    text = "GB82WEST12345698765432 or GB82 WEST 1234 5698 7654 32, on 28/02/2021 (2021/02/28, 2021-02-28) not 31/02/2021, 12/31/2021 or GB83 WEST 1234 5698 7654 32"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = pii.pseudonymise(d, "k")
    got = out.first()
    assert (got.n_iban, got.n_date) == (2, 3) and "28/02/2021" not in got.text and "7654 32," not in got.text
    assert got.text.endswith(" not 31/02/2021, 12/31/2021 or GB83 WEST 1234 5698 7654 32")
    a, b = re.match(r"(\w+) or ([A-Z0-9 ]+),", got.text).groups()
    assert a == b.replace(" ", "") and re.fullmatch(r"[A-Z]{2}\d\d WEST \d{4} \d{4} \d{4} \d\d", b)
    (p, q, r), = re.findall(r"(\d\d/\d\d/\d{4}) \((\d{4}/\d\d/\d\d), (\d{4}-\d\d-\d\d)\)", got.text)
    assert q.replace("/", "-") == r == "-".join(reversed(p.split("/")))
    assert pii.pseudonymise(out.select("doc_id", "text"), "k", inverse=True).first().text == text


def test_feistel_is_a_permutation(spark):
    n = 17 * 23
    d = spark.range(n).select(pii.feistel((F.col("id") / 23).cast("long"), F.col("id") % 23, F.lit(17), F.lit(23), "k", "t", False).alias("s"))
    assert {(r.s.x, r.s.y) for r in d.collect()} == {(i, j) for i in range(17) for j in range(23)}
    assert not re.search("Python|Arrow|Pandas", pii.pseudonymise(spark.createDataFrame([("x",)], "text string"), "k")._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "").replace("applySchemaToPythonRDD", ""))


# -- 10 language --------------------------------------------------------------------------------------


def test_language_held_out(spark, sf, edges, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1), 150).join(docs, "doc_id")
    held = got.filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    out = language.identify(edges, edges.filter("lang is not null"), 10)
    assert out.count() == edges.count() and {r.lang_pred for r in out.filter("doc_id in (1000, 1001, 1002, 1005)").collect()} == {"und"}
    assert language.identify(empty, empty).count() == 0
    assert {r.lang_pred for r in language.identify(edges, empty).collect()} == {"und"}


# -- queries and the pipeline --------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert {"lang", "source", "item"} <= set(df.columns) if name == "op11_divergence" else "doc_id" in df.columns  # its rows are groups
    if name not in ("op8_decontamination", "op11_divergence"):
        assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    d, seen = docs, {}
    for name, stage in c.STAGES:
        d = stage(spark, d, sf)
        seen[name] = d.count()
        if name != "bpe":
            assert d.columns == docs.columns
    assert docs.count() >= seen["toxicity"] >= seen["near_duplicates"] >= seen["decontamination"] == seen["secrets"] == seen["bpe"] > 0
    assert c.run(spark, sf).count() == seen["bpe"]


# -- repeated rows and clashing names -----------------------------------------------------------------


def test_many_equal_rows(spark):
    """1,000 equal rows of one id, its near copy, and columns named like the operators' own."""
    r = random.Random(8)
    words = [f"w{r.randint(0, 500)}" for _ in range(80)]
    docs = [(1, " ".join(words), "a", "x")] * 1000 + [(2, " ".join([*words[:-1], "other"]), "b", "y")] * 20 + [(3, "alone " * 3, "c", "z")]
    d = spark.createDataFrame(docs, "doc_id long, text string, _id string, _version string").withColumns({"_bucket": F.lit("b"), "_again": F.lit(1)})
    got = neardup.cluster(d)
    assert {(x.doc_id, x.component_id, x.kept) for x in got.collect()} == {(1, 1, True), (2, 1, False), (3, 3, True)} and got.count() == 1021
    left = neardup.survivors(d)
    assert left.columns == d.columns and sorted((x.doc_id, x["_id"], x["_version"]) for x in left.collect()) == [(1, "a", "x"), (3, "c", "z")]
    for hot in (5000, 1):
        out = substrings.dedup(d, 20, 4, hot).groupBy("doc_id", "n_removed").count().collect()
        assert sorted(map(tuple, out)) == [(1, 0, 1000), (2, 79, 20), (3, 0, 1)]


def test_pseudonyms_keep_other_columns(spark):
    d = spark.createDataFrame([(1, "John.Doe7@mail.example.com john.doe7@MAIL.example.com", "mine", "own")], "doc_id long, text string, _found string, n_email string")
    out = pii.pseudonymise(d, "k")
    got = out.first()
    assert (got["_found"], got["n_email"], got["_n_email"]) == ("mine", "own", 2)
    a, b = got.text.split()
    assert a != b and a.lower() == b.lower() and "ohn" not in a
    assert pii.pseudonymise(out.select("doc_id", "text"), "k", inverse=True).first().text == d.first().text
