"""SQL for the document queries that SQL can express."""

_WORDS = r"""w AS (SELECT doc_id, lang, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)"""

OP2 = rf"""WITH {_WORDS},
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS k FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2))),
again AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g, range(0, 3) r(j) WHERE k > 1 GROUP BY 1),
m AS (SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [n_symbols / nullif(word_chars, 0), n_dup_lines * 10::DOUBLE / nullif(n_words, 0), n_repeat_words / nullif(n_words, 0)] AS ratio FROM m),
size0 AS (SELECT lang, count(*) AS n FROM f JOIN (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1) l ON l.doc_id = f.doc_id WHERE NOT base_failed GROUP BY 1),
pool AS (SELECT lang, CASE WHEN pow(1 - 0.05 / 3, n) <= 0.05 / (3 * (SELECT count(*) FROM size0)) THEN 'one ' || coalesce(lang, '') ELSE 'pooled' END AS stratum FROM size0),
f2 AS (SELECT f.*, stratum FROM f LEFT JOIN pool ON pool.lang IS NOT DISTINCT FROM f.lang),
good AS (SELECT f2.* FROM f2 JOIN (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1) l ON l.doc_id = f2.doc_id WHERE NOT base_failed),
size AS (SELECT stratum, count(*) AS n FROM good GROUP BY 1),
grid AS (SELECT r, i, CAST(CASE r WHEN 2 THEN round(1 - 0.04 * i, 2) ELSE round(0.5 - 0.02 * i, 2) END AS DOUBLE) AS cut FROM range(1, 4) a(r), range(0, 25) b(i)),
lost AS (SELECT s.stratum, s.n, r, i, cut, (SELECT count(*) FROM good WHERE good.stratum = s.stratum AND ratio[r] > cut) AS k FROM size s, grid),
p AS (SELECT stratum, r, i, cut, CASE WHEN k >= n THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.05 / 3) + (n - j) * ln(1 - 0.05 / 3))) FROM range(0, k + 1) t(j)) END AS p FROM lost),
bad AS (SELECT stratum, r, min(i) AS i FROM p WHERE p > 0.05 / (3 * (SELECT count(*) FROM size)) GROUP BY 1, 2),
chosen AS (SELECT p.stratum, p.r, min(p.cut) AS cut FROM p LEFT JOIN bad ON bad.stratum = p.stratum AND bad.r = p.r WHERE p.i < coalesce(bad.i, 25) GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.stratum = f2.stratum AND f2.ratio[c.r] > c.cut) AS kept FROM f2"""

OP3 = rf"""WITH {_WORDS},
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS lo FROM (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM w WHERE len(w) >= 50))),
cut AS (SELECT DISTINCT doc_id, i + k AS i FROM g, range(0, 50) r(k) WHERE lo < doc_id),
t AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS x FROM w),
k AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY t.i) AS kept, count(*) AS n FROM t ANTI JOIN cut ON t.doc_id = cut.doc_id AND t.i = cut.i GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

OP5 = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1) m USING (doc_id)"""

OP11 = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
lv AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS k FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT g.lang, g.source, coalesce(sum(k), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(k, 0) AS k, 1 + (1000000000 * (coalesce(k, 0) + 5)) // (g.n + 5 * lv.v) AS p, 1 + (1000000000 * (kept.total + 5)) // (lv.n + 5 * lv.v) AS q
  FROM g JOIN lv USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE k > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM u) WHERE part = 'pair' OR rank <= 50"""

OP12 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2, ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST(least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS BIGINT) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: The same links as OP5's from a higher similarity on.
OP13 = OP5.replace("100 * k >= 85 *", "100 * k >= 90 *").replace(", d.doc_id = m.c AS kept", "")

ORACLES = {"op2_quality": OP2, "op3_substrings": OP3, "op5_neardup": OP5, "op11_divergence": OP11, "op12_fill_in_middle": OP12, "op13_ngram_join": OP13}
