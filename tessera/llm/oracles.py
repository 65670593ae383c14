"""DuckDB SQL for the contract queries that SQL can express over whole tables."""

from __future__ import annotations

from tessera.llm import license_scan

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: list_slice(ws, i, i + 2))) WHEN len(ws) > 0 THEN [ws] ELSE [] END AS sh FROM w),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * n >= 90 * (len(a.sh) + len(b.sh) - n)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT * FROM (WITH RECURSIVE r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN both_ways e ON e.x = r.b) SELECT a, min(b) AS least FROM r GROUP BY 1))
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least AS component_id FROM s JOIN reach ON a = s.doc_id
"""

OP7 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 12) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM win JOIN least USING (k), range(13) r(o) WHERE m < doc_id),
pos AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def _op9(threshold: float = 0.8) -> str:
    cell = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {cell(name)}, {cell(text)})" for i, (name, text) in enumerate(license_scan.TEMPLATES))
    return rf"""
WITH t0(rank, license, body) AS (VALUES {rows}),
t1 AS (SELECT rank, license, string_split(trim(lower(regexp_replace(body, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS ws FROM t0),
t AS (SELECT rank, license, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS known FROM t1),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
l AS (SELECT doc_id, list_concat(string_split(x, chr(10)), list_filter(regexp_split_to_array(x, '\n[\x20\x09-\x0D]*\n'), lambda p: contains(p, chr(10)))) AS l FROM d),
parts AS (SELECT doc_id, unnest(l) AS part, unnest(range(len(l))) AS line FROM l),
g AS (SELECT doc_id, line, string_split(trim(lower(regexp_replace(part, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS ws FROM parts),
grams AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams FROM g WHERE len(ws) > 1),
scored AS (SELECT doc_id, line, rank, license, 2.0 * len(list_intersect(grams, known)) / (len(grams) + len(known)) AS dice FROM grams, t),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, rank) AS rn FROM scored WHERE dice >= {threshold} - 1e-12),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, line, rank) AS q, count(*) OVER (PARTITION BY doc_id) AS n FROM best WHERE rn = 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, license, round(dice, 6) AS dice FROM d LEFT JOIN (SELECT * FROM top WHERE q = 1) USING (doc_id)
"""


#: The six rules: ratio and largest of 24 evenly spaced cutoffs.
_RATIOS = {
    "symbols": ("n_symbols", "n_words", 1.2),
    "dup_lines": ("n_dup_lines", "n_lines", 0.96),
    "repeats": ("n_repeat_words", "n_words", 0.24),
    "long_words": ("word_chars", "n_words", 24.0),
    "shouting": ("n_bangs", "n_words", 1.2),
    "capitals": ("n_capitals", "word_chars", 0.96),
}


def _op4(risk: float = 0.03, confidence: float = 0.05, good_weight: float = 10.0) -> str:
    rules = sorted(_RATIOS)
    ratio = {r: f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)" for r, (a, b, _) in _RATIOS.items()}
    at = lambda r, i: f"round({_RATIOS[r][2]!r}::DOUBLE * ({i}) / 24, 6)"
    levels = " UNION ALL ".join(f"SELECT stratum, quality = 1 AS good, '{r}' AS rule, i, {ratio[r]} > {at(r, 'i')} AS hit FROM lab, range(1, 25) g(i) WHERE doc_id % 2 = 0" for r in rules)
    cut = "CASE rule " + " ".join(f"WHEN '{r}' THEN {at(r, 'i')}" for r in rules) + " END"
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {ratio[r]}" for r in rules) + " END"
    tail = "(SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}::DOUBLE) + (n - i) * ln(1 - {p}::DOUBLE))) FROM range(0, 100000) z(i) WHERE i <= k)".replace("{p}", repr(risk))
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM twice, range(5) r(o) GROUP BY 1),
f0 AS (SELECT doc_id, lang, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_bangs,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ 	-
]')) AS ls FROM d),
f AS MATERIALIZED (SELECT f0.* EXCLUDE (ls, lang), CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS stratum, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed FROM f0 LEFT JOIN rep USING (doc_id)),
truth AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
lab AS MATERIALIZED (SELECT f.*, quality FROM f JOIN truth USING (doc_id) WHERE NOT base_failed),
rated AS (SELECT stratum, rule, i, count(CASE WHEN hit AND NOT good THEN 1 END) / greatest(count(CASE WHEN NOT good THEN 1 END), 1)
  - {good_weight} * (count(CASE WHEN hit AND good THEN 1 END) / greatest(count(CASE WHEN good THEN 1 END), 1)) AS gain FROM ({levels}) GROUP BY 1, 2, 3),
best AS (SELECT * FROM (SELECT stratum, rule, i, round(gain, 9) AS gain, row_number() OVER (PARTITION BY stratum, rule ORDER BY round(gain, 9) DESC, i DESC) AS q FROM rated WHERE round(gain, 9) > 0) WHERE q = 1),
plan AS MATERIALIZED (SELECT stratum, rule, {cut} AS cut, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS rank FROM best),
hold AS (SELECT * FROM lab WHERE doc_id % 2 != 0 AND quality = 1),
first AS (SELECT doc_id, min(rank) AS first, any_value(stratum) AS stratum FROM hold JOIN plan USING (stratum) WHERE {value} > cut GROUP BY 1),
sizes AS (SELECT stratum, n, pow(1 - {risk!r}::DOUBLE, n) AS p FROM (SELECT DISTINCT stratum FROM plan) LEFT JOIN (SELECT stratum, count(*) AS n FROM hold GROUP BY 1) USING (stratum)),
tarone AS (SELECT min(k) AS k FROM range(1, 10001) r(k) WHERE (SELECT count(*) FROM sizes WHERE p <= {confidence} / k) <= k),
sets AS (SELECT stratum, rank, n, count(first) AS k FROM plan JOIN sizes USING (stratum) LEFT JOIN first ON first.stratum = plan.stratum AND first.first <= plan.rank GROUP BY plan.stratum, stratum, rank, n, p HAVING p <= {confidence} / (SELECT k FROM tarone)),
failed AS (SELECT stratum, min(rank) AS stop_at FROM sets WHERE NOT (k < n * {risk!r} AND {tail} <= {confidence} / (SELECT k FROM tarone)) GROUP BY 1),
force AS (SELECT plan.* FROM plan JOIN sets USING (stratum, rank) LEFT JOIN failed USING (stratum) WHERE rank < coalesce(stop_at, 99)),
gone AS (SELECT DISTINCT f.stratum, f.doc_id FROM f JOIN force USING (stratum) WHERE {value} > cut)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM gone) AS kept FROM f
"""


def _op13(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    places = [f"x{i}" for i in range(width)]
    cut = ", ".join(f"z[p * {width} + {i + 1}] AS x{i}" for i in range(width))
    steps = [f"c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, {', '.join(places)} FROM cut QUALIFY e < {entries})"]
    far = " + ".join(f"(cut.{x} - c.{x}) * (cut.{x} - c.{x})" for x in places)
    for k in range(rounds + 1):
        steps.append(f"n{k} AS MATERIALIZED (SELECT vec_id, cut.p, min({far}) AS far, min(({far}) * {entries} + e) % {entries} AS e FROM cut JOIN c{k} c ON c.p = cut.p GROUP BY 1, 2)")
        if k < rounds:
            moved = ", ".join(f"coalesce(m.{x}, c.{x}) AS {x}" for x in places)
            means = ", ".join(f"CAST(floor(CAST(sum({x}) AS DOUBLE) / count(*)) AS BIGINT) AS {x}" for x in places)
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, {moved} FROM c{k} c LEFT JOIN (SELECT p, e, {means} FROM cut JOIN n{k} USING (vec_id, p) GROUP BY 1, 2) m ON m.p = c.p AND m.e = c.e)")
    flat = " || ',' || ".join(places)
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
cut AS MATERIALIZED (SELECT vec_id, p, {cut} FROM v, range({parts}) r(p)),
{', '.join(steps)},
coded AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM n{rounds} GROUP BY 1),
sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN v USING (vec_id) GROUP BY 1)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg({flat}, ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN v USING (vec_id) JOIN sums ON sums.label IS NOT DISTINCT FROM v.label
"""


ORACLES: dict[str, str] = {
    "op3_ngram_jaccard": OP3,
    "op4_quality_rules": _op4(),
    "op7_substring_dedup": OP7,
    "op9_license_scan": _op9(),
    "op13_vector_codes": _op13(),
}
