"""SQL that DuckDB runs over the same tables, written from the statement of each query."""

_RANKED = """
WITH once AS (
  SELECT pack_id, rel, coalesce(reference_score, 0) AS r, coalesce(query_score, 0) AS q, coalesce(demotion, 1) AS demotion,
         row_number() OVER (PARTITION BY pack_id, rel ORDER BY logged_at) AS copy
  FROM explain_rows WHERE pack_id IS NOT NULL AND rel IS NOT NULL),
pct AS (
  SELECT pack_id, rel, demotion, cume_dist() OVER (PARTITION BY pack_id ORDER BY r) AS pr, cume_dist() OVER (PARTITION BY pack_id ORDER BY q) AS pq
  FROM once WHERE copy = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY pack_id ORDER BY least(pr, pq) * demotion DESC, greatest(pr, pq) * demotion DESC, rel) AS position FROM pct)
"""



def _pairs(most: int) -> str:
    return f"""
WITH named AS (SELECT DISTINCT repo, sha, rel FROM commits WHERE repo IS NOT NULL AND sha IS NOT NULL AND rel IS NOT NULL),
kept AS (SELECT repo, sha FROM named GROUP BY repo, sha HAVING count(*) <= {most}),
inside AS (SELECT named.* FROM named JOIN kept USING (repo, sha)),
n AS (SELECT repo, count(*) AS n_commits FROM kept GROUP BY repo),
f AS (SELECT repo, rel, count(*) AS n_f FROM inside GROUP BY repo, rel),
ab AS (SELECT a.repo, a.rel AS rel_a, b.rel AS rel_b, count(*) AS n_ab FROM inside a JOIN inside b ON a.repo = b.repo AND a.sha = b.sha AND a.rel < b.rel GROUP BY ALL),
pairs AS (
  SELECT ab.repo, rel_a, rel_b, n_ab, fa.n_f AS n_a, fb.n_f AS n_b, n_commits
  FROM ab JOIN n USING (repo) JOIN f fa ON fa.repo = ab.repo AND fa.rel = rel_a JOIN f fb ON fb.repo = ab.repo AND fb.rel = rel_b)
"""

_CJK = r"\x{1100}-\x{11ff}\x{3040}-\x{30ff}\x{3130}-\x{318f}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{a960}-\x{a97f}\x{ac00}-\x{d7a3}\x{d7b0}-\x{d7ff}\x{f900}-\x{faff}\x{ff00}-\x{ffef}\x{20000}-\x{2fffd}"

_COPIES = r"""
WITH once AS (SELECT DISTINCT symbol_id, name, signature FROM symbols WHERE regexp_matches(coalesce(signature, ''), '\S') AND name IS NOT NULL),
split AS (
  SELECT symbol_id, name, signature, lower(regexp_replace(name, '[^\p{L}\p{N}]', '', 'g')) AS bare,
    list_sort(list_filter(list_transform(
      regexp_extract_all(regexp_replace(replace(replace(signature, '->', ' '), '=>', ' '), '^\s*\(((?s:.*))\)\s*$', '\1'), '(?:"[^"]*"|''[^'']*''|<[^<>]*>|\[[^\[\]]*\]|[^,])+'),
      lambda p: lower(regexp_replace(p, '[^\p{L}\p{N}]', '', 'g'))), lambda p: p <> '')) AS params
  FROM once),
grouped AS (SELECT symbol_id, name, signature, min(symbol_id) OVER w AS first_id, count(*) OVER w AS copies FROM split WINDOW w AS (PARTITION BY bare, params))
"""

_WEIGHTS = """
WITH once AS (SELECT id, field, arg_min(coalesce(tokens, []), indexed_at) AS tokens FROM bm25_docs GROUP BY id, field),
stats AS (SELECT field, count(*)::DOUBLE AS n, avg(coalesce(len(tokens), 0)) AS avg_len FROM once GROUP BY field),
tf AS (SELECT id, field, term, dl, count(*) AS tf FROM (SELECT id, field, len(tokens)::DOUBLE AS dl, unnest(tokens) AS term FROM once) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY field, term),
w AS (
  SELECT id, field, term, tf, df, ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len)) AS score
  FROM tf JOIN df USING (field, term) JOIN stats USING (field))
"""

SQL = {
    "p1_rank": _RANKED + "SELECT pack_id, rel, round(pr, 9) AS reference_percentile, round(pq, 9) AS query_percentile, demotion, position FROM ranked",
    "p1_found": _RANKED + "SELECT pack_id, rel FROM ranked WHERE position = 1",
    "p2_pairs": _pairs(1000000000) + """SELECT repo, rel_a, rel_b, n_ab, n_a, n_b, n_commits, n_ab::DOUBLE * n_commits / (n_a::DOUBLE * n_b) AS lift,
      (n_ab + 0.5::DOUBLE) * (n_commits - n_a - n_b + n_ab + 0.5::DOUBLE) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE)) AS odds_ratio FROM pairs""",
    "p2_found": _pairs(50) + "SELECT repo, rel_a, rel_b FROM pairs WHERE n_ab >= 5 AND n_ab * n_commits >= 4 * n_a * n_b",
    "p4_found": rf"""
WITH once AS (SELECT DISTINCT section_id, body FROM sections WHERE body IS NOT NULL),
parts AS (SELECT section_id, regexp_replace(body, '[^{_CJK}]', '', 'g') AS cjk, regexp_replace(body, '[{_CJK}]', '', 'g') AS other FROM once),
sized AS (SELECT section_id, ceil((length(other) + length(regexp_replace(other, '[^\x{{10000}}-\x{{10ffff}}]', '', 'g'))) / 4.0::DOUBLE) + ceil(length(cjk) * 0.95::DOUBLE) AS size FROM parts)
SELECT limit_name, section_id FROM sized, size_limits WHERE applies_to = 'sections' AND size > max_tokens""",
    "p5_records": _COPIES + r"""SELECT first_id, name, signature, copies FROM grouped WHERE symbol_id = first_id
UNION ALL SELECT symbol_id, name, signature, 1 FROM (SELECT DISTINCT symbol_id, name, signature FROM symbols) WHERE symbol_id IS NOT NULL AND symbol_id NOT IN (SELECT symbol_id FROM once)""",
    "p5_found": _COPIES + "SELECT first_id, symbol_id AS copy_id FROM grouped WHERE symbol_id <> first_id",
    "p6_terms": _WEIGHTS + "SELECT id, field, term, tf, df, round(score, 6) AS score FROM w",
    "p6_found": _WEIGHTS + "SELECT id, term FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, term) AS k FROM w WHERE field = 'body') WHERE k = 1",
    # four lines behind each content, each with a credential
    "p3_planted": "SELECT DISTINCT pack_id, (len(string_split(content, chr(10))) + k)::INT AS line_no FROM packs, (VALUES (1), (2), (3), (4)) t(k) WHERE pack_id IS NOT NULL AND content IS NOT NULL",
    # what must hold of every section
    "p4_check": "SELECT limit_name, section_id, true AS whole, true AS within FROM (SELECT DISTINCT section_id FROM sections WHERE body IS NOT NULL), size_limits WHERE applies_to = 'sections'",
    # what must hold of every source, whatever the tokens are
    "p8_mix_check": "SELECT source, true AS holds_weight, true AS within_limit FROM mix_targets",
}
