"""SQL that DuckDB runs over the same tables, written from the definition of each query."""

# Fixed values, written here once more, so that a wrong one in the engine shows.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with", "not", "but", "can",
             "if", "into", "than", "then", "so", "such", "which", "what", "when", "where", "who", "how", "do", "does", "did", "you", "your", "we", "our")
STEM_EXCEPTIONS = ("always", "hundred", "anything", "everything", "nothing", "something")
# (extensions, kind, pattern, whether group 2 is a signature)
RULES = [
    ("ts|tsx|js|jsx|mjs|cjs", "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*(\([^)]*\)?)", True),
    ("ts|tsx|js|jsx|mjs|cjs", "class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", False),
    ("ts|tsx|js|jsx|mjs|cjs", "interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)", False),
    ("ts|tsx|js|jsx|mjs|cjs", "type", r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*=", False),
    ("ts|tsx|js|jsx|mjs|cjs", "function", r"^\s*(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?\(", False),
    ("ts|tsx|js|jsx|mjs|cjs", "const", r"^\s*export\s+const\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=", False),
    ("py|php", "function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*(\([^)]*\)?)", True),
    ("py|php", "class", r"^\s*class\s+([A-Za-z_]\w*)", False),
    ("go", "func", r"^func\s+(?:\([^)]+\)\s+)?([A-Za-z_]\w*)\s*(\([^)]*\)?)", True),
    ("go", "type", r"^type\s+([A-Za-z_]\w*)\s+(?:struct|interface)", False),
    ("rs", "fn", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)\s*(\([^)]*\)?)", True),
    ("rs", "type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+([A-Za-z_]\w*)", False),
    ("java|kt|cs|swift", "class", r"^\s*(?:public|private|protected|internal)?\s*(?:abstract\s+|final\s+|sealed\s+|static\s+)*(?:class|interface|enum|record|object)\s+([A-Za-z_]\w*)", False),
    ("rb", "method", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)", False),
    ("rb", "class", r"^\s*(?:class|module)\s+([A-Z]\w*)", False),
    ("c|h|cc|cpp|hpp", "function", r"^[A-Za-z_][\w\s*]*\s\**([A-Za-z_]\w*)\s*(\([^;{)]*\)?)\s*\{?\s*$", True),
    ("c|h|cc|cpp|hpp", "type", r"^\s*(?:typedef\s+)?(?:struct|enum|union)\s+([A-Za-z_]\w*)", False),
]
SOURCE = r"regexp_matches(rel, '[^/]\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|kt|cs|rb|php|swift|c|h|cc|cpp|hpp)$') AND text IS NOT NULL AND repo IS NOT NULL"
_CJK = r"\x{1100}-\x{11ff}\x{3040}-\x{30ff}\x{3130}-\x{318f}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{a960}-\x{a97f}\x{ac00}-\x{d7a3}\x{d7b0}-\x{d7ff}\x{f900}-\x{faff}\x{ff00}-\x{ffef}\x{20000}-\x{2fffd}"
_SEARCH = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}\x{f900}-\x{faff}"
_TEST = r"(^|/)(tests?|__tests__)/|(^|/)(test_[^/]*|conftest)\.py$|\.(test|spec)\.[jt]sx?$"
_CORE, _CHECKS, _WEB = "^(core|pkg/core)(/.*)?$", "^checks(/.*)?$", "^(web|client)(/.*)?$"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _other(t: str) -> str:
    rest = f"regexp_replace({t}, '[{_CJK}]', '', 'g')"
    return rf"(length({rest}) + length(regexp_replace({rest}, '[^\x{{10000}}-\x{{10ffff}}]', '', 'g')))"


def _cjk(t: str) -> str:
    return f"length(regexp_replace({t}, '[^{_CJK}]', '', 'g'))"


def _tokens(other: str, cjk: str) -> str:
    return f"(ceil(({other}) / 4.0::DOUBLE) + ceil(({cjk}) * 0.95::DOUBLE))::BIGINT"


def _stem(t: str) -> str:
    bare = lambda n: f"left({t}, length({t}) - {n})"

    def fold(b: str) -> str:
        doubled = f"(right({b}, 1) IN ('b','d','g','m','n','p','r','t') AND right({b}, 1) = left(right({b}, 2), 1) AND length({b}) >= 2)"
        return f"CASE WHEN {doubled} THEN CASE WHEN length({b}) - 1 >= 3 THEN left({b}, length({b}) - 1) ELSE {t} END WHEN length({b}) >= 4 THEN {b} ELSE {t} END"

    return f"""CASE WHEN length({t}) < 4 OR {t} IN ({', '.join(map(_q, STEM_EXCEPTIONS))}) THEN {t}
      WHEN length({t}) > 4 AND ({t} LIKE '%ies' OR {t} LIKE '%ied') THEN {bare(3)} || 'y'
      WHEN length({t}) > 4 AND regexp_matches({t}, '(sses|xes|zes|ches|shes)$') THEN {bare(2)}
      WHEN length({t}) > 4 AND {t} LIKE '%ing' THEN {fold(bare(3))}
      WHEN length({t}) > 4 AND {t} LIKE '%ed' AND {t} NOT LIKE '%eed' THEN {fold(bare(2))}
      WHEN {t} LIKE '%s' AND NOT regexp_matches({t}, '[suio]s$') THEN {bare(1)} ELSE {t} END"""


_PARTS = rf"""
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[{_SEARCH}]+|[A-Za-z0-9]+')) AS run FROM documents),
parts AS (
  SELECT doc_id, part FROM (
    SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(run, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), ' ')) AS piece, lower(piece) AS part
    FROM runs WHERE regexp_matches(run, '^[A-Za-z0-9]'))
  WHERE length(part) >= 2 AND part NOT IN ({', '.join(map(_q, STOPWORDS))})
  UNION ALL
  SELECT doc_id, unnest(CASE WHEN length(run) = 1 THEN [run] ELSE list_transform(range(1, length(run)), lambda i: substring(run, i, 2)) END) FROM runs WHERE NOT regexp_matches(run, '^[A-Za-z0-9]'))
"""

_ASKED = rf"""
terms AS (SELECT unnest(['release', 'note', 'token', 'count', 'queue']) AS term),
lens AS (SELECT d.doc_id, d.repo, count(p.part) AS dl FROM documents d LEFT JOIN parts p USING (doc_id) GROUP BY ALL),
stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avg_len FROM lens),
tf AS (SELECT doc_id, {_stem('part')} AS term, count(*)::DOUBLE AS tf FROM parts GROUP BY ALL),
hit AS (SELECT tf.* FROM tf JOIN terms USING (term)),
df AS (SELECT term, count(*)::DOUBLE AS df FROM hit GROUP BY term),
asked AS (
  SELECT doc_id, sum(greatest(0, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (dl / avg_len)))) AS score
  FROM hit JOIN df USING (term) JOIN lens USING (doc_id), stats GROUP BY doc_id)
"""

_LINES = "lines AS (SELECT doc_id, repo, rel, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


def _outline() -> str:
    """A branch per rule; the first that matches a line counts, and the first 50 of a text."""
    cases = []
    for ext, kind, pattern, signed in RULES:
        sig = rf"regexp_replace(regexp_extract(line, {_q(pattern)}, 2), '^\s+|\s+$', '', 'g')" if signed else "''"
        cases.append(rf"WHEN regexp_matches(line, {_q(pattern)}) AND regexp_matches(rel, '[^/]\.({ext})$') THEN {{'kind': '{kind}', 'name': regexp_extract(line, {_q(pattern)}, 1), 'signature': {sig}}}")
    return rf"""{_LINES},
marked AS (SELECT doc_id, repo, n, line, CASE {' '.join(cases)} END AS s FROM lines),
symbols_of AS (
  SELECT doc_id, repo, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS ord, s.kind AS kind, s.name AS name, s.signature AS signature, n::INT AS line, NOT regexp_matches(line, '^\s') AS top_level
  FROM marked WHERE s IS NOT NULL QUALIFY ord < 50)
"""


_GENERIC = "(length(name) < 4 OR lower(name) IN ('main','init','test','setup','index','data','name','type','value','get','set','run','new','update','create','delete','read','write'))"
_WORDS = "w AS (SELECT repo, doc_id, word, count(*) AS n FROM (SELECT repo, doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM documents) GROUP BY ALL)"


def _mentions(file: str, names: str, texts: str) -> str:
    """By definition: each name against the whole text of each source file of the repository, with a boundary at each end."""
    before, after = "regexp_matches(substring(d.text, i - 1, 1), '\\w')", "regexp_matches(substring(d.text, i + length(e.name), 1), '\\w')"
    return rf"""
src AS (SELECT * FROM {texts}),
ws AS (SELECT repo, {file}, word, count(*) AS n FROM (SELECT repo, {file}, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM src) GROUP BY ALL),
edged AS (SELECT DISTINCT repo, name FROM {names} WHERE length(name) >= 4),
plain AS (SELECT e.repo, e.name, ws.{file}, ws.n FROM edged e JOIN ws ON ws.repo = e.repo AND ws.word = e.name),
odd AS (
  SELECT e.repo, e.name, d.{file},
    len(list_filter(range(1, length(d.text) + 1), lambda i: substring(d.text, i, length(e.name)) = e.name AND {before} <> regexp_matches(e.name, '^\w') AND {after} <> regexp_matches(e.name, '\w$'))) AS n
  FROM edged e JOIN src d ON d.repo = e.repo AND contains(d.text, e.name) WHERE NOT regexp_matches(e.name, '^\w+$')),
mentions AS (SELECT * FROM plain UNION ALL SELECT * FROM odd WHERE n > 0)
"""


_MENTIONS = _mentions("doc_id", "symbols_of", f"(SELECT * FROM documents WHERE {SOURCE})")
# the files of the table of symbols, which the texts of their repositories name
_TABLE_MENTIONS = _mentions("rel", "symbols", f"(SELECT repo, rel, min(text) AS text FROM documents WHERE {SOURCE} GROUP BY ALL)")
_REFERENCE = f"""{_outline()}, {_WORDS}, {_MENTIONS},
names AS (SELECT repo, doc_id, name, count(*) AS times FROM symbols_of WHERE NOT {_GENERIC} GROUP BY ALL),
refs AS (SELECT names.repo, names.doc_id, sum(least(m.n, 20) * times) AS refs FROM names JOIN mentions m ON m.repo = names.repo AND m.name = names.name AND m.doc_id <> names.doc_id GROUP BY ALL),
own AS (SELECT doc_id, count(*) AS own FROM symbols_of GROUP BY ALL),
reference AS (
  SELECT d.repo, d.doc_id, d.rel, coalesce(refs, 0)::DOUBLE + least(coalesce(own, 0), 10) * 0.5::DOUBLE AS reference, CASE WHEN regexp_matches(coalesce(rel, ''), {_q(_TEST)}) THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS demotion
  FROM src d LEFT JOIN refs USING (doc_id) LEFT JOIN own USING (doc_id)),
ordered AS (SELECT *, reference * demotion AS score, row_number() OVER (PARTITION BY repo ORDER BY reference * demotion DESC, rel COLLATE en, doc_id) AS rank FROM reference)
"""
_WITH_QUERY = f"""
WITH {_PARTS}, {_ASKED}, {_REFERENCE},
norm AS (SELECT repo, doc_id, rel, demotion, CASE WHEN max(reference) OVER (PARTITION BY repo) > 0 THEN reference / max(reference) OVER (PARTITION BY repo) ELSE reference END AS reference FROM reference),
parts_of AS (SELECT repo, doc_id, rel, reference, coalesce(score / (SELECT max(score) FROM asked) * 2, 0)::DOUBLE AS scorers, demotion FROM norm LEFT JOIN asked USING (doc_id)),
final AS (SELECT *, round((reference + scorers) * demotion, 9) AS score FROM parts_of),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, rel COLLATE en, doc_id) AS rank FROM final)
SELECT repo, doc_id, round(score, 6) AS score, round(reference, 6) AS reference, round(scorers, 6) AS scorers, demotion, rank FROM ranked
"""

_FIELDS = """
WITH once AS (SELECT id, field, arg_min(coalesce(tokens, []), indexed_at) AS tokens FROM bm25_docs GROUP BY ALL),
params AS (SELECT * FROM (VALUES ('path', 3.0::DOUBLE, 0.5::DOUBLE), ('symbols', 2.0::DOUBLE, 0.5::DOUBLE), ('body', 1.0::DOUBLE, 0.75::DOUBLE)) t(field, weight, b)),
lens AS (SELECT id, field, tokens, coalesce(len(tokens), 0)::DOUBLE AS dl FROM once),
stats AS (SELECT field, count(*)::DOUBLE AS n, avg(dl) AS avg_len FROM lens GROUP BY field),
tf AS (SELECT id, field, term, count(*)::DOUBLE AS tf FROM (SELECT id, field, unnest(tokens) AS term FROM lens) WHERE term IN ('baseline', 'record', 'path', 'return', 'value') GROUP BY ALL),
df AS (SELECT field, term, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
scores AS (
  SELECT id, sum(weight * greatest(0, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (1 - b + b * (dl / avg_len)))) AS score
  FROM tf JOIN df USING (field, term) JOIN lens USING (id, field) JOIN stats USING (field) JOIN params USING (field) GROUP BY id)
"""

_BLOCKS = rf"""{_REFERENCE},
texts AS (
  SELECT o.repo, o.doc_id, o.rel, o.rank, o.score, '### ' || rel || chr(10) || chr(10) || '```' || chr(10) || regexp_replace(text, '\s+$', '') || chr(10) || '```' || chr(10) || chr(10) AS block,
    coalesce(regexp_replace(regexp_replace(lower(source), '^[\s_-]+|[\s_-]+$', '', 'g'), '[\s_-]+', '_', 'g') IN ('rules', 'repo_map'), false) AS is_seed
  FROM ordered o JOIN (SELECT doc_id, text, source FROM documents) USING (doc_id)),
blocks AS (SELECT repo, doc_id, rel, rank, score, is_seed, {_other('block')} AS other, {_cjk('block')} AS cjk FROM texts)
"""


def _greedy(where: str, header: int, budget: int, reserve: int, rows: str) -> str:
    fits = _tokens("a.o + x.other", "a.c + x.cjk")
    return f"""
listed AS (SELECT repo, list({{'rank': rank, 'other': other, 'cjk': cjk}} ORDER BY rank) AS items FROM {rows} WHERE {where} GROUP BY repo),
walk AS (
  WITH RECURSIVE r(repo, i, o, c, rank, included) AS (
    SELECT repo, 0, {header}::BIGINT, 0::BIGINT, 0::BIGINT, false FROM listed
    UNION ALL
    SELECT repo, i + 1, CASE WHEN fits THEN no ELSE o END, CASE WHEN fits THEN nc ELSE c END, k, fits FROM (
      SELECT r.repo, r.i, r.o, r.c, r.o + items[i + 1].other AS no, r.c + items[i + 1].cjk AS nc, items[i + 1].rank AS k, {_tokens('r.o + items[i + 1].other', 'r.c + items[i + 1].cjk')} + {reserve} <= {budget} AS fits
      FROM r JOIN listed ON listed.repo = r.repo AND i < len(items)))
  SELECT repo, rank, included FROM r WHERE i > 0)
"""


_SEEDED_ROWS = "rows AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY repo ORDER BY score + CASE WHEN is_seed THEN 1e9 ELSE 0 END DESC, rel COLLATE en, doc_id) AS rank FROM blocks)"

_HISTORY = """
once AS (SELECT repo, sha, rel, min(commit_ord) AS commit_ord FROM commits WHERE commit_ord < 500 AND rel IS NOT NULL GROUP BY ALL),
h AS (SELECT * FROM once QUALIFY count(*) OVER (PARTITION BY repo, sha) <= 50)
"""
_SUMS = f"""{_HISTORY},
seeds AS (SELECT DISTINCT repo, rel FROM h WHERE regexp_matches(rel, '{_CORE}')),
sums AS (SELECT f.repo, f.rel, count(*) AS together FROM h f JOIN h s ON s.repo = f.repo AND s.sha = f.sha AND s.rel <> f.rel JOIN seeds ON seeds.repo = s.repo AND seeds.rel = s.rel GROUP BY ALL)
"""

_SECRET = "regexp_matches(line, '-----BEGIN ([A-Z]+ )*PRIVATE KEY-----') OR regexp_matches(line, 'AKIA[0-9A-Z]{16}') OR regexp_matches(line, 'ghp_[A-Za-z0-9]{36}') OR regexp_matches(line, '(?i)(api[_-]?key|secret|token|password)\\s*[:=]\\s*[\"''][^\"''\\s]{12,}[\"'']')"
_SECRETS = f"""
pack_lines AS (SELECT pack_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS n FROM packs),
hits AS (SELECT DISTINCT pack_id, n AS line FROM pack_lines WHERE {_SECRET})
"""
_RESULTS = f"""{_SECRETS},
results AS (
  SELECT 'fail' AS level, 'secrets' AS name, 'pack ' || pack_id || ':' || line || ' looks like a secret' AS detail, 'pack ' || pack_id AS file, line, NULL::VARCHAR AS subject FROM hits
  UNION ALL
  SELECT 'warn', 'tokens', 'pack ' || pack_id || ' has no token count', NULL, NULL, NULL FROM (SELECT DISTINCT pack_id FROM packs WHERE tokens IS NULL)),
applied AS (
  SELECT CASE WHEN level = 'fail' AND line < 60 THEN 'warn' ELSE level END AS level, name, CASE WHEN level = 'fail' AND line < 60 THEN detail || ' (known to the baseline)' ELSE detail END AS detail, file, line, subject
  FROM results)
"""

_SPANS = r"""
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
fences AS (SELECT *, regexp_matches(line, '^\s*```') AS fence, sum(regexp_matches(line, '^\s*```')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS opened FROM lines),
kept AS (SELECT doc_id, n, CASE WHEN fence OR opened % 2 = 1 THEN '' ELSE line END AS line FROM fences)
"""
_SECTION = "once AS (SELECT DISTINCT section_id, heading, body FROM sections), scored AS (SELECT *, (5 * coalesce((length(heading) - length(replace(lower(heading), 'token', ''))) / 5, 0) + coalesce((length(body) - length(replace(lower(body), 'token', ''))) / 5, 0))::BIGINT AS score FROM once)"
_TASKS = """
tasks_of AS (SELECT DISTINCT pack_id, profile FROM packs WHERE about IS NOT NULL),
files_of AS (SELECT pack_id, rel, max(coalesce(final_score, -1)) AS s, max(coalesce(included, false)) AS included FROM explain_rows GROUP BY ALL),
best AS (SELECT pack_id, rel FROM files_of QUALIFY row_number() OVER (PARTITION BY pack_id ORDER BY s DESC, rel) = 1),
tasks AS (SELECT pack_id AS id, rel AS expect_file FROM tasks_of LEFT JOIN best USING (pack_id)),
items AS (SELECT profile, rel, max(included) AS included FROM files_of JOIN tasks_of USING (pack_id) GROUP BY ALL),
cells AS (
  SELECT p.profile, id, CASE WHEN expect_file IS NOT NULL THEN items.rel IS NOT NULL END AS outline_hit, CASE WHEN expect_file IS NOT NULL THEN coalesce(included, false) END AS content_hit
  FROM tasks CROSS JOIN (VALUES ('light'), ('mid')) p(profile) LEFT JOIN items ON items.profile = p.profile AND items.rel = expect_file)
"""
_IMPORTS = r"""
lines AS (SELECT doc_id, rel, regexp_extract(rel, '[^/](\.[^./]*)$', 1) AS ext, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS n FROM documents),
found AS (
  SELECT doc_id, rel, n AS line, unnest(list_concat(regexp_extract_all(line, '(?:^|[^A-Za-z0-9_])from\s+["'']([^"'']+)["'']', 1), regexp_extract_all(line, '(?:^|[^A-Za-z0-9_])import\s+["'']([^"'']+)["'']', 1),
    regexp_extract_all(line, '(?:^|[^A-Za-z0-9_])require\(\s*["'']([^"'']+)["'']\s*\)', 1), regexp_extract_all(line, '(?:^|[^A-Za-z0-9_])import\(\s*["'']([^"'']+)["'']\s*\)', 1))) AS specifier
  FROM lines WHERE ext IN ('.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs')
  UNION ALL
  SELECT doc_id, rel, n, unnest(CASE WHEN regexp_matches(line, '^\s*from\s+\.*[\w.]*\s+import\b') THEN [regexp_extract(line, '^\s*from\s+(\.*[\w.]*)\s+import\b', 1)]
    WHEN regexp_matches(line, '^\s*import\s+.+$') THEN list_filter(list_transform(string_split(regexp_extract(line, '^\s*import\s+(.+)$', 1), ','), lambda p: trim(regexp_split_to_array(trim(p), '\s+as\s+')[1])), lambda p: p <> '') ELSE [] END)
  FROM lines WHERE ext = '.py'
  UNION ALL
  SELECT doc_id, rel, n, CASE WHEN regexp_matches(line, '^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);') THEN trim(regexp_extract(line, '^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);', 1)) ELSE regexp_extract(line, '^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z_]\w*)\s*;', 1) END
  FROM lines WHERE ext = '.rs' AND regexp_matches(line, '^\s*(?:pub(?:\([^)]*\))?\s+)?(?:use\s+[^;]+;|mod\s+[A-Za-z_]\w*\s*;)')
  UNION ALL
  SELECT doc_id, rel, n, regexp_extract(line, '^\s*import\s+(?:\w+\s+)?"([^"]+)"', 1) FROM lines WHERE ext = '.go' AND regexp_matches(line, '^\s*import\s+(?:\w+\s+)?"([^"]+)"'))
"""

_DUPLICATES = rf"""s AS (SELECT DISTINCT repo || '/' || rel AS path, name, regexp_replace(signature, '\s+', '', 'g') AS sig FROM symbols WHERE top_level AND length(name) >= 4 AND NOT regexp_matches(name, '^__.+__$') AND NOT regexp_matches(repo || '/' || rel, {_q(_TEST)})),
g AS (SELECT name, sig FROM s WHERE sig <> '' GROUP BY ALL HAVING count(*) >= 2), f AS (SELECT DISTINCT name, path FROM s JOIN g USING (name, sig))"""
_NAMED_ELSEWHERE = "r AS (SELECT DISTINCT s.repo, s.doc_id FROM symbols_of s JOIN mentions m ON m.repo = s.repo AND m.name = s.name AND m.doc_id <> s.doc_id)"
# the text before each span, and the label in it
_CUT = r"""
pieces AS (SELECT doc_id, n::INT AS line, string_split(line, '`') AS p FROM kept WHERE contains(line, '`')),
spanned AS (SELECT doc_id, line, p, unnest(list_filter(range(2, len(p)), lambda i: i % 2 = 0)) AS i FROM pieces),
before AS (SELECT doc_id, line, (row_number() OVER (PARTITION BY doc_id, line ORDER BY i) - 1)::INT AS span_no, p[i] AS text, array_to_string(list_slice(p, 1, i - 1), '`') AS b FROM spanned WHERE p[i] <> ''),
cut AS (SELECT doc_id, line, span_no, text, CASE WHEN contains(b, ':') THEN trim(regexp_replace(regexp_extract(regexp_extract(b, '([^·]*)$', 1), '^(.*):[^:]*$', 1), '^[-*\s]+', '')) ELSE '' END AS label FROM before)
"""
_RUNS_ON = r"(?i)(--watch\b|(^|\s)-w(\s|$)|\b(watch|serve|dev|start)\b)"
_IMPORTS_OF = _IMPORTS.replace("doc_id, rel,", "repo, rel,").replace("FROM documents)", "FROM (SELECT repo, rel, min(text) AS text FROM documents WHERE rel IS NOT NULL GROUP BY ALL))")


def _normal(path: str) -> str:
    return f"list_reduce(list_prepend('', string_split({path}, '/')), lambda a, s: CASE WHEN s IN ('.', '') THEN a WHEN s = '..' THEN CASE WHEN a = '' OR regexp_matches(a, '(^|/)\\.\\.$') THEN ltrim(a || '/..', '/') ELSE regexp_replace(a, '(^|/)[^/]+$', '') END WHEN a = '' THEN s ELSE a || '/' || s END)"


_RESOLVED = rf"""
placed AS (SELECT *, CASE WHEN contains(rel, '/') THEN regexp_extract(rel, '^(.*)/[^/]*$', 1) || '/' ELSE '' END AS here, regexp_extract(specifier, '^(\.+)', 1) AS dots, regexp_extract(specifier, '^\.+(.*)', 1) AS rest FROM found WHERE specifier LIKE '.%'),
based AS (SELECT *, {_normal("here || specifier")} AS t, {_normal("here || repeat('../', length(dots) - 1) || replace(rest, '.', '/')")} AS p FROM placed),
tried AS (SELECT *, CASE WHEN rel LIKE '%.py' THEN CASE WHEN rest <> '' THEN [p || '.py', p || '/__init__.py'] ELSE [ltrim(p || '/__init__.py', '/')] END
  ELSE CASE WHEN regexp_matches(t, '[^/]\.[^./]*$') THEN [t] ELSE [] END || list_transform({list(('.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.py', '.go', '.rs'))}, lambda e: t || e) || list_transform({list(('.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.py', '.go', '.rs'))}, lambda e: t || '/index' || e) || [t || '/__init__.py'] END AS c FROM based),
there AS (SELECT repo, list(DISTINCT rel) AS rels FROM documents WHERE rel IS NOT NULL GROUP BY repo),
named AS (SELECT tried.*, list_filter(c, lambda x: list_contains(rels, x))[1] AS resolved FROM tried JOIN there USING (repo))
"""
_SOURCE = r"regexp_replace(regexp_replace(lower(source), '^[\s_-]+|[\s_-]+$', '', 'g'), '[\s_-]+', '_', 'g')"

SQL: dict[str, str] = {
    "token_units": f"SELECT doc_id, {_other('text')} AS other_units, {_cjk('text')} AS cjk_chars, {_tokens(_other('text'), _cjk('text'))} AS tokens FROM documents",
    "token_budget_by_source": f"SELECT source, sum({_tokens(_other('text'), _cjk('text'))})::BIGINT AS tokens, count(*) AS n_docs FROM documents GROUP BY source",
    "word_tokens": f"WITH {_WORDS} SELECT word, sum(n)::BIGINT AS n, count(*) AS n_docs FROM w GROUP BY word",
    "stem_vocab": f"WITH {_PARTS} SELECT part, {_stem('part')} AS stem, count(*) AS n FROM parts GROUP BY part",
    "outline_symbols": f"WITH {_outline()} SELECT doc_id, ord, kind, name, signature, line, top_level FROM symbols_of",
    "import_lines": f"WITH {_IMPORTS} SELECT DISTINCT doc_id, specifier, line FROM found",
    "reference_rank": f"WITH {_REFERENCE} SELECT repo, doc_id, score, demotion, rank FROM ordered",
    "rank_with_query": _WITH_QUERY,
    "rank_explain": _WITH_QUERY + " WHERE rank <= 20",
    "elsewhere_top20": f"WITH {_REFERENCE} SELECT repo, doc_id, score, row_number() OVER (PARTITION BY repo ORDER BY rank) AS rank FROM ordered WHERE NOT regexp_matches(rel, '{_CORE}') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ordered.rank) <= 20",
    "symbol_references": f"""WITH {_TABLE_MENTIONS}, once AS (SELECT DISTINCT symbol_id, repo, rel, name FROM symbols), names AS (SELECT repo, rel, name, count(*) AS times FROM once WHERE NOT {_GENERIC} GROUP BY ALL)
SELECT names.repo, names.rel, sum(least(m.n, 20) * times)::BIGINT AS n FROM names JOIN mentions m ON m.repo = names.repo AND m.name = names.name AND m.rel <> names.rel GROUP BY ALL""",
    "diff_expansion": rf"""WITH {_TABLE_MENTIONS},
seeds AS (SELECT DISTINCT repo, rel FROM symbols WHERE regexp_matches(rel, '\.(py|ts|js|go|tsx)$')),
names AS (SELECT DISTINCT repo, name FROM symbols SEMI JOIN seeds USING (repo, rel) WHERE NOT {_GENERIC}),
n AS (SELECT m.repo, m.rel, sum(m.n) AS n FROM mentions m JOIN names USING (repo, name) ANTI JOIN seeds ON seeds.repo = m.repo AND seeds.rel = m.rel GROUP BY ALL),
s AS (SELECT repo, rel, round(n * CASE WHEN regexp_matches(rel, {_q(_TEST)}) THEN 0.2::DOUBLE ELSE 1 END, 6) AS score FROM n)
SELECT repo, rel, score, row_number() OVER (PARTITION BY repo ORDER BY score DESC, rel COLLATE en) AS rank FROM s QUALIFY rank <= 10""",
    "bm25_body": f"WITH {_PARTS}, {_ASKED} SELECT doc_id, round(score, 6) AS score FROM asked",
    "bm25_fields": _FIELDS + "SELECT id, round(score, 6) AS score FROM scores",
    "bm25_topk": _FIELDS + "SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rank FROM scores QUALIFY rank <= 20",
    "query_contribution": _FIELDS + "SELECT id, round(score / (SELECT max(score) FROM scores) * 2, 6) AS contribution FROM scores",
    "repomap_prefix": f"""WITH {_REFERENCE},
l AS (SELECT doc_id, '- L' || line || ' ' || kind || ' `' || name || signature || '`' || chr(10) AS t FROM symbols_of),
b AS (SELECT doc_id, sum({_other('t')})::BIGINT AS other, sum({_cjk('t')})::BIGINT AS cjk FROM l GROUP BY ALL),
h AS (SELECT repo, doc_id, rank, '## ' || rel || chr(10) AS t FROM ordered),
r AS (SELECT repo, doc_id, rank, {_other('t')} + coalesce(other, 0) AS other, {_cjk('t')} + coalesce(cjk, 0) AS cjk FROM h LEFT JOIN b USING (doc_id)),
t AS (SELECT repo, doc_id, rank, {_tokens('sum(other) OVER w', 'sum(cjk) OVER w')} AS tokens FROM r WINDOW w AS (PARTITION BY repo ORDER BY rank))
SELECT * FROM t WHERE tokens <= 800""",
    "pack_greedy": f"WITH RECURSIVE {_BLOCKS}, {_greedy('true', 40, 3000, 50, 'blocks')} SELECT repo, rank, included FROM walk",
    "pack_seeded": f"""WITH RECURSIVE {_BLOCKS}, {_SEEDED_ROWS},
seed AS (SELECT repo, {_tokens('sum(other) + 40', 'sum(cjk)')} > 3000 AS degraded FROM rows WHERE is_seed GROUP BY repo),
chosen AS (SELECT rows.*, coalesce(degraded, false) AS degraded FROM rows LEFT JOIN seed USING (repo)),
{_greedy('NOT degraded OR NOT is_seed OR rank = 1', 40, 3000, 0, 'chosen')}
SELECT repo, rank, is_seed, coalesce(included, false) AS included, degraded FROM chosen LEFT JOIN walk USING (repo, rank)""",
    "cochange_gate": "SELECT repo, count(DISTINCT sha) AS n_commits, count(DISTINCT sha) >= 50 AS available FROM commits WHERE rel IS NOT NULL GROUP BY repo",
    "cochange_window": f"WITH {_HISTORY} SELECT repo, count(DISTINCT sha) AS n_commits, count(*) AS n_files FROM h GROUP BY repo",
    "cochange_sums": f"WITH {_SUMS} SELECT * FROM sums",
    "cochange_score": f"WITH {_SUMS} SELECT repo, rel, round(together::DOUBLE / max(together) OVER (PARTITION BY repo), 6) AS contribution FROM sums",
    "cochange_outside": rf"""WITH {_SUMS} SELECT repo, rel, together, row_number() OVER (PARTITION BY repo ORDER BY together DESC, rel) AS rank FROM sums
WHERE NOT regexp_matches(rel, '{_CORE}') AND NOT regexp_matches(rel, '^(docs|migrations)(/|$)') AND NOT regexp_matches(rel, '(^|/)(\.[^/]*|node_modules|dist|build|out|target|vendor|__pycache__|venv|coverage)(/|$)') QUALIFY rank <= 5""",
    "cochange_baskets": """WITH b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), s AS (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11')
SELECT f.l_partkey AS rel, count(*) AS together FROM b f JOIN b o ON o.l_orderkey = f.l_orderkey AND o.l_partkey <> f.l_partkey JOIN s ON s.p_partkey = o.l_partkey GROUP BY ALL""",
    "duplicate_definitions": f"WITH {_DUPLICATES} SELECT name, path FROM f",
    "duplicate_names": f"WITH {_DUPLICATES} SELECT name, count(*) AS n_files, min(path) AS first FROM f GROUP BY name",
    "referenced": f"WITH {_TABLE_MENTIONS} SELECT DISTINCT s.repo, s.rel FROM symbols s JOIN mentions m ON m.repo = s.repo AND m.name = s.name AND m.rel <> s.rel",
    "orphans": rf"""WITH {_outline()}, {_WORDS}, {_MENTIONS}, {_NAMED_ELSEWHERE}
SELECT repo, doc_id FROM src WHERE doc_id IN (SELECT doc_id FROM symbols_of) AND doc_id NOT IN (SELECT doc_id FROM r) AND NOT regexp_matches(rel, {_q(_TEST)}) AND NOT regexp_matches(rel, '^tools(/|$)')
AND regexp_extract(rel, '([^/]*?)(\.[^./]+)?$', 1) NOT IN ('main', 'index', 'cli', 'app', '__main__', 'server', 'worker', 'setup', 'conftest', 'page', 'layout', 'route', 'middleware')""",
    "uncovered": f"SELECT doc_id, rel FROM documents WHERE rel IS NOT NULL AND NOT regexp_matches(rel, '{_CORE}|{_CHECKS}|{_WEB}')",
    "constraint_only_in": "SELECT DISTINCT symbol_id, repo, rel, line FROM symbols WHERE name = 'StorePanel' AND NOT regexp_matches(rel, '^(core|lib)(/|$)')",
    "constraint_imports": rf"""WITH {_IMPORTS} SELECT DISTINCT doc_id, specifier, line FROM found
WHERE regexp_matches(rel, '\.(py|js)$') AND (regexp_matches(specifier, '(^|/)token$|^build(/|$)|^\.\./[^/]*\.js$') OR regexp_matches(replace(specifier, '.', '/'), '(^|/)token$|^build(/|$)'))""",
    "constraint_forbid_pattern": f"WITH {_LINES} SELECT doc_id, n::INT AS line FROM lines WHERE regexp_matches(rel, '\\.(go|md)$') AND regexp_matches(line, 'set -euo pipefail|return nil, err')",
    "secrets_scan": f"WITH {_SECRETS} SELECT pack_id, line FROM hits",
    "rule_length": "SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents WHERE len(string_split(text, chr(10))) > 60",
    "stale_maps": f"WITH d AS (SELECT *, {_SOURCE} AS s FROM documents), newest AS (SELECT repo, max(updated_at) AS changed_at FROM d WHERE s = 'code' GROUP BY repo) SELECT DISTINCT repo, epoch_us(changed_at) AS changed_at FROM newest JOIN d USING (repo) WHERE s = 'repo_map' AND changed_at > d.updated_at",
    "baseline_entries": f"WITH {_RESULTS} SELECT name AS \"check\", file, line, NULL::VARCHAR AS subject, CASE WHEN file IS NULL THEN detail END AS identifier FROM results",
    "baseline_ratchet": f"WITH {_RESULTS} SELECT * FROM applied",
    "check_summary": f"WITH {_RESULTS} SELECT name, level, count(*) AS n FROM applied GROUP BY ALL",
    "fence_strip": f"WITH {_SPANS} SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, sum(length(line))::BIGINT AS n_chars FROM kept GROUP BY doc_id",
    "section_scope": rf"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\s') THEN lower(regexp_replace(regexp_replace(line, '^#{{1,6}}\s+', ''), '\s+$', '')) = 'overview' END AS here FROM lines),
s AS (SELECT doc_id, here, last_value(here IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS inside FROM h)
SELECT doc_id, count(*) AS n_lines FROM s WHERE here IS NULL AND inside GROUP BY doc_id""",
    "backtick_spans": rf"""WITH {_SPANS}, spans AS (SELECT doc_id, n, unnest(regexp_extract_all(line, '`([^`]+)`', 1)) AS s FROM kept)
SELECT doc_id, n::INT AS line, count(*) AS n_spans, sum((NOT regexp_matches(s, '\s') AND NOT regexp_matches(s, '(?i)^[a-z]+://') AND NOT regexp_matches(s, '[<>]') AND (contains(s, '/') OR regexp_matches(s,
  '[^/]\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|kt|cs|rb|php|swift|c|h|cc|cpp|hpp|json|yaml|yml|md|toml|lock|txt|cfg|ini|env|sh|sql)$')))::INT)::BIGINT AS n_paths FROM spans GROUP BY ALL""",
    "section_split": r"""WITH parts AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(^|\n)## ', '\1' || chr(1) || '## ', 'g'), chr(1)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS p FROM documents),
s AS (SELECT doc_id, unnest(p) AS body, (generate_subscripts(p, 1) - 1)::INT AS section_ord FROM parts)
SELECT doc_id, section_ord, regexp_replace(regexp_extract(body, '^## ([^\n]*)', 1), '^\s+|\s+$', '', 'g') AS heading, length(body) AS n_chars FROM s""",
    "section_search": f"WITH {_SECTION} SELECT section_id, score FROM scored WHERE score > 0 ORDER BY score DESC, section_id LIMIT 5",
    "section_budget": f"""WITH {_SECTION}, top AS (SELECT section_id, body, row_number() OVER (ORDER BY score DESC, section_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 20),
t AS (SELECT section_id, rank, {_tokens(f"sum({_other('body')}) OVER (ORDER BY rank)", f"sum({_cjk('body')}) OVER (ORDER BY rank)")} AS tokens FROM top) SELECT * FROM t WHERE tokens <= 4000""",
    "symbol_search": "SELECT DISTINCT symbol_id, name FROM symbols WHERE contains(lower(name), 'panel')",
    "symbol_refs30": f"WITH {_LINES} SELECT doc_id, n::INT AS line, left(trim(line, ' '), 120) AS line_text FROM lines WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])return([^A-Za-z0-9_]|$)') ORDER BY doc_id, n LIMIT 30",
    "eval_cells": f"WITH {_TASKS} SELECT * FROM cells",
    "eval_rates": f"WITH {_TASKS} SELECT profile, count(content_hit) AS n, round(coalesce(avg(outline_hit::INT), 0), 6) AS outline_rate, round(coalesce(avg(content_hit::INT), 0), 6) AS content_rate FROM cells GROUP BY profile",
    "eval_matrix": f"WITH {_TASKS} SELECT p AS profile, m AS model, count(*) AS n_calls FROM tasks, (SELECT unnest(['light', 'mid']) AS p), (SELECT unnest(['small', 'large']) AS m) GROUP BY ALL",
    "graded_answers": "WITH once AS (SELECT DISTINCT section_id, repo, body FROM sections) SELECT repo AS profile, count(*) AS n, round(avg((contains(lower(coalesce(body, '')), 'token') OR contains(lower(coalesce(body, '')), 'snapshot'))::INT), 6) AS rate FROM once GROUP BY repo",
    "module_detect": r"""WITH f AS (SELECT DISTINCT repo, rel FROM commits WHERE rel IS NOT NULL),
d AS (SELECT repo, CASE WHEN regexp_matches(rel, '^(services|apps|packages|crates|src|lib)/[^/]+/') THEN regexp_extract(rel, '^[^/]+/[^/]+') WHEN contains(rel, '/') THEN regexp_extract(rel, '^[^/]+') END AS dir FROM f),
c AS (SELECT repo, dir, count(*) AS n FROM d WHERE dir IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
t AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, dir) AS k FROM c QUALIFY k <= 8),
m AS (SELECT repo, regexp_replace(regexp_extract(dir, '[^/]*$'), '[^A-Za-z0-9_-]', '-', 'g') AS module, dir, n, k FROM t)
SELECT repo, module, dir || '/**' AS glob, n AS n_files FROM m QUALIFY row_number() OVER (PARTITION BY repo, module ORDER BY k) = 1""",
    "module_match_counts": f"SELECT unnest(['core', 'checks', 'web']) AS module, unnest([count(*) FILTER (regexp_matches(rel, '{_CORE}')), count(*) FILTER (regexp_matches(rel, '{_CHECKS}')), count(*) FILTER (regexp_matches(rel, '{_WEB}'))]) AS n_files FROM documents",
    "head_lines": "SELECT doc_id, length(array_to_string(list_slice(string_split(text, chr(10)), 1, 12), chr(10))) AS n_chars FROM documents",
    "exact_tokens": r"SELECT source, sum(len(list_filter(regexp_split_to_array(text, '[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '')))::BIGINT AS tokens FROM documents GROUP BY source",
    "source_extensions": rf"SELECT regexp_extract(rel, '(\.[^./]*)$', 1) AS extension, count(*) AS n_files FROM documents WHERE {SOURCE} GROUP BY ALL",
    "module_scan": f"SELECT doc_id, rel FROM documents WHERE regexp_matches(rel, '{_CORE}')",
    "query_seeds": f"SELECT repo, doc_id, rank FROM ({_WITH_QUERY}) WHERE rank <= 10",
    "diff_selection": rf"""WITH {_TABLE_MENTIONS},
seeds AS (SELECT DISTINCT repo, rel FROM symbols WHERE regexp_matches(rel, '\.(py|ts|js|go|tsx)$')),
names AS (SELECT DISTINCT repo, name FROM symbols SEMI JOIN seeds USING (repo, rel) WHERE NOT {_GENERIC}),
t AS (SELECT m.repo, m.rel, sum(m.n) AS n FROM mentions m JOIN names USING (repo, name) ANTI JOIN seeds ON seeds.repo = m.repo AND seeds.rel = m.rel GROUP BY ALL),
n AS (SELECT repo, rel, n * CASE WHEN regexp_matches(rel, {_q(_TEST)}) THEN 0.2::DOUBLE ELSE 1 END AS score FROM t)
SELECT repo, rel, true AS is_seed FROM seeds UNION ALL SELECT repo, rel, false FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY repo ORDER BY score DESC, rel COLLATE en) <= 10)""",
    "pack_explain": f"WITH RECURSIVE {_BLOCKS}, {_greedy('true', 40, 3000, 50, 'blocks')} SELECT repo, doc_id, score, rank, included FROM blocks JOIN walk USING (repo, rank) WHERE rank <= 20",
    "stale_first": f"WITH d AS (SELECT *, {_SOURCE} AS s FROM documents), b AS (SELECT repo, max(updated_at) AS built FROM d WHERE s = 'repo_map' GROUP BY repo) SELECT repo, min(rel) AS first FROM d JOIN b USING (repo) WHERE s = 'code' AND updated_at > built GROUP BY repo HAVING min(rel) IS NOT NULL",
    "check_failures": f"WITH {_RESULTS} SELECT count(*) FILTER (level = 'fail') AS n_failures FROM applied",
    "span_labels": rf"WITH {_SPANS}, {_CUT} SELECT doc_id, line, span_no, text, label FROM cut WHERE label <> ''",
    "span_commands": rf"WITH {_SPANS}, {_CUT} SELECT doc_id, line, span_no, text FROM cut WHERE contains(lower(text), 'import') OR contains(lower(label), 'import') OR regexp_matches(text, {_q(_RUNS_ON)}) OR regexp_matches(label, {_q(_RUNS_ON)})",
    "missing_paths": rf"""WITH {_SPANS}, {_CUT},
there AS (SELECT DISTINCT array_to_string(list_slice(string_split(rel, '/'), 1, n), '/') AS p FROM documents, unnest(range(1, 50)) t(n) WHERE rel IS NOT NULL AND n <= len(string_split(rel, '/')))
SELECT doc_id, line, span_no, text FROM cut WHERE NOT regexp_matches(text, '\s') AND NOT regexp_matches(text, '(?i)^[a-z]+://') AND NOT regexp_matches(text, '[<>]') AND (contains(text, '/') OR regexp_matches(text,
  '[^/]\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|kt|cs|rb|php|swift|c|h|cc|cpp|hpp|json|yaml|yml|md|toml|lock|txt|cfg|ini|env|sh|sql)$')) AND regexp_replace(regexp_replace(text, '^\./', ''), '/$', '') NOT IN (SELECT p FROM there)""",
    "section_context": f"""WITH {_SECTION}, top AS (SELECT section_id, body, row_number() OVER (ORDER BY score DESC, section_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 20),
t AS (SELECT section_id, rank, {_tokens(f"30 + sum({_other('body')}) OVER (ORDER BY rank)", f"sum({_cjk('body')}) OVER (ORDER BY rank)")} AS tokens FROM top) SELECT * FROM t WHERE tokens <= 8000""",
    "answer_clips": r"SELECT DISTINCT section_id, left(regexp_replace(body, '[ \t\n\x0b\f\r]+', ' ', 'g'), 80) AS answer FROM sections",
    "pass_percent": "WITH once AS (SELECT DISTINCT section_id, repo, body FROM sections) SELECT repo AS profile, floor(round(avg((contains(lower(coalesce(body, '')), 'token') OR contains(lower(coalesce(body, '')), 'snapshot'))::INT), 6) * 100 + 0.5)::INT AS percent FROM once GROUP BY repo",
    "import_resolved": rf"""WITH {_IMPORTS_OF}, {_RESOLVED} SELECT DISTINCT repo, rel, specifier, line, resolved FROM named""",
}
