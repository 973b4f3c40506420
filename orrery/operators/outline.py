"""Symbols and imports of source texts, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import extension, lines, trim_all

MAX_SYMBOLS = 50
# Fixed values: (pattern, kind, whether group 2 is a signature) by language; the first that matches a line wins.
RULES: dict[str, list[tuple[str, str, bool]]] = {
    "js": [
        (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*(\([^)]*\)?)", "function", True),
        (r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", "class", False),
        (r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)", "interface", False),
        (r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*=", "type", False),
        (r"^\s*(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?\(", "function", False),
        (r"^\s*export\s+const\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=", "const", False),
    ],
    "py": [
        (r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*(\([^)]*\)?)", "function", True),
        (r"^\s*class\s+([A-Za-z_]\w*)", "class", False),
    ],
    "go": [
        (r"^func\s+(?:\([^)]+\)\s+)?([A-Za-z_]\w*)\s*(\([^)]*\)?)", "func", True),
        (r"^type\s+([A-Za-z_]\w*)\s+(?:struct|interface)", "type", False),
    ],
    "rs": [
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)\s*(\([^)]*\)?)", "fn", True),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+([A-Za-z_]\w*)", "type", False),
    ],
    "jvm": [(r"^\s*(?:public|private|protected|internal)?\s*(?:abstract\s+|final\s+|sealed\s+|static\s+)*(?:class|interface|enum|record|object)\s+([A-Za-z_]\w*)", "class", False)],
    "rb": [
        (r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)", "method", False),
        (r"^\s*(?:class|module)\s+([A-Z]\w*)", "class", False),
    ],
    "c": [
        (r"^[A-Za-z_][\w\s*]*\s\**([A-Za-z_]\w*)\s*(\([^;{)]*\)?)\s*\{?\s*$", "function", True),
        (r"^\s*(?:typedef\s+)?(?:struct|enum|union)\s+([A-Za-z_]\w*)", "type", False),
    ],
}
# The rules of each source extension.
LANGUAGE_OF = {
    ".ts": "js", ".tsx": "js", ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".py": "py", ".php": "py", ".go": "go", ".rs": "rs",
    ".java": "jvm", ".kt": "jvm", ".cs": "jvm", ".swift": "jvm", ".rb": "rb", ".c": "c", ".h": "c", ".cc": "c", ".cpp": "c", ".hpp": "c",
}
SOURCE_EXTENSIONS = tuple(LANGUAGE_OF)
SYMBOL = "struct<ord int, kind string, name string, signature string, line int, top_level boolean>"


def symbols_of(text: Column, rules: list[tuple[str, str, bool]], most: int = MAX_SYMBOLS) -> Column:
    """The first ``most`` symbols of a text as an array of structs without ``ord``, in line order."""

    def symbol(line: Column, i: Column) -> Column:
        found = [
            F.when(line.rlike(p), F.struct(
                F.lit(kind).alias("kind"), F.regexp_extract(line, p, 1).alias("name"),
                (trim_all(F.regexp_extract(line, p, 2)) if signed else F.lit("")).alias("signature"),
                (i + 1).cast("int").alias("line"), (~line.rlike(r"^\s")).alias("top_level")))
            for p, kind, signed in rules]
        return F.coalesce(*found)

    return F.slice(F.filter(F.transform(lines(text), symbol), lambda s: s.isNotNull()), 1, most)


def symbols(files: DataFrame, keys: list[str], path: str = "rel", text: str = "text", rules: str | None = None) -> DataFrame:
    """(keys, ord INT from 0, kind, name, signature, line, top_level) of each file, by the rules of its extension.

    ``rules`` names one rule set for all files instead, "any" all of them in order. Files of other extensions, null
    texts and empty texts give no rows. Each text stays in its row, so there is no shuffle.
    """
    ext = extension(F.col(path))
    if rules:
        chosen = [r for set_ in RULES.values() for r in set_] if rules == "any" else RULES[rules]
        found = symbols_of(F.col(text), chosen)
    else:
        found = F.coalesce(*[F.when(ext.isin(*[e for e, l in LANGUAGE_OF.items() if l == lang]), symbols_of(F.col(text), set_)) for lang, set_ in RULES.items()])
    return files.select(*keys, F.posexplode(found).alias("ord", "_s")).select(*keys, "ord", "_s.*")


_EDGE = r"(?<![A-Za-z0-9_])"
# Forms of a JavaScript specifier.
JS_SPECIFIERS = [_EDGE + r"from\s+[\"']([^\"']+)[\"']", _EDGE + r"import\s+[\"']([^\"']+)[\"']", _EDGE + r"require\(\s*[\"']([^\"']+)[\"']\s*\)", _EDGE + r"import\(\s*[\"']([^\"']+)[\"']\s*\)"]
IMPORT = "array<struct<specifier string, line int>>"


def _pairs(text: Column, per_line) -> Column:
    """Array of (specifier, line) from a function of a line to an array of specifiers."""
    found = F.transform(lines(text), lambda l, i: F.transform(per_line(l), lambda s: F.struct(s.alias("specifier"), (i + 1).cast("int").alias("line"))))
    return F.flatten(found)


def _one(line: Column, pattern: str) -> Column:
    return F.when(line.rlike(pattern), F.array(F.regexp_extract(line, pattern, 1)))


def _js(text: Column) -> Column:
    # each match is preceded by a copy of its specifier between two controls, so it stands on the line the match starts on
    one = lambda p: _pairs(F.regexp_replace(text, p, "\x01$1\x02$0"), lambda l: F.regexp_extract_all(l, F.lit("\x01([^\x02]*)\x02"), F.lit(1)))
    by_line = F.array_distinct(F.flatten(F.array(*[one(p) for p in JS_SPECIFIERS])))
    return F.array_sort(by_line, lambda a, b: a.line - b.line)


def _py(text: Column) -> Column:
    from_, import_ = r"^\s*from\s+(\.*[A-Za-z0-9_.]*)\s+import(?![A-Za-z0-9_])", r"^\s*import\s+(.+)$"
    names = lambda l: F.filter(F.transform(F.split(F.regexp_extract(l, import_, 1), ","), lambda p: F.trim(F.element_at(F.split(F.trim(p), r"\s+as\s+"), 1))), lambda n: n != "")
    return _pairs(text, lambda l: F.coalesce(_one(l, from_), F.when(l.rlike(import_), names(l)), F.array().cast("array<string>")))


def _rs(text: Column) -> Column:
    use, mod = r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z_]\w*)\s*;"
    return _pairs(text, lambda l: F.coalesce(F.transform(_one(l, use), F.trim), _one(l, mod), F.array().cast("array<string>")))


def _go(text: Column) -> Column:
    single, entry = r'^\s*import\s+(?:\w+\s+)?"([^"]+)"', r'^\s*(?:\w+\s+)?"([^"]+)"'
    numbered = F.transform(lines(text), lambda l, i: F.struct(l.alias("l"), (i + 1).cast("int").alias("n")))
    state = F.struct(F.lit(False).alias("open"), F.array().cast(IMPORT).alias("found"))

    def step(a: Column, x: Column) -> Column:
        pattern = F.when(a.open, F.when(x.l.rlike(entry), F.regexp_extract(x.l, entry, 1))).otherwise(F.when(x.l.rlike(single), F.regexp_extract(x.l, single, 1)))
        here = F.when(pattern.isNotNull(), F.array(F.struct(pattern.alias("specifier"), x.n.alias("line")))).otherwise(F.array()).cast(IMPORT)
        open_ = F.when(a.open, ~x.l.rlike(r"^\s*\)\s*$")).otherwise(x.l.rlike(r"^\s*import\s*\($"))
        return F.struct(open_.alias("open"), F.concat(a.found, here).alias("found"))

    return F.aggregate(numbered, state, step, lambda a: a.found)


def imports(files: DataFrame, keys: list[str], path: str = "rel", text: str = "text") -> DataFrame:
    """(keys, ord INT from 0, specifier, line INT): the imports of JavaScript, Python, Go and Rust files, by extension."""
    ext = extension(F.col(path))
    js = [e for e, l in LANGUAGE_OF.items() if l == "js"]
    found = F.when(ext.isin(*js), _js(F.col(text))).when(ext == ".py", _py(F.col(text))).when(ext == ".go", _go(F.col(text))).when(ext == ".rs", _rs(F.col(text)))
    return files.select(*keys, F.posexplode(found.cast(IMPORT)).alias("ord", "_i")).select(*keys, "ord", "_i.*")


# Extensions tried for a specifier without one, in order.
PROBES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs")


def normal_path(path: Column) -> Column:
    """Without ``.`` and ``..`` segments; leading ``..`` stay."""
    up = lambda a: (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), a), -1) != "..")
    step = lambda a, s: F.when((s == ".") | (s == ""), a).when((s == "..") & up(a), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve(found: DataFrame, files: DataFrame, group: list[str], path: str = "rel") -> DataFrame:
    """``found`` with ``resolved``: the file a relative specifier names, null for others and for files that aren't there.

    Candidates of each specifier meet the files of their group by an equi-join; the first that exists wins. ``found``
    must have unique (group, path, ord).
    """
    here, spec = F.when(F.instr(path, "/") > 0, F.concat(F.regexp_extract(path, r"^(.*)/[^/]*\z", 1), F.lit("/"))).otherwise(""), F.col("specifier")
    target = normal_path(F.concat(here, spec))
    js = F.concat(
        F.when(F.col("_t").rlike(r"[^/]\.[^./]*\z"), F.array("_t")).otherwise(F.array().cast("array<string>")), F.transform(F.array(*[F.lit(e) for e in PROBES]), lambda e: F.concat("_t", e)),
        F.transform(F.array(*[F.lit(e) for e in PROBES]), lambda e: F.concat("_t", F.lit("/index"), e)), F.array(F.concat("_t", F.lit("/__init__.py"))))
    dots, rest = F.length(F.regexp_extract(spec, r"^(\.+)", 1)), F.regexp_extract(spec, r"^\.+(.*)", 1)
    base = normal_path(F.concat(here, F.repeat(F.lit("../"), dots - 1), F.replace(rest, F.lit("."), F.lit("/"))))
    inside = lambda p: F.when(p == "", "__init__.py").otherwise(F.concat(p, F.lit("/__init__.py")))
    py = F.when(rest != "", F.array(F.concat("_p", F.lit(".py")), inside(F.col("_p")))).otherwise(F.array(inside(F.col("_p"))))
    rows = found.withColumn("_t", target).withColumn("_p", base)
    candidates = F.when(spec.startswith("."), F.when(extension(F.col(path)) == ".py", py).otherwise(js))
    tried = rows.select(*group, path, "ord", F.posexplode(candidates).alias("_n", "_c"))
    there = files.select(*group, F.col(path).alias("_c")).distinct()
    hit = tried.join(there, [*group, "_c"]).groupBy(*group, path, "ord").agg(F.min_by("_c", "_n").alias("resolved"))
    return found.join(hit, [*group, path, "ord"], "left")
