"""The queries of the engine over the tables of a directory, each over its whole tables.

Files are ``documents`` (key doc_id, grouped by repo), histories are ``commits``, outlines come from the texts or from
``symbols``, fields from ``bm25_docs``, sections from ``sections`` and packs from ``packs`` and ``explain_rows``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.functions.counter import Counter, Exact
from orrery.functions.glob import matches
from orrery.operators import baseline, bm25, budget, cochange, detect, evaluate, health, lookup, outline, rank, rot, sections, select
from orrery.operators.skew import cut
from orrery.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FLAGSHIP = "rank_with_query"
ABOUT = "release notes for the token counting queue"
MODULES = {"core": ["core/**", "pkg/core/**"], "checks": ["checks/**"], "web": ["web/**", "client/**"]}
DIFF = ["**/*.py", "**/*.ts", "**/*.tsx", "**/*.js", "**/*.go"]
GROUP, FILE = ["repo"], "doc_id"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def files(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("repo", "doc_id", "rel", "source", "text"))


def about_tokens(spark: SparkSession, about: str) -> list[str]:
    """Search tokens of a query, by the same function as those of texts."""
    return spark.range(1).select(T.search_tokens(F.lit(about)).alias("t")).first()["t"]


def sources(spark: SparkSession, d: str) -> DataFrame:
    """The files that are ranked: those with a source extension and a text."""
    return select.source_files(files(spark, d)).filter("text is not null and repo is not null")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return cut(outline.symbols(sources(spark, d), ["repo", "doc_id"]))


def counts(f: DataFrame, s: DataFrame) -> DataFrame:
    """(repo, doc_id, word, n) of the names that the texts hold."""
    return rank.name_counts(f, s, GROUP, FILE)


def round6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# text


@query
def token_units(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return files(spark, d).select("doc_id", T.other_units(t).cast("bigint").alias("other_units"), T.cjk_chars(t).cast("bigint").alias("cjk_chars"), T.approx_tokens(t).alias("tokens"))


@query
def token_budget_by_source(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).groupBy("source").agg(F.sum(T.approx_tokens(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("n_docs"))


@query
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    return rank.word_counts(files(spark, d), ["doc_id"]).groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query
def stem_vocab(spark: SparkSession, d: str) -> DataFrame:
    parts = T.exploded_parts(files(spark, d), [], "text").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return parts.select("part", T.stem(F.col("part")).alias("stem"), "n")


@query
def head_lines(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document its first twelve lines are."""
    return files(spark, d).select("doc_id", F.length(T.head_lines(F.col("text"), 12)).cast("bigint").alias("n_chars"))


def count_words(text: str) -> int:
    return len(text.split())


@query
def exact_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each source by an exact counter in place of the heuristic; here a token is a word."""
    other, cjk = Exact(lambda: count_words).columns(F.col("text"))
    return files(spark, d).groupBy("source").agg(F.sum(T.units_to_tokens(other, cjk)).cast("bigint").alias("tokens"))


# outlines


@query
def source_extensions(spark: SparkSession, d: str) -> DataFrame:
    """Ranked files by extension."""
    return sources(spark, d).groupBy(T.extension(F.col("rel")).alias("extension")).agg(F.count(F.lit(1)).alias("n_files"))


@query
def module_scan(spark: SparkSession, d: str) -> DataFrame:
    """All files of one module, of any type."""
    return select.module_files(files(spark, d).drop("text"), MODULES, "core").select("doc_id", "rel")


@query
def outline_symbols(spark: SparkSession, d: str) -> DataFrame:
    return outline.symbols(files(spark, d), ["doc_id"])


@query
def import_lines(spark: SparkSession, d: str) -> DataFrame:
    return outline.imports(files(spark, d), ["doc_id"]).select("doc_id", "specifier", "line").distinct()


@query
def import_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Relative imports of each file and the files that they name."""
    return import_targets(spark, d).filter(F.col("specifier").startswith(".")).select("repo", "rel", "specifier", "line", "resolved").distinct()


@query
def import_targets(spark: SparkSession, d: str) -> DataFrame:
    """Imports with the file of the same repository that they name."""
    f = files(spark, d).filter("rel is not null").groupBy("repo", "rel").agg(F.min("text").alias("text"))
    return outline.resolve(outline.imports(f, ["repo", "rel"]), f, GROUP)


# ranking


def _scores(spark: SparkSession, d: str, scorers: list[DataFrame]) -> DataFrame:
    f, s = sources(spark, d), symbols(spark, d)
    refs = rank.reference_scores(f, s, counts(f, s), GROUP, FILE)
    return rank.scored(refs.join(f.select("repo", "doc_id", "rel"), ["repo", "doc_id"]), GROUP, FILE, "rel", scorers)


def ties() -> list[Column]:
    """Order of ties in a rank: by path, then by key, as a path may be in a table twice."""
    return rank.by_path("rel", FILE)


def _about(spark: SparkSession, d: str) -> DataFrame:
    return bm25.bm25_texts(files(spark, d), about_tokens(spark, ABOUT), "doc_id", "text")


@query
def reference_rank(spark: SparkSession, d: str) -> DataFrame:
    return rank.ranked(_scores(spark, d, []), GROUP, ties()).select("repo", "doc_id", "score", "demotion", "rank")


@query
def rank_with_query(spark: SparkSession, d: str) -> DataFrame:
    """Every file's rank by references and by what the query asks for, with the parts of its score."""
    asked = bm25.contribution(_about(spark, d)).join(files(spark, d).select("doc_id", "repo"), "doc_id")
    return round6(rank.ranked(_scores(spark, d, [asked]).withColumn("score", F.round("score", 9)), GROUP, ties()).drop("rel"), "score", "reference", "scorers")


@query
def rank_explain(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 files of each repository with the parts of their scores."""
    asked = bm25.contribution(_about(spark, d)).join(files(spark, d).select("doc_id", "repo"), "doc_id")
    return round6(rank.top(_scores(spark, d, [asked]).withColumn("score", F.round("score", 9)), GROUP, ties(), 20).drop("rel"), "score", "reference", "scorers")


@query
def query_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The first ten files of each repository for a query, from which co-change starts."""
    asked = bm25.contribution(_about(spark, d)).join(files(spark, d).select("doc_id", "repo"), "doc_id")
    return rank.top(_scores(spark, d, [asked]).withColumn("score", F.round("score", 9)), GROUP, ties(), 10).select("repo", "doc_id", "rank")


@query
def elsewhere_top20(spark: SparkSession, d: str) -> DataFrame:
    own = sources(spark, d).filter(matches(F.col("rel"), MODULES["core"]))
    return rank.elsewhere(_scores(spark, d, []), own, ["repo", "doc_id"], GROUP, ties()).select("repo", "doc_id", "score", "rank")


def _outlined(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, symbols of the table, counts), all by repository and path; the outlined files are named by the texts."""
    f = sources(spark, d).groupBy("repo", "rel").agg(F.min("text").alias("text"))
    s = cut(table(spark, d, "symbols").filter("repo is not null and rel is not null and name is not null").select("symbol_id", "repo", "rel", "name").distinct())
    return f, s, rank.name_counts(f, s, GROUP, "rel")


@query
def symbol_references(spark: SparkSession, d: str) -> DataFrame:
    """How often the texts of a repository name the symbols of each of its outlined files."""
    _, s, n = _outlined(spark, d)
    return rank.references(n, s, GROUP, "rel")


@query
def diff_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Callers of each repository's outlined Python, TypeScript, JavaScript and Go files, as if those had changed."""
    f, s, n = _outlined(spark, d)
    seeds = s.filter(matches(F.col("rel"), DIFF)).select("repo", "rel")
    return round6(select.expansion(n, s, seeds, f, GROUP, "rel", "rel"), "score")


@query
def diff_selection(spark: SparkSession, d: str) -> DataFrame:
    """The changed files with their callers, each once."""
    f, s, n = _outlined(spark, d)
    seeds = s.filter(matches(F.col("rel"), DIFF)).select("repo", "rel").distinct()
    callers = select.expansion(n, s, seeds, f, GROUP, "rel", "rel")
    return seeds.withColumn("is_seed", F.lit(True)).unionByName(callers.select("repo", "rel", F.lit(False).alias("is_seed")))


# relevance


@query
def bm25_body(spark: SparkSession, d: str) -> DataFrame:
    return round6(_about(spark, d), "score")


def _fields(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "bm25_docs").groupBy("id", "field").agg(F.min_by("tokens", F.struct("indexed_at", "tokens")).alias("tokens"))
    return bm25.bm25(docs, ["baseline", "record", "path", "return", "value"], "id", field="field")


@query
def bm25_fields(spark: SparkSession, d: str) -> DataFrame:
    return round6(_fields(spark, d), "score")


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rank.top(_fields(spark, d).withColumn("score", F.round("score", 6)), [], "id", 20)


@query
def query_contribution(spark: SparkSession, d: str) -> DataFrame:
    return round6(bm25.contribution(_fields(spark, d)), "contribution")


# budgets


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """(repo, doc_id, rank, score, other, cjk): the ranked files with the sizes of their blocks."""
    f = sources(spark, d)
    block = F.concat(F.lit("### "), "rel", F.lit("\n\n```\n"), T.rstrip(F.col("text")), F.lit("\n```\n\n"))
    sized = T.with_sizes(f.select("repo", "doc_id", "rel", "text"), block).select("repo", "doc_id", "other", "cjk")
    return rank.ranked(_scores(spark, d, []), GROUP, ties()).select("repo", "doc_id", "rel", "score", "rank").join(sized, ["repo", "doc_id"])


@query
def repomap_prefix(spark: SparkSession, d: str) -> DataFrame:
    """How far an outline of each repository's files, most referenced first, reaches in 800 tokens."""
    line = F.concat(F.lit("- L"), F.col("line").cast("string"), F.lit(" "), "kind", F.lit(" `"), "name", "signature", F.lit("`\n"))
    outlines = T.with_sizes(symbols(spark, d), line).groupBy("repo", "doc_id").agg(F.sum("other").alias("_o"), F.sum("cjk").alias("_c"))
    head = F.concat(F.lit("## "), "rel", F.lit("\n"))
    best = rank.top(_scores(spark, d, []), GROUP, ties(), 800).join(outlines, ["repo", "doc_id"], "left")
    sized = best.select("repo", "doc_id", "rank", (T.other_units(head) + F.coalesce("_o", F.lit(0))).alias("other"), (T.cjk_chars(head) + F.coalesce("_c", F.lit(0))).alias("cjk"))
    return budget.prefix_cut(sized, GROUP, 800).select("repo", "doc_id", "rank", "tokens")


@query
def pack_greedy(spark: SparkSession, d: str) -> DataFrame:
    """The files of each repository, in rank order, that fit into a pack together."""
    return budget.greedy_fit(_blocks(spark, d), GROUP, 3000, header=(40, 0), reserve=50)


@query
def pack_explain(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 files of each repository and whether a pack of 3,000 tokens holds them."""
    blocks = cut(_blocks(spark, d))
    fitted = budget.greedy_fit(blocks, GROUP, 3000, header=(40, 0), reserve=50)
    return blocks.filter("rank <= 20").join(fitted, ["repo", "rank"]).select("repo", "doc_id", "score", "rank", "included")


@query
def pack_seeded(spark: SparkSession, d: str) -> DataFrame:
    """Packs led by each repository's rules and repository maps, however these sources are spelled."""
    marks = sources(spark, d).select("repo", "doc_id", F.coalesce(T.normal_source(F.col("source")).isin("rules", "repo_map"), F.lit(False)).alias("is_seed"))
    blocks = _blocks(spark, d).drop("rank").join(marks, ["repo", "doc_id"])
    order = rank.ranked(blocks.withColumn("score", F.col("score") + F.when(F.col("is_seed"), 1e9).otherwise(0.0)), GROUP, ties())
    return budget.seeded_fit(order.select("repo", "doc_id", "is_seed", "rank", "other", "cjk"), GROUP, 3000, header=(40, 0))


# baskets


def _history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = cochange.window_commits(table(spark, d, "commits"))
    return h, h.filter(matches(F.col("rel"), MODULES["core"])).select("repo", "rel").distinct()


@query
def cochange_gate(spark: SparkSession, d: str) -> DataFrame:
    return cochange.deep_enough(table(spark, d, "commits").filter("rel is not null"))


@query
def cochange_window(spark: SparkSession, d: str) -> DataFrame:
    h = cochange.window_commits(table(spark, d, "commits"))
    return h.groupBy("repo").agg(F.countDistinct("sha").alias("n_commits"), F.count(F.lit(1)).alias("n_files"))


@query
def cochange_sums(spark: SparkSession, d: str) -> DataFrame:
    return cochange.seed_sums(*_history(spark, d))


@query
def cochange_score(spark: SparkSession, d: str) -> DataFrame:
    h, seeds = _history(spark, d)
    return round6(cochange.cochange_scores(cochange.seed_sums(h, seeds), seeds), "contribution")


@query
def cochange_outside(spark: SparkSession, d: str) -> DataFrame:
    h, seeds = _history(spark, d)
    return cochange.outside(cochange.seed_sums(h, seeds), seeds, None, exclude=["docs/**", "migrations"])


@query
def cochange_baskets(spark: SparkSession, d: str) -> DataFrame:
    """The same on orders: parts that were ordered with parts of one brand."""
    baskets = table(spark, d, "lineitem").select(F.lit("orders").alias("repo"), F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("rel")).distinct()
    seeds = table(spark, d, "part").filter("p_brand = 'Brand#11'").select(F.lit("orders").alias("repo"), F.col("p_partkey").alias("rel"))
    return cochange.seed_sums(baskets, seeds).select("rel", "together")


# health


@query
def duplicate_definitions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").withColumn("path", F.concat_ws("/", "repo", "rel"))
    return health.duplicates(s, path="path")


@query
def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    return health.duplicate_names(duplicate_definitions(spark, d), path="path")


def _referenced(f: DataFrame, s: DataFrame) -> DataFrame:
    return health.referenced(counts(f, s), s, GROUP, FILE)


@query
def referenced(spark: SparkSession, d: str) -> DataFrame:
    """The outlined files with a symbol that a text of their repository names."""
    _, s, n = _outlined(spark, d)
    return health.referenced(n, s, GROUP, "rel")


@query
def orphans(spark: SparkSession, d: str) -> DataFrame:
    f, s = sources(spark, d), symbols(spark, d)
    return health.orphans(f, s, _referenced(f, s), GROUP, FILE, "rel", ["tools/**"]).select("repo", "doc_id")


@query
def uncovered(spark: SparkSession, d: str) -> DataFrame:
    return health.uncovered(files(spark, d), MODULES).select("doc_id", "rel")


@query
def constraint_only_in(spark: SparkSession, d: str) -> DataFrame:
    return health.only_in(table(spark, d, "symbols"), "StorePanel", ["core/**", "lib/**"]).select("symbol_id", "repo", "rel", "line").distinct()


@query
def constraint_imports(spark: SparkSession, d: str) -> DataFrame:
    found = outline.imports(files(spark, d), ["doc_id", "rel"])
    return health.must_not_import(found, ["**/*.py", "**/*.js"], ["**/token", "build/**", "../*.js"]).select("doc_id", "specifier", "line").distinct()


@query
def constraint_forbid_pattern(spark: SparkSession, d: str) -> DataFrame:
    return health.forbid_pattern(files(spark, d), ["doc_id"], r"set -euo pipefail|return nil, err", ["**/*.go", "**/*.md"])


@query
def secrets_scan(spark: SparkSession, d: str) -> DataFrame:
    return health.secret_lines(spread(table(spark, d, "packs").filter("pack_id is not null").select("pack_id", "content")), ["pack_id"], "content").distinct()


@query
def rule_length(spark: SparkSession, d: str) -> DataFrame:
    return health.long_texts(files(spark, d), ["doc_id"], 60)


@query
def stale_maps(spark: SparkSession, d: str) -> DataFrame:
    """Repository maps that are older than the newest code file of their repository, however the sources are spelled."""
    docs = table(spark, d, "documents").withColumn("source", T.normal_source(F.col("source")))
    built = docs.filter("source = 'repo_map' and updated_at is not null").select("repo", "doc_id", "updated_at")
    return health.stale(docs.filter("source = 'code'").withColumnRenamed("updated_at", "changed"), built, GROUP, "changed", "updated_at").groupBy("repo").agg(F.unix_micros(F.max("changed_at")).alias("changed_at"))


@query
def stale_first(spark: SparkSession, d: str) -> DataFrame:
    """The first code file of each repository that is newer than its newest map."""
    docs = table(spark, d, "documents").withColumn("source", T.normal_source(F.col("source")))
    built = docs.filter("source = 'repo_map' and updated_at is not null").groupBy("repo").agg(F.max("updated_at").alias("built"))
    return health.first_newer_of(docs.filter("source = 'code'"), built, GROUP, "rel", "updated_at", "built")


def _results(spark: SparkSession, d: str) -> DataFrame:
    packs = table(spark, d, "packs").filter("pack_id is not null")
    hits = health.secret_lines(packs, ["pack_id"], "content").distinct()
    at = F.concat(F.lit("pack "), F.col("pack_id").cast("string"))
    secrets = hits.select(F.lit("fail").alias("level"), F.lit("secrets").alias("name"), F.concat(at, F.lit(":"), F.col("line").cast("string"), F.lit(" looks like a secret")).alias("detail"), at.alias("file"), "line", F.lit(None).cast("string").alias("subject"))
    missing = packs.filter("tokens is null").select("pack_id").distinct().select(F.lit("warn").alias("level"), F.lit("tokens").alias("name"), F.concat(at, F.lit(" has no token count")).alias("detail"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("subject"))
    return secrets.unionByName(missing)


@query
def baseline_entries(spark: SparkSession, d: str) -> DataFrame:
    return baseline.entries(_results(spark, d))


@query
def baseline_ratchet(spark: SparkSession, d: str) -> DataFrame:
    """Results against a baseline that knows every secret above line 60."""
    results = _results(spark, d)
    return baseline.apply(results, baseline.entries(results.filter("line < 60")))


@query
def check_summary(spark: SparkSession, d: str) -> DataFrame:
    results = _results(spark, d)
    return baseline.apply(results, baseline.entries(results.filter("line < 60"))).groupBy("name", "level").agg(F.count(F.lit(1)).alias("n"))


@query
def check_failures(spark: SparkSession, d: str) -> DataFrame:
    """What decides the exit code."""
    results = _results(spark, d)
    return spark.createDataFrame([(baseline.failures(baseline.apply(results, baseline.entries(results.filter("line < 60")))),)], "n_failures bigint")


# rule documents


@query
def span_labels(spark: SparkSession, d: str) -> DataFrame:
    """What stands before the colon ahead of each span."""
    return rot.backticks(files(spark, d), ["doc_id"]).filter("label <> ''").select("doc_id", "line", "span_no", "text", "label")


@query
def span_commands(spark: SparkSession, d: str) -> DataFrame:
    """Spans that, as commands, may not end by themselves or are left out by the settings."""
    spans = rot.backticks(files(spark, d), ["doc_id"])
    return spans.filter(rot.non_terminating_reason(F.col("text"), F.col("label"), ["import"]).isNotNull()).select("doc_id", "line", "span_no", "text")


@query
def missing_paths(spark: SparkSession, d: str) -> DataFrame:
    """Spans that look like a path and name none of the files."""
    f = files(spark, d)
    return rot.missing_paths(rot.backticks(f, ["doc_id"]), f.filter("rel is not null").select("rel")).select("doc_id", "line", "span_no", "text")


@query
def fence_strip(spark: SparkSession, d: str) -> DataFrame:
    kept = F.filter(rot.strip_fences(F.col("text")), lambda l: l != "")
    return files(spark, d).select("doc_id", F.size(kept).cast("bigint").alias("n_lines"), F.length(F.array_join(kept, "")).cast("bigint").alias("n_chars"))


@query
def section_scope(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of each document stand under a heading called Overview."""
    return files(spark, d).select("doc_id", F.size(rot.section_lines(T.lines(F.col("text")), "overview")).cast("bigint").alias("n_lines")).filter("n_lines > 0")


@query
def backtick_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = rot.backticks(files(spark, d), ["doc_id"])
    return spans.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(rot.is_path_candidate(F.col("text")).cast("bigint")).alias("n_paths"))


# sections


@query
def section_split(spark: SparkSession, d: str) -> DataFrame:
    """Sections of every document."""
    s = sections.split_sections(files(spark, d), "doc_id", "text")
    return s.select("doc_id", "section_ord", "heading", F.length("body").cast("bigint").alias("n_chars"))


@query
def section_search(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").select("section_id", "heading", "body").distinct()
    return sections.search(s, "token", ["section_id"], 5).select("section_id", "score")


@query
def section_budget(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").select("section_id", "heading", "body").distinct()
    return sections.within_budget(sections.search(s, "token", ["section_id"], 20), ["section_id"], 4000).select("section_id", "rank", "tokens")


@query
def section_context(spark: SparkSession, d: str) -> DataFrame:
    """What an answer of 8,000 tokens to a search holds, its header counted."""
    s = table(spark, d, "sections").select("section_id", "heading", "body").distinct()
    head = Counter().sizes('<!-- sections for "token" -->\n')
    return sections.within_budget(sections.search(s, "token", ["section_id"], 20), ["section_id"], 8000, head).select("section_id", "rank", "tokens")


# lookup, evaluation, detection


@query
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return lookup.find_symbols(table(spark, d, "symbols").select("symbol_id", "repo", "rel", "kind", "name").distinct(), "PANEL").select("symbol_id", "name")


@query
def symbol_refs30(spark: SparkSession, d: str) -> DataFrame:
    return lookup.reference_lines(files(spark, d), "return", ["doc_id"], ["doc_id"])


def _evaluated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Tasks: the packs with a question, each expecting the file that its ranking put first; a pack without one has none."""
    packs = table(spark, d, "packs").filter("about is not null").select("pack_id", "profile").distinct()
    rows = table(spark, d, "explain_rows").groupBy("pack_id", "rel").agg(F.max(F.coalesce("final_score", F.lit(-1.0))).alias("s"), F.max(F.coalesce("included", F.lit(False))).alias("included"))
    first = rows.groupBy("pack_id").agg(F.min(F.struct((-F.col("s")).alias("s"), "rel")).alias("b")).select("pack_id", F.col("b.rel").alias("expect_file"))
    tasks = packs.select("pack_id").join(first, "pack_id", "left").select(F.col("pack_id").alias("id"), "expect_file")
    items = rows.join(packs, "pack_id").groupBy("profile", "rel").agg(F.lit(True).alias("in_outline"), F.max("included").alias("included"))
    return tasks, items


@query
def eval_cells(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.cells(["light", "mid"], *_evaluated(spark, d))


@query
def eval_rates(spark: SparkSession, d: str) -> DataFrame:
    return round6(evaluate.rates(evaluate.cells(["light", "mid"], *_evaluated(spark, d))), "outline_rate", "content_rate")


@query
def eval_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.matrix(["light", "mid"], ["small", "large"], _evaluated(spark, d)[0]).groupBy("profile", "model").agg(F.count(F.lit(1)).alias("n_calls"))


@query
def graded_answers(spark: SparkSession, d: str) -> DataFrame:
    """Sections as answers: which ones say what was expected."""
    s = table(spark, d, "sections").select("section_id", "repo", "body").distinct()
    graded = s.withColumn("passed", evaluate.passed(F.col("body"), F.array(F.lit("Token"), F.lit("snapshot")))).withColumn("profile", F.col("repo")).withColumn("model", F.lit("text"))
    return evaluate.pass_rates(graded).select("profile", "n", F.round("rate", 6).alias("rate"))


@query
def answer_clips(spark: SparkSession, d: str) -> DataFrame:
    """Each section as an answer is shown in a report."""
    return table(spark, d, "sections").select("section_id", evaluate.clip(F.col("body")).alias("answer")).distinct()


@query
def pass_percent(spark: SparkSession, d: str) -> DataFrame:
    return graded_answers(spark, d).select("profile", evaluate.percent(F.col("rate")).alias("percent"))


@query
def module_detect(spark: SparkSession, d: str) -> DataFrame:
    return detect.modules(table(spark, d, "commits").filter("rel is not null").select("repo", "rel").distinct(), GROUP)


@query
def module_match_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files of each module; a module that matches none has rotted."""
    return health.module_counts(files(spark, d), MODULES)
