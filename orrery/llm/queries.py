"""The pN_ queries over the tables of a directory, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm import cooccurrence, copies, credentials, language, leximin, mixing, packing, relevance, split
from orrery.llm import sizes as sizing
from orrery.operators.skew import cut
from orrery.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# 1: one ranking from several differently scaled scores


@query
def p1_rank(spark: SparkSession, d: str) -> DataFrame:
    """(pack_id, rel, reference_percentile, query_percentile, demotion, position) of every explained file."""
    ranked = leximin.leximin(table(spark, d, "explain_rows"), "pack_id", "rel", ["reference_score", "query_score"], "demotion", "logged_at")
    return ranked.select("pack_id", "rel", F.round("reference_score_percentile", 9).alias("reference_percentile"), F.round("query_score_percentile", 9).alias("query_percentile"), "demotion", "position")


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_rank(spark, d).filter("position = 1").select("pack_id", "rel")


# 2: items that appear together


@query
def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of files that a commit names, with its counts, lift and odds ratio."""
    return cooccurrence.pairs(table(spark, d, "commits"))


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.pairs(table(spark, d, "commits"), max_files=50, least=5, times_chance=4.0).select("repo", "rel_a", "rel_b")


# 4: splitting oversized items at natural boundaries


@query
def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """(limit_name, section_id, heading, piece_no, n_pieces, tokens, overlap, text) for each limit of sections.

    ``size_limits`` is a table of fixed size: its rows are the parameters of this query.
    """
    limits = table(spark, d, "size_limits").filter("applies_to = 'sections'").select("limit_name", "max_tokens", "overlap_tokens").orderBy("limit_name").collect()
    sections = table(spark, d, "sections")
    heads = sections.filter("section_id is not null").groupBy("section_id").agg(F.min("heading").alias("heading"))
    out = None
    for name, most, overlap in limits:
        p = split.pieces(sections, "section_id", "body", most, overlap or 0).withColumn("limit_name", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out.join(heads, "section_id").select("limit_name", "section_id", "heading", "piece_no", "n_pieces", "tokens", "overlap", "text")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).filter("n_pieces > 1 and piece_no = 1").select("limit_name", "section_id")


@query
def p4_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of each section, without their overlaps, are its body, and all are within the limit."""
    limits = table(spark, d, "size_limits").select("limit_name", "max_tokens")
    core = F.substr("text", F.length("overlap") + 1)
    parts = p4_pieces(spark, d).join(limits, "limit_name").groupBy("limit_name", "section_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", core.alias("core")))), lambda p: p.core), "").alias("_all"), F.max(F.col("tokens") - F.col("max_tokens")).alias("_over"))
    bodies = table(spark, d, "sections").filter("section_id is not null").groupBy("section_id").agg(F.min("body").alias("body"))
    return parts.join(bodies, "section_id").select("limit_name", "section_id", (F.col("_all") == F.col("body")).alias("whole"), (F.col("_over") <= 0).alias("within"))


# 5: duplicates hidden by formatting differences


@query
def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """(first_id, name, signature, copies): one record for each definition; one without a signature has no other copy."""
    return copies.records(copies.keyed(table(spark, d, "symbols"), all_rows=True)).select("first_id", "name", "signature", "copies")


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.members(copies.keyed(table(spark, d, "symbols"))).filter("copy_id <> first_id").select("first_id", "copy_id")


# 6: how distinctive a term is per record


@query
def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    """(id, field, term, tf, df, score) of every row; paths, symbols and bodies are collections of their own."""
    return relevance.term_weights(table(spark, d, "bm25_docs"), collection=["field"]).withColumn("score", F.round("score", 6))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return relevance.top_term(relevance.term_weights(table(spark, d, "bm25_docs").filter("field = 'body'")))


# 3: credentials embedded in source code


@query
def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """(pack_id, content, n_redacted): every pack with its credentials replaced."""
    return credentials.redacted(spread(table(spark, d, "packs").select("pack_id", "content")), "pack_id", "content")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credentials(spread(table(spark, d, "packs").select("pack_id", "content")), "pack_id", "content").select("pack_id", "line_no").distinct()


#: Lines with a credential each: a token, a connection string, a signed token and a wrapped key, of any length.
PLANTED = ("t = 'ghp_" + "a1B2" * 9 + "'", "dsn: postgres://svc:" + "Q7wz" * 75 + "@db.internal/x", "jwt=eyJ" + "hbG1" * 1250 + ".eyJ" + "c3V1" * 50 + "." + "Sg5k" * 20,
           "tls: LS0tLS1CRUdJTiBQUklWQVRFIEtFWS0tLS0tCk" + "1JSUV2" * 900)


@query
def p3_planted(spark: SparkSession, d: str) -> DataFrame:
    """(pack_id, line_no) of the credentials found in lines that were put behind each content."""
    packs = spread(table(spark, d, "packs").filter("pack_id is not null and content is not null").select("pack_id", "content"))
    planted = packs.select("pack_id", F.concat_ws("\n", "content", *map(F.lit, PLANTED)).alias("content"))
    ends = packs.select("pack_id", F.size(F.split("content", "\n", -1)).alias("_n")).distinct()
    found = credentials.credentials(planted, "pack_id", "content").join(ends, "pack_id").filter("line_no > _n")
    return found.select("pack_id", "line_no").distinct()


# 7: filling fixed-capacity containers


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    capacity = table(spark, d, "size_limits").filter("limit_name = 'document_container'").first()["max_tokens"]
    sizes = cut(sizing.token_counts(spread(table(spark, d, "documents").select("doc_id", "text"))))
    return packing.pack(sizes, "doc_id", "n_tokens", capacity), capacity


@query
def p7_parts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, part_no, n_parts, start, end, container_id): where each document's tokens are."""
    return _packed(spark, d)[0]


@query
def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    packed, capacity = _packed(spark, d)
    return packing.containers(packed, capacity)


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0].filter("n_parts > 1 and part_no = 1").select("doc_id")


# 8: mixing sources to target weights


#: The budget of the mixtures, as a share of all tokens of the named sources.
OF_CORPUS = 0.5


def _mixed(spark: SparkSession, d: str, how: str) -> tuple[DataFrame, DataFrame, float]:
    """(selection, (source, target_share, natural_share, weight, max_repeats, smallest), budget).

    ``how``: "limits" bisects the exponent from the targets on until no source exceeds its repetition limit, "entropy"
    the plain temperature until the weights have the targets' entropy, "targets" takes the largest budget that needs no
    exponent.
    """
    goals = table(spark, d, "mix_targets").filter("source is not null and target_share is not null").collect()
    targets, repeats = {r["source"]: r["target_share"] for r in goals}, {r["source"]: r["max_repeats"] for r in goals}
    documents = spread(table(spark, d, "documents").select("doc_id", mixing.normal_source(F.col("source")).alias("source"), "text"))
    sized = cut(sizing.token_counts(documents.filter(F.col("source").isin(*targets))))
    sizes = mixing.source_sizes(sized, "source", "n_tokens", list(targets))
    wanted = OF_CORPUS * sum(sizes.values())
    if how == "entropy":
        budget, _, weights = mixing.plan_entropy(sizes, mixing.entropy(mixing.normalised(targets)), repeats, wanted)
    else:
        budget, _, weights = mixing.plan(sizes, targets, repeats, wanted if how == "limits" else None)
    chosen = mixing.select(sized, "doc_id", "source", "n_tokens", {k: budget * w for k, w in weights.items()}, sizes, repeats)
    natural = max(1, sum(sizes.values()))
    rows = [(k, float(t), sizes.get(k, 0) / natural, weights.get(k, 0.0), int(repeats[k] or 1)) for k, t in targets.items()]
    return chosen, spark.createDataFrame(rows, "source string, target_share double, natural_share double, weight double, max_repeats int"), budget


def _shares(spark: SparkSession, d: str, how: str) -> DataFrame:
    chosen, sources, _ = _mixed(spark, d, how)
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    got = got.withColumn("_all", F.sum("tokens").over(Window.partitionBy(F.lit(1))))  # one row per target
    shares = sources.join(got, "source", "left")
    return shares.select("source", "target_share", "natural_share", "weight", F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"),
                         F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))


@query
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, n_tokens, repeats): half of the corpus in shares as near to the targets as the repetition limits
    let one exponent come."""
    return _mixed(spark, d, "limits")[0]


@query
def p8_mix_shares(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d, "limits")


@query
def p8_mix_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source of ``p8_mix`` holds its weight of the budget, to 1 % or to its smallest document that could be
    used once more, within its limit."""
    chosen, sources, budget = _mixed(spark, d, "limits")
    documents = spread(table(spark, d, "documents").select("doc_id", mixing.normal_source(F.col("source")).alias("source"), "text"))
    used = sizing.token_counts(documents).filter("n_tokens > 0").join(chosen.select("doc_id", "repeats"), "doc_id", "left").withColumn("repeats", F.coalesce("repeats", F.lit(0)))
    by = used.groupBy("source", "repeats").agg(F.min("n_tokens").alias("least"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    by = by.groupBy("source").agg(F.min_by("least", "repeats").alias("least"), F.sum("tokens").alias("tokens"), F.max("repeats").alias("most"))
    due = F.lit(budget) * F.col("weight")
    off = due - F.coalesce("tokens", F.lit(0))
    return sources.join(by, "source", "left").select(
        "source", ((off >= -1e-6) & (off <= F.greatest(due * 0.01, F.coalesce("least", F.lit(0)).cast("double")) + 1e-6)).alias("holds_weight"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_limit"))


@query
def p8_entropy_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of a plain temperature mixture of the same budget, as even as the targets are."""
    return _shares(spark, d, "entropy")


@query
def p8_target_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the largest selection that meets the targets themselves."""
    return _shares(spark, d, "targets")


# 9: missing or wrong document language labels


@query
def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, language, share, confidence) of each language in a document's prose."""
    documents = spread(table(spark, d, "documents").select("doc_id", "lang", "text"))
    return language.languages(documents, language.profiles_of(documents))


@query
def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents").select("doc_id", "lang", "text"))
    return language.language_segments(documents, language.profiles_of(documents))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents").select("doc_id", "lang", "text"))
    return language.mislabelled(language.languages(documents, language.profiles_of(documents)), documents)
