"""The evidence gate: which hits support an answer, and whether they suffice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlake.functions.text import tokenize
from loamlake.plans.config import EvidenceConfig

# Fixed values of the classes, whatever the settings.
FULL, HALF = 0.999, 0.60
LEXICAL_TOP, VECTOR_TOP = 10, 5


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(part).cast("double"), F.size(whole).cast("double")), F.lit(0.0))


def classify(hits: DataFrame, config: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """hits with evidence_class (direct, partial, weak), coverages, terms_covered, exact_phrase, distributed_strong and strong_partial.

    hits: qid, terms (distinct), titulo, texto, rank, rank_/score_ of both rankings (null: not in it).
    """
    df = hits.withColumns({"title_tokens": tokenize(F.col("titulo")), "text_tokens": tokenize(F.col("texto"))})
    within = lambda tokens: F.filter("terms", lambda t: F.array_contains(tokens, t))
    phrase = F.array_join("terms", " ")
    df = df.withColumns(
        {
            "terms_covered": F.filter("terms", lambda t: F.array_contains("title_tokens", t) | F.array_contains("text_tokens", t)),
            "title_coverage": _share(within(F.col("title_tokens")), F.col("terms")),
            "text_coverage": _share(within(F.col("text_tokens")), F.col("terms")),
            "exact_phrase": (phrase != "") & (F.contains(F.array_join("title_tokens", " "), phrase) | F.contains(F.array_join("text_tokens", " "), phrase)),
            "lexical_hit": F.col("rank_lexical").isNotNull() & (F.coalesce("score_lexical", F.lit(0.0)) > 0),
            "vector_hit": F.col("rank_vector").isNotNull() & (F.coalesce("score_vector", F.lit(0.0)) > 0),
        }
    )
    df = df.withColumn("term_coverage", _share(F.col("terms_covered"), F.col("terms"))).drop("title_tokens", "text_tokens")
    yes = lambda c: F.coalesce(c, F.lit(False))
    lexical, vector = F.col("lexical_hit"), F.col("vector_hit")
    top_lexical, top_vector = yes(lexical & (F.col("rank_lexical") <= LEXICAL_TOP)), yes(vector & (F.col("rank_vector") <= VECTOR_TOP))
    coverage, title, text, exact = F.col("term_coverage"), F.col("title_coverage"), F.col("text_coverage"), F.col("exact_phrase")
    direct = (coverage >= FULL) & top_lexical & (exact | (title >= FULL) | (text >= FULL))
    partial = ((coverage >= HALF) & (lexical | top_vector)) | (~lexical & top_vector & (coverage > 0))
    df = df.withColumn("evidence_class", F.when(direct, "direct").when(partial, "partial").otherwise("weak"))
    enough = config.single_min_coverage
    spread = (F.size("terms") >= 4) & (F.size("terms_covered") >= 4) & (coverage >= enough) & top_vector & yes(lexical & (F.col("rank_lexical") == 1)) & (F.col("rank") == 1)
    df = df.withColumn("distributed_strong", spread)
    strong = (
        (F.col("evidence_class") == "partial")
        & F.lit(config.single_allow_strong_partial)
        & (F.size("terms") >= 2)
        & (F.size("terms_covered") >= config.single_min_matched_terms)
        & (coverage >= enough)
        & yes(lexical & (F.col("rank_lexical") <= config.single_max_lexical_rank))
        & (F.col("rank") <= config.single_max_lexical_rank)
        & (exact | (title >= enough) | (text >= enough) | F.col("distributed_strong"))
        & (top_vector | exact | (title >= enough))
    )
    return df.withColumn("strong_partial", strong)


def decide(questions: DataFrame, classified: DataFrame, config: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """One row per question: counts, coverage, sufficient, decision and reason. questions: qid, terms."""
    source = F.coalesce(*[F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in ("url", "documento_id") if c in classified.columns], F.col("id").cast("string"))
    support = F.col("evidence_class").isin("direct", "partial")
    is_ = lambda c: F.count_if(F.col("evidence_class") == c)
    # the strongest single source: the first direct one, else the first strong partial one
    place = F.when(F.col("evidence_class") == "direct", F.col("rank")).when(F.col("strong_partial"), F.col("rank") + 1_000_000)
    first = F.min_by(F.struct(F.col("term_coverage").alias("coverage"), F.size("terms_covered").alias("matched"), "title_coverage", "rank_lexical"), place)
    sums = classified.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_sources"),
        is_("direct").alias("n_direct"),
        is_("partial").alias("n_partial"),
        is_("weak").alias("n_weak"),
        F.count_if("strong_partial").alias("n_strong_partial"),
        F.count_if(support & F.col("rank_lexical").isNotNull()).alias("n_lexical"),
        F.countDistinct(F.when(support, source)).alias("n_distinct_sources"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(support, F.col("terms_covered")))))).alias("n_covered"),
        F.when(F.count(place) > 0, first).alias("strongest"),
    )
    counts = ["n_sources", "n_direct", "n_partial", "n_weak", "n_strong_partial", "n_lexical", "n_distinct_sources", "n_covered"]
    df = questions.select("qid", "terms").join(sums, "qid", "left").fillna(0, counts)
    df = df.withColumn("coverage", F.coalesce(F.try_divide(F.col("n_covered").cast("double"), F.size("terms").cast("double")), F.lit(0.0)))
    if not config.enabled:
        return df.withColumns({"sufficient": F.lit(True), "decision": F.lit("disabled"), "reason": F.lit("evidence_check_disabled")}).drop("strongest")
    defensible, relevant, s = F.col("n_direct") + F.col("n_strong_partial"), F.col("n_direct") + F.col("n_partial"), F.col("strongest")
    covered = F.col("coverage") >= config.min_query_term_coverage
    several = (F.col("n_direct") >= config.min_direct_sources) & (defensible >= config.min_total_relevant_sources) & covered & (F.col("n_lexical") >= config.min_lexical_matched_sources)
    title_ok = (s["title_coverage"] >= config.single_min_coverage) if config.single_require_title_match else F.lit(True)
    single = F.lit(config.allow_single_strong_source) & s.isNotNull() & (s["coverage"] >= config.single_min_coverage) & (s["matched"] >= config.single_min_matched_terms) & title_ok & (s["rank_lexical"] <= config.single_max_lexical_rank)
    reason = (
        F.when(F.col("n_sources") == 0, "no_results")
        .when(F.lit(config.reject_all_weak) & (F.col("n_weak") == F.col("n_sources")), "all_sources_weak")
        .when(several | F.coalesce(single, F.lit(False)), "evidence_accepted")
        .when(~covered, "insufficient_term_coverage")
        .when(F.col("n_direct") < config.min_direct_sources, "insufficient_direct_sources")
        .when(relevant < config.min_total_relevant_sources, "insufficient_relevant_sources")
        .when(F.col("n_lexical") < config.min_lexical_matched_sources, "ambiguous_matches")
        .otherwise("insufficient_relevant_sources")
    )
    df = df.withColumn("reason", reason).withColumn("sufficient", F.col("reason") == "evidence_accepted")
    return df.withColumn("decision", F.when(F.col("sufficient"), "accepted").otherwise("refused")).drop("strongest")


def context_sources(classified: DataFrame, decisions: DataFrame, config: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """Hits of accepted questions that make the context: direct ones first, then strong partial ones, each by rank (context_rank)."""
    ok = decisions.where("sufficient").select("qid")
    kept = classified.join(ok, "qid", "left_semi")
    if config.enabled:
        kept = kept.where("evidence_class = 'direct' or strong_partial")
        order = Window.partitionBy("qid").orderBy(F.when(F.col("evidence_class") == "direct", 0).otherwise(1), "rank")
    else:
        order = Window.partitionBy("qid").orderBy("rank")
    return kept.withColumn("context_rank", F.row_number().over(order))


def public_sources(classified: DataFrame, decisions: DataFrame, config: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """What a caller may see: the context of accepted questions, and the direct hits of refused ones."""
    no = decisions.where("not sufficient").select("qid")
    refused = classified.where("evidence_class = 'direct'").join(no, "qid", "left_semi").withColumn("context_rank", F.col("rank"))
    return context_sources(classified, decisions, config).unionByName(refused)
