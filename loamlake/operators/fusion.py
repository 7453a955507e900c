"""Weighted reciprocal rank fusion, fallbacks, and dedup by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamlake.plans.config import RetrievalConfig

DIGITS = 12
NO_RANK = 10**9


#: Hits up to this number are sent to the chunks by their ids; above, both sides are shuffled.
SENT = 5_000_000


def of_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that any hit names. hits are read twice, so they should be kept; texts of other chunks don't move."""
    ids = hits.select("id").distinct()
    return chunks.join(F.broadcast(ids) if hits.count() <= SENT else ids, "id", "left_semi")


def known_only(vector_hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vector hits that the text table knows, ranked anew by their order."""
    order = Window.partitionBy("qid").orderBy("rank_vector")
    return vector_hits.join(of_hits(vector_hits, chunks.select("id")), "id", "left_semi").withColumn("rank_vector", F.row_number().over(order))


def fuse(vector_hits: DataFrame, lexical_hits: DataFrame, config: RetrievalConfig = RetrievalConfig(), mode: str = "hybrid") -> DataFrame:
    """(qid, id, score_*, rank_*, mode, score, rank): both rankings of each question as one.

    A question without lexical hits keeps its vector ranking; ties go to the better vector rank, then the
    better lexical one, then the smaller id. The modes vector and lexical pass one ranking through.
    """
    k, wv, wl = config.rrf_k, config.vector_weight, config.lexical_weight
    v = vector_hits.select("qid", "id", "score_vector", "rank_vector")
    l = lexical_hits.select("qid", "id", "score_lexical", "rank_lexical")
    if mode == "vector" or not config.hybrid_enabled or not config.lexical_enabled:
        both = v.withColumns({"score_lexical": F.lit(None).cast("double"), "rank_lexical": F.lit(None).cast("int"), "mode": F.lit("vector"), "score": F.col("score_vector")})
    elif mode == "lexical":
        both = l.select("qid", "id", F.lit(None).cast("double").alias("score_vector"), F.lit(None).cast("int").alias("rank_vector"), "score_lexical", "rank_lexical").withColumns({"mode": F.lit("lexical"), "score": F.col("score_lexical")})
    else:
        both = v.join(l, ["qid", "id"], "full_outer")
        share = lambda w, rank: F.coalesce(F.lit(w) / (F.lit(k) + F.col(rank)), F.lit(0.0))
        some = F.count("rank_lexical").over(Window.partitionBy("qid")) > 0
        fused = F.round(share(wv, "rank_vector") + share(wl, "rank_lexical"), DIGITS)
        both = both.withColumn("mode", F.when(some, F.lit("hybrid")).otherwise(F.lit("hybrid_fallback_vector")))
        both = both.withColumn("score", F.when(F.col("mode") == "hybrid", fused).otherwise(F.col("score_vector")))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.coalesce("rank_vector", F.lit(NO_RANK)), F.coalesce("rank_lexical", F.lit(NO_RANK)), "id")
    return both.withColumn("rank", F.row_number().over(order))


def dedup_sources(hits: DataFrame, limit: int, per_source: int = 1) -> DataFrame:
    """At most per_source hits of each source (url, else documento_id, else id), then the first ``limit``, ranked anew."""
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))
    source = F.coalesce(*[blank(c) for c in ("url", "documento_id") if c in hits.columns], F.col("id").cast("string"))
    within = Window.partitionBy("qid", "source_key").orderBy("rank")
    order = Window.partitionBy("qid").orderBy("rank")
    kept = hits.withColumn("source_key", source).withColumn("n", F.row_number().over(within)).where(F.col("n") <= per_source)
    return kept.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= limit).drop("n", "rank").withColumnRenamed("final_rank", "rank")
