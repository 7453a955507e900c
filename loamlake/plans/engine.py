"""The two dataflows that callers use: asking many questions at once, and loading sources into the lake."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Self

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamlake.functions.text import expand_terms, query_terms
from loamlake.operators.context import AnswerProvider, answers, pack_context
from loamlake.operators.embed import HashingEmbedder
from loamlake.operators.evidence import classify, context_sources, decide, public_sources
from loamlake.operators.fusion import dedup_sources, fuse, known_only, of_hits
from loamlake.operators.lexical import LexicalIndex, lexical_search
from loamlake.operators.vector import vector_search
from loamlake.plans.config import TOP_K, AnswerConfig, EvidenceConfig, RetrievalConfig, valid_mode, valid_top_k


#: As many different questions are sent to those that are equal to them.
FEW = 100_000
#: What a caller may see of a question's measures.
PUBLIC_METRICS = ("n_sources", "n_direct", "n_partial", "n_weak", "n_strong_partial", "n_lexical", "n_distinct_sources", "n_covered", "coverage")


def public_metrics(decisions: DataFrame) -> DataFrame:
    """(qid, metrics map) of the measures in PUBLIC_METRICS that are known."""
    pairs = [x for m in PUBLIC_METRICS if m in decisions.columns for x in (F.lit(m), F.col(m).cast("double"))]
    return decisions.select("qid", F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("metrics"))


@dataclass
class Engine:
    """Searches chunks (id, documento_id, titulo, texto, url, categoria, autor, ...) and their vectors (id, vector)."""

    chunks: DataFrame
    vectors: DataFrame
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    evidence: EvidenceConfig = field(default_factory=EvidenceConfig)
    answer: AnswerConfig = field(default_factory=AnswerConfig)
    embedder: HashingEmbedder = field(default_factory=HashingEmbedder)
    _index: LexicalIndex | None = None
    _kept: list[DataFrame] = field(default_factory=list)

    def __enter__(self) -> Self:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Lets go of the index and of what was kept for questions; their results can't be read any more without being made anew."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()
        if self._index is not None:
            self._index.close()
            self._index = None

    def keep(self, df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
        """df held until close()."""
        self._kept.append(df.persist(level))
        return df

    @property
    def index(self) -> LexicalIndex:
        """Built at the first use and kept."""
        if self._index is None:
            self._index = LexicalIndex.build(self.chunks, self.retrieval)
        return self._index

    def prepare(self, questions: DataFrame) -> DataFrame:
        """questions (qid, question) with terms; blank questions are an error."""
        checked = F.when(F.trim(F.coalesce("question", F.lit(""))) == "", F.raise_error(F.lit("a question is blank"))).otherwise(F.col("question"))
        return questions.select("qid", checked.alias("question")).withColumn("terms", query_terms(F.col("question"), self.retrieval.stopwords))

    def search(self, questions: DataFrame, top_k: int = TOP_K, mode: str = "hybrid") -> DataFrame:
        """Ranked hits: qid, id, scores and ranks of both legs, mode, score, rank and the chunk's columns."""
        valid_top_k(top_k)
        valid_mode(mode)
        most = max(top_k, self.retrieval.initial_candidates)
        asked = self.prepare(questions) if "terms" not in questions.columns else questions
        # a text that is asked many times is searched once, under the least of its qids
        asked = self.keep(asked.select("qid", "question", "terms"))
        once = self.keep(asked.groupBy("question", "terms").agg(F.min("qid").alias("qid")))
        expanded = once.select("qid", expand_terms(F.col("terms")).alias("terms"))
        empty = once.select("qid", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("int").alias("r")).limit(0)
        if mode != "lexical":
            embedded = once.select("qid", self.embedder.vector(F.col("question")).alias("vector"))
            near = known_only(self.keep(vector_search(self.vectors, embedded, most)), self.chunks)
        else:
            near = empty.select("qid", "id", F.col("s").alias("score_vector"), F.col("r").alias("rank_vector"))
        if mode != "vector":
            found = lexical_search(self.index, expanded, most, self.retrieval)
        else:
            found = empty.select("qid", "id", F.col("s").alias("score_lexical"), F.col("r").alias("rank_lexical"))
        fused = self.keep(fuse(near, found, self.retrieval, mode))
        hits = fused.join(of_hits(fused, self.chunks), "id")
        hits = dedup_sources(hits, min(top_k, self.retrieval.final_sources), self.retrieval.max_chunks_per_source)
        n = once.count()
        if n == asked.count():
            return hits
        named = once.select(F.col("qid").alias("_of"), F.col("question").alias("_question"), F.col("terms").alias("_terms"))
        pairs = asked.join(F.broadcast(named) if n <= FEW else named, F.col("question").eqNullSafe(F.col("_question")) & F.col("terms").eqNullSafe(F.col("_terms"))).select("qid", "_of")
        return pairs.join(hits.withColumnRenamed("qid", "_of"), "_of").drop("_of")

    def judge(self, questions: DataFrame, top_k: int = TOP_K, mode: str = "hybrid") -> tuple[DataFrame, DataFrame, DataFrame]:
        """(questions with terms, classified hits, one decision per question)."""
        asked = self.prepare(questions)
        # a few rows for each question, read by the decision, the context and the public sources
        classified = self.keep(classify(self.search(asked, top_k, mode).join(asked.select("qid", "terms"), "qid"), self.evidence))
        return asked, classified, decide(asked, classified, self.evidence)

    def ask(self, questions: DataFrame, top_k: int = TOP_K, mode: str = "hybrid", provider: AnswerProvider | None = None) -> DataFrame:
        """One row per question: answer, llm_skipped, decision, counts and sources (the public ones, in order)."""
        asked, classified, decisions = self.judge(questions, top_k, mode)
        contexts = pack_context(context_sources(classified, decisions, self.evidence), self.answer)
        said = answers(asked, decisions, contexts, provider)
        shown = public_sources(classified, decisions, self.evidence)
        entry = F.struct("context_rank", "id", "documento_id", "titulo", "url", "score", "evidence_class")
        sources = shown.groupBy("qid").agg(F.sort_array(F.collect_list(entry)).alias("sources"))
        return said.join(decisions, "qid").join(sources, "qid", "left")
