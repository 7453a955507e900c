"""Bounded contexts from ranked chunks, and answers to them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loamlake.functions.text import safe_truncate, strip, text_identity
from loamlake.plans.config import AnswerConfig

REFUSAL = "Não encontrei evidências suficientes no acervo para responder a essa pergunta com segurança."
UNTITLED = "Sem título"


def select_context(sources: DataFrame, config: AnswerConfig = AnswerConfig()) -> DataFrame:
    """sources without repeated texts, in the first max_sources documents (doc_number, first seen first).

    A text counts as seen even where its document is over the limit. sources: qid, context_rank, id, texto,
    titulo, documento_id and url.
    """
    keyed = sources.where(F.col("texto").isNotNull() & (strip(F.col("texto")) != "")).withColumn("body", strip(F.col("texto")))
    blank = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
    document = F.coalesce(*[blank(c) for c in ("documento_id", "url") if c in sources.columns], F.col("id").cast("string"))
    same = Window.partitionBy("qid", "identity").orderBy("context_rank")
    once = keyed.withColumn("identity", text_identity(F.col("body"))).withColumn("k", F.row_number().over(same)).where("k = 1").drop("k", "identity")
    once = once.withColumn("document", document).withColumn("seen", F.min("context_rank").over(Window.partitionBy("qid", "document")))
    return once.withColumn("doc_number", F.dense_rank().over(Window.partitionBy("qid").orderBy("seen"))).where(F.col("doc_number") <= config.max_sources).drop("seen")


def pack_context(sources: DataFrame, config: AnswerConfig = AnswerConfig()) -> DataFrame:
    """(qid, context, used): numbered documents within max_context_chars, and the ids of chunks in it.

    The few chunks of a question are folded from first to last: a chunk that had to be truncated ends its
    document, and a document without room ends the context. Questions without sources have no row.
    """
    fields = ["doc_number", "context_rank", "id", F.coalesce(F.when(F.col("titulo") != "", F.col("titulo")), F.lit(UNTITLED)).alias("title"), "body"]
    rows = select_context(sources, config).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("parts"))
    kind = "struct<text:string,used:array<bigint>,doc:int,shut:int,end:boolean>"
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<bigint>").alias("used"), F.lit(0).alias("doc"), F.lit(0).alias("shut"), F.lit(False).alias("end")).cast(kind)

    def step(acc: Column, p: Column) -> Column:
        fresh = p["doc_number"] != acc["doc"]
        # the first chunk of a document tells whether its heading has room at all
        lead = F.concat(F.when(acc["text"] != "", F.lit("\n\n")).otherwise(F.lit("")), F.lit("["), (F.regexp_count(acc["text"], F.lit("\x00")) + 1).cast("string"), F.lit("] "), p["title"], F.lit("\n"))
        head = F.when(fresh, F.concat(F.lit("\x00"), lead)).otherwise(F.lit("\n"))
        length = F.length(F.replace(acc["text"], F.lit("\x00"), F.lit("")))
        room = F.lit(config.max_context_chars) - length - F.length(F.replace(head, F.lit("\x00"), F.lit("")))
        content = safe_truncate(p["body"], room)
        takes = (room > 0) & ~acc["end"] & (acc["shut"] != p["doc_number"]) & (content != "")
        stop = acc["end"] | (fresh & (room <= 0))
        shut = F.when((room <= 0) | (F.length(content) < F.length(p["body"])), p["doc_number"]).otherwise(acc["shut"])
        return F.struct(
            F.when(takes, F.concat(acc["text"], head, content)).otherwise(acc["text"]).alias("text"),
            F.when(takes, F.concat(acc["used"], F.array(p["id"].cast("long")))).otherwise(acc["used"]).alias("used"),
            F.when(takes, p["doc_number"]).otherwise(acc["doc"]).cast("int").alias("doc"),
            shut.cast("int").alias("shut"),
            stop.alias("end"),
        ).cast(kind)

    packed = rows.select("qid", F.aggregate("parts", start, step).alias("c"))
    return packed.select("qid", F.replace("c.text", F.lit("\x00"), F.lit("")).alias("context"), F.col("c.used").alias("used"))


class AnswerProvider(Protocol):
    def answer(self, question: Column, context: Column) -> Column: ...


class ExtractiveAnswers:
    """The sentences of the context that share most terms with the question, in their order; needs no model."""

    def __init__(self, sentences: int = 2) -> None:
        self.sentences = sentences

    def answer(self, question: Column, context: Column) -> Column:
        most = self.sentences

        @F.pandas_udf("string")
        def pick(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            import re

            for asked, texts in batches:
                out = []
                for q, t in zip(asked, texts, strict=True):
                    words = set(re.findall(r"\w+", (q or "").lower()))
                    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", t or "") if s.strip() and not re.match(r"\[\d+\] ", s)]
                    best = sorted(range(len(parts)), key=lambda i: (-len(words & set(re.findall(r"\w+", parts[i].lower()))), i))[:most]
                    out.append(" ".join(parts[i] for i in sorted(best)))
                yield pd.Series(out, dtype=object)

        return pick(question, context)


def answers(questions: DataFrame, decisions: DataFrame, contexts: DataFrame, provider: AnswerProvider | None = None) -> DataFrame:
    """(qid, answer, llm_skipped, used). Refused questions take their own branch, so the provider never sees them."""
    provider = provider or ExtractiveAnswers()
    asked = questions.select("qid", "question").join(decisions.select("qid", "sufficient"), "qid")
    kept = asked.where("sufficient").join(contexts, "qid", "left")
    given = kept.select("qid", provider.answer(F.col("question"), F.coalesce("context", F.lit(""))).alias("answer"), F.lit(False).alias("llm_skipped"), F.coalesce("used", F.array().cast("array<bigint>")).alias("used"))
    refused = asked.where("not sufficient").select("qid", F.lit(REFUSAL).alias("answer"), F.lit(True).alias("llm_skipped"), F.array().cast("array<bigint>").alias("used"))
    return given.unionByName(refused)


@F.pandas_udf(StringType())
def four_digits(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Four digits after the point of the number as it is stored, where it lies half way to the even one; the
    platform's format_string rounds the shortest decimal form, and that up."""
    for s in numbers:
        yield s.map(lambda x: f"{x:.4f}").astype(object)


def source_cards(sources: DataFrame) -> DataFrame:
    """(qid, n, title, link, score) of public sources (qid, context_rank, titulo, url, score) as a page shows them.

    A source without a title is named by its number; only http and https addresses become links.
    """
    n = F.row_number().over(Window.partitionBy("qid").orderBy("context_rank"))
    df = sources.withColumn("n", n)
    title = F.coalesce(F.when(strip(F.col("titulo")) != "", strip(F.col("titulo"))), F.concat(F.lit("Fonte "), F.col("n").cast("string")))
    link = F.when(F.col("url").rlike(r"(?i)^https?://[^/?#\s]+[^\s]*$"), F.col("url"))
    return df.select("qid", "n", title.alias("title"), link.alias("link"), F.when(F.col("score").isNotNull(), four_digits(F.col("score").cast("double"))).alias("score"))
