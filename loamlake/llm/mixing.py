"""Operator 4, mixing sources to target weights by Poisson replication [native].

A source with n documents and target weight w gets the rate w * total / n. Every document draws a uniform
number from a hash of the seed and its id; the count of Poisson distribution steps at or below that number
is how often it appears. A rate above LARGEST is the sum of draws of at most PART each, every one with a number
of its own. Counts are independent of partitioning, so a retried task repeats them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.llm.common import cut, free_name, md5_uniform, table

#: A source without a stated weight counts as one share; the registered query states none: all sources equal.
DEFAULT_WEIGHT = 1.0
SEED = "mix-1"

#: exp(-rate) is a normal double up to here; a larger rate is split into equal parts of at most PART.
LARGEST = 700
PART = 500
#: Copies of a row are numbered in runs of so many, so that no array grows with the rate.
RUN = 1_000

#: At most so many sources are sent to every executor. Of more, those with this share of all rows or more, which
#: can't be more either; the others, none of them large, are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def poisson_steps(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as far as a double below 1 can lie above them.

    The recurrence starts at exp(-rate); beyond a rate of 700 that is zero in doubles, so such a rate is refused
    here and split by its caller.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * rate / k)).alias("c"))
    return F.when(rate > LARGEST, F.raise_error(F.lit("a repetition rate above 700"))).otherwise(F.aggregate(F.sequence(F.lit(1), last), start, step)["c"])


def rate_parts(rate: Column) -> Column:
    """How many draws a rate is split into; 1 up to LARGEST."""
    return F.when(rate > LARGEST, F.ceil(rate / PART).cast("int")).otherwise(F.lit(1))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, total: int | None = None, source: str = "source") -> tuple[DataFrame, int, int]:
    """(source, n, rate) of every source, how many sources there are, and how many rows; a null source is one of its own.

    weights: shares by source, none negative, DEFAULT_WEIGHT for any other; if all are 0 every rate is 0.
    total: rows wanted, by default as many as there are.
    """
    if any(not share >= 0 for share in (weights or {}).values()) or (total is not None and total < 0):
        raise ValueError("weights and total must not be negative")
    w = F.lit(DEFAULT_WEIGHT)
    for name, share in (weights or {}).items():
        w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(w)
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n")).withColumn("w", w)
    whole = sizes.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    want = float(whole["n"] or 0 if total is None else total)
    rate = F.col("w") / F.lit(whole["w"]) * F.lit(want) / F.col("n") if whole["w"] else F.lit(0.0)
    return sizes.select("source", "n", rate.alias("rate")), whole["k"], whole["n"] or 0


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, total: int | None = None, seed: str = SEED, source: str = "source", key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """docs with every row as often as its draw says, dealt and ordered by a hash; adds copy_no (from 0) and repeats.

    The hash deals each copy to a random partition and orders it within: a global shuffle without a sort
    over everything. Copies of one document get different places. A null key draws as the text 'null';
    rows with equal keys draw alike. Columns named copy_no or repeats are replaced. Empty in, empty out.
    """
    docs = docs.drop("copy_no", "repeats")
    steps, parts, src, mix, run, draw = (free_name(docs, f"mix_{x}") for x in ("steps", "parts", "source", "key", "run", "draw"))
    rates, found, rows = source_rates(docs, weights, total, source)
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    drawing = docs.withColumn(draw, md5_uniform(F.lit(seed), name))

    def met(left: DataFrame, right: DataFrame, small: bool, how: str = "inner") -> DataFrame:
        r = right.select(F.col("source").alias(src), rate_parts(F.col("rate")).alias(parts), poisson_steps(F.col("rate") / rate_parts(F.col("rate"))).alias(steps))
        return left.join(F.broadcast(r) if small else r, left[source].eqNullSafe(r[src]), how)

    if found <= BROADCAST_SOURCES:
        drawn = met(drawing, rates, True)
    else:
        rates = cut(rates)
        large = rates.where(F.col("n") * BROADCAST_SOURCES >= rows)
        rest = met(met(drawing, large, True, "left_anti"), rates.where(F.col("n") * BROADCAST_SOURCES < rows), False)
        drawn = met(drawing, large, True).unionByName(rest)
    below = lambda u: F.size(F.filter(steps, lambda c: c <= u))
    us = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: md5_uniform(F.lit(seed), name, F.lit("part"), j.cast("string")))
    drawn_parts = F.aggregate(us, F.lit(0), lambda n, u: n + below(u))
    drawn = drawn.withColumn("repeats", F.when(F.col(parts) > 1, drawn_parts).otherwise(below(F.col(draw)))).drop(steps, parts, src, draw).where("repeats > 0")
    runs = drawn.withColumn(run, F.explode(F.sequence(F.lit(0), F.col("repeats") - 1, F.lit(RUN))))
    copies = runs.withColumn("copy_no", F.explode(F.sequence(F.col(run), F.least(F.col(run) + RUN, F.col("repeats")) - 1))).drop(run)
    copies = copies.withColumn(mix, F.md5(F.concat_ws("|", F.lit(seed), F.lit("place"), name, F.col("copy_no").cast("string"))))
    dealt = copies.repartition(partitions, mix) if partitions else copies.repartition(mix)
    return dealt.sortWithinPartitions(mix).drop(mix)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy_no", "repeats", "text")


SQL = {
    "op4_mix_sources": f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, ({DEFAULT_WEIGHT}::DOUBLE / sum({DEFAULT_WEIGHT}::DOUBLE) OVER ()) * sum(n) OVER ()::DOUBLE / n AS rate FROM sizes),
steps(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
u AS (SELECT doc_id, source, text, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / {float(16**13)}::DOUBLE AS u FROM documents),
d AS (SELECT u.doc_id, u.source, u.text, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM u.source AND s.c <= u.u)::INTEGER AS repeats FROM u)
SELECT doc_id, source, unnest(range(repeats))::INTEGER AS copy_no, repeats, text FROM d WHERE repeats > 0""",
}

QUERIES = {"op4_mix_sources": op4_mix_sources}
