"""Exact nearest vectors, scored by matrix products: few questions go to the data, many meet it in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlake.operators.best import Best

DIGITS = 9
#: Vectors that one task holds while questions stream by, and questions that are scored at once.
BLOCK = 65_536
AT_ONCE = 16
#: As many questions go to every task, which scores so many vectors at once.
FEW, ROWS = 2_048, 1_024


def vector_search(vectors: DataFrame, questions: DataFrame, limit: int, key: str = "id", vector: str = "vector", question_vector: str = "vector", metric: str = "cosine") -> DataFrame:
    """(qid, id, score_vector, rank_vector): the ``limit`` nearest of each question by cosine or inner product.

    Up to FEW questions go to all tasks, which keep the best of their vectors, so that no vector is shuffled. Of more,
    every data block meets every question once; neither side is collected, and each task keeps one block.
    Zero vectors have no direction and take no part; ties after rounding go to the smaller id.
    """
    if metric not in ("cosine", "inner"):
        raise ValueError("metric must be cosine or inner")
    data = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    asked = questions.select(F.col("qid").cast("long").alias("id"), F.col(question_vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    few = asked.limit(FEW + 1).collect()
    order = Window.partitionBy("qid").orderBy(F.desc("score_vector"), "id")
    if len(few) <= FEW:
        found = _beside(data, few, limit, metric)
        return found.withColumn("rank_vector", F.row_number().over(order)).where(F.col("rank_vector") <= limit)
    blocks = max(1, -(-data.count() // BLOCK))
    rows = data.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"), F.lit(0).alias("q"), "id", "v")
    many = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.lit(1).alias("q"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            bs, qs, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(bs):
                continue
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(bs), -1)
            edges = np.flatnonzero(np.diff(bs) | np.diff(qs)) + 1
            for a, b in zip([0, *edges], [*edges, len(bs)], strict=True):
                if bs[a] != block:
                    block, held, parts = bs[a], None, []
                if qs[a] == 0:
                    parts.append((ids[a:b], x[a:b]))
                    continue
                if held is None and parts:
                    all_ids, all_x = np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])
                    norms = np.einsum("ij,ij->i", all_x, all_x)
                    held = all_ids[norms > 0], all_x[norms > 0], norms[norms > 0]
                if held is None:
                    continue
                for at in range(a, b, AT_ONCE):
                    yield _best(ids[at : min(b, at + AT_ONCE)], x[at : min(b, at + AT_ONCE)], *held, limit, metric)

    dealt = rows.unionByName(many).repartition(blocks, "b").sortWithinPartitions("b", "q")
    found = dealt.mapInArrow(run, "qid long, id long, score_vector double")
    return found.withColumn("rank_vector", F.row_number().over(order)).where(F.col("rank_vector") <= limit)


def _beside(data: DataFrame, few: list, limit: int, metric: str) -> DataFrame:
    """(qid, id, score_vector): the best of each task's vectors for every one of a few questions."""
    qids, q = np.array([r["id"] for r in few], np.int64), np.array([r["v"] for r in few], np.float64)
    own = np.einsum("ij,ij->i", q, q) if len(few) else np.zeros(0)
    if metric == "cosine" and len(few):  # a zero vector has no direction
        qids, q, own = qids[own > 0], q[own > 0], own[own > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(qids), limit)
        for whole in batches:
            for at in range(0, len(whole) if len(qids) else 0, ROWS):
                batch = whole.slice(at, ROWS)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                norms = np.einsum("ij,ij->i", x, x)
                some = np.flatnonzero(norms > 0)
                scores = x[some] @ q.T
                if metric == "cosine":
                    scores /= np.sqrt(norms[some, None] * own)
                best.add(np.round(scores, DIGITS) + 0.0, batch.column(0).to_numpy(zero_copy_only=False)[some])
        yield pa.RecordBatch.from_arrays([pa.array(qids[best.question]), pa.array(best.id), pa.array(best.score)], names=["qid", "id", "score_vector"])

    return data.select("id", "v").mapInArrow(run, "qid long, id long, score_vector double")


def payload_id(payload: Column, point_id: Column) -> Column:
    """The text row of a point: postgres_id in its payload, else its own id; anything but a whole number is an error."""
    given = F.coalesce(F.try_element_at(payload, F.lit("postgres_id")), point_id.cast("string"))
    return F.when(given.rlike(r"^-?\d+$"), given.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not an id: "), F.coalesce(given, F.lit("null")))).cast("long"))


def _best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, limit: int, metric: str) -> pa.RecordBatch:
    scores = q @ x.T
    if metric == "cosine":
        own = np.einsum("ij,ij->i", q, q)
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = scores / np.sqrt(own[:, None] * norms[None, :])
    scores = np.round(scores, DIGITS) + 0.0
    out: tuple[list, list, list] = ([], [], [])
    k = min(limit, len(ids))
    for i, qid in enumerate(qids.tolist()):
        s = scores[i]
        if not k or not np.isfinite(s).all():
            continue
        near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
        near = near[np.lexsort((ids[near], -s[near]))][:limit]
        out[0].extend([qid] * len(near))
        out[1].extend(ids[near].tolist())
        out[2].extend(s[near].tolist())
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["qid", "id", "score_vector"])
