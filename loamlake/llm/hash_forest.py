"""Operator 7, approximate nearest neighbours by a forest of hash-prefix trees.

Vectors are dealt into blocks of a fixed size. In a block every tree is one sorted array of long hash
strings (signs of random projections): a logical prefix tree, without pointers. A query descends each tree to its
longest matching prefix and then all trees ascend together, one bit at a time, until the prefixes that still match
hold enough distinct candidates. These are scored, and nothing else is. The score of the k-th of them tells how far
all trees must ascend still: two vectors at an angle a agree in one bit with probability 1 - a / pi, so a vector that
is as near as the k-th best is missed by every tree at depth d with probability (1 - (1 - a / pi)^d)^trees. The trees
ascend to the depth at which that is at most MISS. Where neighbours stand out, few candidates suffice; where all
directions are alike, as in random vectors, many are needed, and recall is the same for both.

Inner products become angles by one more coordinate, sqrt(M^2 - |x|^2) with M the largest length in the
block, which is zero for queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamlake.llm.common import table

TREES = 64
BITS = 32
BLOCK = 8_192
#: The chance that a vector as near as the k-th best found is no candidate.
MISS = 0.15
#: At least so many distinct vectors for each neighbour wanted are candidates, or all in the block.
DISTINCT = 16
QUERIES_AT_ONCE = 256
#: Of vectors that are equal in every component only so many smallest ids can be among the nearest k.
SPARE = 1


class Forest:
    """The trees over one block. x: distinct vectors as float64 rows."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 7) -> None:
        # scaled to lengths of at most one, so that no square overflows or vanishes
        most = float(np.abs(x).max(initial=0.0)) or 1.0
        lengths = np.sqrt(np.einsum("ij,ij->i", x / most, x / most))
        self.scale = most * (float(lengths.max(initial=0.0)) or 1.0)
        self.x, self.bits = x / self.scale, bits
        self.extra = np.sqrt(np.maximum(1.0 - np.einsum("ij,ij->i", self.x, self.x), 0.0))
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((trees, x.shape[1] + 1, bits))
        self.order, self.codes = [], []
        for p in self.planes:
            code = self._code(np.column_stack([self.x, self.extra]), p)
            order = np.argsort(code, kind="stable")
            self.order.append(order.astype(np.int32))
            self.codes.append(code[order])

    def _code(self, x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        signs = (x @ planes > 0).astype(np.uint64)
        return (signs << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def query_codes(self, q: np.ndarray) -> list[np.ndarray]:
        """The hash string of each query in each tree."""
        lifted = np.column_stack([q, np.zeros(len(q))])
        return [self._code(lifted, p) for p in self.planes]

    def levels(self, codes: list[np.ndarray], least: int) -> np.ndarray:
        """The depth, for each query, to which all trees ascend from its deepest prefixes until ``least`` entries match.

        Matches only grow on the way up, so the depth is found by halving; at depth 0 everything matches.
        """
        low, high = np.zeros(len(codes[0]), np.int64), np.full(len(codes[0]), self.bits, np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            size = np.zeros(len(low), np.int64)
            for code, own in zip(self.codes, codes, strict=True):
                a, b = self._range(code, own, middle)
                size += b - a
            enough = size >= least
            low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
        return low

    def matching(self, codes: list[np.ndarray], level: np.ndarray, mask: np.ndarray, todo: np.ndarray) -> None:
        """Sets in mask, for the queries in todo, the vectors that share a prefix of the query's depth in some tree."""
        for code, order, own in zip(self.codes, self.order, codes, strict=True):
            a, b = self._range(code, own[todo], level[todo])
            count = b - a
            at = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())
            mask[np.repeat(todo, count), order[at]] = True

    def ascend(self, codes: list[np.ndarray], level: np.ndarray, distinct: int) -> np.ndarray:
        """A bool for each query and vector: the candidates at ``level``, which goes on up until ``distinct`` vectors
        besides the query's own match, or all there are."""
        n, asked = len(self.x), len(level)
        mask = np.zeros((asked, n), bool)
        todo, need = np.arange(asked), min(n, distinct + 1)  # one of them may be the query's own
        while len(todo):
            self.matching(codes, level, mask, todo)
            todo = todo[(mask[todo].sum(axis=1) < need) & (level[todo] > 0)]
            level[todo] -= 1
        return mask

    def candidates(self, q: np.ndarray, least: int, distinct: int = 0) -> np.ndarray:
        """The candidates of each query once ``least`` entries and ``distinct`` vectors match."""
        codes = self.query_codes(q)
        return self.ascend(codes, self.levels(codes, least), distinct)

    def depth_for(self, cosine: np.ndarray, miss: float) -> np.ndarray:
        """The greatest depth at which a vector of that inner product is a candidate but for a chance of ``miss``.

        cosine: inner products of queries of length one with scaled vectors; -inf, for none, asks for every vector.
        """
        with np.errstate(divide="ignore", invalid="ignore"):
            agree = 1.0 - np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi
            depth = np.log1p(-(miss ** (1.0 / len(self.codes)))) / np.log(agree)
        return np.where(np.isfinite(cosine), np.clip(np.nan_to_num(np.floor(depth), nan=0.0, posinf=self.bits), 0, self.bits), 0).astype(np.int64)

    def _range(self, code: np.ndarray, own: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the sorted array the strings with each query's first ``depth`` bits stand."""
        free = (self.bits - depth).astype(np.uint64)
        low = (own >> free) << free
        return np.searchsorted(code, low), np.searchsorted(code, low + ((np.uint64(1) << free) - np.uint64(1)), side="right")


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums from the first component to the last in doubles, the same on every machine. q, x: (..., dims)."""
    out = np.zeros(np.broadcast_shapes(q.shape, x.shape)[:-1])
    for d in range(q.shape[-1]):
        out += q[..., d] * x[..., d]
    return out


class _Block:
    """The vectors of one block, equal ones as one with their ids in order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        x = x + 0.0  # no negative zeros
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        _, first, where = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
        self.forest = Forest(x[first])
        self.x, self.fast = x[first], self.forest.x.astype(np.float32)
        self.members: list[list[int]] = [[] for _ in first]
        for i, w in zip(ids.tolist(), where.ravel().tolist(), strict=True):
            mine = self.members[w]
            if len(mine) < k + SPARE and (not mine or mine[-1] != i):
                mine.append(i)

    def nearest(self, ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
        forest, x, out = self.forest, self.x, ([], [], [])
        q1 = q / np.abs(q).max(axis=1)[:, None]  # no query is zero
        q1 /= np.sqrt(np.einsum("ij,ij->i", q1, q1))[:, None]
        keep = min(k + SPARE, len(x))
        q4 = q1.astype(np.float32)
        codes = forest.query_codes(q1)
        level = forest.levels(codes, min(len(x), DISTINCT * k))
        mask = forest.ascend(codes, level, DISTINCT * k)
        # the k-th best besides the query's own vector, in float32 and so a little less to be safe
        kth = np.full(len(q), -np.inf)
        for i in range(len(q)):
            near = np.flatnonzero(mask[i])
            if len(near) >= keep:
                kth[i] = np.partition(self.fast[near] @ q4[i], len(near) - keep)[len(near) - keep] - 1e-5
        deeper = forest.depth_for(kth, MISS)
        up = np.flatnonzero(deeper < level)
        level[up] = deeper[up]
        forest.matching(codes, level, mask, up)
        for i, own in enumerate(ids.tolist()):
            near = np.flatnonzero(mask[i])
            scores4 = self.fast[near] @ q4[i]
            edge = np.partition(scores4, len(near) - keep)[len(near) - keep] if len(near) > keep else -np.inf
            # how far a float32 product of vectors no longer than one can be from the true one
            near = near[scores4 >= edge - 2e-6 * x.shape[1]]
            scores = inner_products(q[i], x[near])
            best = sorted((-s, m) for s, w in zip(scores.tolist(), near.tolist(), strict=True) for m in self.members[w] if m != own)[:k]
            out[0].extend([own] * len(best))
            out[1].extend(m for _, m in best)
            out[2].extend(-s for s, _ in best)
        return out


def usable(vector: Column) -> Column:
    """A vector takes part if it has components, all finite, and one that isn't zero."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda c: c != 0)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest of vectors for each row of queries, by inner product.

    Null, empty or zero vectors and such with null or non-finite components take no part, nor do rows with a
    null key or a number of components that few others have (the most common number counts; of equally common
    ones the smallest). A row never is its own neighbour: candidates with the query's key don't count, and
    equal (key, vector) rows are one. Ties go to the smaller key. Vectors of any size in doubles are compared by their
    scaled float32 forms first and exactly then. No vectors or no queries give no rows.
    """
    pick = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    data, asked = pick(vectors), pick(queries).dropDuplicates()
    shape = data.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dims, blocks = shape["d"], -(-shape["count"] // BLOCK)
    block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks))
    rows = data.where(F.size("v") == dims).select(block.alias("b"), F.lit(0).alias("q"), "id", "v")
    many = asked.where(F.size("v") == dims).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.lit(1).alias("q"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"b": None}

        def answers(ids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
            if state.get("block") is None and state["ids"]:
                state["block"] = _Block(np.concatenate(state["ids"]), np.concatenate(state["x"]), k)
                state["ids"], state["x"] = [], []
            for at in range(0, len(ids), QUERIES_AT_ONCE) if state.get("block") else ():
                a, b, c = state["block"].nearest(ids[at : at + QUERIES_AT_ONCE], q[at : at + QUERIES_AT_ONCE], k)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            bs, qs, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            lists = batch.column(3)
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            edges = np.flatnonzero(np.diff(bs) | np.diff(qs)) + 1
            for a, b in zip([0, *edges], [*edges, len(bs)], strict=True):
                if a == b:
                    continue
                if bs[a] != state["b"]:
                    state = {"b": bs[a], "ids": [], "x": []}
                if qs[a] == 0:
                    state["ids"].append(ids[a:b])
                    state["x"].append(x[a:b])
                else:
                    yield from answers(ids[a:b], x[a:b])

    dealt = rows.unionByName(many).repartition(blocks, "b").sortWithinPartitions("b", "q")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    # every block has sent its k best of each query, so the window sees k rows for each block
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


SQL: dict[str, str] = {}  # the forest is approximate: recall is measured against brute force in the tests
QUERIES = {"op7_hash_forest": op7_hash_forest}
