"""Operator 6, token counts from pre-token frequencies.

Distinct pre-tokens of the whole corpus are gathered with their counts, and each is merged into pieces once.
Per-document frequencies then meet those piece counts in two joins: the pre-tokens that occur most, a table
of bounded size, are sent to every task and summed on the spot; the others are joined by a shuffle, one row
for each document and rare pre-token. Ids are never built for a document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.llm.bpe import DEFAULT_FILE, LONGEST, BytePairs
from loamlake.llm.common import cut, table

#: The most pre-tokens, of at most LONGEST characters each, that every task holds: some 10 MB to send.
HEAD = 400_000
#: Distinct pre-tokens that a task counts before it passes them on.
FLUSH = 400_000


def _distinct(docs: DataFrame, file: str) -> DataFrame:
    """(p, n): the pre-tokens of all texts with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, counts = BytePairs.of(file), Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["p", "n"])
            counts.clear()
            return made

        for batch in batches:
            for t in batch.column(0):
                text = t.as_py()
                if text:
                    counts.update(bpe.split(text)[0])
                    if len(counts) >= FLUSH:
                        yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))


def _pieces(distinct: DataFrame, file: str) -> DataFrame:
    """(p, n, pieces), each pre-token merged once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = BytePairs.of(file).merger._core_bpe.encode_single_piece
        for batch in batches:
            pieces = [len(merge(p.encode())) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.int32())], names=["p", "n", "pieces"])

    return distinct.mapInArrow(run, "p string, n long, pieces int")


def _head(vocabulary: DataFrame, most: int) -> dict[str, int]:
    """The pre-tokens that occur at least so often that no more than ``most`` of them do."""
    short = vocabulary.where(F.length("p") <= LONGEST)
    # classes of counts, few whatever the corpus: exact up to 64, then by eighths of a doubling
    step = lambda n: F.when(n <= 64, n).otherwise(64 + F.floor((F.log2(n.cast("double")) - 6) * 8).cast("long"))
    classes = sorted(((r["c"], r["k"]) for r in short.groupBy(step(F.col("n")).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, held = None, 0
    for c, k in classes:
        if held + k > most:
            break
        least, held = c, held + k
    if least is None:
        return {}
    got = short.where(step(F.col("n")) >= least).select("p", "pieces").toArrow()
    return dict(zip(got["p"].to_pylist(), got["pieces"].to_pylist(), strict=True))


def count_tokens(docs: DataFrame, file: str = DEFAULT_FILE, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of docs, as the library counts whole texts.

    A null or empty text has 0 bytes and tokens. Repeated rows and null keys get their rows. Every script goes
    the same way; a special string in a text counts as the one token that it is. An empty table gives no rows;
    columns other than key and text are ignored.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    vocabulary = cut(_pieces(_distinct(rows, file), file))
    common = rows.sparkSession.sparkContext.broadcast(_head(vocabulary, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = BytePairs.of(file), common.value
        names = ["rid", "doc_id", "n_bytes", "sure", "p", "f"]
        for batch in batches:
            rids, ids, texts = batch.column(0), batch.column(1), batch.column(2)
            for at in range(0, batch.num_rows, 256):
                cols: list[list] = [[] for _ in names]

                def put(*values: object, cols: list[list] = cols) -> None:
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)

                for rid, doc_id, t in zip(rids.slice(at, 256).to_pylist(), ids.slice(at, 256).to_pylist(), texts.slice(at, 256), strict=True):
                    text = t.as_py()
                    size = len(text.encode("utf-8", "surrogatepass"))
                    tokens, special = bpe.split(text)
                    sure, rare = len(special), []
                    for p, f in Counter(tokens).items():
                        pieces = known.get(p)
                        if pieces is None:
                            rare.append((p, f))
                        else:
                            sure += f * pieces
                    put(rid, doc_id, size, sure, None, None)
                    for p, f in rare:
                        put(rid, None, 0, 0, p, f)
                kinds = (pa.int64(), ids.type, pa.int64(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    marked = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    parts = marked.mapInArrow(run, f"rid long, doc_id {kind}, n_bytes long, sure long, p string, f long")
    # a document's own row has no pre-token; a text that no pre-token equals spreads these rows over the join
    keyed = parts.withColumn("p", F.coalesce("p", F.concat(F.lit("\x00row "), F.col("rid").cast("string"))))
    met = keyed.join(vocabulary.select("p", "pieces"), "p", "left")
    sums = met.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("sure") + F.coalesce(F.col("f") * F.col("pieces"), F.lit(0))).alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)


SQL: dict[str, str] = {}  # SQL has no tokenizer
QUERIES = {"op6_token_counts": op6_token_counts}
