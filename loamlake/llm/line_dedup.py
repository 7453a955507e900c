"""Operator 3, line dedup by content-defined chunks of lines [native].

Every line has a 64-bit hash; a rolling hash over a window of line hashes marks a boundary where it is a
local minimum. Boundaries depend only on the lines around them, so an inserted or lost line moves none but
its neighbours' chunks, and two boundaries are never adjacent: chunks between them have two lines or more.

A passage of few lines inside differing text may lie between two boundaries and hold no whole chunk. So a second kind
of chunk begins at every line with a word and ends, as its content says, with the first line by which it has more than
PASSAGE_WORDS words, if that is two to PASSAGE_LINES lines on. Such chunks overlap each other and the first kind.

Chunks whose hash occurs again are fetched, compared byte by byte with the first occurrence, and removed
wherever they are its equal; the first occurrence stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.llm.common import cut, forget, free_name, table

#: Lines under the rolling hash; a boundary needs the smallest of three neighbouring values.
WINDOW = 2
#: A chunk of the second kind has more words than this, in at most so many lines.
PASSAGE_WORDS = 50
PASSAGE_LINES = 5
LAST = (1 << 63) - 1


def chunk_columns(df: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """df with lines and cs = array<struct<pos, start, size>>, the chunks of two lines or more (start from 0), by start and size.

    Line i begins a chunk if the rolling hash there is below its left and not above its right neighbour; the
    second line and the last never do, as the first or the last would stand alone. Between these stand the short
    passages of the second kind, none twice. Each step is a projection that later ones refer to more than once, so
    that none is evaluated anew for each element.
    """
    shifted = lambda x, k: F.concat(F.array_repeat(F.lit(None).cast("long"), k), F.slice(x, 1, F.greatest(F.size(x) - k, F.lit(0))))
    df = df.withColumn("lines", F.split(text, "\n"))
    df = df.withColumn("h", F.transform("lines", lambda x: F.xxhash64(x)))
    rolled = F.col("h")
    for k in range(1, window):
        rolled = F.zip_with(rolled, shifted(F.col("h"), k), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("r", rolled).drop("h")
    sides = F.zip_with(shifted(F.col("r"), 1), F.slice("r", 2, F.size("r")), lambda a, b: F.struct(a.alias("l"), b.alias("r")))
    low = F.zip_with("r", sides, lambda x, y: (x < y["l"]) & (x <= y["r"]))
    at = F.filter(F.transform(low, lambda m, i: F.when(m & (i > 1), i).otherwise(-1)), lambda i: i > 0)
    df = df.withColumn("at", F.concat(F.array(F.lit(0)), at)).drop("r")
    ends = F.concat(F.slice("at", 2, F.size("at")), F.array(F.size("lines")))
    zipped = F.zip_with("at", ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("size")))
    df = df.withColumn("tiles", F.filter(zipped, lambda c: c["size"] > 1)).drop("at")
    df = df.withColumn("words", F.transform("lines", lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))))

    def passage(n: Column, i: Column) -> Column:
        size, sum_ = F.lit(None).cast("int"), n
        steps = []
        for k in range(1, PASSAGE_LINES):
            sum_ = sum_ + F.get("words", i + k)  # null beyond the end
            steps.append((sum_ > PASSAGE_WORDS, k + 1))
        for enough, k in reversed(steps):
            size = F.when(enough, k).otherwise(size)
        return F.struct(i.alias("start"), F.when(n > 0, size).alias("size"))

    passages = F.filter(F.transform("words", passage), lambda c: c["size"].isNotNull())
    both = F.sort_array(F.array_distinct(F.concat("tiles", passages)))
    df = df.withColumn("both", both).drop("tiles", "words")
    return df.withColumn("cs", F.transform("both", lambda c, i: F.struct(i.alias("pos"), c["start"], c["size"]))).drop("both")


def _hashed_chunks(base: DataFrame) -> DataFrame:
    """did, th, pos, start, size, hash of every chunk with a word in it."""
    split = chunk_columns(base.where("contains(text, '\n')"))
    body = lambda c: F.slice("lines", c["start"] + 1, c["size"])
    word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    hashed = F.transform("cs", lambda c: F.struct(c["pos"], c["start"], c["size"], F.xxhash64(body(c)).alias("hash"), F.exists(body(c), word).alias("some")))
    return split.select("did", "th", F.explode(hashed).alias("c")).where("c.some").select("did", "th", "c.pos", "c.start", "c.size", "c.hash")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with its text column deduplicated and two columns added: removed_chunks and removed_lines (ints).

    A chunk is removed where an equal one, of the same bytes, comes before it: in a row of smaller key, or
    earlier in the same text. Rows with equal keys are ordered by the hash of their text, and repeated rows
    count as one. Null keys come last. A null text stays null, an empty one empty; a text left without lines
    becomes empty; single lines and blank chunks are never removed. Chunks may overlap; a line goes if one that holds it
    goes, and since every removal points to an earlier place, some copy of each line stays. Nothing else of the text changes. Columns
    named removed_chunks or removed_lines are replaced; an empty table gives no rows.
    """
    docs = docs.drop("removed_chunks", "removed_lines")
    base = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("did"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    found = cut(_hashed_chunks(base))
    place = F.struct("did", "th", "pos")
    # written before the join: a small table is sent out, and for a large one the join has a shuffle of its own on
    # either side, so that Spark can split a chunk that a large share of all texts holds
    repeated = cut(found.groupBy("hash").agg(F.min(place).alias("one"), F.max(place).alias("last")).where("one <> last").select("hash", "one"))
    again = found.join(repeated, "hash").select("did", "th", F.struct("start", "size", "pos", "hash", (place == F.col("one")).alias("first")).alias("c"))
    marked = again.groupBy("did", "th").agg(F.collect_set("c").alias("cs"))
    # only texts that hold a repeated chunk meet their own text again, and only those chunks go on
    texts = base.join(marked.hint("shuffle_hash"), ["did", "th"]).select("did", "th", "cs", F.split("text", "\n").alias("lines"))
    body = lambda c: F.encode(F.array_join(F.slice("lines", c["start"] + 1, c["size"]), "\n"), "utf-8")
    cut_out = F.transform("cs", lambda c: F.struct(c["start"], c["size"], c["pos"], c["hash"], c["first"], body(c).alias("bytes"), F.size("lines").alias("of")))
    # the shuffle of the texts goes before the documents are shuffled at the end
    pieces = cut(texts.select("did", "th", F.explode(cut_out).alias("c")).select("did", "th", "c.*"), tidy=True)
    forget(found, repeated)
    lead = cut(pieces.where("first").select("hash", F.col("bytes").alias("lead")).dropDuplicates(["hash"]))
    compared = pieces.where("not first").join(lead, "hash")
    gone = compared.where("bytes = lead").select("did", "th", "start", "size")
    # one hash over different bytes: what isn't like the first goes by its bytes
    other = compared.where("bytes <> lead").select("did", "th", "pos", "start", "size", "bytes")
    ones = other.groupBy("bytes").agg(F.min(place).alias("one"))
    gone = gone.unionByName(other.join(ones, "bytes").where(place != F.col("one")).select("did", "th", "start", "size"))
    # what goes is small; the shuffles of the bytes end here
    gone = cut(gone, tidy=True)
    forget(pieces, lead)
    name, spans, h, lines = (free_name(docs, x) for x in ("gone_id", "gone_spans", "gone_hash", "gone_lines"))
    per_doc = gone.groupBy("did", "th").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias(spans))
    per_doc = per_doc.select(F.col("did").alias(name), F.col("th").alias(h), spans).hint("shuffle_hash")
    joined = docs.join(per_doc, (F.coalesce(docs[key].cast("long"), F.lit(LAST)) == F.col(name)) & (F.xxhash64(docs[text]) == F.col(h)), "left")
    joined = joined.withColumn(lines, F.when(F.col(spans).isNotNull(), F.split(text, "\n")))
    dead = F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))
    kept = free_name(docs, "gone_kept")
    joined = joined.withColumn(kept, F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dead))
    none = F.col(spans).isNull()
    out = joined.withColumns(
        {
            text: F.when(none, F.col(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")),
            "removed_chunks": F.when(none, F.lit(0)).otherwise(F.size(spans)),
            "removed_lines": F.when(none, F.lit(0)).otherwise(F.size(lines) - F.size(kept)),
        }
    )
    return out.drop(name, spans, h, lines, kept)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "removed_chunks", "removed_lines")


SQL: dict[str, str] = {}  # SQL has no xxhash64; tested against brute force
QUERIES = {"op3_line_dedup": op3_line_dedup}
