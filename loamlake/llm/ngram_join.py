"""Operator 2, n-gram Jaccard join over prefix trees.

1. Every text becomes its set of distinct shingles (64-bit hashes). Equal sets form a class; only classes
   are compared, so copies are never expanded into pairs.
2. Survivors: linked sets share a fixed share of their smallest hashes. A set whose smallest hashes are
   mostly its own links with nothing and leaves here, which spares its text any further shuffle.
3. Survivors get the global order: shingles by ascending number of classes that hold them, then by hash. Linked
   sets meet in the shortest prefixes that their size allows.
4. First pass: sets connected by shared prefix shingles are a group, each set in one. A bounded number of pivots
   makes a prefix tree; every set of the group, dealt over slices of bounded size, walks the tree once. Subtrees
   are cut by size and remaining-length bounds, and one link to each connected group of pivots is enough. That
   settles small groups at once and clusters of near copies in a round or two, at one copy of each set.
5. Second pass, for groups of which the rounds leave sets that aren't connected: where shared shingles have chained
   many sets together, the sets of one prefix shingle and one band of sizes are a group of their own, without any
   closure; such as are connected already are done, and the others get pivots again. Where that would deal more
   tokens than a comparison of the whole group block by block, and within a shingle and band that pivots don't
   settle, blocks are compared, so no link is lost and no task holds a whole group. Blocks are made of the sets
   outside the largest component of the group only, and all pairs of a block and a part of the group are counted by
   matrix products.
6. Components of the links give the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.llm.blocks import PROBE_TOKENS, PROBES, Block
from loamlake.llm.common import cut, forget, free_name, table
from loamlake.llm.components import connected_components
from loamlake.llm.trie import PrefixTree
from loamlake.llm.words import WordHashes, lower_words, shingle_set

#: Sets in one prefix tree, tokens in one, and tokens of the sets that one task compares with it, about.
PIVOTS = 64
TREE_TOKENS = 2_000_000
SLICE_TOKENS = 400_000
#: Sets in one block, and tokens in one, about.
BLOCK = 512
BLOCK_TOKENS = 1_000_000
#: Rounds of pivots in each pass.
ROUNDS = 2

_SETS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("toks", pa.list_(pa.int64()))])
_SETS_DDL = "doc_id long, text_hash long, n long, fp binary, toks array<long>"


def shingle_sets(docs: DataFrame, width: int, share: tuple[int, int] | None) -> DataFrame:
    """_SETS_DDL of docs (doc_id long, text_hash long, text); share (a, b): only the a/b smallest hashes and some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            ids, hashes, texts = batch.column(0), batch.column(1), batch.column(2)
            for at in range(0, batch.num_rows, 256):
                sizes, prints, parts = [], [], []
                for t in texts.slice(at, 256):
                    s = shingle_set(lower_words(t.as_py()), cache, width)
                    n = len(s)
                    sizes.append(n)
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                    parts.append(s if share is None else s[: n - -(-share[0] * n // share[1]) + max(1, n // 20)] if n else s)
                ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                flat = pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                cols = [ids.slice(at, 256), hashes.slice(at, 256), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(cols, schema=_SETS)

    return docs.mapInArrow(run, _SETS_DDL)


def _links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) links. rows: grp, part, pivot, cls, n, toks, comp; of each (grp, part) the pivots make the tree.

    The rows of a (grp, part) lie together, pivots first; only the tree is kept while the others stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, open_ = None, None, True
        for batch in batches:
            a, b = [], []
            grp, part, pivot, cls, n, comp = (batch.column(i).to_pylist() for i in range(6))
            toks = batch.column(6)
            for i in range(batch.num_rows):
                if (grp[i], part[i]) != key:
                    key, tree, open_ = (grp[i], part[i]), PrefixTree(num, den), True
                tokens = toks[i].values.to_pylist()
                if pivot[i]:
                    linked = tree.add(cls[i], tokens, n[i], comp[i])
                else:
                    if open_:
                        tree.freeze()
                        open_ = False
                    linked = [tree.keys[k] for k in tree.probe(tokens, n[i], comp[i])]
                a += [cls[i]] * len(linked)
                b += linked
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _together(rows).mapInArrow(run, "a long, b long").where("a <> b")


def _block_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) links. rows as for _links; of each (grp, part) the pivots make a block, and meet each other and all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, sets, tokens, first = None, None, [], 0, True

        def meet() -> list[tuple[int, int]]:
            """Links of the sets that wait: of the pivots with each other, or of what comes after them with the block."""
            nonlocal block, sets, tokens
            if not sets:
                return []
            block = Block(sets, num, den) if first else block
            out = block.linked(sets) if block is not None else []
            sets, tokens = [], 0
            return out

        for batch in batches:
            links = []
            grp, part, pivot, cls, n, comp = (batch.column(i).to_pylist() for i in range(6))
            toks = batch.column(6)
            for i in range(batch.num_rows):
                if (grp[i], part[i]) != key:
                    links += meet()
                    key, block, first = (grp[i], part[i]), None, True
                if first and not pivot[i]:
                    links += meet()
                    first = False
                sets.append((cls[i], toks[i].values.to_numpy(), n[i], comp[i]))
                tokens += len(sets[-1][1])
                if not first and (len(sets) >= PROBES or tokens >= PROBE_TOKENS):
                    links += meet()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
        links = meet()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return _together(rows).mapInArrow(run, "a long, b long").where("a <> b")


def _together(rows: DataFrame) -> DataFrame:
    """The rows of a (grp, part) in one task, one after another and pivots first."""
    dealt = rows.repartition("grp", "part").sortWithinPartitions("grp", "part", F.col("pivot").desc(), "cls")
    return dealt.select("grp", "part", "pivot", "cls", "n", "comp", "toks")


def _hash_mod(salt: int, modulus: Column) -> Column:
    return F.pmod(F.xxhash64("cls", F.lit(salt)), modulus)


def _met(sets: DataFrame) -> DataFrame:
    """(fh, met): how many of the small hashes of a set also lie among the small hashes of another, over all its copies.

    fh is a hash of fp; two sets of one fh would only make more survivors.
    """
    rows = sets.where("n > 0").select(F.xxhash64("fp").alias("fh"), F.explode("toks").alias("tok"))
    # written, here and below: a join with what was aggregated by its own key can't be split where one key has many rows
    shared = cut(rows.groupBy("tok").agg(F.min("fh").alias("lo"), F.max("fh").alias("hi")).where("lo <> hi").select("tok"))
    return rows.join(shared, "tok").groupBy("fh").agg(F.count(F.lit(1)).alias("met"))


def jaccard_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) links that connect the same classes as all links do. sets: cls, n, toks (distinct, any order)."""
    given = cut(sets, tidy=True)
    tokens = given.select("cls", F.explode("toks").alias("tok"))
    counts = cut(tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    shared = tokens.join(counts, "tok").groupBy("cls").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "tok"))), lambda s: s["tok"]).alias("toks"))
    # tokens of one class only come first in the order; what the prefix has left after them is shared
    least = F.floor((F.col("n") * num + (den - 1)) / den)
    left = (F.col("n") - least + 1 - (F.col("n") - F.size("toks"))).cast("int")
    ordered = cut(given.select("cls", "n").join(shared, "cls").withColumn("left", left).where("left > 0"), tidy=True)
    forget(given, counts)
    heads = ordered.select("cls", F.explode(F.slice("toks", F.lit(1), F.col("left"))).alias("tok"))
    hubs = cut(heads.groupBy("tok").agg(F.min("cls").alias("hub"), F.max("cls").alias("far")).where("hub <> far").select("tok", "hub"))
    stars = heads.join(hubs, "tok").where("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct()
    groups = connected_components(stars).select(F.col("node").alias("cls"), F.col("component").alias("grp"))
    members = cut(ordered.select("cls", "left", F.size("toks").alias("k"), F.col("cls").alias("comp")).join(groups, "cls"))
    links, members = _rounds(ordered, members, None, num, den, 0)
    if members is None:
        return links
    # of the two ways to compare what is left of a group, the one that deals fewer tokens
    sized = _sized_blocks(members).groupBy("grp").agg((F.sum("k") * F.max("blocks")).alias("whole"), F.sum(F.col("left").cast("long") * 2 * F.col("k")).alias("split"))
    chained = cut(members.join(cut(sized.where("split < whole").select("grp")), "grp", "left_semi"))
    direct = members.join(chained.select("grp").distinct(), "grp", "left_anti")
    if not chained.isEmpty():
        links, rest = _rounds(ordered, _by_token(ordered, chained, num, den), links, num, den, ROUNDS)
        direct = direct if rest is None else direct.unionByName(rest)
    return links if direct.isEmpty() else _blocks(ordered, direct, links, num, den)


def _sized(members: DataFrame) -> DataFrame:
    """members with the blocks of sets that trees can hold, and the slices that tasks can compare, of their group."""
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("g"), F.sum("k").alias("t"))
    blocks = F.greatest(F.ceil(F.col("g") / PIVOTS), F.ceil(F.col("t") / TREE_TOKENS)).cast("int")
    return members.join(sizes.select("grp", blocks.alias("blocks"), (F.floor(F.col("t") / SLICE_TOKENS).cast("int") + 1).alias("slices")), "grp")


def _sized_blocks(members: DataFrame) -> DataFrame:
    """members with main, whether they are of the largest component of their group, the blocks of those that aren't, and slices as above."""
    each = members.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("g"), F.sum("k").alias("t"))
    sizes = each.groupBy("grp").agg(F.max(F.struct("g", "comp", "t")).alias("main"), F.sum("g").alias("g"), F.sum("t").alias("t"))
    blocks = F.greatest(F.ceil((F.col("g") - F.col("main.g")) / BLOCK), F.ceil((F.col("t") - F.col("main.t")) / BLOCK_TOKENS), F.lit(1)).cast("int")
    sizes = sizes.select("grp", F.col("main.comp").alias("most"), blocks.alias("blocks"), (F.floor(F.col("t") / SLICE_TOKENS).cast("int") + 1).alias("slices"))
    return members.join(sizes, "grp").withColumn("main", F.col("comp") == F.col("most")).drop("most")


def _rounds(sets: DataFrame, members: DataFrame, links: DataFrame | None, num: int, den: int, first: int) -> tuple[DataFrame | None, DataFrame | None]:
    """All links so far, and the members (cls, left, k, comp, grp) of the groups that ROUNDS rounds of pivots don't settle."""
    for turn in range(first, first + ROUNDS):
        marked = _sized(members).withColumn("pivot", _hash_mod(turn * 101 + 2, F.col("blocks")) == 0)
        parts = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("slices") - 1).cast("array<bigint>")).otherwise(F.array(_hash_mod(turn * 101 + 1, F.col("slices"))))
        dealt = marked.withColumn("part", F.explode(parts)).join(sets.select("cls", "n", "toks"), "cls")
        links = _with(links, _links(dealt, num, den))
        # groups of one block are settled; of the others, those of which all that is left is connected
        rest = marked.where("blocks > 1 and not pivot").select("cls", "left", "k", "grp")
        if rest.isEmpty():
            return links, None
        comp = connected_components(links).select(F.col("node").alias("cls"), F.col("component").alias("comp"))
        rest = cut(rest.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
        forget(members)
        members = cut(rest.join(_apart(rest), "grp"))
        forget(rest)
        if members.isEmpty():
            return links, None
    return links, members


def _apart(members: DataFrame) -> DataFrame:
    """(grp) of the groups with sets of more than one component."""
    return cut(members.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("grp"))


def _with(links: DataFrame | None, found: DataFrame) -> DataFrame:
    more = cut(found if links is None else links.union(found))
    if links is not None:
        forget(links)
    return more


def _by_token(sets: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """The members by prefix shingle and band of sizes: sizes of linked sets lie in one band or two that touch."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)))
    heads = sets.join(members.select("cls", "comp").distinct(), "cls").select("cls", "left", F.size("toks").alias("k"), "comp", F.explode(F.array(band, band + 1)).alias("band"), F.slice("toks", F.lit(1), F.col("left")).alias("toks"))
    dealt = heads.select("cls", "left", "k", "comp", "band", F.explode("toks").alias("tok")).select("cls", "left", "k", "comp", F.xxhash64("tok", "band").alias("grp"))
    return cut(dealt.join(_apart(dealt), "grp"))


def _blocks(sets: DataFrame, members: DataFrame, links: DataFrame | None, num: int, den: int) -> DataFrame:
    """links with those of every block of a group against all of it; the largest component needn't meet itself."""
    sized = _sized_blocks(members).withColumn("own", F.when(F.col("main"), -1).otherwise(_hash_mod(9002, F.col("blocks"))))
    mine = _hash_mod(9001, F.col("slices"))
    # a set meets the blocks after its own, so that two blocks meet once
    later = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j > F.col("own"))
    probes = F.transform(later, lambda j: F.struct((j.cast("long") * F.col("slices") + mine).alias("part"), F.lit(False).alias("pivot")))
    block = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.struct((F.col("own") * F.col("slices") + s).alias("part"), F.lit(True).alias("pivot")))
    dealt = sized.withColumn("x", F.explode(F.when(F.col("main"), probes).otherwise(F.concat(probes, block)))).select("cls", "comp", "grp", "x.part", "x.pivot")
    return _with(links, _block_links(dealt.join(sets.select("cls", "n", "toks"), "cls"), num, den))


def _components(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, text_hash, n, least) of rows (doc_id, text_hash, text); least: doc_id and text_hash of the first
    text that links reach, null without shingles or id."""
    if not 2 * num > den > num > 0:
        raise ValueError("the similarity must lie between 1/2 and 1")
    sets = cut(shingle_sets(rows, width, (num, den)))
    linked = sets.where("n > 0 and doc_id is not null")
    # one text stands for each class of equal sets
    classes = linked.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    # sets that link share at least this many tokens of their prefixes, which run n // 20 tokens (one at least) beyond the shortest
    enough = F.greatest(F.lit(1), F.floor(F.col("n") * num / (20 * den)))
    few = classes.join(cut(_met(linked), tidy=True), F.xxhash64("fp") == F.col("fh")).where(F.col("met") >= enough * F.col("copies"))
    chosen = few.select("one.doc_id", "one.text_hash", "cls")
    texts = rows.join(chosen.hint("shuffle_hash"), ["doc_id", "text_hash"]).select(F.col("cls").alias("doc_id"), "text_hash", "text")
    survivors = shingle_sets(texts, width, None).select(F.col("doc_id").alias("cls"), "n", "toks").dropDuplicates(["cls"])
    comp = connected_components(jaccard_links(survivors, num, den))
    named = comp.join(classes.select("cls", "one"), comp["node"] == F.col("cls"))
    least = named.groupBy("component").agg(F.min("one").alias("least"))
    by_class = named.join(least, "component").select("cls", "least")
    result = classes.join(by_class, "cls", "left").select("fp", F.coalesce("least", "one").alias("least"))
    # sets without shingles have no key to join by
    some, none = sets.drop("toks").where("n > 0"), sets.drop("toks").where("n = 0").withColumn("least", F.lit(None).cast(result.schema["least"].dataType))
    found = some.join(result, "fp", "left").withColumn("least", F.when(F.col("doc_id").isNotNull(), F.col("least")))
    return found.unionByName(none).drop("fp")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.col(text).cast("string")
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))


def similar_documents(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Two rows link when the Jaccard similarity of their shingle sets is num/den or more. A-Z are lower-cased;
    words end at ASCII white space; fewer words than ``width`` make one shingle. A null, empty or blank text
    has no shingles and is its own component. Rows with a null key take no part and get a null component.
    Repeated rows each get their row; rows with one key and different texts are linked by their texts alone.
    An empty table gives no rows; columns other than key and text are ignored.
    """
    out = _components(_rows(docs, key, text), width, num, den)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least.doc_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stand for their component: of the smallest key, and once where a row is repeated.

    Rows without shingles and rows with a null key stay.
    """
    found = cut(_components(_rows(docs, key, text), width, num, den))
    own = F.struct("doc_id", "text_hash")
    first = found.where(F.col("doc_id").isNotNull() & (F.col("least").isNull() | (F.col("least") == own))).select("doc_id", "text_hash", (F.col("n") > 0).alias("some"))
    name, hashed = free_name(docs, "kept_id"), free_name(docs, "kept_hash")
    keys = first.select(F.col("doc_id").alias(name), F.col("text_hash").alias(hashed)).distinct().hint("shuffle_hash")
    kept = docs.join(keys, (docs[key].cast("long") == F.col(name)) & (F.xxhash64(docs[text].cast("string")) == F.col(hashed)), "left_semi")
    if not first.where("some").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        blank = ~F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        again, salt = free_name(docs, "again"), free_name(docs, "again_hash")
        marked = kept.withColumn(again, F.when(blank, F.monotonically_increasing_id()).otherwise(-1)).withColumn(salt, F.xxhash64(text))
        kept = marked.dropDuplicates([key, salt, again]).drop(again, salt)
    return kept.unionByName(docs.where(F.col(key).isNull()))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


#: Exact shingles, all pairs that share one, and what links reach. Fit for the tables of the SQL check only.
SQL = {
    "op2_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END AS s FROM w),
u AS (SELECT DISTINCT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m.y, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = doc_id""",
}
QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
