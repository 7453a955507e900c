"""Canonical documents: block dedup, quality gate, canonical hash, and reconciliation of two sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlake.functions import text as T
from loamlake.functions.similarity import similarity
from loamlake.operators.chunks import OVERLAP, SIZE, chunk_documents

SCHEMA_VERSION = "1.0"
MINOR_SIMILARITY = 0.98
#: Phrases of page furniture that a canonical text must not hold.
BOILERPLATE_PHRASES = ("pular barra de compartilhamento", "no ar veiculado pela rede")
FIELDS = ("document_id", "title", "author", "published_at", "category", "url", "text")


def dedup_blocks(text: Column, key=T.paragraph_key, separator: str = "\n{2,}", joiner: str = "\n\n") -> Column:
    """struct<text, removed>: blocks whose key came before are dropped; the first ones keep their places.

    Blocks are numbered once in the row, so no row is exploded and nothing is shuffled. A block without a key stays.
    """
    blocks = F.filter(F.transform(F.split(text, separator), T.strip), lambda b: b != "")
    keyed = F.transform(blocks, lambda b: F.struct(b.alias("b"), key(b).alias("k")))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        again = (x["k"] != "") & F.array_contains(acc["seen"], x["k"])
        return F.struct(
            F.when(again, acc["out"]).otherwise(F.concat(acc["out"], F.array(x["b"]))).alias("out"),
            F.when(again | (x["k"] == ""), acc["seen"]).otherwise(F.concat(acc["seen"], F.array(x["k"]))).alias("seen"),
            (acc["n"] + again.cast("int")).alias("n"),
        )

    return F.aggregate(keyed, empty, step, lambda acc: F.struct(F.array_join(acc["out"], joiner).alias("text"), acc["n"].alias("removed")))


def dedup_lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """df with ``text`` freed of repeated lines and ``removed``: for long texts, by the first place of each line key."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", T.strip(F.col("line"))).where("line <> ''")
    firsts = lines.withColumn("k", T.paragraph_key(F.col("line"))).groupBy(key, F.when(F.col("k") == "", F.concat(F.lit("\x00"), F.col("pos").cast("string"))).otherwise(F.col("k")).alias("k")).agg(F.min(F.struct("pos", "line")).alias("one"), F.count(F.lit(1)).alias("n"))
    joined = firsts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("one")), lambda x: x["line"]), "\n").alias("_t"), F.sum(F.col("n") - 1).alias("removed"))
    return df.join(joined, key, "left").withColumn(text, F.coalesce("_t", F.lit(""))).withColumn("removed", F.coalesce("removed", F.lit(0))).drop("_t")


def quality_issues(phrases: Sequence[str] = BOILERPLATE_PHRASES, **fields: Column) -> Column:
    """array<string> of what keeps a document out of Gold, in a fixed order."""
    f = {k: F.coalesce(fields[k], F.lit("")) for k in FIELDS if k in fields}
    missing = [F.when(T.strip(f[k]) == "", F.lit(f"missing_{k}")) for k in ("document_id", "title", "published_at", "category", "url", "text") if k in f]
    low = T.casefold(f["text"])
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(low, F.lit(p))
    rest = [
        F.when((f["url"] != "") & ~f["url"].rlike(r"(?i)^https?://[^/?#]+"), F.lit("invalid_url")),
        F.when(found, F.lit("known_boilerplate")),
        F.when(F.contains(f["text"], F.lit("�")), F.lit("unicode_replacement_character")),
        F.when(f["text"].rlike(r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"), F.lit("invalid_control_character")),
    ]
    return F.array_distinct(F.array_compact(F.array(*missing, *rest)))


def canonical(articles: DataFrame, source: str = "json", exact: bool = False) -> DataFrame:
    """Canonical documents of articles (document_id, title, author, published_at, category, url, text, object_name,
    binary_sha256, source_content_sha256), with promotable and quality_issues.

    exact: compatibility characters are folded by NFKC in Python; else only invisible ones are dropped.
    """
    fold = (lambda c: T.squeeze(T.fold_exact(c))) if exact else T.semantic_text
    df = articles.withColumns({c: fold(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "author", "published_at", "category")})
    df = df.withColumn("url", T.strip(F.coalesce("url", F.lit("")))).withColumn("_b", dedup_blocks(F.coalesce("text", F.lit(""))))
    df = df.withColumn("text", T.fold_exact(F.col("_b.text")) if exact else F.translate(F.col("_b.text"), T.INVISIBLE, ""))
    steps = ["html_to_markdown", "remove_confirmed_boilerplates", "normalize_unicode_nfkc", "remove_invisible_format_characters", "avoid_leading_title_duplication"] if source == "json" else ["extract_pdf_text", "normalize_unicode_nfkc"]
    repeated = F.when(F.col("_b.removed") > 0, F.array(F.concat(F.lit("deduplicate_exact_blocks:"), F.col("_b.removed").cast("string")))).otherwise(F.array().cast("array<string>"))
    sha = F.sha2(T.canonical_json(**{k: F.col(k) for k in FIELDS}), 256)
    issues = quality_issues(**{k: F.col(k) for k in FIELDS})
    if source == "pdf":  # a PDF alone is never promoted
        extra = F.array_compact(F.array(F.when(F.col("document_id").startswith("pdf_"), F.lit("pdf_without_canonical_identity")), F.when(F.col("source_content_sha256").isNull(), F.lit("pdf_without_source_hash")), F.lit("pdf_requires_json_authority")))
        issues = F.array_distinct(F.concat(issues, extra))
    df = df.withColumns({"schema_version": F.lit(SCHEMA_VERSION), "canonical_sha256": sha, "primary_source": F.lit(source), "quality_issues": issues, "transformations": F.concat(F.array(*map(F.lit, steps)), repeated)})
    df = df.withColumn("lineage_id", T.lineage_id(F.col("document_id"), F.col("canonical_sha256"))).withColumn("promotable", F.size("quality_issues") == 0)
    df = df.withColumn("sources", F.array(F.struct(F.lit(source).alias("source_type"), "object_name", "binary_sha256", "source_content_sha256")))
    return df.select("schema_version", "document_id", "lineage_id", "title", "author", "published_at", "category", "url", "text", "canonical_sha256", "primary_source", "sources", "transformations", "promotable", "quality_issues")


def with_title(text: Column, title: Column, always: Column | None = None) -> Column:
    """``# title`` before the text unless one of its first three lines already is the title."""
    first = F.slice(F.filter(F.split(text, "\n"), lambda x: T.strip(x) != ""), 1, 3)
    there = F.exists(first, lambda x: T.comparable_heading(x) == T.comparable_heading(title)) & (T.comparable_heading(title) != "")
    put = (title != "") & (~there if always is None else always | ~there)
    return T.strip(F.concat_ws("\n\n", F.when(put, F.concat(F.lit("# "), title)), F.when(text != "", text)))


def divergence(a: DataFrame, b: DataFrame, by: str = "document_id", with_similarity: bool = True) -> DataFrame:
    """How the b document of each a document differs: classification and its grounds. Rows of a without one are left out.

    The similarity of texts is computed on matched pairs only; without it, a pair can't be ``minor``.
    """
    pick = lambda df, p: df.select(F.col(by).alias("document_id"), *[F.col(c).alias(f"{p}_{c}") for c in ("title", "author", "published_at", "category", "url", "text")], F.col("document_id").alias(f"{p}_id"), F.element_at("sources", 1)["source_content_sha256"].alias(f"{p}_hash"))
    pairs = pick(a, "a").join(pick(b, "b"), "document_id")
    ta, tb = T.semantic_text(F.col("a_text")), T.semantic_text(F.col("b_text"))
    pairs = pairs.withColumns({"ta": ta, "tb": tb})
    differ = lambda c: F.when(T.semantic_text(F.col(f"a_{c}")) != T.semantic_text(F.col(f"b_{c}")), F.lit(c))
    la, lb = F.length("ta"), F.length("tb")
    pairs = pairs.withColumns(
        {
            "text_similarity": F.round(similarity(F.col("ta"), F.col("tb")), 6) if with_similarity else F.lit(None).cast("double"),
            "length_difference": lb - la,
            "length_ratio": F.round(F.least(la, lb) / F.greatest(la, lb, F.lit(1)), 6),
            "source_hash_match": F.when(F.coalesce("b_hash", F.lit("")) != "", F.col("b_hash").eqNullSafe(F.col("a_hash"))),
            "metadata_differences": F.array_compact(F.array(*map(differ, ("title", "author", "published_at", "category", "url")))),
        }
    )
    pairs = pairs.withColumn("structural_differences", F.array_compact(F.array(F.when(F.col("a_id") != F.col("b_id"), F.lit("document_id")), F.when(F.abs("length_difference") > F.greatest(F.lit(200), F.floor(la * 0.02)), F.lit("text_length")))))
    same = F.size("metadata_differences") == 0
    match = F.col("source_hash_match")
    close = F.coalesce(F.col("text_similarity") >= MINOR_SIMILARITY, F.lit(False))
    label = F.when(F.coalesce(match, F.lit(False)) & same, "equivalent").when(F.coalesce(match, F.lit(True)) & close & same, "minor").otherwise("major")
    return pairs.withColumn("classification", label).select("document_id", "classification", "text_similarity", "length_difference", "length_ratio", "source_hash_match", "metadata_differences", "structural_differences")


def reconcile(json_docs: DataFrame, pdf_docs: DataFrame, with_similarity: bool = True) -> DataFrame:
    """json_docs with the sources of their PDFs; a major divergence keeps a document out of Gold."""
    found = divergence(json_docs, pdf_docs, with_similarity=with_similarity).withColumnRenamed("document_id", "_id")
    other = pdf_docs.select(F.col("document_id").alias("_id"), F.col("sources").alias("_s")).join(found, "_id")
    df = json_docs.join(other, F.col("document_id") == F.col("_id"), "left")
    paired = F.col("_id").isNotNull()
    df = df.withColumn("sources", F.when(paired, F.concat("sources", "_s")).otherwise(F.col("sources")))
    df = df.withColumn("transformations", F.when(paired, F.concat("transformations", F.array(F.lit("validate_against_pdf")))).otherwise(F.col("transformations")))
    df = df.withColumn("quality_issues", F.when(F.col("classification") == "major", F.array_distinct(F.concat("quality_issues", F.array(F.lit("major_json_pdf_divergence"))))).otherwise(F.col("quality_issues")))
    report = F.when(paired, F.struct("classification", "text_similarity", "length_difference", "length_ratio", "source_hash_match", "metadata_differences", "structural_differences"))
    df = df.withColumn("promotable", F.size("quality_issues") == 0).withColumn("divergence", report)
    return df.select(*json_docs.columns, "divergence")


def to_gold_chunks(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(chunk records of promotable documents, the others with their quality_issues)."""
    good, bad = documents.where("promotable"), documents.where("not promotable").select("document_id", "quality_issues")
    main = F.coalesce(F.element_at(F.filter("sources", lambda s: s["source_type"] == F.col("primary_source")), 1), F.element_at("sources", 1))
    rows = good.select(
        F.col("document_id").alias("documento_id"), F.col("title").alias("titulo"), F.col("author").alias("autor"), F.col("published_at").alias("data_publicacao"), F.col("category").alias("categoria"), "url", main["object_name"].alias("source_object"),
        F.col("primary_source").alias("source_type"), F.transform("sources", lambda s: s["object_name"]).alias("source_objects"), "sources", "lineage_id", "canonical_sha256", "schema_version", F.col("text").alias("texto"),
    )
    return chunk_documents(rows, "texto", size, overlap), bad
