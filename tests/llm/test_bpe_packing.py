from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamlake.llm.bpe import BytePairs
from loamlake.llm.packing import SumOfSquares, pack_documents

FILE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(FILE))


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def test_fast_path_equals_library_on_every_plain_code_point(library):
    bpe, rng = BytePairs.of(FILE), random.Random(3)
    points = [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]
    for c in points:
        for text in (f"a{chr(c)}b", f" {chr(c)} {chr(c)}{chr(c)}1", f"{chr(c)}  \n x'll"):
            assert bpe.plain(text)
            assert ids(bpe.encode(text)) == library.encode(text, add_special_tokens=False).ids, hex(c)
    for _ in range(300):
        text = "".join(chr(rng.choice(points)) for _ in range(80))
        assert ids(bpe.encode(text)) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "漢字 かな", "x <|endoftext|> y", "emoji 🙂🙂", "a" * 5000, " " * 3000, "Привет, мир", " a　b", "١٢٣", "it's we'll I'M"])
def test_other_texts_equal_library(library, text):
    assert ids(BytePairs.of(FILE).encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_every_script_is_split_and_never_encoded_whole(library):
    """CJK, Cyrillic, emoji, combining marks and special strings: pre-tokens tile the text and their ids are the library's."""
    bpe, rng = BytePairs.of(FILE), random.Random(8)
    parts = ["漢字", "かな", " カナ", "Привет", " мир", "🙂", "👩‍👩‍👧", " é", "é", "한국어", " العربية", "١٢", "ไทย", "\u3000", "\u2028", " ", "  ", "\n", "it's", "12", "!?", "<|endoftext|>", "<|endo", "𝔘", "ﬁ", "\u00ad", "\ufeff", "\U0010ffff", "a", " b"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert ids(bpe.encode(text)) == library.encode(text, add_special_tokens=False).ids, text
        tokens, special = bpe.split(text)
        assert "".join(tokens) == text.replace("<|endoftext|>", "") and len(special) == text.count("<|endoftext|>")
        assert sum(len(bpe.piece(t)) // 4 for t in tokens) + len(special) == len(library.encode(text, add_special_tokens=False).ids)
    for _ in range(300):
        text = "".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(60)) if not 0xD800 <= c < 0xE000)
        assert ids(bpe.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_place_minimises_sum_of_squares():
    rng, width = random.Random(5), 32
    packer, levels = SumOfSquares(width), {}
    for _ in range(400):
        size = rng.randrange(1, width)
        counts = np.bincount([*levels.values(), width], minlength=width + 1)[:width]
        best = None
        for h in {0, *(v for v in levels.values() if v + size <= width)}:
            after = counts.copy()
            after[h] -= h > 0
            if h + size < width:
                after[h + size] += 1
            score = int((after[1:] ** 2).sum())
            best = score if best is None else min(best, score)
        window, offset = packer.place(size)
        assert levels.get(window, 0) == offset
        levels[window] = offset + size
        if levels[window] == width:
            del levels[window]
        assert int((np.bincount([*levels.values(), width], minlength=width + 1)[1:width] ** 2).sum()) == best


def check_packing(rows, docs, library, width):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    padding = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= width
        padding += 0 if at & (at - 1) == 0 else width - at
    for doc_id, text in docs:
        want = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        pieces, at = sorted(by_doc[doc_id], key=lambda r: r["start"]), 0
        for r in pieces:
            assert r["start"] == at and r["doc_tokens"] == len(want)
            part = np.array(want[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            if "ids" in r:
                assert bytes(r["ids"]) == part
            at += r["length"]
        assert at == len(want)
    return padding


def test_pack_round_trip(spark, library):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma's", "δ", "12 34"]) for _ in range(rng.randrange(0, 900)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "word " * 9000)]
    rows = [r.asDict() for r in pack_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), width=256, with_ids=True).collect()]
    assert check_packing(rows, docs, library, 256) == 0  # powers of two end each task


def test_pack_edges(spark):
    schema = "doc_id long, text string, sequence_id string, offset string"
    assert pack_documents(spark.createDataFrame([], schema)).count() == 0
    rows = pack_documents(spark.createDataFrame([(None, None, "x", "y"), (7, "a b", None, None), (7, "a b", None, None)], schema)).collect()
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in rows if r["start"] == 0) == [("7", 3), ("7", 3), ("None", 1)]
    with pytest.raises(ValueError):
        pack_documents(spark.createDataFrame([], schema), width=1000)


def test_pack_sf(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r.asDict() for r in pack_documents(docs).collect()]
    assert check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], library, 2048) <= 2048
    assert docs.agg(F.count("*")).first()[0] == len({r["doc_id"] for r in rows})
