from __future__ import annotations

import base64
import random
import re

import zstandard

from loamlake.llm.quality import LEVEL, assess, band_of, keep_good, limits, op8_quality_rules, quality_columns, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows, hit = {}, set()
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            hit.update(i + k for i in at for k in range(5))
    n, rep = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 10 or 100 * rep > 20 * n


def test_assess_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "x\n\nx\nx \n x", "a b c d e " * 4, "ß ü\u0085 é\x0b\x1cz"]
    texts += ["".join(rng.choice(["a", "b", "the ", "\n", "\t", "#", "é ", "  "]) for _ in range(rng.randrange(400))) for _ in range(200)]
    press = zstandard.ZstdCompressor(level=LEVEL)
    for t in texts:
        assert assess(t, press)[:6] == brute(t), t
    rows = quality_columns(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).select("doc_id", "quality.*").collect()
    for r in rows:
        assert tuple(r)[1:7] == brute(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_wide_vocabulary_is_exact():
    words = [str(i).encode() for i in range(30_000)] * 2
    assert repeated_words(words) == len(words)
    assert repeated_words([str(i).encode() for i in range(30_000)]) == 0


def test_bands():
    press = zstandard.ZstdCompressor(level=LEVEL)
    rng = random.Random(4)
    prose = " ".join("".join(rng.choice(["th", "er", "on", "an", "ti", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(900))
    noise = " ".join("".join(rng.choice("ABCDEFGHabcdefgh0123456789+/xyzXYZqrsQRS") for _ in range(60)) for _ in range(60))
    loop = " ".join(f"{i % 7} same words again and again number {i % 3}" for i in range(600))
    assert assess(prose, press)[-1]
    assert not assess(noise, press)[-1]
    assert not assess(loop, press)[-1]
    mixed = prose + "".join(f" filler{i % 2}" for i in range(1200))  # a part of the document repeats
    assert assess(mixed, press)[7] > 0
    assert band_of(99).below == 100 and band_of(100).below == 300


def test_edges(spark):
    schema = "doc_id long, text string, quality string, kept int"
    assert keep_good(spark.createDataFrame([], schema)).count() == 0
    good = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, good, "q", 1), (1, good, "q", 1), (None, good, None, None), (3, None, None, None), (4, "word " * 200_000, None, None)], schema)
    kept = keep_good(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "1", "None"]


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op8_quality_rules(spark, sf).join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert good and all(r["kept"] for r in good)
    assert any(not r["kept"] for r in rows if r["quality"] == 0)


def test_bands_alone_reject_noise():
    """Base64 noise in eleven words or more, which the base rules let through."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    rng = random.Random(5)
    for size in (130, 200, 290, 400, 600, 900, 1500):
        for _ in range(50):
            text = base64.b64encode(rng.randbytes(size)).decode()[:size]
            text = " ".join(text[i : i + size // 11] for i in range(0, size, size // 11))
            row = assess(text, press)
            assert not row[5] and row[8], (size, row)


def test_bands_alone_reject_labelled_documents(spark):
    """More than half of the documents labelled bad that pass the base rules fall to the bands; no good one does."""
    sf = "/root/testdata/sf0.1"
    rows = op8_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    bad = [r["band_failed"] for r in rows if r["quality"] == 0]
    assert sum(bad) > len(bad) / 2
    assert not any(r["band_failed"] for r in rows if r["quality"] == 1)


def test_limits_follow_the_labels():
    for size in (100, 299, 300, 999, 1000, 3999, 5000, 39_999, 10**7):
        least, most = limits(size)
        assert 0.9 < least < most < 3.1
    assert limits(0) == limits(1) and limits(120)[0] > 0.95 and limits(3000)[1] < 2.3
