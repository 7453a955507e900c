"""PDF files: a deterministic writer, a reader for text and metadata, and checks of one against the other."""

from __future__ import annotations

import re
import textwrap
import unicodedata
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlake.functions.text import INVISIBLE, pdf_keywords

LINES, WIDTH = 52, 92
#: One sign that the main font lacks, and its code in the Symbol font.
SYMBOLS = {"≈": 187}
CREATOR, PRODUCER = "loamlake", "loamlake-pdf/1.0"
_DROP = dict.fromkeys(INVISIBLE, "") | {"\xa0": " ", "\u202f": " ", "\ufb01": "fi"}
#: Articles or files that a task turns into PDFs or texts before it hands them on.
AT_ONCE = 64


def _unsigned(text: str) -> str:
    """text without the signs of the Symbol font."""
    for c in SYMBOLS:
        text = text.replace(c, "")
    return text


def printable(text: str, name: str = "text") -> str:
    """NFC with plain spaces; a sign that the fonts can't show is an error, never replaced."""
    text = unicodedata.normalize("NFC", text)
    for c, shown in _DROP.items():
        text = text.replace(c, shown)
    if "\r" in text:
        text = re.sub(r"\r\n?", "\n", text)
    if "  " in text or "\t" in text:
        text = re.sub(r"[ \t]+", " ", text)
    text = text.replace(" \n", "\n").replace("\n ", "\n")
    if "\n\n\n" in text:
        text = re.sub(r"\n{3,}", "\n\n", text)
    text = text.strip()
    try:
        _unsigned(text).encode("cp1252")
        return text
    except UnicodeEncodeError:
        pass
    for c in set(text) - set(SYMBOLS):
        try:
            c.encode("cp1252")
        except UnicodeEncodeError:
            raise ValueError(f"{name} holds U+{ord(c):04X}, which the PDF fonts can't show") from None
    return text


def wrapped(line: str) -> list[str]:
    """The lines of textwrap.wrap, one at least; plain words with single spaces between them are cut without it."""
    plain = line.isprintable() and "  " not in line and line[:1] != " " != line[-1:]
    if not plain or (len(line) > WIDTH and max(map(len, line.split(" "))) > WIDTH):
        return textwrap.wrap(line, WIDTH, break_on_hyphens=False) or [""]
    out, start = [], 0
    while len(line) - start > WIDTH:
        end = line.rfind(" ", start, start + WIDTH + 1)
        out.append(line[start:end])
        start = end + 1
    return [*out, line[start:]]


def _escaped(raw: bytes) -> bytes:
    return re.sub(rb"([\\()])", rb"\\\1", raw) if b"(" in raw or b")" in raw or b"\\" in raw else raw


def _shown(line: str) -> bytes:
    """Text operators for one line: runs in the main font, and single signs in the Symbol font."""
    if not line:
        return b"T*"
    if not any(c in line for c in SYMBOLS):
        return b"(%s) Tj T*" % _escaped(line.encode("cp1252"))
    out = []
    for run in re.split(f"([{''.join(SYMBOLS)}])", line):
        if run in SYMBOLS:
            out.append(b"/F2 10 Tf <%02X> Tj /F1 10 Tf" % SYMBOLS[run])
        elif run:
            out.append(b"(%s) Tj" % _escaped(run.encode("cp1252")))
    return b" ".join([*out, b"T*"])


def _utf16(text: str) -> bytes:
    return b"<FEFF" + text.encode("utf-16-be").hex().upper().encode() + b">"


def write_pdf(lines: list[str], info: Mapping[str, str], per_page: int = LINES) -> bytes:
    """The same bytes for the same lines and metadata, always."""
    pages = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] or [[]]
    n = len(pages)
    kids = b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(n))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Count %d /Kids [%s] >>" % (n, kids),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Symbol >>",
    ]
    for i, page in enumerate(pages):
        stream = b"\n".join([b"BT /F1 10 Tf 13 TL 50 790 Td", *map(_shown, page), b"ET"])
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents %d 0 R >>" % (6 + 2 * i))
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
    objects.append(b"<< " + b" ".join(b"/%s %s" % (k.encode(), _utf16(v)) for k, v in info.items()) + b" >>")
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(objects), len(out))
    return bytes(out)


def _fields(article: Mapping[str, str]) -> dict[str, str]:
    f = {k: printable(article.get(k) or "", k) for k in ("titulo", "autor", "data", "categoria", "url", "conteudo_texto")}
    if not f["conteudo_texto"]:
        raise ValueError("the article has no text")
    return f


def _info(f: Mapping[str, str], document_id: str, source_sha: str) -> dict[str, str]:
    words = f"Canonical-ID={document_id};Source-JSON={document_id}.json;Source-SHA256={source_sha};Source-Format=json"
    return {"Title": f["titulo"], "Author": f["autor"], "Subject": f"Source-URL: {f['url']}", "Creator": CREATOR, "Producer": PRODUCER, "Keywords": words}


def article_pdf(article: Mapping[str, str], document_id: str, source_sha: str) -> bytes:
    """An article with its metadata on top and its identity in the keywords. A text without content is an error."""
    f = _fields(article)
    head = [f["titulo"], "", f"Autor: {f['autor'] or 'Não informado'}", f"Data: {f['data'] or 'Não informada'}", f"Categoria: {f['categoria'] or 'Não informada'}", f"URL original: {f['url'] or 'Não informada'}", ""]
    lines = [w for x in [*head, *f["conteudo_texto"].split("\n")] for w in wrapped(x)]
    return write_pdf(lines, _info(f, document_id, source_sha))


def text_pdf(text: str, title: str = "", url: str = "") -> bytes:
    """Any text as a simple PDF of 54 lines a page; what the font lacks becomes a question mark."""
    shown = text.translate(str.maketrans(_DROP)).encode("cp1252", "replace").decode("cp1252")
    lines = [w for x in shown.splitlines() for w in textwrap.wrap(x, WIDTH) or [""]]
    return write_pdf(lines, {"Title": title, "Subject": f"Source-URL: {url}" if url else "", "Creator": CREATOR, "Producer": PRODUCER}, 54)


@dataclass
class Pdf:
    pages: list[str] = field(default_factory=list)
    info: dict[str, str] = field(default_factory=dict)

    @property
    def text(self) -> str:
        return "\n\n".join(self.pages).strip()


_STRING = re.compile(rb"\((?:[^()\\]++|\\.|\((?:[^()\\]++|\\.)*+\))*+\)|<[0-9A-Fa-f\s]*>", re.S)
_SHOW = re.compile(rb"(?P<font>/F\w+)\s+[\d.]+\s+Tf|(?P<array>\[(?:[^\]\\]|\\.)*\])\s*TJ|(?P<one>\((?:[^()\\]++|\\.|\((?:[^()\\]++|\\.)*+\))*+\)|<[0-9A-Fa-f\s]*>)\s*(?P<op>Tj|'|\")|(?P<next>T\*|\bTd\b|\bTD\b|\bTm\b)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _bytes(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    if b"\\" not in token:
        return token[1:-1]
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def _string(token: bytes) -> str:
    raw = _bytes(token)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def _page_text(stream: bytes, symbol: bytes) -> str:
    signs = {v: k for k, v in SYMBOLS.items()}
    out: list[str] = []
    plain: list[bytes] = []  # decoded at once, as every byte is a sign of its own

    def decoded() -> None:
        out.append(b"".join(plain).decode("cp1252", "replace"))
        plain.clear()

    font, started = b"", False
    for m in _SHOW.finditer(stream):
        kind = m.lastgroup
        if kind == "next":
            if started:
                plain.append(b"\n")
        elif kind == "font":
            font = m["font"]
        else:
            if kind == "op" and m["op"] != b"Tj" and started:
                plain.append(b"\n")
            raw = _bytes(m["one"]) if kind == "op" else b"".join(_bytes(t[0]) for t in _STRING.finditer(m["array"]))
            if font == symbol:
                decoded()
                out.append("".join(signs.get(b, "?") for b in raw))
            else:
                plain.append(raw)
            started = True
    decoded()
    return "".join(out).strip("\n")


_HEAD = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")


def _word(data: bytes, word: bytes, at: int) -> int:
    """Where word stands by itself, from a place on; -1: nowhere."""
    while (at := data.find(word, at)) >= 0:
        if not re.match(rb"\w", data[at - 1 : at]) and not re.match(rb"\w", data[at + len(word) : at + len(word) + 1]):
            return at
        at += 1
    return -1


def read_pdf(data: bytes | None) -> Pdf:
    """Text and metadata of a PDF with simple fonts; streams may be deflated. Errors say what is wrong."""
    if not data:
        raise ValueError("the PDF is empty")
    if not data.startswith(b"%PDF-"):
        raise ValueError("the PDF signature is missing")
    objects, at = {}, 0
    while (m := _HEAD.search(data, at)) and (end := _word(data, b"endobj", m.end())) >= 0:
        objects[int(m[1])], at = data[m.end() : end], end + 6
    out = Pdf()

    def stream(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n", body)
        end = body.find(b"endstream", m.end()) if m else -1
        if end < 0:
            m, raw = None, b""
        else:
            raw = body[m.end() : end]
            raw = raw[: -2 if raw.endswith(b"\r\n") else -1 if raw.endswith((b"\n", b"\r")) else None]
        return zlib.decompressobj().decompress(raw) if b"FlateDecode" in body[: m.start() if m else 0] else raw

    def order(number: int, seen: frozenset[int] = frozenset()) -> Iterator[bytes]:
        body = objects.get(number, b"")
        if kids := re.search(rb"/Kids\s*\[(.*?)\]", body, re.S):
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                if int(k) not in seen:
                    yield from order(int(k), seen | {number})
        elif re.search(rb"/Type\s*/Page\b", body):
            yield body

    # the last trailer, if there is one, says what counts, and no text that looks like it
    trailer = data[max(0, data.rfind(b"trailer")) :]
    if not re.search(rb"/Root\s+\d+", trailer):
        trailer = data
    root = re.search(rb"/Root\s+(\d+)", trailer)
    tree = re.search(rb"/Pages\s+(\d+)", objects.get(int(root[1]), b"")) if root else None
    for page in order(int(tree[1])) if tree else (b for b in objects.values() if re.search(rb"/Type\s*/Page\b", b)):
        fonts = {n: objects.get(int(i), b"") for n, i in re.findall(rb"(/F\w+)\s+(\d+)\s+\d+\s+R", page)}
        symbol = next((n for n, b in fonts.items() if b"/Symbol" in b), b"")
        held = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", page, re.S)
        parts = re.findall(rb"(\d+)\s+\d+\s+R", held[1] or held[2]) if held else []
        out.pages.append(_page_text(b"\n".join(stream(objects.get(int(p), b"")) for p in parts), symbol))
    if info := re.search(rb"/Info\s+(\d+)", trailer) or re.search(rb"/Info\s+(\d+)", data):
        body = objects.get(int(info[1]), b"")
        out.info = {m[1].decode(): _string(m[2]) for m in re.finditer(rb"/(\w+)\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)", body, re.S)}
    return out


def validate(data: bytes | None, article: Mapping[str, str], document_id: str, source_sha: str) -> list[str]:
    """What is wrong with the PDF of an article; nothing if it is right."""
    try:
        pdf = read_pdf(data)
    except ValueError as error:
        return [str(error)]
    want = read_pdf(write_pdf([], _info(_fields(article), document_id, source_sha))).info
    flat = "".join(pdf.text.split())
    wrong = [f"metadata {k}" for k, v in want.items() if pdf.info.get(k, "") != v]
    wrong += [f"{k} is missing" for k in ("titulo", "url") if "".join(printable(article.get(k) or "").split()) not in flat]
    return wrong + ["no pages"] * (not pdf.pages) + ["no text"] * (not flat)


def _decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for at in range(0, len(whole), AT_ONCE):
            rows = []
            for data in whole[at : at + AT_ONCE]:
                try:
                    p = read_pdf(data)
                    rows.append((p.text, *(p.info.get(k) for k in ("Title", "Author", "Subject", "Creator", "Keywords")), len(p.pages), None if p.text else "the PDF has no text"))
                except (ValueError, zlib.error) as error:
                    rows.append((None,) * 6 + (0, str(error)))
            yield pd.DataFrame(rows, columns=["text", "title", "author", "subject", "creator", "keywords", "pages", "error"])


def decode_pdfs(content: Column) -> Column:
    """struct<text, title, subject, creator, keywords, error> of PDF bytes; a bad file has an error and no text."""

    @F.pandas_udf("text string, title string, author string, subject string, creator string, keywords string, pages int, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _decoded(batches)

    return run(content)


def pdf_articles(files: DataFrame) -> DataFrame:
    """Articles of PDF files (path, content): document_id from the keywords, else pdf_ and the file's stem."""
    df = files.withColumn("p", decode_pdfs(F.col("content"))).withColumn("k", pdf_keywords(F.col("p.keywords")))
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    url = F.when(F.col("p.subject").startswith("Source-URL: "), F.trim(F.substring(F.col("p.subject"), 13, 10_000))).otherwise(F.lit(""))
    title = F.when(F.coalesce("p.title", F.lit("")) != "", F.col("p.title")).otherwise(F.initcap(F.replace(stem, F.lit("_"), F.lit(" "))))
    return df.select(
        F.coalesce(F.try_element_at("k", F.lit("Canonical-ID")), F.concat(F.lit("pdf_"), stem)).alias("document_id"), title.alias("title"), F.coalesce("p.author", F.lit("")).alias("author"), F.lit("").alias("published_at"), F.lit("").alias("category"),
        url.alias("url"), F.col("p.text").alias("text"), F.element_at(F.split("path", "/"), -1).alias("object_name"), F.sha2("content", 256).alias("binary_sha256"), F.try_element_at("k", F.lit("Source-SHA256")).alias("source_content_sha256"), F.col("p.error").alias("error"),
    )


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), AT_ONCE):
            ids, made, errors = [], [], []
            for r in whole.slice(at, AT_ONCE).to_pylist():
                data, wrong = None, None
                try:
                    data = article_pdf({k: v if isinstance(v, str) else "" for k, v in r.items()}, r["document_id"], r["source_sha"] or "")
                except ValueError as error:
                    wrong = str(error)
                ids.append(r["document_id"])
                made.append(data)
                errors.append(wrong)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(made, pa.binary()), pa.array(errors, pa.string())], names=["document_id", "content", "error"])


def article_pdfs(articles: DataFrame) -> DataFrame:
    """(document_id, content, sha256, error) of articles (document_id, the six fields, source_sha): one PDF each."""

    made = articles.select("document_id", "titulo", "autor", "data", "categoria", "url", "conteudo_texto", "source_sha").mapInArrow(_made, "document_id string, content binary, error string")
    return made.withColumn("sha256", F.sha2("content", 256))
