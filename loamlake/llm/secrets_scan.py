"""Operator 5, secret scans with structural confirmation.

Three patterns report on sight: assignments to names of secrets, access key ids and long hex runs. Base64
and hex candidates that could be keys or signed tokens are decoded first and reported only if what they
hold parses: a private key in DER whose nested lengths tile exactly, an OpenSSH key in its length-prefixed
form, or a token whose header and claims are JSON objects and whose header names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.llm.common import table

#: In the order that breaks ties; the first three are the base.
KINDS = ("assign", "access", "hex", "token", "key")
BASE = 3


def _either(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


#: An assignment needs one of these in any case.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), f"{_either('api')}_?{_either('key')}"])
ASSIGN = re.compile(rf"(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: A JSON object begins with a brace and a quote or white space, so its base64 begins with ew or ey.
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(e[wy][A-Za-z0-9_-]{6,})\.([A-Za-z0-9_-]{3,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{32}")
#: A value may follow the equals sign of its name; names joined to it by other delimiters are cut off in key_in.
BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}(?![A-Za-z0-9+/_=-])")
HEX_BLOB = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?((?:[0-9A-Fa-f]{2}){40,}+)(?![0-9A-Za-z])")
#: Lines may end in literal \n or \r, as in JSON and env strings, and a slash may be escaped.
ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----((?:[A-Za-z0-9+/=\s]++|\\+[nrt/])++)-----END [A-Z0-9 ]*PRIVATE KEY-----")
ESCAPED = re.compile(r"\\+[nrt]")
#: Where a key can begin after a delimiter: the base64 of a DER sequence or of the OpenSSH magic.
BEGIN = re.compile(r"(?<=[+/_-])(?=M[A-P]|b3BlbnNzaC1rZXktdjEA)")


def unbase64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, padded or not; null if it isn't any."""
    body = "".join(text.split()).rstrip("=").translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[at:end] exactly; null if lengths don't tile."""
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or end - at < n or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if size > end - at:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_private_der(data: bytes) -> bool:
    """PKCS#1, SEC 1, PKCS#8 or encrypted PKCS#8; every constructed value must tile down to the leaves."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    stack, first = [top[0]], None
    while stack:
        tag, a, b = stack.pop()
        if tag & 0x20:
            items = der_items(data, a, b)
            if items is None:
                return False
            first = items if first is None else first
            stack += items
    tags = [t for t, _, _ in first]
    number = int.from_bytes(data[first[0][1] : first[0][2]], "big") if tags and tags[0] == 0x02 else None
    within = [t for t, _, _ in der_items(data, *first[k][1:]) or []] if (k := 1 if number is not None else 0) < len(first) and first[k][0] == 0x30 else []
    algorithm = within[:1] == [0x06]
    return (
        (number in (0, 1) and len(tags) >= 9 and tags[1:9] == [0x02] * 8 and first[1][2] - first[1][1] >= 32)
        or (number == 1 and tags[1:2] == [0x04] and first[1][2] - first[1][1] >= 16)
        or (number in (0, 1) and algorithm and tags[2:3] == [0x04])
        or (number is None and algorithm and tags == [0x30, 0x04])
    )


def is_openssh_key(data: bytes) -> bool:
    """The magic, then cipher, derivation, options, the number of keys, and as many public parts and one private part."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def string(at: int) -> int:
        size = int.from_bytes(data[at : at + 4], "big")
        return at + 4 + size if len(data) - at - 4 >= size else -1

    for _ in range(3):
        if (at := string(at)) < 0:
            return False
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= count <= 16:
        return False
    for _ in range(count + 1):
        if (at := string(at)) < 0:
            return False
    return at == len(data)


def is_signed_token(header: str, claims: str) -> bool:
    objects = []
    for part in (header, claims):
        try:
            objects.append(json.loads(unbase64(part) or b""))
        except (ValueError, RecursionError):
            return False
    return all(isinstance(x, dict) for x in objects) and isinstance(objects[0].get("alg"), str)


def holds_key(data: bytes | None) -> bool:
    return bool(data) and (is_private_der(data) or is_openssh_key(data))


def key_in(run: str) -> int | None:
    """Where in a base64 run a key begins that fills it to the end: at its start, or after a delimiter."""
    if holds_key(unbase64(run)):
        return 0
    size = len(run.rstrip("="))
    for m in BEGIN.finditer(run):
        at = m.start()
        if run[at] == "M":  # the outer length must fit before the rest is decoded
            head, total = unbase64(run[at : at + 8]) or b"", (size - at) * 3 // 4
            n = head[1] & 0x7F if len(head) > 1 and head[1] & 0x80 else 0
            if len(head) < 6 or n > 4 or 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1]) != total:
                continue
        if holds_key(unbase64(run[at:])):
            return at
    return None


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then by KINDS; a span of one kind only once."""
    text = text or ""
    found = {("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16}
    low = text.lower()
    if any(word in low for word in WORDS):
        found |= {("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8}
    found |= {("token", *m.span()) for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2])}
    if not RUN.search(text):  # none of the other patterns can match without one
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    found |= {("hex", *m.span()) for m in HEX.finditer(text)}
    found |= {("key", *m.span()) for m in ARMOUR.finditer(text) if holds_key(unbase64(ESCAPED.sub("", m[1]).replace("\\", "")))}
    inside = [(a, b) for k, a, b in found if k == "key"]
    keys = {(m.start() + at, m.end()) for m in BLOB.finditer(text) if (at := key_in(m[0])) is not None}
    keys |= {m.span(1) for m in HEX_BLOB.finditer(text) if holds_key(bytes.fromhex(m[1]))}
    found |= {("key", *k) for k in keys if not any(a <= k[0] and k[1] <= b for a, b in inside)}
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def secret_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of each whole text; empty for null, empty or harmless texts.

    Rows are scanned on their own, so repeated rows report alike and no row moves; long texts are read whole.
    """

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] for t in texts], dtype=object)

    return scan(text.cast("string"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", secret_spans(F.col("text")).alias("s"))
    of = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("s", lambda x: x["kind"].isin(*KINDS[:BASE]))
    return docs.select("doc_id", *map(of, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


SQL: dict[str, str] = {}  # SQL doesn't parse keys; hashlib and brute force check it in the tests
QUERIES = {"op5_secret_scan": op5_secret_scan}
