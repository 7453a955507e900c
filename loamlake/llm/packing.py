"""Operator 9, packing by the sum-of-squares rule.

Whole windows are cut off each document first. What is left over, shorter than a window, is placed online:
of all fill levels with room the one is taken that keeps the sum of the squared counts of partially filled
windows smallest, looked up in an array with one count per level. When a task ends, the windows that are
still open are emptied into each other by cutting documents, so a task pads at most one window; that last
one is split at powers of two where that saves padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.llm.bpe import DEFAULT_FILE, BytePairs
from loamlake.llm.common import table

WINDOW = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
WITH_IDS = f"{SCHEMA}, ids binary"
#: Windows of one task are numbered below this, after the task's number.
PER_TASK = 1 << 36


class SumOfSquares:
    """Open windows by fill level. place(size) says which window takes a piece, and at which offset."""

    def __init__(self, width: int) -> None:
        self.width, self.next = width, 0
        self.count = np.zeros(width + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(width + 1)]

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, size: int) -> tuple[int, int]:
        """0 < size < width. Ties: the fullest level, then the window that reached it last."""
        room = self.width - size
        # counts[h] -> -1 and counts[h + size] -> +1 change the sum of squares by 2 * (counts[h + size] - counts[h] + 1)
        change = 2 * (self.count[size + 1 : self.width + 1] - self.count[1 : room + 1] + 1)
        change[-1:] = 1 - 2 * self.count[room : room + 1]  # a full window isn't counted
        change = np.where(self.count[1 : room + 1] > 0, change, np.iinfo(np.int64).max)
        fresh = 2 * self.count[size] + 1
        level = 0
        if len(change):
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= fresh:
                level = best + 1
        window = self.new() if level == 0 else self.open[level].pop()
        if level:
            self.count[level] -= 1
        if level + size < self.width:
            self.count[level + size] += 1
            self.open[level + size].append(window)
        return window, level


def _finish(pieces: list[tuple], packer: SumOfSquares, open_windows: set[int]) -> list[tuple]:
    """(doc, at, length, window, offset) of open windows, poured into full ones in order; powers of two for the rest."""
    poured = sorted((p for p in pieces if p[3] in open_windows), key=lambda p: (p[3], p[4]))
    left = sum(p[2] for p in poured)
    out = [p for p in pieces if p[3] not in open_windows]
    window, offset, room = -1, 0, 0
    for doc, at, length, _, _ in poured:
        while length:
            if not room:
                room = packer.width if left >= packer.width else _part(left, packer.width)
                window, offset = packer.new(), 0
                left -= min(room, left)
            take = min(room, length)
            out.append((doc, at, take, window, offset))
            at, length, offset, room = at + take, length - take, offset + take, room - take
    return out


def _part(left: int, width: int) -> int:
    """The next window's share of the last ids: a power of two needs no padding."""
    return 1 << (left.bit_length() - 1)


def pack_task(ids: Iterator[tuple[int | None, bytes]], width: int, task: int, with_ids: bool) -> Iterator[pd.DataFrame]:
    """Packs the documents of one task. Only ids of pieces in open windows stay in memory, under one window each."""
    packer, first = SumOfSquares(width), task * PER_TASK
    waiting: dict[int, list[tuple]] = {}  # open window -> its pieces
    rows: list[tuple] = []
    docs: dict[int, tuple] = {}  # number -> doc_id, ids of the piece, start of them, tokens of the document

    def row(doc: int, at: int, length: int, window: int, offset: int) -> tuple:
        doc_id, data, base, total = docs[doc]
        piece = data[4 * at : 4 * (at + length)]
        out = (doc_id, base + at, length, zlib.crc32(piece), total, first + window, offset)
        return (*out, bytes(piece)) if with_ids else out

    names = [x.split()[0] for x in (WITH_IDS if with_ids else SCHEMA).split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    for number, (doc_id, data) in enumerate(ids):
        total = len(data) // 4
        whole = total - total % width
        docs[number] = (doc_id, data, 0, total)
        for at in range(0, whole, width):
            rows.append(row(number, at, width, packer.new(), 0))
        if size := total - whole:
            docs[number] = (doc_id, data[4 * whole :], whole, total)
            window, offset = packer.place(size)
            mine = waiting.setdefault(window, [])
            mine.append((number, 0, size, window, offset))
            if offset + size == width:
                for p in waiting.pop(window):
                    rows.append(row(*p))
                    del docs[p[0]]
        else:
            del docs[number]
        if len(rows) >= 5_000:
            yield frame(rows)
            rows = []
    rest = [p for pieces in waiting.values() for p in pieces]
    rows += [row(*p) for p in _finish(rest, packer, set(waiting))]
    if rows:
        yield frame(rows)


def pack_documents(docs: DataFrame, file: str = DEFAULT_FILE, width: int = WINDOW, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece (SCHEMA; with_ids adds the ids themselves as little-endian uint32).

    A null or empty text is the end id alone. A null key stays null; repeated rows are packed as often as
    they come. Documents longer than a window are cut. Each input partition packs its own documents, without
    a shuffle, and numbers its windows from its own number, so a repeated task gives the same rows; an empty
    table gives none. Other columns are ignored.
    """
    if width < 1 or width & (width - 1):
        raise ValueError("the window must be a power of two")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, end = BytePairs.of(file), np.array([end_id], "<u4").tobytes()

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for doc_id, body in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                    yield None if pd.isna(doc_id) else int(doc_id), bpe.encode(body or "") + end

        yield from pack_task(encoded(), width, TaskContext.get().partitionId(), with_ids)

    # as text, a null id in a batch doesn't make the others floats
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run, WITH_IDS if with_ids else SCHEMA)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}  # SQL has no tokenizer
QUERIES = {"op9_pack": op9_pack}
