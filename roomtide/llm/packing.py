"""Packing documents into token sequences: sum-of-squares online packing.

A document is cut into whole windows and a rest. A rest goes to the fill level that makes the sum of squares of
the numbers of windows at each partial level smallest; the numbers are kept in an array by level. A task packs
the documents of its partition as they come, with one array and the open windows as its only state, so nothing
is shuffled and no task sees more than its partition.

At the end of a partition a window whose fill is a power of two needs no padding and stays. The pieces of the others
are laid end to end and cut into whole windows; what is left after them is cut into powers of two. So only
pieces of the last open windows of a partition are ever cut, and no sequence has padding.

Defined cases: null text is empty and is one piece of the end id alone; repeated rows are packed each. A sequence
belongs to one partition: its id is the partition's number times 2^32 plus a running number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from roomtide.llm.common import give_back, text_batches
from roomtide.llm.pieces import TEXT_BYTES, default_vocabulary, piece_ids

WINDOW = 4096
END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Open windows by fill level. `place` puts an item of `size` < window into the level that minimises the sum of
    squared level counts, and returns the window and the offset; `open` holds (window, fill) after the last item."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # open windows at each fill; 0 and the full level count nothing
        self.at: list[list[int]] = [[] for _ in range(window)]
        self.next = 0

    def place(self, size: int) -> tuple[int, int]:
        # Moving a window from level h to h + size changes the sum of squares by
        # (N[h] - 1)^2 - N[h]^2 + (N[h + size] + 1)^2 - N[h + size]^2; a new window only adds at `size`.
        h = self.counts[1 : self.window - size + 1]
        target = self.counts[1 + size : self.window + 1]
        change = 2 * target - 2 * h + 2
        if len(change):
            change[-1] = 1 - 2 * h[-1]  # a filled window leaves the count
        change = np.where(h > 0, change, np.iinfo(np.int64).max)
        fresh = 2 * self.counts[size] + 1
        best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else -1  # ties: the fullest
        if best >= 0 and change[best] <= fresh:
            level = best + 1
            self.counts[level] -= 1
            name = self.at[level].pop()
        else:
            level, name, self.next = 0, self.next, self.next + 1
        fill = level + size
        if fill < self.window:
            self.counts[fill] += 1
            self.at[fill].append(name)
        return name, level

    def open(self) -> list[tuple[int, int]]:
        return [(name, fill) for fill, names in enumerate(self.at) for name in names]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def pack_stream(documents: Iterator[tuple[int, np.ndarray]], window: int = WINDOW) -> Iterator[tuple]:
    """Pieces (doc_id, start, length, crc, doc_tokens, sequence, offset) of documents given with their ids."""
    packer = SumOfSquares(window)
    held: dict[int, list[tuple]] = {}  # the pieces of each open window, with their ids
    for doc_id, ids in documents:
        total = len(ids)
        whole = total // window * window
        for start in range(0, whole, window):
            yield doc_id, start, window, crc(ids[start : start + window]), total, packer.next, 0
            packer.next += 1
        if rest := total - whole:
            name, offset = packer.place(rest)
            pieces = held.setdefault(name, [])
            pieces.append((doc_id, whole, ids[whole:], total, offset))
            if offset + rest == window:
                for piece in held.pop(name):
                    yield piece[0], piece[1], len(piece[2]), crc(piece[2]), piece[3], name, piece[4]
    loose = []
    for name, fill in packer.open():
        pieces = held.pop(name)
        if fill & (fill - 1):
            loose += pieces
        else:
            for piece in pieces:
                yield piece[0], piece[1], len(piece[2]), crc(piece[2]), piece[3], name, piece[4]
    # Whole windows, then the powers of two that make up what is left.
    left = sum(len(p[2]) for p in loose)
    sizes = [window] * (left // window) + [1 << b for b in range(window.bit_length(), -1, -1) if left % window >> b & 1]
    sizes = iter(sizes)
    room, fill = 0, 0
    for doc_id, start, ids, total, _ in loose:
        while len(ids):
            if not room:
                room, fill, name, packer.next = next(sizes), 0, packer.next, packer.next + 1
            part = ids[:room]
            yield doc_id, start, len(part), crc(part), total, name, fill
            start, ids, room, fill = start + len(part), ids[len(part) :], room - len(part), fill + len(part)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what other stages have freed in this worker
        known, base = piece_ids(path), TaskContext.get().partitionId() << 32

        def documents():
            for batch in text_batches(batches, TEXT_BYTES):
                ids, sizes = known.of(batch.column("text"), END_ID)
                cuts = [0, *np.cumsum(sizes).tolist()]
                # Copies, as open windows would keep all ids of the batch.
                each = (ids[a:b].copy() for a, b in zip(cuts[:-1], cuts[1:], strict=True))
                yield from zip(batch.column("doc_id").to_pylist(), each, strict=True)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            columns[5] = [base + x for x in columns[5]]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        rows = []
        for piece in pack_stream(documents(), window):
            rows.append(piece)
            if len(rows) == 10_000:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op2(spark, folder: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{folder}/documents.parquet"))
