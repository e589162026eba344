"""Removal of repeated word windows.

Every window of `width` words has a Rabin-Karp hash: a polynomial in the hashes of its words, from one running sum
modulo 2^64. Windows are counted by hash in buckets that Spark deals out: each task folds the windows of some million
words, settles repeats among them, and sends for every hash only its first start. A bucket finds the first start of
all, and the others are repeats. Repeats go back to the documents, where overlapping windows merge into maximal
intervals.

Windows are equal if their hash and 24 bits of a second one, over the words' hashes mixed anew, both are: n windows give
about n^2 / 2^89 false matches.

Hashes and starts travel as packed bytes, one row for a task and bucket. A window that fills a third of all
documents reaches its bucket once per task, whatever its number.

Defined cases: null or empty text has no words; a text shorter than a window loses nothing. Rows that share a doc_id
are versions of one document: equal starts do not repeat each other, and a start removed in one is removed
in all. A null doc_id counts as after every other. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roomtide.llm.common import (
    PART_SCHEMA,
    Powers,
    buckets,
    dealt,
    dealt_texts,
    doc_ids,
    intervals,
    join_parts,
    mix,
    pack_places,
    part_data,
    part_rows,
    part_texts,
    span_hashes,
    split_by,
    split_parts,
    string_bytes,
    text_batches,
    unpack_places,
    window_hashes,
    window_starts,
    words,
)

WIDTH = 20
#: Windows that a task folds at a time.
FLUSH = 1 << 21
FIRST_STARTS, REPEATS = 1, 2
#: Sets the words' second hashes apart from the first.
OTHER = np.uint64(0x5851F42D4C957F2D)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets by the leading bits, so that sorted hashes have ascending buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def check_bits(tokens: np.ndarray, at: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """24 bits for each window, from a polynomial in other hashes of its words."""
    return (window_hashes(mix(tokens ^ OTHER), at, width, powers) >> np.uint64(40)).astype("<u4")


def pack_checks(checks: np.ndarray) -> bytes:
    return checks.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpack_checks(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def not_first(hashes: np.ndarray, checks: np.ndarray, docs: np.ndarray, places: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Along `order`, which sorts the hashes: whether a start comes after the first one of its hash and check."""
    h = hashes[order]
    run = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    late = np.zeros(len(h), bool)
    several = ~run
    several[:-1] |= ~run[1:]
    many = np.flatnonzero(several)
    if len(many):
        number = np.cumsum(run[many])
        d, p, c = docs[order[many]], places[order[many]], checks[order[many]]
        by = np.lexsort((p, d, c, number))
        d, p, c, number = d[by], p[by], c[by], number[by]
        lead = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (c[1:] != c[:-1])]))
        lead = np.repeat(lead, np.diff(np.append(lead, len(number))))
        late[many[by]] = (d != d[lead]) | (p != p[lead])
    return late


def window_rows(docs: DataFrame, width: int, n: int) -> DataFrame:
    """Rows (bucket, FIRST_STARTS, hashes, checks and starts) and (bucket, REPEATS, starts) of the windows of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size, turn = Powers(), [], 0, 0

        def rows() -> pa.RecordBatch:
            hashes, checks, ids, places = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if np.any(ids[1:] < ids[:-1]):
                by = np.argsort(ids, kind="stable")
                hashes, checks, ids, places = hashes[by], checks[by], ids[by], places[by]
            order = np.argsort(hashes, kind="stable")
            late = not_first(hashes, checks, ids, places, order)
            first = order[~late]
            cuts = np.searchsorted(bucket_of(hashes[first], n), np.arange(n + 1))
            out = []
            for bucket, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    at = np.sort(first[a:b])
                    data = join_parts(hashes[at].astype("<u8").tobytes(), pack_checks(checks[at]), pack_places(ids[at], places[at]))
                    out.append((bucket, FIRST_STARTS, data))
            again = np.sort(order[late])
            if len(again):
                out.append((turn % n, REPEATS, pack_places(ids[again], places[again])))
            return part_rows(out)

        for batch in text_batches(batches):
            data, ends = string_bytes(batch.column("text"))
            starts, stops, first = words(data, ends)
            tokens = span_hashes(data, starts, stops)
            at, text = window_starts(first, width)
            if len(at):
                hashes, checks = window_hashes(tokens, at, width, powers), check_bits(tokens, at, width, powers)
                held.append((hashes, checks, doc_ids(batch.column("doc_id"))[text], at - first[text]))
                size += len(at)
            turn += 1
            if size >= FLUSH:
                yield rows()
                size = 0
        if held:
            yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, PART_SCHEMA)


def repeated_starts(table: pa.Table, parts: int) -> pa.Table:
    """The repeats of one bucket as rows (part of the document, REPEATS, starts)."""
    found = []
    for data in part_data(table, FIRST_STARTS):
        h, c, starts = split_parts(data)
        found.append((np.frombuffer(h, "<u8"), unpack_checks(c), *unpack_places(starts)))
    again = [unpack_places(data) for data in part_data(table, REPEATS)]
    if found:
        h, c, d, p = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        order = np.argsort(h)
        late = order[not_first(h, c, d, p, order)]
        again.append((d[late], p[late]))
        del h, c, d, p, order
    d, p = (np.concatenate(x) for x in zip(*again, strict=True))
    by = np.lexsort((p, d))
    d, p = d[by], p[by]
    rows = [(part, REPEATS, pack_places(d[at], p[at])) for part, at in split_by(dealt(d, parts), parts)]
    return pa.Table.from_batches([part_rows(rows)])


def cleaned(table: pa.Table, width: int) -> Iterator[tuple]:
    """(doc_id, words, starts of the removed intervals, their ends) for the documents of one part."""
    docs = part_texts(table)
    ids = doc_ids(docs.column("doc_id").combine_chunks()) if docs.num_rows else np.zeros(0, np.int64)
    again = [unpack_places(data) for data in part_data(table, REPEATS)]
    d, p = (np.concatenate(x) for x in zip(*again, strict=True)) if again else (np.zeros(0, np.int64),) * 2
    by = np.lexsort((p, d))
    d, p = d[by], p[by]
    low, high = np.searchsorted(d, ids), np.searchsorted(d, ids, "right")
    for i, (doc_id, text) in enumerate(zip(docs.column("doc_id"), docs.column("text"), strict=True)):
        found = text.as_buffer().to_pybytes().split() if text.is_valid else []  # splits at the six ASCII spaces
        starts = p[low[i] : high[i]]
        starts, stops = intervals(starts, starts + width)
        yield doc_id.as_py(), found, starts, np.minimum(stops, len(found))


def remove_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and the kept words joined by one space as text if
    asked for."""
    spark = docs.sparkSession
    n = parts = buckets(spark)
    docs = docs.select("doc_id", "text")
    repeats = window_rows(docs, width, n).groupBy("part").applyInArrow(lambda t: repeated_starts(t, parts), PART_SCHEMA)

    def finish(table: pa.Table) -> pa.Table:
        out = []
        for doc_id, found, starts, stops in cleaned(table, width):
            keep = np.ones(len(found), bool)
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                keep[a:b] = False
            kept = b" ".join(found if not len(starts) else compress(found, keep.tolist()))
            text = kept.decode() if with_text else None
            out.append((doc_id, len(found), int(len(found) - keep.sum()), hashlib.sha256(kept).hexdigest(), text))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate(zip(names, kinds, strict=False))})

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text
    schema = ", ".join(f"{n} {'string' if n in ('kept_sha256', 'text') else 'long'}" for n in names)

    rows = dealt_texts(docs, parts).union(repeats)
    return rows.groupBy("part").applyInArrow(finish, schema)


def op5(spark, folder: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"), with_text=False)
