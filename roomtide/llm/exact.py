"""Exact dedup with counting quotient filters.

Each partition folds the fingerprints of its texts into counting quotient filters, one for each segment of the
fingerprint space: a fingerprint is cut into a quotient, for which only the length of its run is stored, and a
remainder, sorted within the run, with a count. Filters of a segment merge without loss by sorted remainders. Only
texts whose fingerprint counts more than one are compared byte by byte, by grouping on the text itself, with
partial aggregation before the shuffle.

A hot text costs one entry in each partition's filter and one partial group in each task; its rows meet no
single task. The join that routes repeated texts is one whose large partitions adaptive execution splits.

Defined cases: null counts as the empty text. Of rows that agree in doc_id and text exactly one is kept. A null doc_id
loses to every other; a group without any other has a null keep_id. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtide.llm.common import buckets, join_parts, pack_gaps, split_parts, text_column, unpack_gaps

#: Bits of the quotient inside a segment.
QUOTIENT_BITS = 12
FLUSH = 1 << 20


class CountingQuotientFilter:
    """Fingerprints of one segment: run length by quotient, sorted remainders, counts.

    `segment_bits` leading bits of the 64 name the segment; the next QUOTIENT_BITS are the quotient.
    """

    def __init__(self, segment_bits: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> None:
        self.segment_bits, self.runs, self.remainders, self.counts = segment_bits, runs, remainders, counts

    @staticmethod
    def _rest_bits(segment_bits: int) -> np.uint64:
        return np.uint64(64 - segment_bits - QUOTIENT_BITS)

    @classmethod
    def of(cls, segment_bits: int, fingerprints: np.ndarray, counts: np.ndarray | None = None):
        """From the unsigned fingerprints of one segment, in any order, with their counts (1 each by default)."""
        values, inverse = np.unique(fingerprints, return_inverse=True)
        counts = np.bincount(inverse, counts, len(values)).astype(np.int64)
        rest = cls._rest_bits(segment_bits)
        quotients = (values >> rest) & np.uint64((1 << QUOTIENT_BITS) - 1)
        runs = np.bincount(quotients.astype(np.int64), minlength=1 << QUOTIENT_BITS)
        return cls(segment_bits, runs, values & ((np.uint64(1) << rest) - np.uint64(1)), counts)

    def fingerprints(self, segment: int) -> np.ndarray:
        """The whole fingerprints, ascending."""
        rest = self._rest_bits(self.segment_bits)
        top = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs) << rest
        lead = np.uint64(segment << (64 - self.segment_bits)) if self.segment_bits else np.uint64(0)
        return lead | top | self.remainders

    def merge(self, others: list[CountingQuotientFilter], segment: int) -> CountingQuotientFilter:
        """All filters in one; nothing is lost, as each entry is its whole fingerprint."""
        every = [self, *others]
        return self.of(
            self.segment_bits,
            np.concatenate([f.fingerprints(segment) for f in every]),
            np.concatenate([f.counts for f in every]),
        )

    def to_bytes(self) -> bytes:
        return join_parts(pack_gaps(self.runs), self.remainders.astype("<u8").tobytes(), pack_gaps(self.counts))

    @classmethod
    def from_bytes(cls, segment_bits: int, data: bytes) -> CountingQuotientFilter:
        runs, remainders, counts = split_parts(data)
        return cls(segment_bits, unpack_gaps(runs), np.frombuffer(remainders, "<u8"), unpack_gaps(counts))


def repeated_fingerprints(fingerprints: DataFrame, column: str = "fp") -> DataFrame:
    """(fp, n): the 64-bit fingerprints that occur more than once in `column`, with their counts."""
    segment_bits = max(buckets(fingerprints.sparkSession) - 1, 1).bit_length()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held).view(np.uint64))
            segments = (values >> np.uint64(64 - segment_bits)).astype(np.int64)
            names, first = np.unique(segments, return_index=True)
            parts = np.split(values, first[1:])
            filters = [CountingQuotientFilter.of(segment_bits, part).to_bytes() for part in parts]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(filters, pa.binary())], ["segment", "filter"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        segment = key[0].as_py()
        first, *rest = [CountingQuotientFilter.from_bytes(segment_bits, x) for x in table.column("filter").to_pylist()]
        whole = first.merge(rest, segment)
        many = whole.counts > 1
        values = whole.fingerprints(segment)[many].view(np.int64)
        return pa.table({"fp": pa.array(values, pa.int64()), "n": pa.array(whole.counts[many], pa.int64())})

    filters = fingerprints.select(column).mapInArrow(build, "segment long, filter binary")
    return filters.groupBy("segment").applyInArrow(merge, "fp long, n long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    text = text_column()
    base = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("fp"))
    repeated = repeated_fingerprints(base)
    verified = (
        base.join(repeated.select("fp"), "fp", "left_semi")
        .groupBy("text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
        .filter("group_size > 1")
    )
    rows = base.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    rows = rows.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("same"))
    placed = rows.join(verified, "text_sha256", "left")
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))))
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return placed.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (keep_id.eqNullSafe(F.col("doc_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each group of equal texts; columns as given."""
    # Keys without nulls, so that the join and the last step share a shuffle of the texts.
    number = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    kept = exact_groups(docs).filter("kept").select(number.alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    rows = docs.withColumns({"_kept_id": number, "_kept_sha": F.sha2(text_column(), 256)})
    rows = rows.join(kept, ["_kept_id", "_kept_sha"], "left_semi")
    return rows.dropDuplicates(["_kept_id", "_kept_sha"]).select(*docs.columns)


def op3(spark, folder: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{folder}/documents.parquet"))


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
