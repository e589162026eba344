"""Token ids in compressed files: a static range asymmetric numeral system (rANS) with one frequency table for all files.

A table of documents is encoded with a public tokenizer, an end id is put behind each document, and the ids of all documents
are counted. The counts, scaled to 2^SCALE_BITS with at least one for each id that occurs, are the frequency table of
every block. Documents are sorted by doc_id; each part of the sort writes blocks of whole documents in that order.

A block is coded by itself: id i belongs to lane i mod LANES, and all lanes step together, as numpy arrays. A lane's state
is a number in [2^31, 2^63); when an id would push it out, its lower 32 bits go to the block's words. Lanes are coded from
the last step to the first, so that reading goes forward. At every SEGMENT steps a checkpoint keeps the states and the
place in the words, from which reading can start: the segments of a block are decoded side by side, and one document
is read by decoding only its segments. Each segment has a checksum of its ids, each block one of its bytes.

Files lie in three Parquet folders, so that Spark commits them whole, in any store, however often tasks are lost:
`blocks` (part, block, first, ids, docs, data), `frequencies` (id, frequency) and `parts` (part, start). A part's files are
in the order of its number; `first` counts the part's ids before a block, `start` all ids before a part.

Bounds: the driver gets one count for each id of the vocabulary, and the table of frequencies is what every task gets.
`parts` has a row for each part of the sort. A task holds a block (BLOCK ids, or one document if it is longer).

Defined cases: null text is empty and has the end id alone; null doc_ids come first; rows that share a doc_id are
ordered by length and checksum and returned each; a table without rows has no blocks. A damaged block or a block of
another frequency table is an error (ValueError).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomtide.llm.common import buckets, give_back, shared_folder, string_bytes, text_batches, written
from roomtide.llm.pieces import TEXT_BYTES, default_vocabulary, piece_ids

END_ID = 1
SCALE_BITS = 20
LANES = 4096
#: Steps between checkpoints, and ids after which a block is full.
SEGMENT = 256
BLOCK = 1 << 21
LOW = np.uint64(1 << 31)
MAGIC = b"RANS1\n"
#: Magic, checksum of the rest, documents, those of them without a doc_id, ids, lanes, steps a segment, checksum of the table.
HEADER = struct.Struct("<6sIIIQIII")


# --- frequencies ----------------------------------------------------------------------------------


class Frequencies:
    """The shared table: ids that occur, ascending, with frequencies that add up to 2^SCALE_BITS."""

    def __init__(self, ids: np.ndarray, frequency: np.ndarray) -> None:
        self.ids = ids.astype(np.uint32)
        self.frequency = frequency.astype(np.uint64)
        self.below = np.cumsum(self.frequency) - self.frequency
        self.check = zlib.crc32(self.ids.tobytes() + self.frequency.tobytes())
        self._places = None
        self._slots = None

    def places(self, ids: np.ndarray) -> np.ndarray:
        """The places of ids in the table."""
        if self._places is None:
            self._places = np.zeros(int(self.ids[-1]) + 1 if len(self.ids) else 0, np.int64)
            self._places[self.ids] = np.arange(len(self.ids))
        return self._places[ids]

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By each of the 2^SCALE_BITS values of a state's lower bits: frequency, what the value is above the id's first
        one, and the id."""
        if self._slots is None:
            times = self.frequency.astype(np.int64)
            above = np.arange(int(times.sum())) - np.repeat(self.below.astype(np.int64), times)
            self._slots = np.repeat(self.frequency.astype(np.uint32), times), above.astype(np.uint32), np.repeat(self.ids, times)
        return self._slots


def scaled(counts: list[int]) -> np.ndarray:
    """Positive counts as frequencies of at least 1 that add up to 2^SCALE_BITS, in whole numbers of any size."""
    total, free = sum(counts), (1 << SCALE_BITS) - len(counts)
    if free < 0:
        raise ValueError(f"{len(counts)} different ids do not fit a table of 2^{SCALE_BITS}")
    shares = [c * free // total + 1 for c in counts]
    if counts:
        shares[counts.index(max(counts))] += (1 << SCALE_BITS) - sum(shares)
    return np.array(shares, np.uint64)


# --- one block ------------------------------------------------------------------------------------


def lanes_of(n: int) -> int:
    """Short blocks have fewer lanes, whose states would be most of their bytes."""
    return max(1, min(LANES, n // 64))


def encode_block(ids: np.ndarray, docs: np.ndarray, sizes: np.ndarray, table: Frequencies, nulls: int = 0) -> bytes:
    """A block of the ids of whole documents (`docs`, with `sizes` ids each), the first `nulls` of which have no doc_id."""
    n, lanes = len(ids), lanes_of(len(ids))
    steps = -(-n // lanes)
    places = table.places(ids)
    frequency, below = table.frequency[places], table.below[places]
    most = frequency << np.uint64(63 - SCALE_BITS)
    scale, half, low = np.uint64(SCALE_BITS), np.uint64(32), np.uint64(0xFFFFFFFF)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    written_words, marks, states = 0, [], []
    for step in range(steps - 1, -1, -1):
        now = slice(step * lanes, (step + 1) * lanes)
        f = frequency[now]
        x = state[: len(f)]
        out = np.flatnonzero(x >= most[now])
        if len(out):
            full = x[out]
            words.append((full & low).astype("<u4"))
            written_words += len(out)
            x[out] = full >> half
        whole = x // f
        x -= whole * f
        x += whole << scale
        x += below[now]
        if step % SEGMENT == 0:
            marks.append(written_words)
            states.append(state.copy())
    marks.reverse()
    states.reverse()
    # Reading goes forward: the words of the first step come first, so a segment begins where fewer are left.
    begins = np.array([written_words - m for m in marks], "<u4")
    checks = [zlib.crc32(ids[a : a + SEGMENT * lanes].astype("<u4").tobytes()) for a in range(0, n, SEGMENT * lanes)]
    parts = [
        zlib.compress(np.diff(docs, prepend=0).astype("<i8").tobytes(), 1),
        zlib.compress(sizes.astype("<u4").tobytes(), 1),
        begins.tobytes(),
        np.array(checks, "<u4").tobytes(),
        b"".join(s.astype("<u8").tobytes() for s in states),
        b"".join(w.tobytes() for w in reversed(words)),
    ]
    body = struct.pack("<6Q", *map(len, parts)) + b"".join(parts)
    tail = HEADER.pack(MAGIC, 0, len(docs), nulls, n, lanes, SEGMENT, table.check)[10:] + body
    return MAGIC + struct.pack("<I", zlib.crc32(tail)) + tail


class Block:
    """A block's bytes, checked; `docs` and `sizes` without decoding, ids by `decode`."""

    def __init__(self, data: bytes, table: Frequencies) -> None:
        if len(data) < HEADER.size or data[:6] != MAGIC:
            raise ValueError("not a block of token ids")
        _, check, docs, self.nulls, self.n, self.lanes, self.segment, of = HEADER.unpack_from(data)
        if check != zlib.crc32(data[10:]):
            raise ValueError("the bytes of a block do not have its checksum")
        if of != table.check:
            raise ValueError("a block of another frequency table")
        lengths = struct.unpack_from("<6Q", data, HEADER.size)
        cuts = HEADER.size + 48 + np.cumsum([0, *lengths])
        part = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.docs = np.cumsum(np.frombuffer(zlib.decompress(part[0]), "<i8"))
        self.sizes = np.frombuffer(zlib.decompress(part[1]), "<u4").astype(np.int64)
        if len(self.docs) != docs or self.sizes.sum() != self.n:
            raise ValueError("a block's documents do not add up to its ids")
        self.begins = np.frombuffer(part[2], "<u4").astype(np.int64)
        self.checks = np.frombuffer(part[3], "<u4")
        self.states = np.frombuffer(part[4], "<u8").reshape(len(self.begins), self.lanes)
        self.words = np.frombuffer(part[5], "<u4")
        self.table = table

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from `start` to `stop`, decoding only the segments that hold them, all of these side by side."""
        stop = self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        width, lanes = self.segment * self.lanes, self.lanes
        first, last = start // width, -(-stop // width)
        segments = last - first
        held = min(self.n, last * width) - first * width
        rest = held - (segments - 1) * width  # ids of the last segment, which may be fewer
        frequency, above, id_of = self.table.slots()
        state = self.states[first:last].reshape(-1).copy()
        place = self.begins[first:last].copy()
        scale, mask, half = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1), np.uint64(32)
        found = np.zeros((min(self.segment, -(-held // lanes)), segments * lanes), np.uint32)
        for step in range(len(found)):
            live = (segments - 1) * lanes + max(0, min(lanes, rest - step * lanes))
            x = state[:live]
            slot = (x & mask).view(np.int64)
            found[step, :live] = slot
            x >>= scale
            x *= frequency[slot]
            x += above[slot]
            need = np.flatnonzero(x < LOW)
            if len(need):
                count = np.diff(np.searchsorted(need, np.arange(segments + 1) * lanes))
                at = np.arange(len(need)) + np.repeat(place - (np.cumsum(count) - count), count)
                x[need] = (x[need] << half) | self.words[at]
                place += count
        ids = id_of[found.reshape(len(found), segments, lanes).swapaxes(0, 1).reshape(-1)]
        ids = ids[:held]
        for k in range(segments):
            if zlib.crc32(ids[k * width : (k + 1) * width].astype("<u4").tobytes()) != self.checks[first + k]:
                raise ValueError("the ids of a segment do not have their checksum")
        return ids[start - first * width : stop - first * width]


# --- files ----------------------------------------------------------------------------------------

TOKENS = "doc_id long, n long, crc long, ids binary"
BLOCKS = "part int, block int, first long, ids long, docs long, data binary"


def encoded(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """(doc_id, n, crc, ids): the ids of each document in 32 bits, or in 16 if the vocabulary allows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        known = piece_ids(vocabulary)
        unit = "<u2" if known.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in text_batches(batches, TEXT_BYTES):
            ids, sizes = known.of(batch.column("text"), end)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            small = ids.astype(unit)
            size = pa.py_buffer((cuts * small.itemsize).astype(np.int64).tobytes())
            packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, size, pa.py_buffer(small.tobytes())])
            columns = [batch.column("doc_id"), pa.array(sizes), pa.array(crc, pa.int64()), packed.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "crc", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS)


def raw_ids(column: pa.Array, n: int) -> np.ndarray:
    """All ids of a column of packed ids, of which there are n."""
    data, _ = string_bytes(column)
    return np.frombuffer(data.tobytes(), "<u4" if len(data) == 4 * n else "<u2") if n else np.zeros(0, "<u4")


def counted(tokens: DataFrame) -> DataFrame:
    """(id, n) of every id that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            ids = raw_ids(batch.column("ids"), int(batch.column("n").to_numpy().sum()))
            seen = np.bincount(ids, minlength=len(counts))
            seen[: len(counts)] += counts
            counts = seen
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["id", "n"])

    return tokens.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END_ID) -> None:
    """Writes the ids of all documents (doc_id, text) as compressed files under `path`, in ascending doc_id order."""
    spark = docs.sparkSession
    tokens = written(encoded(docs, vocabulary or default_vocabulary(), end).withColumn("row", F.monotonically_increasing_id()))
    # One count for each id of the vocabulary at most.
    counts = sorted(map(tuple, counted(tokens).collect()))
    table = Frequencies(np.array([i for i, _ in counts], np.uint32), scaled([n for _, n in counts]))
    rows = [(int(i), int(f)) for i, f in zip(table.ids, table.frequency, strict=True)]
    spark.createDataFrame(rows, "id long, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast((table.ids, table.frequency))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        own, part = Frequencies(*shared.value), TaskContext.get().partitionId()
        held, size, block, first = [], 0, 0, 0

        def rows() -> pa.RecordBatch:
            ids, docs, sizes, given = (np.concatenate(x) for x in zip(*held, strict=True))
            data = encode_block(ids, docs, sizes, own, int((~given).sum()))  # rows without a doc_id come first
            columns = [[part], [block], [first], [len(ids)], [len(docs)], [data]]
            names = [f.split()[0] for f in BLOCKS.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            sizes = batch.column("n").to_numpy()
            docs = batch.column("doc_id")
            known = docs.is_valid().to_numpy(zero_copy_only=False)
            numbers = docs.fill_null(0).to_numpy(zero_copy_only=False)
            ids = raw_ids(batch.column("ids"), int(sizes.sum()))
            cuts, start = np.cumsum(sizes), 0
            while start < len(sizes):
                before = int(cuts[start - 1]) if start else 0
                stop = int(np.searchsorted(cuts, before + BLOCK - size)) + 1
                stop = min(stop, len(sizes))
                held.append((ids[before : int(cuts[stop - 1])], numbers[start:stop], sizes[start:stop], known[start:stop]))
                size += int(cuts[stop - 1]) - before
                start = stop
                if size >= BLOCK:
                    yield rows()
                    held, first, size, block = [], first + size, 0, block + 1
        if held:
            yield rows()

    order = ["doc_id", "n", "crc", "row"]
    sorted_tokens = tokens.repartitionByRange(buckets(spark, 1), *order).sortWithinPartitions(*order)
    blocks = sorted_tokens.select("doc_id", "n", "ids").mapInArrow(run, BLOCKS)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    sizes = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each part
    parts = sizes.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    parts.write.parquet(f"{path}/parts")


def frequencies(spark: SparkSession, path: str) -> Frequencies:
    """The table of the files; one row for each id of the vocabulary at most."""
    rows = spark.read.schema("id long, frequency long").parquet(f"{path}/frequencies").orderBy("id").collect()
    return Frequencies(np.array([r[0] for r in rows], np.uint32), np.array([r[1] for r in rows], np.uint64))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and `ids`."""
    table = frequencies(spark, path)
    shared = spark.sparkContext.broadcast((table.ids, table.frequency))
    names = ["doc_id", "part", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Frequencies(*shared.value)
        for batch in batches:
            for part, first, data in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "data")), strict=True):
                block = Block(data, own)
                ids = block.decode().astype("<u4", copy=False)
                cuts = np.concatenate([[0], np.cumsum(block.sizes)])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                doc = pa.array(block.docs, pa.int64(), mask=np.arange(len(block.docs)) < block.nulls)
                columns = [doc, pa.array([part] * len(doc), pa.int32()), pa.array(first + cuts[:-1]), pa.array(block.sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.LargeListArray.from_arrays(cuts, pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("part", "first", "data")
    schema = "doc_id long, part int, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    parts = spark.read.schema("part int, start long").parquet(f"{path}/parts").withColumnRenamed("start", "_before")
    rows = blocks.mapInArrow(run, schema).join(parts, "part")
    return rows.withColumn("start", F.col("start") + F.col("_before")).select("doc_id", *names[2:])


def op12(spark, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/roomtide-tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{folder}/documents.parquet"), path)
    return read_tokens(spark, path, with_ids=False)
