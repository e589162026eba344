"""What the operators share: shared tables, text columns, packed bytes, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls from tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


# --- tables ---------------------------------------------------------------------------------------


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of its own where that is unset and everything runs on
    this machine, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="roomtide-shared-"))
        folder = _own_folder[0]
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: the plan above is computed once and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/roomtide-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Lets Python workers that share this machine's folders import the package from where the driver did. On a cluster
    the package is installed or sent with --py-files."""
    import roomtide

    root = os.path.dirname(next(iter(roomtide.__path__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def buckets(spark: SparkSession, per_partition: int = 2) -> int:
    """How many buckets deal out packed bytes: some for each shuffle partition, so that one bucket fits a task many times."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(name: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(name), F.lit(""))


# --- Arrow strings as bytes -----------------------------------------------------------------------


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its values; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def text_batches(batches, limit: int = 2 << 20):
    """Record batches cut so that each holds about `limit` bytes of its column `text`; one long text stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = batch.schema.get_field_index("text")
        _, ends = string_bytes(batch.column(at))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


# --- words and hashes -----------------------------------------------------------------------------

_SEPARATES = np.zeros(256, bool)
_SEPARATES[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LOW = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (the splitmix64 finaliser)."""
    x = x + _M1
    x ^= x >> np.uint64(30)
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text the index of its first word, with a last entry for the number of words."""
    apart = _SEPARATES[data]
    begins = ~apart
    begins[1:] &= apart[:-1]
    cuts = ends[1:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = ~apart[cuts]
    starts = np.flatnonzero(begins)
    stops = np.empty(len(data), bool)
    if len(data):
        stops[:-1] = apart[1:]
        stops[-1] = True
        inner = cuts[cuts > 0] - 1
        stops[inner] = True
        stops &= ~apart
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, which need not be disjoint."""
    lengths = (stops - starts).astype(np.int64)
    out = mix(lengths.astype(np.uint64) ^ np.uint64(seed))
    if len(starts) == 0:
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    left, at, rest = None, starts.astype(np.int64), lengths
    value = mix(out ^ (eights[at] & _LOW[np.minimum(rest, 8)]))
    out = value.copy()
    long = np.flatnonzero(rest > 8)
    done = 8
    while len(long):
        if done >= 512:  # a few very long spans: hashed one by one
            import hashlib

            for i in long:
                tail = hashlib.blake2b(data[starts[i] + done : stops[i]].tobytes(), digest_size=8).digest()
                out[i] = mix(out[i : i + 1] ^ np.frombuffer(tail, "<u8"))[0]
            break
        left = np.minimum(rest[long] - done, 8)
        out[long] = mix(out[long] ^ (eights[at[long] + done] & _LOW[left]))
        done += 8
        long = long[rest[long] > done]
    return out


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BASE = 0x2545F4914F6CDD1D


class Powers:
    """Powers of the base of the rolling hash and of its inverse modulo 2^64, kept for the next batch."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _inverse(_BASE))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def window_hashes(tokens: np.ndarray, starts: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Rabin-Karp hashes modulo 2^64 of the windows of `width` tokens at `starts`, from one running sum, then mixed."""
    up, down = powers.of(len(tokens) + 1)
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * up[:-1], dtype=np.uint64, out=sums[1:])
    return mix((sums[starts + width] - sums[starts]) * down[starts])


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All window starts inside texts whose tokens begin at first[i] and end at first[i + 1], and the text of each."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(before[-1]) - before[text] + first[text], text


# --- small encodings of sorted numbers -----------------------------------------------------------


_UNITS = {b"b": np.uint8, b"h": np.uint16}


def pack_gaps(gaps: np.ndarray) -> bytes:
    """Non-negative numbers in bytes or 16-bit units: each unit full of ones adds its value to the number that ends with
    the next smaller unit. Compressed 64-bit numbers where those are shorter."""
    best, size = b"w", 6 * len(gaps)
    for name, unit in _UNITS.items():
        most = np.iinfo(unit).max
        cost = int((gaps // most).sum() + len(gaps)) * (most.bit_length() // 8)
        if cost <= size:
            best, size = name, cost
    if best == b"w":
        return best + zlib.compress(gaps.astype("<i8").tobytes(), 1)
    most = np.iinfo(_UNITS[best]).max
    at = np.cumsum(gaps // most + 1) - 1
    out = np.full(int(at[-1]) + 1 if len(at) else 0, most, _UNITS[best])
    out[at] = gaps % most
    return best + out.tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    if data[:1] == b"w":
        return np.frombuffer(zlib.decompress(data[1:]), "<i8")
    unit = _UNITS[data[:1]]
    raw = np.frombuffer(data[1:], unit)
    return np.diff(np.cumsum(raw, dtype=np.int64)[raw != np.iinfo(unit).max], prepend=0)


def join_parts(*parts: bytes) -> bytes:
    """Byte strings in one, each behind its length."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def split_parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def pack_places(doc: np.ndarray, place: np.ndarray) -> bytes:
    """(doc, place) pairs, sorted by doc and then place: run lengths of docs, gaps of places."""
    if len(doc) == 0:
        return join_parts(b"", b"", b"")
    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    gaps = np.diff(place, prepend=0)
    gaps[new] = place[new]
    ids = zlib.compress(np.diff(doc[new], prepend=0).astype("<i8").tobytes(), 1)
    return join_parts(ids, pack_gaps(np.diff(np.append(new, len(doc)))), pack_gaps(gaps))


def unpack_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, runs, gaps = split_parts(data)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = np.cumsum(np.frombuffer(zlib.decompress(ids), "<i8"))
    runs, gaps = unpack_gaps(runs), unpack_gaps(gaps)
    sums = np.cumsum(gaps)
    first = np.cumsum(runs) - runs
    base = sums[first] - gaps[first]
    return np.repeat(ids, runs), sums - np.repeat(base, runs)


def intervals(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that sorted, possibly overlapping or touching intervals cover."""
    if len(starts) == 0:
        return starts, stops
    reach = np.maximum.accumulate(stops)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def give_back() -> None:
    """Returns freed memory to the system. A worker lives through many tasks, whose arrays come and go in sizes that
    the allocators would keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def cpu_threads_off() -> None:
    """One thread a task: Spark already runs one task for each core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


# --- documents dealt out by id, with what is known of them ------------------------------------------

#: What a null doc_id counts as: after every other.
NO_ID = np.iinfo(np.int64).max


def doc_ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def dealt(ids: np.ndarray, n: int) -> np.ndarray:
    """The part of n that each document belongs to."""
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


def split_by(names: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(name, ascending indices) for each name below n that occurs."""
    order = np.argsort(names, kind="stable")
    cuts = np.searchsorted(names[order], np.arange(n + 1))
    return [(i, order[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


PART_SCHEMA = "part long, kind int, data binary"
TEXTS = 0


def part_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    kinds = [pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "kind", "data"])


def dealt_texts(docs: DataFrame, parts: int, flush: int = 8 << 20) -> DataFrame:
    """The documents as rows (part, TEXTS, compressed doc_id and text columns), so that text travels compressed."""

    def run(batches):
        held, size = [], 0

        def rows():
            table = pa.Table.from_batches(held).combine_chunks()
            ids = doc_ids(table.column("doc_id").combine_chunks())
            out = []
            for part, at in split_by(dealt(ids, parts), parts):
                sink = pa.BufferOutputStream()
                chosen = table.take(pa.array(at))
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(chosen)
                out.append((part, TEXTS, sink.getvalue().to_pybytes()))
            return part_rows(out)

        for batch in text_batches(batches, flush):
            held.append(batch)
            size += batch.nbytes
            if size >= flush:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    return docs.select("doc_id", text_column().alias("text")).mapInArrow(run, PART_SCHEMA)


def part_texts(table: pa.Table) -> pa.Table:
    """The documents of a group of part rows."""
    found = [d for k, d in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True) if k == TEXTS]
    return pa.concat_tables([pa.ipc.open_stream(d).read_all() for d in found]) if found else pa.table(
        {"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}
    )


def part_data(table: pa.Table, kind: int) -> list[bytes]:
    return [d for k, d in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True) if k == kind]
