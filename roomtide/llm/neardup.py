"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its word shingles. Its sketch has one coordinate for each of BANDS * ROWS bins:
in round i each element is hashed to a bin with a value in [i, i + 1), and a bin keeps its smallest value. From round
t on, round t + j hashes all elements to bin j, so after 2t rounds every bin is filled; a document stops when its
bins are. Coordinates agree with the probability of the Jaccard similarity, concentrated as if bins were independent.

Documents with equal sets form a class, named by its smallest doc_id; only class names go on. Classes that agree in all
rows of a band share a bucket. At similarity 0.8 a pair shares none of 48 bands of 7 rows with probability 1.2e-5.

No pair is made of two members of a bucket only because they share it. The member that meets most others becomes
the centre of its buckets, and each member is compared with the centre on full sets. Members not linked to their
centre are compared with the others of that centre in blocks of BLOCK by BLOCK documents, each block pair a group of
its own, and only links that connect something new leave a block. By the triangle inequality of the Jaccard distance, a
member further than twice the limit from the centre has no link to those at the limit and is not compared with them.
Links become components by alternating stars.

Defined cases: null text or no words: empty set, linked with nothing. Fewer words than a shingle: the whole sequence is
the one shingle. Rows with the same doc_id are one node, and each keeps its row; rows with null doc_id have a null
component and are kept. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomtide.llm.common import LOWER, Powers, mix, span_hashes, string_bytes, text_batches, window_hashes, window_starts, words, written
from roomtide.llm.components import components
from roomtide.operators.joins import salted_join

BANDS, ROWS = 48, 7
BLOCK = 256
THRESHOLD_PERCENT = 80


# --- sets and sketches ----------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, width: int, powers: Powers) -> list[np.ndarray]:
    """Sorted distinct hashes of the `width`-word shingles of each text, A-Z lower-cased."""
    data, ends = string_bytes(texts)
    data = LOWER[data]
    starts, stops, first = words(data, ends)
    tokens = span_hashes(data, starts, stops)
    at, text = window_starts(first, width)
    hashes = window_hashes(tokens, at, width, powers)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    sets = [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    counts = np.diff(first)
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        n = int(counts[i])
        sets[i] = window_hashes(tokens, first[i : i + 1], n, powers) ^ np.uint64(n)
    return sets


def sketches(sets: list[np.ndarray], size: int, seed: int = 0) -> np.ndarray:
    """The fast similarity sketch of each set, which must not be empty: an array (sets, size) of round and value."""
    empty = np.uint64((1 << 64) - 1)
    out = np.full((len(sets), size), empty, np.uint64)
    active = np.arange(len(sets))
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(active, [len(s) for s in sets])
    for i in range(2 * size):
        if not len(active):
            break
        drawn = mix(values ^ mix(np.array([seed * 4096 + i + 1], np.uint64)))
        value = (np.uint64(i) << np.uint64(40)) | (drawn >> np.uint64(24))
        if i < size:
            bins = ((drawn & np.uint64(0xFFFFFF)) * np.uint64(size) >> np.uint64(24)).astype(np.int64)
        else:
            bins = i - size
        np.minimum.at(out.reshape(-1), owner * size + bins, value)
        full = (out[active] != empty).all(axis=1)
        if full.any():
            going = np.zeros(len(sets), bool)
            going[active[~full]] = True
            active = active[~full]
            keep = going[owner]
            values, owner = values[keep], owner[keep]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), (len(sketch), bands)).copy()
    for r in range(rows):
        key = mix(key ^ parts[:, :, r])
    return key


def sketched(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_hash (128 bits of the whole set), keys (one a band; none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in text_batches(batches):
            sets = shingle_sets(batch.column("text"), width, powers)
            counts = np.array([len(s) for s in sets], np.int64)
            some = [s for s in sets if len(s)]
            keys = band_keys(sketches(some, bands * rows), bands, rows).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1))),
                ],
                ["doc_id", "n_shingles", "set_hash", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, keys array<long>")


# --- links ----------------------------------------------------------------------------------------


def _common(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of `sets` with each of `others`."""
    values, place = np.unique(np.concatenate(others), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum([len(s) for s in others])])
    out = np.zeros((len(sets), len(others)), np.int64)
    for i, s in enumerate(sets):
        at = np.searchsorted(values, s)
        at = at[at < len(values)]
        mark = np.zeros(len(values), np.int32)
        mark[at[np.isin(values[at], s)]] = 1
        out[i] = np.add.reduceat(mark[place], ends[:-1])
    return out


def _enough(common, n_a, n_b, percent: int):
    return 100 * common >= percent * (n_a + n_b - common)


def compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Adds `common`, `n_a`, `n_b` of the full sets to pairs (a, b)."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in text_batches(batches):
            one = shingle_sets(batch.column("text"), width, powers)
            two = [shingle_sets(batch.column("text_b").slice(i, 1), width, powers)[0] for i in range(batch.num_rows)]
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two, strict=True)]
            sizes = [[len(s) for s in sets] for sets in (one, two)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), *(pa.array(x, pa.int64()) for x in (common, *sizes))],
                ["a", "b", "common", "n_a", "n_b"],
            )

    return joined.mapInArrow(run, "a long, b long, common long, n_a long, n_b long")


def block_links(table: pa.Table, width: int, percent: int) -> list[tuple[int, int]]:
    """Links that connect the documents of one block pair. Rows with `linked` are known to be in one component with the
    centre; `side` 0 are rows of the first block, 1 of the second, 2 of a block paired with itself."""
    sets = shingle_sets(table.column("text").combine_chunks(), width, Powers())
    ids = table.column("doc_id").to_pylist()
    linked = np.array(table.column("linked").to_pylist(), bool)
    far = np.array(table.column("far").to_pylist(), bool)
    side = np.array(table.column("side").to_pylist())
    some = np.array([len(s) > 0 for s in sets], bool)
    rows = np.flatnonzero((side != 1) & some)
    columns = np.flatnonzero((side != 0) & some)
    if not len(rows) or not len(columns):
        return []
    n = np.array([len(s) for s in sets])
    common = _common([sets[i] for i in rows], [sets[i] for i in columns])
    good = _enough(common, n[rows][:, None], n[columns][None, :], percent)
    good &= ~(far[rows][:, None] & linked[columns][None, :])
    parent = list(range(len(ids) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    centre = len(ids)
    for x in np.flatnonzero(linked):
        parent[x] = centre
    links = []
    for i, j in zip(*np.nonzero(good), strict=True):
        x, y = int(rows[i]), int(columns[j])
        a, b = root(x), root(y)
        if a != b:
            parent[min(a, b)] = max(a, b)
            links.append((ids[x], ids[y]))
    return links


def residual_links(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of members (centre, doc_id, linked, far) that aren't linked to their centre, with all others of it."""
    kind = F.when(F.col("linked"), "linked").when(F.col("far"), "far").otherwise("near")
    counted = [F.ceil(F.sum((kind == k).cast("int")) / BLOCK).cast("int").alias(f"{k}_blocks") for k in ("linked", "near", "far")]
    sizes = members.groupBy("centre").agg(*counted, F.count("*").alias("rows"))
    # With a single member there is no pair that the comparison with the centre has not settled.
    sizes = sizes.filter("near_blocks + far_blocks > 0 AND rows > 1").drop("rows")
    # A centre may have a large part of all members: they are dealt over salts.
    rows = salted_join(members, sizes, ["centre"])
    h = F.xxhash64("doc_id")
    near, far, linked = (F.col(f"{k}_blocks") for k in ("near", "far", "linked"))
    # Loose blocks are numbered, those near the centre first; linked blocks have numbers of their own.
    place = F.when(kind == "linked", F.pmod(h, linked)).when(kind == "near", F.pmod(h, near)).otherwise(near + F.pmod(h, far))
    rows = rows.withColumn("block", place.cast("int"))
    pair_type = "array<struct<pair:string,side:int>>"

    def upto(n: Column, build) -> Column:
        """`build` of each number below n."""
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), build)).otherwise(F.array().cast(pair_type))

    # Block pairs: "i:j" of loose blocks i <= j, "i:+j" of a loose block near the centre and a linked block. Members far
    # from the centre have no link with those linked to it, so neither's text is sent to the other.
    block = F.col("block")
    of_linked = upto(near, lambda i: F.struct(F.concat(i.cast("string"), F.lit(":+"), block.cast("string")).alias("pair"), F.lit(1).alias("side")))
    of_loose = upto(
        near + far,
        lambda i: F.struct(
            F.concat_ws(":", F.least(i, block).cast("string"), F.greatest(i, block).cast("string")).alias("pair"),
            F.when(i == block, 2).when(block < i, 0).otherwise(1).alias("side"),
        ),
    )
    with_linked = upto(linked, lambda j: F.struct(F.concat(block.cast("string"), F.lit(":+"), j.cast("string")).alias("pair"), F.lit(0).alias("side")))
    to = F.when(kind == "linked", of_linked).when(kind == "near", F.concat(of_loose, with_linked)).otherwise(of_loose)
    rows = rows.withColumn("to", F.explode(to))
    rows = rows.select("centre", "to.pair", "to.side", "doc_id", "linked", "far").join(texts, "doc_id")

    def run(table: pa.Table) -> pa.Table:
        links = block_links(table, width, percent)
        return pa.table({k: pa.array([x[i] for x in links], pa.int64()) for i, k in enumerate("ab")})

    return rows.groupBy("centre", "pair").applyInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = THRESHOLD_PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select("doc_id", "text")
    table = written(sketched(docs, width, bands, rows))
    some = table.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("set_hash").agg(F.min("doc_id").alias("class_id"))
    # One row of keys for each class, from the document that names it; rows that share a doc_id may name several.
    of_rows = some.join(classes, "set_hash")
    named = of_rows.filter("doc_id = class_id").select("doc_id", "set_hash", "keys").dropDuplicates(["doc_id", "set_hash"])
    keyed = named.select("doc_id", F.explode("keys").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(keyed.join(shared, "key"))
    score = met.groupBy("doc_id").agg(F.sum("n").alias("score"))
    scored = met.join(score, "doc_id")
    centres = scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("minus"))).alias("best"))
    centres = centres.select("key", (-F.col("best.minus")).alias("centre"))
    pairs = written(met.select("key", "doc_id").join(centres, "key").select("centre", "doc_id").filter("centre <> doc_id").distinct())
    wanted = met.select("doc_id").distinct()
    texts = written(docs.join(wanted, "doc_id", "left_semi"))
    checked = written(compared(pairs.select(F.col("doc_id").alias("a"), F.col("centre").alias("b")), texts, width))
    union = F.col("n_a") + F.col("n_b") - F.col("common")
    linked = 100 * F.col("common") >= percent * union
    # Beyond twice the limit of the distance from the centre.
    far = F.lit(100) * (union - F.col("common")) > 2 * (100 - percent) * union
    members = checked.groupBy(F.col("b").alias("centre"), F.col("a").alias("doc_id")).agg(
        F.max(linked).alias("linked"), F.min(far).alias("far")
    )
    members = written(members)
    # Rows that share a doc_id are one node: its classes are linked.
    several = of_rows.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).filter("a < b")
    shared_ids = of_rows.select("doc_id", F.col("class_id").alias("b")).distinct().join(several.drop("b"), "doc_id").select("a", "b")
    links = checked.filter(linked).select("a", "b").union(residual_links(members, texts, width, percent)).union(shared_ids)
    found = components(links).withColumnRenamed("node", "class_id")
    of_class = classes.join(found, "class_id", "left").select(
        "set_hash", F.coalesce("component", "class_id").alias("component")
    )
    placed = table.drop("keys").join(of_class, "set_hash", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return placed.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The documents without all but the first of each group of near-duplicates; columns as given."""
    kept = near_duplicates(docs, width, percent).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("_kept_id")), "left_semi")


def op6(spark, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"), width=4)
