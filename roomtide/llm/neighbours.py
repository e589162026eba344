"""Approximate nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut in two halves, and each half is quantised with its own codebook, so a pair of centroids names a cell.
A query sorts both halves' centroids by distance and takes centroid pairs off a heap by their summed distance until the
cells taken hold enough vectors; those are reranked by their exact cosine in double precision.

Codebooks are fitted on a bounded sample of at most SAMPLE rows; every row is indexed. How many vectors a query takes is
set by measurement: for at most TRIALS queries the true neighbours among all rows are found by brute force, in one pass,
and the number is the one at which the wanted part of them lies in the cells taken. Equal vectors are one entry with
their smallest ids, as many as a result can need, which a window group limit keeps before any shuffle. Large cells
are split over several groups, and a query visits all of them; a query's result list stays short all along.

Codebooks (at most MOST_CENTROIDS each) and the cell sizes (their square) are all that goes to every task.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, as queries
or candidates; nor do those of another length than most. A row repeated with id and vector counts once. Fewer candidates
than asked for: all of them. No valid rows: no rows out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomtide.llm.common import dealt, written

SAMPLE = 20_000
MOST_CENTROIDS = 1024
#: Vectors in a cell on average, as long as there are enough centroids.
CELL = 16
#: Vectors that are reranked together: a query's visits, and so its short lists, grow with the index, not with the cluster.
GROUP = 2048
#: Queries whose true neighbours are found to set the number of candidates, and the part of them to be reached.
TRIALS = 100
RECALL = 0.96
#: Vectors of a cell in one group.
BLOCK = 4096
QUERY_EVERY = 50
RESULT = "query_id long, rank int, vec_id long, score double"


def vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Summed row by row, so that equal rows have equal scores. Scaled by powers of two first, which rounds nothing, so
    that squares of large or small numbers neither overflow nor vanish."""
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    query = np.ldexp(query, -np.frexp(np.abs(query).max())[1])
    norms = np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum())
    return (rows * query).sum(axis=1) / norms


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids; one without members moves to the point farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        d = distances(x, centroids)
        of = d.argmin(axis=1)
        counts = np.bincount(of, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        empty = np.flatnonzero(counts == 0)
        centroids = sums / np.maximum(counts, 1)[:, None]
        if len(empty):
            centroids[empty] = x[np.argsort(d[np.arange(len(x)), of])[-len(empty) :]]
    return centroids


def assign(x: np.ndarray, codebooks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The cell of each unit vector."""
    half = codebooks[0].shape[1]
    first, second = distances(x[:, :half], codebooks[0]), distances(x[:, half:], codebooks[1])
    return first.argmin(axis=1) * len(codebooks[1]) + second.argmin(axis=1)


def nearest_cells(x: np.ndarray, codebooks: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, wanted: int) -> list[int]:
    """Non-empty cells in the order of their summed distance from unit vector x, until they hold `wanted` vectors."""
    half = codebooks[0].shape[1]
    d = [distances(part[None], book)[0] for part, book in zip((x[:half], x[half:]), codebooks, strict=True)]
    order = [np.argsort(v, kind="stable") for v in d]
    a, b = ([float(x) for x in v[o]] for v, o in zip(d, order, strict=True))
    first, second = (o.tolist() for o in order)
    width = len(second)
    heap, found, held = [(a[0] + b[0], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = first[i] * width + second[j]
        if sizes[cell]:
            found.append(cell)
            held += int(sizes[cell])
        # (i, j) is pushed once: along the row always, down the column from its head.
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return found


def candidates_needed(index: DataFrame, asks: DataFrame, codebooks, sizes: np.ndarray, k: int, recall: float) -> int:
    """How many vectors a query has to take so that the part `recall` of true neighbours is among them."""
    n = asks.count()
    few = asks.filter(F.pmod(F.xxhash64("entry", F.lit(1)), F.lit(1 << 20)) < int(min(1.0, TRIALS / n) * (1 << 20)) + 1)
    few = few.orderBy(F.xxhash64("entry", F.lit(1)), "entry").select("embedding").limit(TRIALS).toArrow().column(0).combine_chunks()
    if not len(few):
        return 1
    trials = unit(vectors(few))
    sent = index.sparkSession.sparkContext.broadcast(trials)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = np.full((len(sent.value), k + 1), -2.0)
        cell = np.zeros((len(sent.value), k + 1), np.int64)
        for batch in batches:
            of = batch.column("cell").to_numpy()
            near = sent.value @ unit(vectors(batch.column("embedding"))).T
            every = np.concatenate([score, near], axis=1)
            cells = np.concatenate([cell, np.broadcast_to(of, near.shape)], axis=1)
            top = np.argpartition(-every, k, axis=1)[:, : k + 1]
            score, cell = np.take_along_axis(every, top, 1), np.take_along_axis(cells, top, 1)
        at = np.flatnonzero(score.reshape(-1) > -2)
        columns = [pa.array(at // (k + 1), pa.int64()), pa.array(score.reshape(-1)[at]), pa.array(cell.reshape(-1)[at], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["trial", "score", "cell"])

    found = index.select("embedding", "cell").mapInArrow(best, "trial long, score double, cell long")
    order = Window.partitionBy("trial").orderBy(F.desc("score"), "cell")
    found = found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).toArrow()
    half, needed = codebooks[0].shape[1], []
    cells, which = found.column("cell").to_numpy(), found.column("trial").to_numpy()
    for i, x in enumerate(trials):
        summed = distances(x[None, :half], codebooks[0])[0][:, None] + distances(x[None, half:], codebooks[1])[0][None, :]
        order_of = np.argsort(summed.reshape(-1))
        taken = np.empty(len(order_of), np.int64)
        taken[order_of] = np.cumsum(sizes[order_of])
        needed.append(taken[cells[which == i]])
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else 1


def valid_vectors(rows: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    x = F.col(column)
    usable = (
        x.isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists(x, lambda v: v != 0)
    )
    rows = rows.filter(F.col(id_column).isNotNull() & usable).select(F.col(id_column).alias("vec_id"), x.alias("embedding"))
    lengths = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size"))
    most = lengths.first()
    return rows.filter(F.size("embedding") == (most["size"] if most else 0))


def nearest(
    embeddings: DataFrame,
    k: int = 5,
    recall: float = RECALL,
    every: int = QUERY_EVERY,
    id_column: str = "vec_id",
    column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by `every`."""
    spark = embeddings.sparkSession
    rows = valid_vectors(embeddings, id_column, column)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    entries = rows.dropDuplicates().withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1)
    entries = written(
        entries.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.col("ids")[0])
    )
    n = entries.count()
    if n == 0:
        return spark.createDataFrame([], RESULT)
    part = min(1.0, SAMPLE / n)
    drawn = entries.filter(F.pmod(F.xxhash64("entry"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    sample = unit(vectors(drawn.orderBy(F.xxhash64("entry"), "entry").select("embedding").limit(SAMPLE).toArrow().column(0).combine_chunks()))
    half = sample.shape[1] // 2 or sample.shape[1]
    centroids = int(min(MOST_CENTROIDS, 1 << max(1, int(np.ceil(np.log2(np.sqrt(n / CELL)))))))
    parts = [x if x.shape[1] else np.zeros((len(x), 1)) for x in (sample[:, :half], sample[:, half:])]
    codebooks = tuple(k_means(x, centroids) for x in parts) if sample.shape[1] > 1 else (k_means(sample, centroids), np.zeros((1, 0)))
    books = spark.sparkContext.broadcast(codebooks)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = assign(unit(vectors(batch.column("embedding"))), books.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int64())], [*batch.schema.names, "cell"])

    index = written(entries.mapInArrow(cells, entries._jdf.schema().toDDL() + ", cell long"))
    counted = index.groupBy("cell").count().toArrow()
    sizes = np.zeros(len(codebooks[0]) * len(codebooks[1]), np.int64)
    sizes[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    held = spark.sparkContext.broadcast(sizes)
    asks = index.join(rows.filter(F.col("vec_id") % every == 0).select("embedding").distinct(), "embedding", "left_semi")
    asks = written(asks.select("entry", "embedding"))
    if asks.isEmpty():
        return spark.createDataFrame([], RESULT)
    candidates = candidates_needed(index, asks, codebooks, sizes, k, recall)
    shards = -(-n // GROUP)

    def groups_of(cell: np.ndarray, block: np.ndarray) -> np.ndarray:
        return dealt(cell * (1 << 20) + block, shards)

    # Each vector in one block of its cell; a cell's blocks lie in groups of their own.
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            blocks = -(-held.value[cell] // BLOCK)
            block = dealt(batch.column("entry").to_numpy() + 1, 1 << 40) % np.maximum(blocks, 1)
            columns = [pa.array(groups_of(cell, block)), pa.array(cell), batch.column("embedding"), batch.column("ids")]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "cell", "embedding", "ids"])

    ddl = rows._jdf.schema().fields()[1].dataType().sql()
    placed = index.mapInArrow(place, f"shard long, cell long, embedding {ddl}, ids array<long>")

    # A row for each query and group that it visits, with the cells there.
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(vectors(batch.column("embedding")))
            row, shard, visited = [], [], []
            for i in range(len(x)):
                found = np.array(nearest_cells(x[i], books.value, held.value, candidates), np.int64)
                blocks = -(-held.value[found] // BLOCK)
                cell = np.repeat(found, blocks)
                block = np.arange(len(cell)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                to = groups_of(cell, block)
                for s in np.unique(to):
                    row.append(i)
                    shard.append(int(s))
                    visited.append(np.unique(cell[to == s]))
            ends = np.concatenate([[0], np.cumsum([len(v) for v in visited])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(visited) if visited else [], pa.int64()))
            chosen = batch.select(["entry", "embedding"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *chosen.columns, lists], ["shard", "entry", "query", "cells"])

    probes = asks.mapInArrow(probe, f"shard long, entry long, query {ddl}, cells array<long>")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            x = vectors(left.column("embedding").combine_chunks())
            directions = unit(x)
            cell = left.column("cell").to_numpy()
            ids = left.column("ids").to_pylist()
            order = np.argsort(cell, kind="stable")
            by_cell = cell[order]
            asked = vectors(right.column("query").combine_chunks())
            aims = unit(asked)
            for i, (entry, visited) in enumerate(zip(right.column("entry").to_pylist(), right.column("cells"), strict=True)):
                visited = visited.values.to_numpy()
                low, high = np.searchsorted(by_cell, visited), np.searchsorted(by_cell, visited, "right")
                counts = high - low
                at = order[np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
                if not len(at):
                    continue
                # A fast product finds who can be among the nearest; scores are then summed row by row.
                close = directions[at] @ aims[i]
                if len(at) > k + 1:
                    at = at[close >= np.partition(close, -(k + 1))[-(k + 1)] - 1e-9]
                scores = cosine(x[at], asked[i])
                found = sorted((-s, v) for a, s in zip(at, scores.tolist(), strict=True) for v in ids[a])
                out += [(entry, v, -s) for s, v in found[: k + 1]]
        kinds = [("entry", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
        return pa.table({name: pa.array([x[i] for x in out], t) for i, (name, t) in enumerate(kinds)})

    near = placed.groupBy("shard").cogroup(probes.groupBy("shard")).applyInArrow(rerank, "entry long, vec_id long, score double")
    # At most k + 1 from each group that a query visited.
    near = near.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("near"))
    near = near.select("entry", F.slice("near", 1, k + 1).alias("near"))
    queries = rows.filter(F.col("vec_id") % every == 0).distinct().join(index.select("embedding", "entry"), "embedding")
    result = queries.select(F.col("vec_id").alias("query_id"), "entry").join(near, "entry")
    others = F.filter("near", lambda v: v["vec_id"] != F.col("query_id"))
    result = result.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "found"))
    return result.select(
        "query_id",
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("found.vec_id").alias("vec_id"),
        (-F.col("found.minus")).alias("score"),
    )


def op4(spark, folder: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{folder}/embeddings.parquet"))
