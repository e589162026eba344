"""Mixing sources to target weights.

Every document gets a hash-random key. Documents are sorted by it within their source, distributed prefix
sums of their sizes place each in its source, and a source is cut at its exact budget. A budget above the
source's size repeats whole epochs first.

DataFrame functions only. A source is dealt over 16^`RANGE_DIGITS` ranges of the key, so a source with most of
the rows is sorted by as many tasks as the others together; only one row per (source, range) meets in the
prefix sum over ranges, and one row per source where targets are shared out.

Defined cases: null text is empty (size 0), a null source is one source that comes last, a document without
words is never taken. Rows that agree in doc_id and size are interchangeable. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomtide.llm.common import WORD, text_column, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
#: Hexadecimal digits of the key that make a range: 16^3 ranges for each source.
RANGE_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shared_targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, share: float = 1.0
) -> DataFrame:
    """Adds `target` to one row per source (source, source_size).

    `share` of all sizes goes to the sources by weight. No target exceeds `most` times its source's size: what is
    above goes to the others by weight. In the order of size per weight the sources at their limit come first,
    so running sums tell where that stops.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sources.withColumn("_place", place).withColumn("_weight", weight)
    rows = rows.withColumn("_limit", F.col("source_size").cast("double") * most)
    rows = rows.withColumn("_all", F.sum("source_size").over(everything).cast("double") * share)
    order = Window.orderBy(F.col("_limit") / F.col("_weight"), "_place")
    before = F.coalesce(F.sum("_limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.col("_all") - before) / left)
    rows = rows.withColumn("_full", F.col("_level") * F.col("_weight") >= F.col("_limit"))
    first_free = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    rows = rows.withColumn("target", F.when(F.col("_full"), F.col("_limit")).otherwise(first_free * F.col("_weight")))
    return rows.select("source", "source_size", "target")


def keyed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Adds the size, the hash-random key, the source and the key's range."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    return docs.withColumns(
        {
            "_mix_size": n_words(text_column()),
            "_mix_key": key,
            # A null source is told from every text by its prefix.
            "_mix_source": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
            "_mix_range": F.substring(key, 1, RANGE_DIGITS),
        }
    )


def range_budgets(rows: DataFrame, weights: Sequence[float], most: int, share: float) -> DataFrame:
    """For each source and key range: source_size, target, and the words of the source in earlier ranges."""
    ranges = rows.groupBy("_mix_source", "_mix_range").agg(
        F.sum("_mix_size").alias("_mix_inside"), F.first("source").alias("source")
    )
    sources = ranges.groupBy("_mix_source").agg(F.sum("_mix_inside").alias("source_size"), F.first("source").alias("source"))
    targets = shared_targets(sources.drop("_mix_source"), weights, most, share)
    targets = targets.withColumn("_mix_source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    earlier = Window.partitionBy("_mix_source").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_mix_inside").over(earlier), F.lit(0))
    ranges = ranges.select("_mix_source", "_mix_range", before.alias("_mix_before"))
    targets = targets.select("_mix_source", F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"))
    return ranges.join(targets, "_mix_source")


def taken_words(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds `_mix_taken`: whole epochs of the document, and its part of the last one."""
    placed = rows.join(ranges, ["_mix_source", "_mix_range"])
    inside = (
        Window.partitionBy("_mix_source", "_mix_range")
        .orderBy("_mix_key", "doc_id", "_mix_size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    at = F.col("_mix_before") + F.coalesce(F.sum("_mix_size").over(inside), F.lit(0))
    budget, whole = F.floor("_mix_target"), F.col("_mix_source_size")
    epochs = F.when(whole > 0, F.floor(budget / whole)).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("_mix_at", at).withColumn("_mix_epochs", epochs)
    rest = budget - F.col("_mix_epochs") * whole - F.col("_mix_at")
    part = F.greatest(F.lit(0), F.least(F.col("_mix_size"), rest))
    return placed.withColumn("_mix_taken", (F.col("_mix_epochs") * F.col("_mix_size") + part).cast("long"))


SMALL = ["doc_id", "source", "_mix_size", "_mix_key", "_mix_source", "_mix_range"]


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, share: float = 1.0, seed: int = 0
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the sort key `mix_key`."""
    rows = written(keyed(docs.select("doc_id", "source", "text"), seed).select(SMALL))
    found = taken_words(rows, range_budgets(rows, weights, most, share))
    names = {"size": "size", "source_size": "source_size", "target": "target", "taken": "taken", "key": "mix_key"}
    return found.select("doc_id", *(F.col(f"_mix_{k}").alias(v) for k, v in names.items()))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pattern = F.concat(F.lit(r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), n.cast("string"), F.lit("}+"))
    return F.rtrim(F.regexp_substr(text, pattern))


def mixed(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS, share: float = 1.0, seed: int = 0
) -> DataFrame:
    """The mix itself; columns as given. A document appears once for each whole epoch that takes it, and the document
    at a source's cut once more with as many of its first words as the budget has left. Its other columns stay.
    Documents without words have nothing to take and are not in the mix.
    """
    rows = written(keyed(docs.select("doc_id", "source", "text"), seed).select(SMALL))
    found = taken_words(keyed(docs, seed), range_budgets(rows, weights, most, share)).filter("_mix_taken > 0")
    whole = F.floor(F.col("_mix_taken") / F.col("_mix_size")).cast("int")
    rest = F.col("_mix_taken") - whole * F.col("_mix_size")
    parts = F.concat(
        F.array_repeat(F.lit(None).cast("long"), whole),
        F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")),
    )
    found = found.withColumn("_mix_part", F.explode(parts))
    text = F.when(F.col("_mix_part").isNull(), F.col("text")).otherwise(first_words(F.col("text"), F.col("_mix_part")))
    return found.withColumn("text", text).select(*docs.columns)


def op10(spark, folder: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{folder}/documents.parquet"))


SQL = r"""
WITH docs AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5('0:' || CAST(doc_id AS VARCHAR)) AS mix_key
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
    FROM docs GROUP BY source
), weighed AS (
    SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
           3.0::DOUBLE * source_size AS lim
    FROM sources
), levels AS (
    SELECT *, ((SELECT CAST(sum(size) AS DOUBLE) FROM docs)
               - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed
), targets AS (
    SELECT source, source_size,
           CASE WHEN level * weight >= lim THEN lim
                ELSE (SELECT max(level) FROM levels WHERE level * weight < lim) * weight END AS target
    FROM levels
), placed AS (
    SELECT d.doc_id, d.size, d.mix_key, t.source_size, t.target,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mix_key, d.doc_id, d.size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
           CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END AS epochs
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - earlier)) AS BIGINT) AS taken,
       mix_key
FROM placed
"""
