"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roomtide.llm import (
    bytedup,
    exact,
    html_text,
    manifest,
    mixing,
    neardup,
    neighbours,
    packing,
    personal,
    substring,
    tokenfile,
    toxicity,
    whitening,
)
from roomtide.llm.common import importable


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        importable(spark)
        return query(spark, folder)

    return run


QUERIES = {
    name: _shipped(query)
    for name, query in {
        "op1_extract_text": html_text.op1,
        "op2_pack_sequences": packing.op2,
        "op3_exact_dedup": exact.op3,
        "op4_nearest_neighbours": neighbours.op4,
        "op5_remove_repeats": substring.op5,
        "op6_near_duplicates": neardup.op6,
        "op7_toxicity": toxicity.op7,
        "op8_repeated_bytes": bytedup.op8,
        "op9_personal_data": personal.op9,
        "op10_mix_sources": mixing.op10,
        "op11_merkle_manifest": manifest.op11,
        "op12_token_files": tokenfile.op12,
        "op13_whiten_embeddings": whitening.op13,
    }.items()
}

SQL = {
    "op3_exact_dedup": exact.SQL,
    "op10_mix_sources": mixing.SQL,
    "op11_merkle_manifest": manifest.SQL,
}
