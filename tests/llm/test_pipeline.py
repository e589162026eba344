"""The registered text queries, their SQL, and the pipeline against brute force."""

import re
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from test_near_duplicates import classes

import __spark_entry__ as registered
import compare
import corpus_pipeline
from roomtide.llm import catalog, mixing, packing, pieces, toxicity
from roomtide.llm.common import written

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    return con


def test_one_query_for_each_operator():
    names = [n for n in registered.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in registered.queries() and catalog.SQL.keys() <= registered.queries().keys()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, db, name):
    assert compare.difference(spark, db, name, FOLDER) is None


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_whole_tables(spark, name):
    """A row for each row of the table that a query reads, or for each piece or query of it."""
    rows = catalog.QUERIES[name](spark, FOLDER).collect()
    table = {"op1": "pages", "op4": "embeddings", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    column = {"pages": "page_id", "embeddings": "vec_id", "documents": "doc_id"}[table]
    ids = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(column).collect()}
    if name.startswith("op13"):
        assert {(r["vec_id"], r["component"]) for r in rows} == {(i, c) for i in ids for c in range(1, 17)}
        assert len(rows) == 16 * len(ids)
    elif table == "embeddings":
        assert {r["query_id"] for r in rows} == {i for i in ids if i % 50 == 0}
    else:
        assert {r[column] for r in rows} == ids
        assert len(rows) == len(ids) or name.startswith("op2")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["drop_toxic", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    after = [docs]
    for _, stage in corpus_pipeline.STAGES:
        after.append(written(stage(spark, after[-1], FOLDER)))
        assert after[-1].columns == docs.columns or stage is corpus_pipeline.pack
    rows = [{r["doc_id"]: r for r in df.collect()} for df in after[:4]]
    rejected = {r["doc_id"] for r in toxicity.toxicity(docs, labels).filter("toxic").collect()}
    assert rows[1].keys() == rows[0].keys() - rejected
    last = {}
    for i, r in rows[1].items():
        last[r["text"] or ""] = max(i, last.get(r["text"] or "", i))
    assert rows[2].keys() == set(last.values())
    groups = classes([(i, r["text"]) for i, r in rows[2].items()], 5, 80)
    assert rows[3].keys() == {i for i, (_, c) in groups.items() if i == c}
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(after[3]).collect() if r["taken"]}
    mixed, words = after[4].collect(), defaultdict(int)
    for r in mixed:
        words[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert dict(words) == taken
    # Each row of the mix is packed once.
    tokens, want = defaultdict(int), defaultdict(int)
    for r in after[5].collect():
        tokens[r["doc_id"]] += r["length"]
    known = pieces.piece_ids(pieces.default_vocabulary())
    for r, n in zip(mixed, known.of(pa.array([r["text"] for r in mixed]), packing.END_ID)[1].tolist(), strict=True):
        want[r["doc_id"]] += n
    assert tokens == want
    assert sum(r["length"] for r in registered.queries()["pipeline"](spark, FOLDER).collect()) == sum(want.values())


def test_empty_documents(spark, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{FOLDER}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
