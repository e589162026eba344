"""The Merkle manifest against plain Python and SQL."""

import hashlib
import zlib

import duckdb
import pytest

from roomtide.llm import manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(hashes):
    """The root, and for each node the siblings (left, right) of all levels."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, k in enumerate(at):
            run = hashes[k // 8 * 8 : k // 8 * 8 + 8]
            paths[i].append((run[: k % 8], run[k % 8 + 1 :]))
        hashes = [h("".join(hashes[k : k + 8])) for k in range(0, len(hashes), 8)]
        at = [k // 8 for k in at]
    return hashes[0], paths


def expected(rows):
    """The rows of the contract, for rows that share no doc_id."""
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    inner = {}
    for lang in names:
        groups[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
        inner[lang] = tree([leaf_of(r, r["text"]) for r in groups[lang]])
    root, above = tree([inner[lang][0] for lang in names])
    out = []
    for lang, up in zip(names, above, strict=True):
        for row, path in zip(groups[lang], inner[lang][1], strict=True):
            text, doc = row["text"], row["doc_id"]
            if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(row, text)
            for left, right in path + up:
                node = h("".join(left) + node + "".join(right))
            proof = h("".join("".join(left + right) for left, right in path + up))
            out.append((doc, leaf_of(row, row["text"]), inner[lang][0], root, proof, node, node == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(df):
    found = manifest.verified_rows(df)
    assert found.columns == COLUMNS
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == expected([r.asDict() for r in df.collect()])
    return got


def test_prose_in_languages(documents, prose):
    df = documents([(i, t) for i, t in prose]).selectExpr(
        "doc_id", "text", "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN '' WHEN doc_id % 2 = 0 THEN 'é' ELSE 'z' END AS lang",
        "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'S' END AS source", "n_chars", "1 AS leaf", "2 AS root", "3 AS _hash", "4 AS _group",
    )
    got = check(df)
    assert any(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 73])
def test_sizes_of_groups(spark, n):
    """Runs of one, lone leaves, groups of different heights in one tree."""
    rows = [(i, f"Text {i}", "en", "s", 6) for i in range(n)] + [(1000 + i, None, "fr", None, None) for i in range(9)]
    rows += [(2000, "Alone", None, "s", 5), (None, "No Id", "no", "s", 5)]
    rows += [(3000 + i, "a", f"x{i:02d}", "s", 1) for i in range(7)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3))


def test_tampered_rows_are_found(spark):
    rows = [(i, "Capital" if i % 2 else "small", "en", "s", 1) for i in range(100)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert [r[0] for r in got if not r[-1]] == sorted((i for i in range(100) if i % 2 and zlib.crc32(b"%d" % i) % 3 == 0), key=repr)


def test_repeated_rows(documents):
    """Rows that share a doc_id are leaves each, by digest; equal rows lead to the same root."""
    rows = [(1, "a"), (1, "b"), (1, "b"), (None, None), (None, "x")] + [(5, "same")] * 200
    df = documents(rows)
    found = manifest.verified_rows(df)
    assert found.count() == len(rows)
    got = found.collect()
    leaves = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]) for r in got)
    assert {r["root"] for r in got} == {tree([x[2] for x in leaves])[0]}
    assert all(r["verified"] == (r["folded_root"] == r["root"]) and r["verified"] for r in got)


def test_a_path_of_one_leaf_and_an_empty_table(documents):
    one = manifest.verified_rows(documents([(1, "A")])).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"]
    assert one["proof_sha256"] == h("")
    none = manifest.verified_rows(documents([(1, "a")]).filter("doc_id = 2"))
    assert none.columns == COLUMNS and none.count() == 0


def test_large_group_is_dealt_over_parts(spark):
    """One language with nearly all rows: its rows are in many parts, and its parents in many groups."""
    df = spark.range(3000).selectExpr("id AS _row", "IF(id = 0, 'a', 'b') AS _group", "id AS _order")
    placed = manifest.in_place(df, "_group", ["_order"])
    assert placed.selectExpr("spark_partition_id() AS p").distinct().count() > 2
    assert {(r["_group"], r["_at"], r["_order"], r["_n"]) for r in placed.collect()} == {("a", 0, 0, 1)} | {("b", i - 1, i, 2999) for i in range(1, 3000)}


def test_sql(documents, prose, tmp_path):
    df = documents(prose).selectExpr("doc_id", "text", "IF(doc_id % 3 = 0, NULL, source) AS source", "IF(doc_id % 2 = 0, NULL, lang) AS lang", "n_chars")
    df.write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({manifest.SQL})").fetchall()
    assert sorted(map(tuple, manifest.verified_rows(df).collect()), key=repr) == sorted(want, key=repr)
