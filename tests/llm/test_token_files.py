"""Token files: exact round trips, single segments, damage."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roomtide.llm import tokenfile
from roomtide.llm.packing import default_vocabulary


def block_of(ids, sizes=None, docs=None):
    ids = np.array(ids, np.uint32)
    values, counts = np.unique(ids, return_counts=True)
    table = tokenfile.Frequencies(values, tokenfile.scaled(counts.tolist()))
    sizes = np.array([len(ids)] if sizes is None else sizes, np.int64)
    docs = np.arange(len(sizes)) if docs is None else np.array(docs, np.int64)
    return tokenfile.encode_block(ids, docs, sizes, table), table


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 60_000)), min_size=1, max_size=700))
def test_blocks_round_trip(ids):
    data, table = block_of(ids)
    assert tokenfile.Block(data, table).decode().tolist() == ids


@pytest.mark.parametrize("n", [1, 65, 4096, 300_000, tokenfile.LANES * tokenfile.SEGMENT, tokenfile.LANES * tokenfile.SEGMENT + 1, 2_500_000])
def test_segments_are_read_alone(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_407)
    data, table = block_of(ids, [n - n // 2, n // 2], [-5, 7])
    block = tokenfile.Block(data, table)
    assert (block.decode() == ids).all() and block.docs.tolist() == [-5, 7]
    for _ in range(4):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (block.decode(a, b) == ids[a:b]).all()


def test_size_is_near_the_entropy():
    ids = np.minimum(np.random.default_rng(1).zipf(1.3, 1 << 20), 49_407)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(block_of(ids)[0]) < 1.06 * len(ids) * -(share * np.log2(share)).sum() / 8


@pytest.mark.parametrize("counts", [[1], [1, 10**15], [10**14] * 3, list(range(1, 50_000)), [1] * 40_000 + [10**13]])
def test_frequencies_fill_the_table(counts):
    f = tokenfile.scaled(counts)
    assert f.min() >= 1 and int(f.sum()) == 1 << tokenfile.SCALE_BITS
    assert f.argmax() == np.argmax(counts)


def test_no_table_for_too_many_ids():
    with pytest.raises(ValueError, match="do not fit"):
        tokenfile.scaled([1] * ((1 << tokenfile.SCALE_BITS) + 1))


def test_damage_is_found():
    data, table = block_of(list(range(500)) * 3)
    for at in (3, 12, len(data) // 2, len(data) - 1):
        wrong = bytearray(data)
        wrong[at] ^= 1
        with pytest.raises(ValueError):
            tokenfile.Block(bytes(wrong), table).decode()
    with pytest.raises(ValueError):
        tokenfile.Block(data[:20], table)
    with pytest.raises(ValueError, match="another frequency table"):
        tokenfile.Block(data, block_of([1, 2, 3])[1])


def expected(rows):
    tokenizer = Tokenizer.from_file(default_vocabulary())
    out = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    starts = np.cumsum([0] + [r[1] for r in out]).tolist()
    return [(doc, start, n, crc, ids) for (doc, n, crc, ids), start in zip(out, starts, strict=False)]


@pytest.mark.parametrize("block", [200, tokenfile.BLOCK])
def test_tables_round_trip(spark, documents, prose, tmp_path, monkeypatch, block):
    """Whole texts, nulls, rows that repeat, with many blocks and with few."""
    monkeypatch.setattr(tokenfile, "BLOCK", block)
    rows = prose + [(None, "no id"), (None, None), (7, "twice"), (7, "twice"), (7, "it's <|endoftext|> 3.14 | bar"), (-(2**63), "least"), (2**63 - 1, "most")]
    tokenfile.write_tokens(documents(rows), str(tmp_path / "t"))
    got = tokenfile.read_tokens(spark, str(tmp_path / "t"))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == expected(rows)
    files = spark.read.parquet(str(tmp_path / "t" / "blocks"))
    assert (files.count() > 50) == (block == 200)


def test_empty_tables(spark, documents, tmp_path):
    tokenfile.write_tokens(documents([(1, "a")]).filter("doc_id = 2"), str(tmp_path / "t"))
    assert tokenfile.read_tokens(spark, str(tmp_path / "t")).count() == 0
    tokenfile.write_tokens(documents([(1, None)]), str(tmp_path / "u"))
    assert [tuple(r) for r in tokenfile.read_tokens(spark, str(tmp_path / "u")).collect()] == [(1, 0, 1, zlib.crc32(b"\1\0\0\0"), [1])]
