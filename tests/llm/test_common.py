"""Packed bytes, words and hashes."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roomtide.llm import common


@given(st.lists(st.integers(0, 1 << 40), max_size=60))
def test_gaps_round_trip(values):
    gaps = np.array(values, np.int64)
    assert common.unpack_gaps(common.pack_gaps(gaps)).tolist() == values


@given(st.lists(st.tuples(st.integers(-(1 << 62), 1 << 62), st.integers(0, 1 << 31)), max_size=60))
def test_places_round_trip(pairs):
    pairs = sorted(set(pairs))
    doc, place = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    a, b = common.unpack_places(common.pack_places(doc, place))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == pairs


def test_parts_round_trip():
    assert common.split_parts(common.join_parts(b"", b"a", b"bc" * 99)) == [b"", b"a", b"bc" * 99]


@settings(max_examples=200)
@given(st.lists(st.one_of(st.none(), st.text("abé \t\n\x0b\x1c ", max_size=30)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    data, ends = common.string_bytes(pa.array(texts, pa.string()))
    starts, stops, first = common.words(data, ends)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, stops, strict=True)]
    assert found == [w for t in texts for w in re.findall(common.WORD, t or "")]
    assert np.diff(first).tolist() == [len(re.findall(common.WORD, t or "")) for t in texts]


def test_slices_of_columns_are_read_alone():
    data, ends = common.string_bytes(pa.array(["aa", None, "b", "cc"]).slice(1, 2))
    assert bytes(data) == b"b" and ends.tolist() == [0, 0, 1]


@pytest.mark.parametrize("n", [0, 1, 8, 9, 600, 5000])
def test_span_hashes_tell_spans_apart(n):
    rng = np.random.default_rng(n)
    data = rng.integers(0, 3, n + 20).astype(np.uint8)
    starts, stops = np.array([0, 3, 3]), np.array([n, 3 + n, 4 + n])
    h = common.span_hashes(data, starts, stops)
    again = common.span_hashes(np.concatenate([data[3:], data]), np.array([0]), np.array([n]))
    assert h[1] == again[0] and h[1] != h[2]


def test_window_hashes_are_equal_for_equal_windows():
    tokens = common.mix(np.array([1, 2, 3, 4, 9, 1, 2, 3, 4, 5], np.uint64))
    starts, _ = common.window_starts(np.array([0, 5, 10]), 4)
    h = common.window_hashes(tokens, starts, 4, common.Powers())
    assert starts.tolist() == [0, 1, 5, 6] and h[0] == h[2] and len(set(h.tolist())) == 3


def test_intervals_merge():
    a, b = common.intervals(np.array([0, 2, 5, 9]), np.array([3, 4, 9, 10]))
    assert a.tolist() == [0, 5] and b.tolist() == [4, 10]
    a, b = common.intervals(np.array([0, 1, 2]), np.array([10, 2, 3]))
    assert a.tolist() == [0] and b.tolist() == [10]


def test_a_shared_folder_is_asked_for_on_a_cluster():
    """Tables that other machines have to read never go to a folder of the driver's own."""
    from types import SimpleNamespace

    import pytest

    from roomtide.llm import common

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda key, default: folder or default)
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_folder(session(master))
        assert common.shared_folder(session(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_folder(session("local[4]")).startswith("file:")
