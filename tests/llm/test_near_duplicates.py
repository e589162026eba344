"""Near-duplicates and components against plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from roomtide.llm import neardup
from roomtide.llm.common import Powers
from roomtide.llm.components import components


def shingles(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def classes(rows, width, percent):
    """(set size, smallest doc_id reachable) of each document, by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(documents, table, rows, width=4, percent=80):
    found = table(neardup.near_duplicates(documents(rows), width, percent))
    want = classes(rows, width, percent)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == want
    assert {i for i, r in found.items() if r["kept"]} == {i for i, (_, c) in want.items() if i == c}


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("width", [4, 5])
def test_prose(documents, table, prose, width):
    check(documents, table, prose, width)


def test_copies_around_the_threshold(documents, table):
    """Groups in which many pairs, but not all, are just similar enough, linked only through others."""
    rng = random.Random(3)
    rows = []
    for _ in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows += [(len(rows) + k * 1000 % 7919, edited(base, rng.randint(0, 9), rng)) for k in range(1, 61)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rng.shuffle(rows)
    check(documents, table, rows)


def test_blocks_of_a_large_centre(documents, table, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    check(documents, table, [(i, edited(base, rng.randint(0, 11), rng)) for i in range(90)])


def test_chain(documents, table):
    """Each text is similar to the next only."""
    words = [f"w{i}" for i in range(400)]
    rows = [(50 - k, " ".join(words[6 * k : 6 * k + 100])) for k in range(40)]
    check(documents, table, rows)


def test_odd_rows(documents, table):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one"), (7, "two one"), (8, "É x y z"), (9, "é x y z")]
    check(documents, table, rows)
    none = documents([(1, "a")]).filter("doc_id = 2")
    assert neardup.near_duplicates(none).count() == neardup.keep_one_of_each(none).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    twice = neardup.near_duplicates(documents([(None, text), (5, text), (5, text), (3, text)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in twice) == [(0, None, True), (3, 3, True), (5, 3, False), (5, 3, False)]


@pytest.mark.parametrize("partitions", [1, 3])
def test_rows_that_share_a_doc_id(documents, partitions):
    """Every version of a repeated doc_id has its links, and its versions are one node, however the rows are dealt."""
    rng = random.Random(8)
    texts = [[f"{name}{i}" for i in range(60)] for name in "abcd"]
    rows = [(1, " ".join(texts[0])), (1, " ".join(texts[1])), (2, edited(texts[0], 1, rng)), (3, edited(texts[1], 1, rng))]
    rows += [(5, " ".join(texts[2])), (7, " ".join(texts[2])), (7, " ".join(texts[3])), (9, edited(texts[3], 1, rng)), (11, "alone")]
    found = neardup.near_duplicates(documents(rows).repartition(partitions), 4).collect()
    got = sorted((r["doc_id"], r["component_id"]) for r in found)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (5, 5), (7, 5), (7, 5), (9, 5), (11, 11)]


def test_kept_documents_keep_their_columns(documents, prose):
    docs = documents(prose)
    kept = neardup.keep_one_of_each(docs, 4)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in classes(prose, 4, 80).items() if i == c}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_sketches_agree_as_sets_do():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        values = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
        n = int(1000 * 2 * share / (1 + share))
        a, b = values[:1000], np.concatenate([values[:n], values[1000 : 2000 - n]])
        jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x = neardup.sketches([a, b], 2000)
        assert abs((x[0] == x[1]).mean() - jaccard) < 0.05


def test_every_coordinate_is_filled():
    one = neardup.sketches([np.array([7], np.uint64), np.arange(3, dtype=np.uint64)], 64)
    assert (one != np.uint64((1 << 64) - 1)).all()


def test_shingle_hashes_are_as_many_as_shingles(prose):
    sets = neardup.shingle_sets(pa.array([t for _, t in prose]), 4, Powers())
    assert [len(s) for s in sets] == [len(shingles(t, 4)) for _, t in prose]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)]
    links += [(2000, 2001 + i) for i in range(150)] + [(5, 5)]
    parent = defaultdict(lambda: None)

    def root(x):
        while parent[x] not in (None, x):
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        if x != y:
            parent[y] = x
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert found == {n: root(n) for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
