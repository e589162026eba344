"""Exact dedup and mixing against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roomtide.llm import exact, mixing


@given(st.lists(st.integers(0, (1 << 60) - 1), max_size=80), st.lists(st.integers(0, (1 << 60) - 1), max_size=80))
def test_quotient_filters_merge_without_loss(a, b):
    a, b = a + b[:9], b + a[:7]
    filters = [exact.CountingQuotientFilter.of(4, np.array(x, np.uint64)) for x in (a, b)]
    filters = [exact.CountingQuotientFilter.from_bytes(4, f.to_bytes()) for f in filters]
    whole = filters[0].merge(filters[1:], 0)
    assert dict(zip(whole.fingerprints(0).tolist(), whole.counts.tolist(), strict=True)) == Counter(a + b)


def check_exact(docs, rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    found = defaultdict(list)
    for r in exact.exact_groups(docs).collect():
        found[r["doc_id"], r["text_sha256"]].append(r)
    assert sum(map(len, found.values())) == len(rows)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        named = [i for i in ids if i is not None]
        keep = max(named) if named else None
        same = [r for i in set(ids) for r in found[i, sha]]
        assert {(r["keep_id"], r["group_size"]) for r in same} == {(keep, len(ids))}
        assert [r["doc_id"] for r in same if r["kept"]] == [keep]


def test_exact_groups(documents, prose):
    check_exact(documents(prose), prose)


def test_exact_groups_of_odd_rows(documents):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "b"), (None, "c"), (None, "c"), (2, None), (3, ""), (4, " "), (9, "A")]
    rows += [(100 + i, "same") for i in range(500)]
    check_exact(documents(rows), rows)
    kept = exact.keep_one_of_each(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [
        (False, 1, "a"), (False, 1, "b"), (False, 3, ""), (False, 4, " "), (False, 9, "A"), (False, 599, "same"), (True, 0, "c"),
    ]


def test_empty_tables(documents):
    none = documents([(1, "a")]).filter("doc_id = 2")
    assert exact.exact_groups(none).count() == exact.keep_one_of_each(none).count() == 0
    assert mixing.mix_sources(none).count() == mixing.mixed(none).count() == 0


def targets(sizes, weights, most):
    """By the rule itself: what is above the limit is shared out again until nothing is."""
    names = sorted((n for n in sizes if n is not None), key=lambda s: s.encode()) + [n for n in sizes if n is None]
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full = set()
    total = sum(sizes.values())
    while True:
        free = [n for n in names if n not in full]
        left = total - sum(most * sizes[n] for n in full)
        level = left / sum(w[n] for n in free) if free else 0
        over = [n for n in free if level * w[n] > most * sizes[n]]
        if not over:
            return {n: most * sizes[n] if n in full else level * w[n] for n in names}
        full.update(over)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixing(documents, prose):
    names = ["a", "é", "Z", None, "zero", "big"]
    rows = [(i, t, names[5 if i % 2 else i % 4]) for i, t in prose] + [(9000, "", "zero"), (9001, None, "zero"), (9002, "tiny one", "b")]
    docs = documents(rows)
    found = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(found) == sorted(again) and len(found) == len(rows)
    text = {i: t for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += size(t)
    want = targets(sizes, mixing.WEIGHTS, mixing.MOST_EPOCHS)
    taken = defaultdict(int)
    for r in found:
        s = source[r["doc_id"]]
        assert r["size"] == size(text[r["doc_id"]]) and r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(taken[s] == int(want[s] + 1e-6) for s in sizes)
    # Within a source the order is that of the keys, and only one document is cut.
    for s in sizes:
        own = sorted((r["mix_key"], r["taken"], r["size"]) for r in found if source[r["doc_id"]] == s and r["size"])
        epochs = [t / n for _, t, n in own]
        assert epochs == sorted(epochs, reverse=True) and sum(e != int(e) for e in epochs) <= 1


def test_mixed_documents_hold_what_is_taken(documents, prose):
    docs = documents([(i, t, "big" if i % 3 else "small") for i, t in prose])
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).collect()}
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    found = defaultdict(int)
    text = dict(prose)
    for r in mixed.collect():
        found[r["doc_id"]] += size(r["text"])
        assert text[r["doc_id"]].startswith(r["text"])
    assert dict(found) == {i: t for i, t in taken.items() if t}


def test_mixing_without_words(documents):
    found = mixing.mix_sources(documents([(1, None, None), (None, " ", "a"), (None, " ", "a")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in found] == [(0, 0.0, 0)] * 3


def test_repeated_rows_share_their_part(documents):
    rows = [(1, "a b c d", "x")] * 6 + [(2, "e", "y")]
    found = mixing.mix_sources(documents(rows)).collect()
    assert sum(r["taken"] for r in found) == 25 and mixing.mixed(documents(rows)).agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == 25
