"""Nearest neighbours, personal data and the classifier chain."""

import hashlib
import heapq
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roomtide.llm import neighbours, personal, toxicity

# --- neighbours -------------------------------------------------------------------------------------


def brute(rows, k=5, every=50):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q, x in good.items():
        if q % every == 0:
            scores = {i: float((v * x).sum() / (np.sqrt((v * v).sum()) * np.sqrt((x * x).sum()))) for i, v in good.items() if i != q}
            out[q] = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
    return out


def search(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, entry string")
    found = {}
    for r in neighbours.nearest(table, **options).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def as_floats(x):
    return [float(v) for v in np.asarray(x, np.float32)]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    rows = [(i, as_floats(centres[i % 30] + 0.4 * rng.normal(size=16))) for i in range(3000)]
    want, found = brute(rows), search(spark, rows)
    assert found.keys() == want.keys() and all(len(f) == 5 for f in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    vectors = {i: np.array(v) for i, v in rows}
    for q, near in found.items():
        assert near == sorted(near, key=lambda s: (-s[1], s[0]))
        for i, score in near:
            a, b = vectors[q], vectors[i]
            assert score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_equal_vectors_and_rows_that_take_no_part(spark):
    one, two = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(i, one) for i in range(0, 900)] + [(1000 + i, two) for i in range(60)]
    rows += [(50, one), (5000, None), (5050, [0.0, 0.0, 0.0]), (5100, [1.0, None, 0.0]), (5150, [float("nan"), 1.0, 0.0])]
    rows += [(5200, [float("inf"), 1.0, 0.0]), (5250, []), (5300, [1.0, 2.0]), (None, one), (6000, [-3.0, 1e-30, 2.0])]
    want = brute([r for r in rows if r[0] != 5300])
    found = search(spark, rows)
    assert found.keys() == want.keys()
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]], q


@pytest.mark.parametrize("rows", [[], [(50, [1.0, 2.0])], [(50, [1.0]), (1, [2.0]), (2, [-1.0])], [(1, [1.0, 2.0]), (2, [1.0, 0.0])]])
def test_few_rows(spark, rows):
    found, want = search(spark, rows), brute(rows)
    assert {q: [i for i, _ in f] for q, f in found.items()} == {q: [i for i, _ in w] for q, w in want.items() if w}


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "GROUP", 64)
    rng = np.random.default_rng(2)
    rows = [(i, as_floats(np.array([5.0, 1, 1, 1]) + 1e-3 * rng.normal(size=4))) for i in range(700)]
    found, want = search(spark, rows, recall=1.0), brute(rows)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)


def test_cells_are_taken_by_summed_distance():
    rng = np.random.default_rng(3)
    books = (rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    sizes = rng.integers(0, 3, 35)
    x = rng.normal(size=6)
    a, b = (((part - book) ** 2).sum(axis=1) for part, book in zip((x[:3], x[3:]), books, strict=True))
    want = [c for _, c in heapq.nsmallest(35, ((a[c // 5] + b[c % 5], c) for c in range(35))) if sizes[c]]
    assert neighbours.nearest_cells(x, books, sizes, 10**9) == want
    some = neighbours.nearest_cells(x, books, sizes, 8)
    assert some == want[: len(some)] and sizes[some].sum() >= 8 > sizes[some[:-1]].sum()


# --- personal data ----------------------------------------------------------------------------------


def by_patterns(text):
    """The base by the patterns as they are worded, tried from the left."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and personal.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("01259.+@-ab %() é٣\n", max_size=60))
def test_base_spans(text):
    assert personal.base_spans(text) == by_patterns(text)


def test_base_spans_of_documents(prose):
    texts = ["a@b.c", "4111111111111111", "4111 1111-1111 1111 1 2.3.4.5", "+1 (040) 555-0631.", "x" * 5000 + "@a.b", "é1.2.3.4"]
    assert [personal.base_spans(t) for t in texts] == [by_patterns(t) for t in texts]
    assert personal.base_spans("4111111111111111") and not personal.base_spans("4111111111111112")


def test_long_runs_take_linear_time():
    for text in ("a@" * 60000, "1." * 60000, "1" * 300000 + ".2", "x" * 300000 + "@", "+1" + "(" * 200000, "+1" * 100000):
        personal.base_spans(text)


def test_personal_data(spark, documents):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = [(0, None), (1, ""), (2, "no data here"), (2, "no data here")]
    for i in range(10, 400):
        words = [word() for _ in range(30)]
        kind = i % 6
        if kind == 0:
            words[5] = f"{word()}.{i}@mail.example.com"
        if kind == 1:
            words[7:8] = [f"+1 (0{rng.randint(10, 99)}) 555-{rng.randint(1000, 9999)}"]
        if kind == 2:
            words[9] = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        rows.append((i, " ".join(words)))
    rows.append((500, "tel (040) 555-0631 or so"))
    found = personal.personal_data(documents(rows)).collect()
    assert len(found) == len(rows)
    text = dict(rows)
    for r in found:
        base = by_patterns(text[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(k == s[0] for s in base) for k in personal.KINDS]
        spans = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= {":".join(s) for s in spans}
        assert [(personal.KINDS.index(k), int(a)) for k, a, _ in spans] == sorted((personal.KINDS.index(k), int(a)) for k, a, _ in spans)
        if not re.search("[0-9@]", text[r["doc_id"]] or ""):
            assert r["spans"] == ""
    # The field adds what the patterns miss: a number without its country code.
    assert [r["spans"] for r in found if r["doc_id"] == 500] == ["phone:4:18"]
    assert personal.personal_data(documents([(1, "a")]).filter("doc_id = 2")).count() == 0


def random_field(seed):
    rng = np.random.default_rng(seed)
    n = len(personal.KINDS) + 1
    field = personal.RandomField(rng.normal(size=(3 * (personal.SHAPES + 1), n)), rng.normal(size=(n, n)))
    rows = [rng.integers(0, personal.SHAPES, rng.integers(1, 5)).tolist() for _ in range(6)]
    return field, rows


def scores_of_all_paths(field, row):
    import itertools

    features, _ = field.features([row])
    e = field.emissions(features)[0]
    n = e.shape[1]
    paths = list(itertools.product(range(n), repeat=len(row)))
    scores = [sum(e[t, y] for t, y in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths]
    return paths, np.array(scores)


def test_viterbi_and_marginals_are_those_of_all_paths():
    field, rows = random_field(5)
    features, lengths = field.features(rows)
    inside = np.arange(features.shape[1]) < lengths[:, None]
    node, edge = field.marginals(features, inside)
    total = np.zeros_like(edge)
    for i, (row, best) in enumerate(zip(rows, field.decode(rows), strict=True)):
        paths, scores = scores_of_all_paths(field, row)
        assert tuple(best) == paths[int(scores.argmax())]
        p = np.exp(scores - scores.max())
        p /= p.sum()
        for t in range(len(row)):
            for y in range(edge.shape[0]):
                assert node[i, t, y] == pytest.approx(sum(q for path, q in zip(paths, p, strict=True) if path[t] == y))
        for path, q in zip(paths, p, strict=True):
            for a, b in zip(path, path[1:], strict=False):
                total[a, b] += q
    assert np.allclose(edge, total)


def test_long_neighbourhoods_are_decoded_whole():
    """A number at any place of a long run of digits is found, also where a row of LONGEST words would end."""
    rng = random.Random(2)
    number = lambda: f"({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
    texts = [f"row {i} item 7 tel +1 {number()} or so {i} 12 more" for i in range(300)]
    spans = [personal.base_spans(t) for t in texts]
    table = []
    for t, s in zip(texts, spans, strict=True):
        table += [([t[a:b] for a, b in w], personal.labelled(w, s)) for w in personal.neighbourhoods(t)]
    field = personal.train(table)
    for before in range(30, 48):
        text = " ".join(["7 item"] * before)[: None if before % 2 else -5] + f" tel {number()} or so 7 item 7"
        (words,) = personal.neighbourhoods(text)
        y = field.decode([[personal.shape(text[a:b]) for a, b in words]])[0]
        at = text.index("(")
        assert personal.added_spans(text, words, y, []) == [("phone", at, at + 14)], before


def test_training_rows_hold_every_kind_and_do_not_depend_on_the_split(spark, monkeypatch):
    """Numbers in the first rows of a table, and personal data in a few of the last and late in its document."""
    monkeypatch.setattr(personal, "TRAIN_ROWS", 40)
    rows = [(i, f"a {i} b c d e f " * 30) for i in range(60)]
    late = "a 1 b c d e f " * 30
    rows += [(100 + i, f"{late} {x} and so on") for i, x in enumerate(("me@some.example.com", "+1 (040) 555-0631"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = personal.labelled_table(docs.coalesce(1))
    assert len(table) == 40 and {y for _, labels in table for y in labels} == {0, 1, 4}
    assert table == personal.labelled_table(docs.repartition(5))


def test_batches_of_neighbourhoods():
    lengths = [5, 900, 1, 40, 3, 40, 7]
    batches = list(personal.side_by_side(lengths, 100))
    assert sorted(i for b in batches for i in b) == list(range(7)) and [1] in batches
    assert all(len(b) == 1 or len(b) * max(lengths[i] for i in b) <= 100 for b in batches) and not list(personal.side_by_side([]))


def planted(kind, rng):
    """Personal data as no pattern has it, among spellings that are taught and others, in drawn values."""
    name = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 9)))
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    if kind == "email":
        forms = [f"{name()} (at) {name()} (dot) org", f"{name()}.{name()}[at]{name()}.de", f"{name()} at {name()} dot com"]
        forms += [f"{name()}_{digits(2)} {{at}} {name()}-{name()} {{dot}} net", f"{name()}@{name()} dot com", f"{name()} @ {name()}.fr"]
    elif kind == "ip":
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        forms = ["[.]".join(parts), " dot ".join(parts), "(dot)".join(parts), " [dot] ".join(parts)]
    elif kind == "card":
        number = next(x for x in iter(lambda: "4" + digits(15), "") if personal.luhn(x))
        forms = [sign.join(re.findall("....", number)) for sign in (".", "/", " / ")]
    else:
        forms = [f"({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(7)}", f"{digits(3)} {digits(3)}-{digits(4)}", f"0{digits(3)}/{digits(7)}"]
        forms += [f"0049 {digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"tel 0{digits(2)} {digits(6)}"]
    return rng.choice(forms)


def test_held_out_spellings_are_found_and_clean_numbers_are_not():
    """Trained on what the patterns find, the field finds in other words most of what they miss, of each kind."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda: [rng.choice(words) for _ in range(24)]
    table = []
    for i in range(240):
        value = (f"{rng.choice(words)}.{i % 90}@mail{i % 9}.example.com", "10.20.30.40", "4111111111111111", "+1 (243) 555-5526", f"{i} of {i * i}")[i % 5]
        text = " ".join([*prose()[:8], value, *prose()[:8]])
        spans = personal.base_spans(text)
        table += [([text[a:b] for a, b in w], personal.labelled(w, spans)) for w in personal.neighbourhoods(text)]
    field = personal.train(table)

    def found(before, value, after):
        text = " ".join([*before, value, *after])
        at = len(" ".join([*before, ""]))
        out = []
        for near in personal.neighbourhoods(text):
            y = field.decode([[personal.shape(text[a:b]) for a, b in near]])[0]
            out += personal.added_spans(text, near, y, personal.base_spans(text))
        return [(kind, a - at, b - at) for kind, a, b in out]

    for kind in personal.KINDS:
        values = [planted(kind, rng) for _ in range(100)]
        assert not any(personal.base_spans(v) for v in values)
        results = [found(prose(), v, prose()) for v in values]
        assert sum(r == [(kind, 4 if v.startswith("tel ") else 0, len(v))] for v, r in zip(values, results, strict=True)) >= 70, kind
    clean = [v for _ in range(40) for v in personal.decoys(rng)]
    clean += ["the dot at 12:30", "at 5", "12 dot 5", "3 (at) 4", "rooms 12 13 14 15", "12:30-14:45", "1.2.3"]
    assert sum(found(prose(), v, prose()) != [] for v in clean) <= len(clean) // 200


def test_spelled_signs():
    assert personal.holds("email", "ann (at) some [dot] org") and personal.holds("email", "ann at some dot org")
    assert not personal.holds("email", "look at this") and not personal.holds("email", "at dot com") and not personal.holds("email", "a at b c dot org")
    assert personal.holds("ip", "1 dot 2 [.] 3(dot)255") and not personal.holds("ip", "1 dot 2 dot 3 dot 256") and not personal.holds("ip", "1-2-3-4")
    assert [len(n) for n in personal.neighbourhoods("a b c d e ann at some DOT org f g h i j")] == [7]
    assert personal.neighbourhoods("the dotted anecdote at home") == []


# --- toxicity ---------------------------------------------------------------------------------------


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 9))) for _ in range(600)]
    bad = ["vilest", "rotten", "wretch"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        toxic, poor = rng.random() < 0.2, rng.random() < 0.15
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "er", "ly", "s"])
        if poor:
            words += ["click"] * 4
        rows.append((i, " ".join(words)))
        labels.append((i, int(not poor), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus(2400, 1)
    known = spark.createDataFrame(labels[:1200], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(documents(rows), known).collect()}
    assert len(found) == len(rows)
    held = labels[1200:]
    right = sum(found[i]["toxic"] == bool(t) for i, _, t in held)
    missed = sum(t and not found[i]["toxic"] for i, _, t in held)
    poor = sum((found[i]["p_low_quality"] > 0.5) == (not q) for i, q, _ in held)
    assert right >= 0.98 * len(held) and missed <= 0.05 * sum(t for _, _, t in held) and poor >= 0.97 * len(held)
    kept = toxicity.reject_toxic(documents(rows), known)
    assert kept.columns == documents(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if not r["toxic"]}


def test_earlier_categories_help_later_ones():
    """The second category is the first one of documents that have a mark; its model leans on the first's odds."""
    rng = np.random.default_rng(0)
    n = 1500
    signs = rng.random((n, 30)) < 0.3
    first = (signs[:, :5].sum(axis=1) >= 2).astype(float)
    second = first * signs[:, 7]
    rows, numbers = np.nonzero(signs)
    models = toxicity.fit_chain(rows, numbers, np.column_stack([first, second]), rng.integers(0, toxicity.FOLDS, n))
    assert len(models[0].earlier) == 0 and models[1].earlier[0] > 0.1
    p = toxicity.predict(models, rows, numbers, n)
    assert ((p > 0.5) == np.column_stack([first, second])).mean(axis=0).min() > 0.95


@pytest.mark.parametrize(
    "labels, want",
    [([], 0.0), ([(1, None, None)], 0.0), ([(1, 1, 1), (2, 1, 1)], 1.0), ([(1, 1, 0), (None, 1, 1)], 0.0)],
)
def test_labels_of_one_kind(spark, documents, labels, want):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents([(1, "a b"), (2, None), (2, None), (None, ""), (3, "x" * 10**6)])
    found = toxicity.toxicity(docs, known).collect()
    assert len(found) == 5 and all(r["p_toxic"] == pytest.approx(want, abs=1e-6) for r in found)
    assert toxicity.reject_toxic(docs.filter("doc_id = 9"), known).count() == 0


def test_features_are_distinct_words_and_beginnings():
    import pyarrow as pa

    rows, numbers = toxicity.features(pa.array(["Idiot idiot", None, "idiots", "ab"]))
    sets = [set(numbers[rows == i].tolist()) for i in range(4)]
    assert len(sets[0]) == 3 and not sets[1] and len(sets[2]) == 4 and len(sets[3]) == 1
    assert len(sets[0] & sets[2]) == 2  # idio, idiot


def test_words_that_differ_only_late_and_many_of_them():
    """Toxic words that begin like harmless ones for six bytes, in more kinds than a feature for 24 rows could tell."""
    import pyarrow as pa

    texts, labels = [], []
    for i in range(1200):
        late = "xy"[i % 2]
        texts.append(f"beginn{late}{'abcdefgh'[i // 2 % 8]}{i}")
        labels.append(float(i % 2))
    rows, numbers = toxicity.features(pa.array(texts))
    model = toxicity.fit(rows, numbers, np.zeros((1200, 0)), np.array(labels))
    held, found = toxicity.features(pa.array(["beginnxaz", "beginnyaz"]))
    assert (model.log_odds(held, found, np.zeros((2, 0))) > 0).tolist() == [False, True]
    rng = np.random.default_rng(3)
    kinds = np.arange(1200) // 8
    model = toxicity.fit(np.arange(1200), kinds, np.zeros((1200, 0)), (rng.random(150) < 0.5)[kinds].astype(float))
    assert len(model.numbers) == 150


def test_features_chosen_from_counts_are_those_of_all_pairs(spark, documents, monkeypatch):
    """The driver gets only the features that the models choose, and the models are those of all features."""
    import pyarrow as pa

    rows, labels = corpus(600, 4)
    given = []
    chain = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda *x: given.append(x) or chain(*x))
    known = spark.createDataFrame([(i, q if i % 7 else None, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    models = toxicity.train(documents(rows), known)
    owner, numbers = toxicity.features(pa.array([t for _, t in rows]))
    want = chain(owner, numbers, given[0][2], given[0][3])
    every = [len(given[0][1]), len(numbers)]
    assert every[0] < every[1] / 2
    for model, other in zip(models, want, strict=True):
        tied = np.setxor1d(model.numbers, other.numbers)
        assert len(model.numbers) == len(other.numbers) and len(tied) <= 0.1 * len(other.numbers)


def test_cosine_of_large_and_small_numbers():
    rows = np.array([[3.0, 4.0], [1e200, -2e200], [1e-200, 1e-200], [1.5e-5, 7.0]])
    for query in (np.array([1e250, 1e250]), np.array([2.0, 1.0]), np.array([1e-250, 0.0])):
        plain = np.array([np.dot(r / np.abs(r).max(), query / np.abs(query).max()) / np.linalg.norm(r / np.abs(r).max()) / np.linalg.norm(query / np.abs(query).max()) for r in rows])
        assert np.allclose(neighbours.cosine(rows, query), plain, rtol=1e-14)
    # Numbers of usual size are scored to the bit as without scaling.
    x = np.random.default_rng(1).standard_normal((50, 64)).astype(np.float32).astype(float)
    want = (x * x[0]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[0] * x[0]).sum()))
    assert (neighbours.cosine(x, x[0]) == want).all()


def test_shapes_of_very_long_words():
    """The whole word counts, in training as in decoding."""
    assert personal.shape("a1-" * 40 + "x") != personal.shape("a1-" * 40 + "7")
    assert personal.shape("-" * 60 + "1" + "-" * 60) != personal.shape("-" * 121)
