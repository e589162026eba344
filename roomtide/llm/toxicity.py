"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each is a logistic regression over the words and word beginnings of a
document, and over the log odds of the categories before it. For training these come from models that have not seen
the document (out-of-fold), for prediction from the models fitted on all training rows.

The training rows are the labelled documents with the smallest share of a hash of doc_id, about TRAIN_ROWS of them at
most. Features are made and counted by label and fold on Spark. From the counts the driver chooses the features of each
model, and only the chosen feature numbers of the training rows come to it. The fitted model is a table of at most
MOST_FEATURES weights for each category, whatever the size of the corpus. Every whole text is scored.

Defined cases: null text is empty and has only the prior. A null or missing label leaves a document out of the training of
its category; of repeated labels the largest counts. Without both classes among a category's labels its probability
is the share of ones, or 0 without labels. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomtide.llm.common import LOWER, mix, span_hashes, string_bytes, text_batches, words, written

TRAIN_ROWS = 12_000
FEATURE_BITS = 20
MOST_FEATURES = 3000
#: So many training rows for each feature, beyond a few features; at TRAIN_ROWS there are MOST_FEATURES.
ROWS_A_FEATURE, LEAST_FEATURES = 4, 60
#: Beginnings of words, in bytes, beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
FOLDS = 4
#: A feature is in so many training documents at least.
LEAST_DOCS = 4
#: (category, label column, whether the label's ones or zeros are the category's)
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
REJECT = "toxic"
THRESHOLD = 0.45


# --- features -------------------------------------------------------------------------------------


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, sorted; only the features that `wanted` marks."""
    data, ends = string_bytes(texts)
    data = LOWER[data]
    starts, stops, first = words(data, ends)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    head, size = eights[starts], stops - starts
    shift = np.uint64(64 - FEATURE_BITS)
    found = []

    def take(which: np.ndarray | slice, hashes: np.ndarray) -> None:
        number = (hashes >> shift).astype(np.int64)
        of = owner[which]
        if wanted is not None:
            hit = wanted[number]
            number, of = number[hit], of[hit]
        found.append((of << FEATURE_BITS) | number)

    take(slice(None), span_hashes(data, starts, stops, seed=1))
    for length in BEGINNINGS:
        long = np.flatnonzero(size >= length)
        mask = np.uint64((1 << (8 * length)) - 1) if length < 8 else np.uint64((1 << 64) - 1)
        take(long, mix((head[long] & mask) ^ mix(np.array([length], np.uint64))))
    pairs = np.unique(np.concatenate(found))
    return pairs >> FEATURE_BITS, pairs & ((1 << FEATURE_BITS) - 1)


# --- linear models ----------------------------------------------------------------------------------


class Linear(NamedTuple):
    """Weights of the chosen feature numbers, of the log odds of earlier categories, and the constant."""

    numbers: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    constant: float

    def log_odds(self, rows: np.ndarray, numbers: np.ndarray, before: np.ndarray) -> np.ndarray:
        """For len(before) rows, from (row, feature) pairs and the log odds of earlier categories."""
        out = np.full(len(before), self.constant)
        if len(self.numbers):
            at = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
            hit = self.numbers[at] == numbers
            out += np.bincount(rows[hit], self.weights[at[hit]], len(before))
        return out + before @ self.earlier


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def most_telling(count: np.ndarray, with_one: np.ndarray, n: int, ones: float) -> np.ndarray:
    """The features, sorted, that tell most about which of n rows are the ones: from the rows with each feature, and
    the ones among them."""
    share = ones / max(n, 1)
    if not 0 < ones < n:
        return np.zeros(0, np.int64)
    tells = (with_one - count * share) ** 2 / (count * share * (1 - share) + 1)
    tells[count < LEAST_DOCS] = 0
    most = min(MOST_FEATURES, max(LEAST_FEATURES, n // ROWS_A_FEATURE), int((tells > 0).sum()))
    return np.sort(np.argpartition(-tells, most - 1)[:most]) if most else np.zeros(0, np.int64)


def fit(rows: np.ndarray, numbers: np.ndarray, before: np.ndarray, y: np.ndarray, rounds: int = 400, penalty: float = 0.1) -> Linear:
    """Logistic regression with a quadratic penalty, by Adam, on the features that tell most about y."""
    n, ones = len(y), y.sum()
    share = ones / max(n, 1)
    none = np.zeros(0)
    if not 0 < ones < n:
        constant = 30.0 if n and ones else -30.0
        return Linear(none.astype(np.int64), none, np.zeros(before.shape[1]), constant)
    count = np.bincount(numbers, minlength=1 << FEATURE_BITS)
    with_one = np.bincount(numbers, y[rows], 1 << FEATURE_BITS)
    chosen = most_telling(count, with_one, n, ones)
    index = np.full(1 << FEATURE_BITS, -1, np.int32)
    index[chosen] = np.arange(len(chosen), dtype=np.int32)
    at = index[numbers]
    rows, at = rows[at >= 0], at[at >= 0]
    dense = np.concatenate([before, np.ones((n, 1))], axis=1)
    w, v = np.zeros(len(chosen)), np.zeros(dense.shape[1])
    v[-1] = np.log(share / (1 - share))
    state = [np.zeros_like(x) for x in (w, w, v, v)]
    for step in range(1, rounds + 1):
        p = sigmoid(np.bincount(rows, w[at], n) + dense @ v)
        off = p - y
        gradients = (np.bincount(at, off[rows], len(w)) + penalty * w, dense.T @ off + penalty * np.append(v[:-1], 0))
        rate = 0.1 * (1 - step / (rounds + 1)) + 0.005
        for x, g, (m, s) in zip((w, v), gradients, (state[:2], state[2:]), strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Linear(chosen, w, v[:-1], float(v[-1]))


def fit_chain(rows: np.ndarray, numbers: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """A model for each column of labels (NaN: unknown), each with the out-of-fold log odds of those before."""
    n, models = len(labels), []
    before = np.zeros((n, 0))

    def part(keep: np.ndarray, y: np.ndarray | None = None):
        place = (np.cumsum(keep) - 1).astype(np.int32)
        inside = keep[rows]
        pairs = (place[rows[inside]], numbers[inside], before[keep])
        return pairs if y is None else (*pairs, y[keep])

    for column in labels.T:
        known = ~np.isnan(column)
        models.append(fit(*part(known, column)))
        odds = np.zeros(n)
        for fold in range(FOLDS):
            unseen = folds == fold
            model = fit(*part(known & ~unseen, column))
            odds[unseen] = model.log_odds(*part(unseen))
        before = np.column_stack([before, np.clip(odds, -30, 30)])
    return models


def predict(models: Sequence[Linear], rows: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    """Probabilities (n, categories), each model fed with those before."""
    before = np.zeros((n, 0))
    for model in models:
        before = np.column_stack([before, np.clip(model.log_odds(rows, numbers, before), -30, 30)])
    return sigmoid(before)


# --- on Spark ---------------------------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, seed: int = 0) -> list[Linear]:
    """The chain, fitted on at most about TRAIN_ROWS labelled documents."""
    columns = [
        F.max(F.when(F.col(column).isNotNull(), (F.col(column) == ones).cast("double"))).alias(name)
        for name, column, ones in categories
    ]
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*columns)
    part = min(1.0, TRAIN_ROWS / max(known.count(), 1))
    key = F.xxhash64("doc_id", F.lit(seed))
    # The bound of what is broadcast: TRAIN_ROWS numbers and labels.
    drawn = known.filter(F.pmod(key, F.lit(1 << 20)) < int(part * (1 << 20)) + 1).orderBy(key, "doc_id").limit(2 * TRAIN_ROWS)
    names = [name for name, _, _ in categories]
    # Read twice, so written: at most about TRAIN_ROWS texts.
    rows = written(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"))
    if rows.count() > 2 * TRAIN_ROWS:  # rows that share doc_ids
        rows = written(rows.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(2 * TRAIN_ROWS))
    wanted = rows.sparkSession.sparkContext.broadcast(chosen_features(rows, names))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found, numbers = features(batch.column("text"), wanted.value)
            cuts = np.searchsorted(found, np.arange(batch.num_rows + 1))
            packed = [numbers[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            kept = [batch.column(c) for c in ("doc_id", *names)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(packed, pa.binary())], ["doc_id", *names, "numbers"])

    schema = f"doc_id long, {', '.join(f'{n} double' for n in names)}, numbers binary"
    table = rows.mapInArrow(collect, schema).toArrow().sort_by("doc_id")
    y = np.column_stack([table.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])
    data, ends = string_bytes(table.column("numbers"))
    owner = np.repeat(np.arange(len(table), dtype=np.int32), np.diff(ends) // 4)
    return fit_chain(owner, data.view("<u4").astype(np.int32), y, folds_of(table.column("doc_id").to_numpy()))


def folds_of(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)


def feature_counts(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(number, n<k>, ones<k>, ...) of features in LEAST_DOCS documents: how many documents have the feature and a label,
    and a label of one, for each k = category * FOLDS + fold."""
    cells = len(names) * FOLDS
    columns = [f"{kind}{k}" for k in range(cells) for kind in ("n", "ones")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted keys (feature, column) with their counts: only what occurs takes memory.
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in text_batches(batches):
            owner, numbers = features(batch.column("text"))
            fold = folds_of(batch.column("doc_id").to_numpy(zero_copy_only=False))
            found = [keys]
            for c, name in enumerate(names):
                y = batch.column(name).to_numpy(zero_copy_only=False).astype(float)
                for j, has in enumerate((~np.isnan(y), y == 1)):
                    mine = has[owner]
                    found.append(numbers[mine] * 2 * cells + 2 * (c * FOLDS + fold[owner[mine]]) + j)
            new = np.concatenate(found[1:])
            weights = np.concatenate([times, np.ones(len(new), np.int64)])
            keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            times = np.bincount(at, weights, len(keys)).astype(np.int64)
        for start in range(0, len(keys), 100_000):
            at, column = np.divmod(keys[start : start + 100_000], 2 * cells)
            seen, row = np.unique(at, return_inverse=True)
            counts = np.zeros((2 * cells, len(seen)), np.int32)
            counts[column, row] = times[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(x) for x in counts)], ["number", *columns])

    schema = f"number long, {', '.join(f'{c} int' for c in columns)}"
    summed = rows.mapInArrow(count, schema).groupBy("number").agg(*(F.sum(c).cast("int").alias(c) for c in columns))
    labelled = [sum((F.col(f"n{c * FOLDS + f}") for f in range(FOLDS)), F.lit(0)) for c in range(len(names))]
    return summed.filter(F.greatest(F.lit(0), *labelled) >= LEAST_DOCS)


def chosen_features(rows: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Marks the features that any model of the chain chooses, of all rows or of all folds but one."""
    cells = [(c, f) for c in range(len(names)) for f in range(FOLDS)]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = folds_of(batch.column("doc_id").to_numpy(zero_copy_only=False))
            y = [batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]
            out = [int((has & (fold == f)).sum()) for c, f in cells for has in (~np.isnan(y[c]), y[c] == 1)]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], [f"x{i}" for i in range(len(out))])

    sizes = rows.select("doc_id", *names).mapInArrow(rows_of, ", ".join(f"x{i} long" for i in range(2 * len(cells))))
    totals = sizes.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sizes.columns)).first()
    totals = np.array(totals, np.int64).reshape(len(names), FOLDS, 2)
    table = feature_counts(rows, names).toArrow()
    numbers = table.column("number").to_numpy()
    counts = [table.column(i + 1).to_numpy() for i in range(2 * len(cells))]
    wanted = np.zeros(1 << FEATURE_BITS, bool)
    for c in range(len(names)):
        n, ones = (sum(counts[2 * (c * FOLDS + f) + j] for f in range(FOLDS)) for j in (0, 1))
        wanted[numbers[most_telling(n, ones, *totals[c].sum(axis=0))]] = True
        for f in range(FOLDS):
            k = 2 * (c * FOLDS + f)
            wanted[numbers[most_telling(n - counts[k], ones - counts[k + 1], *(totals[c].sum(axis=0) - totals[c, f]))]] = True
    return wanted


def scored(docs: DataFrame, models: list[Linear], names: Sequence[str]) -> DataFrame:
    """The documents with a column of probability for each category."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << FEATURE_BITS, bool)
        for model in sent.value:
            wanted[model.numbers] = True
        for batch in text_batches(batches):
            rows, numbers = features(batch.column("text"), wanted)
            p = predict(sent.value, rows, numbers, batch.num_rows)
            columns = [*batch.columns, *(pa.array(x) for x in p.T)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    fields = [*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]
    return docs.mapInArrow(run, T.StructType(fields))


def toxicity(docs: DataFrame, labels: DataFrame, categories=CATEGORIES) -> DataFrame:
    """One row per document: doc_id, p_<category>, toxic (whether it is rejected), kept."""
    names = [name for name, _, _ in categories]
    models = train(docs, labels, categories)
    rows = scored(docs.select("doc_id", "text"), models, [f"p_{n}" for n in names])
    toxic = F.col(f"p_{REJECT}") >= THRESHOLD
    return rows.select("doc_id", *(f"p_{n}" for n in names), toxic.alias("toxic"), (~toxic).alias("kept"))


def reject_toxic(docs: DataFrame, labels: DataFrame, categories=CATEGORIES) -> DataFrame:
    """The documents that are not rejected; columns as given."""
    own = [f"_roomtide_p_{name}" for name, _, _ in categories]
    rows = scored(docs, train(docs, labels, categories), own)
    last = next(o for o, (name, _, _) in zip(own, categories, strict=True) if name == REJECT)
    return rows.filter(F.col(last) < THRESHOLD).select(*docs.columns)


def op7(spark, folder: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
