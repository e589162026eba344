import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from roomtide.llm.common import importable  # noqa: E402

#: Columns of the documents, and others whose names the operators use inside or return.
EXTRA = ("size", "key", "taken", "kept", "n_words", "text_sha256", "fp", "part", "target", "KIND")


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    importable(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source), with clashing extra columns."""
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields] + [T.StructField(n, T.StringType()) for n in EXTRA])

    def build(rows):
        full = []
        for doc_id, text, *rest in rows:
            source = rest[0] if rest else "s"
            full.append((doc_id, text, "en", source, None if text is None else len(text), *["x"] * len(EXTRA)))
        return spark.createDataFrame(full, schema).repartition(3)

    return build


@pytest.fixture(scope="session")
def prose():
    """Texts with shared passages, exact and near copies, spaces of all kinds, very long and empty ones."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passages = [" ".join(words(40)) for _ in range(4)]
    texts = [None, "", " \t\n", "one", "One two  three", "a\x0bb\x0cc\rd\x1ce", "é" * 300, "ab" * 4000, "\x00\x01    x"]
    for i in range(60):
        body = words(rng.choice([5, 30, 120, 400]))
        if i % 3 == 0:
            at = rng.randrange(len(body))
            body[at:at] = passages[i % 4].split(" ")
        texts.append(rng.choice([" ", "  ", "\n"]).join(body))
    long = " ".join(words(9000))
    texts += [long, long]
    base = words(200)
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [texts[12]] * 4 + [passages[0]] * 3
    rng.shuffle(texts)
    return [(i * 3 - 40, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def table():
    """The rows of a result by doc_id, which must not repeat."""

    def collect(df):
        found = {r["doc_id"]: r for r in df.collect()}
        assert len(found) == df.count()
        return found

    return collect
