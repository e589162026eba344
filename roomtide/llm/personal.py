"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them.

The patterns find e-mail addresses, IP addresses, card and phone numbers. A small labelled table is drawn from the
documents: the neighbourhoods of hints in at most TRAIN_DOCS documents, in rows of at most LONGEST words, whose words the
patterns label. In place of a labelled span the table also has what people write and the patterns miss ("name (at) host
(dot) org", "tel 030/123456"), labelled alike, and what only looks like it (dates, amounts, page ranges), labelled as none,
each spelling in about EACH_SPELLING rows. The random field is trained on it by gradient descent on the exact likelihood
(forward-backward in numpy batches) and decoded by Viterbi over batches of neighbourhoods of all whole texts. A decoded
span is added if it holds what its kind needs and touches no other span.

A hint is a digit, an at sign, "at" or "dot" in brackets, or the word "dot". A neighbourhood is a run of words with
at most twice CONTEXT words between two that hold a hint, and CONTEXT words on either side; words outside have no such word
near and are labelled as none.

Defined cases: null or empty text has no spans, whose digest is that of the empty string. Texts without a hint are not
looked at further, as no span can be in them. Repeated rows are read each. Without a labelled neighbourhood nothing is
added to the patterns, and spellings of a kind are taught only if the patterns find some of that kind.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtide.llm.common import text_batches, written

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 4000
TRAIN_ROWS = 3000
CONTEXT = 3
SHAPES = 1 << 12
#: Rows that teach each spelling, at most about twice as many.
EACH_SPELLING = 60
#: Words of a training row at most, whose batch is padded to the longest.
LONGEST = 40
#: Characters of a training row's words at most; rows with longer ones are not trained on. Every word is decoded.
LONGEST_WORD = 100
#: Padded words of training rows whose probabilities are computed side by side.
TRAINED_TOGETHER = 1 << 13
#: Padded words of neighbourhoods that are decoded side by side.
SIDE_BY_SIDE = 1 << 18

# --- patterns -------------------------------------------------------------------------------------

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match cannot begin inside a run of digits that another attempt has seen, so it begins at its first digit.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ASKED = re.compile(r"[0-9@]")
HINT = re.compile(r"[0-9@]|[(\[{<](?:at|dot)[)\]}>]|(?<!\w)dot(?!\w)", re.IGNORECASE)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def only_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """All leftmost matches: what stands before an at sign up to the last match, if a domain follows."""
    free, at = 0, text.find("@")
    while at >= 0:
        # The run before the at sign, looked at in growing pieces.
        reach = 64
        while True:
            low = max(free, at - reach)
            begin = low + len(text[low:at].rstrip(LOCAL))
            if begin > low or low == free:
                break
            reach *= 4
        if begin < at and (found := DOMAIN.match(text, at + 1)):
            yield begin, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the patterns by kind and start."""
    if not ASKED.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(octet(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


def span_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- neighbourhoods and shapes ----------------------------------------------------------------------


def neighbourhoods(text: str) -> list[list[tuple[int, int]]]:
    """Words (start, end) of each neighbourhood."""
    found = [m.span() for m in WORD.finditer(text)]
    starts = np.array([a for a, _ in found])
    hits = np.unique(np.searchsorted(starts, [m.start() for m in HINT.finditer(text)], "right") - 1)
    low, high = np.maximum(hits - CONTEXT, 0), np.minimum(hits + CONTEXT + 1, len(found))
    out, begin = [], 0
    for i in range(1, len(hits) + 1):
        if i == len(hits) or low[i] > high[i - 1]:
            out.append(found[low[begin] : high[i - 1]])
            begin = i
    return out


_RUN = re.compile(r"[0-9]+|[^\W\d_]+")
#: Words that stand for a sign or before a number, whose shape is the word itself.
CUES = frozenset("at dot tel telefon phone call fax mobile".split())


def shape(word: str) -> int:
    """The word with letters as one letter and digits as their number, or a cue as it is, as an index. In words of four
    and more numbers, as addresses are, those of up to three digits are alike."""
    alike = 3 if sum(m[0][0].isdigit() for m in _RUN.finditer(word)) > 3 else 0

    def short(m: re.Match) -> str:
        if not m[0][0].isdigit():
            return "a"
        return "0" if len(m[0]) <= alike else f"0{min(len(m[0]), 20)}"

    cue = word.lower().strip(".,;:!?")
    text = cue if cue.strip("()[]{}<>") in CUES else _RUN.sub(short, word)
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % SHAPES


def labelled(words: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """0, or 1 + the kind of the span that a word overlaps."""
    out = [0] * len(words)
    for kind, a, b in spans:
        for i, (x, y) in enumerate(words):
            if x < b and a < y:
                out[i] = 1 + KINDS.index(kind)
    return out


def variants(words: list[str], labels: list[int]) -> Iterator[tuple[list[str], list[int]]]:
    """A labelled neighbourhood, and with phone numbers without country code, and cards cut by dots."""
    yield words, labels
    phone, card = 1 + KINDS.index("phone"), 1 + KINDS.index("card")
    if phone in labels:
        kept = [i for i in range(len(words)) if not (labels[i] == phone and words[i].startswith("+"))]
        if phone in [labels[i] for i in kept]:
            yield [words[i] for i in kept], [labels[i] for i in kept]
    if card in labels:
        yield [".".join(re.findall(".{1,4}", w)) if y == card and w.isdigit() else w for w, y in zip(words, labels, strict=True)], labels


# --- spellings that the patterns miss, and what only looks like them ----------------------------------


def spellings(kind: str, value: str, draw: random.Random) -> list[tuple[str, str]]:
    """(words before that belong to no span, the span) for a value of the kind; numbers are drawn anew where no check
    digit binds them."""
    def digits(n: int) -> str:
        return str(draw.randint(1, 9)) + "".join(str(draw.randint(0, 9)) for _ in range(n - 1))

    cue = draw.choice(("tel", "Tel.:", "phone:", "Telefon", "call", "fax", "mobile"))
    if kind == "email":
        local, host = value.split("@")
        parts = host.split(".")[-draw.randint(2, 3) :]
        if draw.random() < 0.5:
            names = re.findall("[A-Za-z]+", local) or [local]
            local = draw.choice(("", ".", "_")).join(names * 2 if len(names) == 1 else names)
        if draw.random() < 0.5:
            host = re.sub("[0-9]+(?=[.])", "", host)
        a, b, host = *draw.choice(("()", "[]", "{}", "<>")), ".".join(parts)
        return [
            ("", f"{local} {a}at{b} {f' {a}dot{b} '.join(parts)}"),
            ("", f"{local} {a}at{b} {host}"),
            ("", f"{local}{a}at{b}{host}"),
            ("", f"{local}{a}at{b}{f'{a}dot{b}'.join(parts)}"),
            ("", f"{local} at {' dot '.join(parts)}"),
            ("", f"{local} @ {host}"),
            ("", f"{local}@{' dot '.join(parts)}"),
        ]
    if kind == "ip":
        parts = [str(draw.randint(0, 255)) for _ in range(4)]
        a, b = draw.choice(("()", "[]", "{}"))
        return [("", sign.join(parts)) for sign in (f"{a}.{b}", f"{a}dot{b}", f" {a}dot{b} ", " . ", " dot ")]
    if kind == "card":
        fours = re.findall("..?.?.?", only_digits(value))
        return [("", sign.join(fours)) for sign in (".", "/", "_", " / ")]
    area, line = digits(draw.randint(2, 4)), digits(draw.randint(5, 8))
    return [
        ("", f"({digits(3)}) {digits(3)}-{digits(4)}"),
        ("", f"{digits(3)}-{digits(3)}-{digits(4)}"),
        ("", f"{digits(3)}.{digits(3)}.{digits(4)}"),
        ("", f"0{area}/{line}"),
        ("", f"0{area}-{line}"),
        ("", f"00{digits(2)} {area} {line}"),
        (cue, f"0{area} {line}"),
        (cue, f"{digits(3)} {digits(3)} {digits(4)}"),
        (cue, digits(draw.randint(8, 12))),
    ]


def decoys(draw: random.Random) -> list[str]:
    """Numbers and signs that are no personal data."""
    year, month, day = draw.randint(1900, 2030), draw.randint(1, 12), draw.randint(1, 31)
    a, b, c, d = (draw.randint(1, 999) for _ in range(4))
    return [
        f"{year}-{month:02}-{day:02}",
        f"{day:02}.{month:02}.{year}",
        f"{day}/{month}/{year}",
        f"{year}-{month:02}-{day:02} {a % 24:02}:{b % 60:02}:{c % 60:02}",
        f"{a},{b:03},{c:03}.{d % 100:02}",
        f"{a}.{b:03}.{c:03},{d % 100:02}",
        f"{a} {b:03} {c:03}",
        f"{year}-{year + a % 50}",
        f"{year}/{(year + 1) % 100:02}",
        f"978-{a % 10}-{b % 90 + 10}-{c:03}{d:03}-{a % 10}",
        str(draw.randint(10**6, 10 ** draw.randint(7, 12))),
        f"{a}-{a + b}",
        f"v{a % 20}.{b % 20}.{c}",
        f"{a}.{b}",
        f"{a} {b} {c} {d}",
        f"{a % 24}:{b % 60:02}",
        f"call {a % 10} times",
        f"no. {a}/{b}",
    ]


def in_place(words: list[str], labels: list[int], kind: int, before: str, text: str, label: int) -> tuple[list[str], list[int]]:
    """The row with the text, of the given label, in place of its first run of words of the kind."""
    i = labels.index(kind)
    j = next((j for j in range(i, len(labels)) if labels[j] != kind), len(labels))
    lead, new = before.split(), text.split()
    return [*words[:i], *lead, *new, *words[j:]], [*labels[:i], *[0] * len(lead), *[label] * len(new), *labels[j:]]


def taught(table: list[tuple[list[str], list[int]]], seed: int = 0) -> Iterator[tuple[list[str], list[int]]]:
    """Rows of the table with spellings and decoys in place of spans."""
    draw = random.Random(seed)
    for k, kind in enumerate(KINDS, 1):
        rows = [r for r in table if k in r[1]]
        step, every = max(1, len(rows) // EACH_SPELLING), max(1, EACH_SPELLING // max(1, len(rows)))
        for n, (words, labels) in enumerate(rows):
            run = " ".join(w for w, y in zip(words, labels, strict=True) if y == k)
            value = next((run[a:b] for found, a, b in base_spans(run) if found == kind), None)
            for _ in range(every if value else 0):
                rewritten = [(before, text, k) for before, text in spellings(kind, value, draw)]
                for i, (before, text, label) in enumerate([*rewritten, *(("", text, 0) for text in decoys(draw))]):
                    if (n + i) % step == 0:
                        yield in_place(words, labels, k, before, text, label)


# --- the random field -------------------------------------------------------------------------------


class RandomField:
    """Weights of the shapes of a word and its neighbours for each label, and of label pairs."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    @staticmethod
    def features(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded (rows, words, 3) indices of the word before, the word and the word after; and the lengths."""
        lengths = np.array([len(r) for r in rows])
        own = np.zeros((len(rows), lengths.max() + 2), np.int64)
        for i, r in enumerate(rows):
            own[i, 1 : len(r) + 1] = np.array(r) + 1
        parts = [own[:, :-2], own[:, 1:-1], own[:, 2:]]
        return np.stack([p + k * (SHAPES + 1) for k, p in enumerate(parts)], axis=2), lengths

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=2)

    @classmethod
    def trained(cls, rows: list[list[int]], labels: list[list[int]], rounds: int = 80, penalty: float = 0.02):
        n = len(KINDS) + 1
        field = cls(np.zeros((3 * (SHAPES + 1), n)), np.zeros((n, n)))
        batches, gold_moves = [], np.zeros((n, n))
        for at in side_by_side([len(r) for r in rows], TRAINED_TOGETHER):
            features, lengths = cls.features([rows[i] for i in at])
            inside = np.arange(features.shape[1]) < lengths[:, None]
            gold = np.zeros(inside.shape, np.int64)
            gold[inside] = [y for i in at for y in labels[i]]
            pairs = inside[:, 1:] & inside[:, :-1]
            np.add.at(gold_moves, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
            batches.append((features, inside, np.eye(n)[gold] * inside[:, :, None]))
        state = [np.zeros_like(x) for x in (field.weights, field.weights, field.moves, field.moves)]
        for step in range(1, rounds + 1):
            gradient, edge = np.zeros_like(field.weights), np.zeros((n, n))
            for features, inside, one_hot in batches:
                node, moved = field.marginals(features, inside)
                edge += moved
                change = (one_hot - node)[inside]
                for k in range(3):
                    np.add.at(gradient, features[:, :, k][inside], change)
            gradients = (gradient / len(rows) - penalty / len(rows) * field.weights, (gold_moves - edge) / len(rows))
            for x, g, (m, v) in zip((field.weights, field.moves), gradients, (state[:2], state[2:]), strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return field

    def marginals(self, features: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each word and expected numbers of label pairs, by forward-backward in log space."""
        e = self.emissions(features)
        rows, steps, n = e.shape
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, steps):
            x = forward[:, t - 1, :, None] + self.moves
            new = np.logaddexp.reduce(x, axis=1) + e[:, t]
            forward[:, t] = np.where(inside[:, t, None], new, forward[:, t - 1])
        for t in range(steps - 2, -1, -1):
            x = self.moves + (e[:, t + 1] + backward[:, t + 1])[:, None, :]
            backward[:, t] = np.where(inside[:, t + 1, None], np.logaddexp.reduce(x, axis=2), 0.0)
        whole = np.logaddexp.reduce(forward[:, -1], axis=1)
        node = np.exp(forward + backward - whole[:, None, None]) * inside[:, :, None]
        edge = np.zeros((n, n))
        for t in range(1, steps):
            x = forward[:, t - 1, :, None] + self.moves + (e[:, t] + backward[:, t])[:, None, :] - whole[:, None, None]
            edge += np.exp(x[inside[:, t]]).sum(axis=0)
        return node, edge

    def decode(self, rows: list[list[int]]) -> list[list[int]]:
        """The best labels of each row, by Viterbi over all rows side by side."""
        if not rows:
            return []
        features, lengths = self.features(rows)
        e = self.emissions(features)
        steps = e.shape[1]
        best, back = e[:, 0], np.zeros(e.shape, np.int8)
        for t in range(1, steps):
            x = best[:, :, None] + self.moves
            back[:, t] = x.argmax(axis=1)
            going = (t < lengths)[:, None]
            best = np.where(going, x.max(axis=1) + e[:, t], best)
            back[:, t] = np.where(going, back[:, t], np.arange(e.shape[2]))
        label = best.argmax(axis=1)
        path = np.zeros((len(rows), steps), np.int64)
        for t in range(steps - 1, -1, -1):
            path[:, t] = label
            label = back[np.arange(len(rows)), t, label]
        return [p[:n].tolist() for p, n in zip(path, lengths, strict=True)]


def side_by_side(lengths: list[int], most: int = SIDE_BY_SIDE) -> Iterator[list[int]]:
    """Indices of rows in batches of similar length, of `most` padded words; a longer row is a batch of its own."""
    batch: list[int] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if batch and (len(batch) + 1) * lengths[i] > most:
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


EDGES = ".,;:!?\"'<>[]{}|"
#: An at sign and a dot as they are written.
AT = re.compile(r"\s*[(\[{<](?:@|at)[)\]}>]\s*|\s+at\s+|\s*@\s*", re.IGNORECASE)
DOT = re.compile(r"\s*[(\[{<](?:\.|dot)[)\]}>]\s*|\s+dot\s+|\s+\.\s+", re.IGNORECASE)


def holds(kind: str, text: str) -> bool:
    """Whether a decoded span has what its kind needs."""
    digits = only_digits(text)
    if kind == "email":
        plain = DOT.sub(".", AT.sub("@", text))
        return next(emails(plain), None) == (0, len(plain))
    if kind == "ip":
        parts = DOT.sub(".", text).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and octet(p) for p in parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits) and len(text) <= 2 * len(digits)
    return 7 <= len(digits) <= 15 and re.fullmatch(r"\+?[ ().0-9/-]+", text) is not None


def added_spans(text: str, words: list[tuple[int, int]], labels: list[int], base: list[tuple[str, int, int]]):
    """Spans of runs of one label that no base span touches, without marks at their ends."""
    out, i = [], 0
    while i < len(words):
        j = i
        while j < len(words) and labels[j] == labels[i]:
            j += 1
        if labels[i]:
            a, b = words[i][0], words[j - 1][1]
            while a < b and text[a] in EDGES:
                a += 1
            while b > a and text[b - 1] in EDGES:
                b -= 1
            kind = KINDS[labels[i] - 1]
            if a < b and holds(kind, text[a:b]) and not any(x < b and a < y for _, x, y in base):
                out.append((kind, a, b))
        i = j
    return out


# --- on Spark ---------------------------------------------------------------------------------------


def labelled_table(docs: DataFrame, seed: int = 0) -> list[tuple[list[str], list[int]]]:
    """At most TRAIN_ROWS labelled rows of neighbourhoods from at most about TRAIN_DOCS documents: those with the smallest
    hashes of document and place, first an equal share with each kind of span and with none, then of all."""
    count = docs.count()
    part = min(1.0, TRAIN_DOCS / max(count, 1))
    some = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    names = ["key", "kinds", "row"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text and HINT.search(text):
                    spans = base_spans(text)
                    rows = [w[j : j + LONGEST] for w in neighbourhoods(text) for j in range(0, len(w), LONGEST)]
                    for place, words in enumerate(rows):
                        if max(b - a for a, b in words) > LONGEST_WORD:
                            continue
                        key = hashlib.blake2b(f"{seed}:{doc_id}:{place}".encode(), digest_size=8).hexdigest()
                        found = labelled(words, between(spans, words[0][0], words[-1][1]))
                        kinds = sum(1 << y for y in set(found) - {0}) or 1
                        out.append((key, kinds, json.dumps([[text[a:b] for a, b in words], found])))
            columns = zip(*out, strict=True) if out else [[]] * 3
            kinds_of = (pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True)], names)

    rows = written(some.mapInArrow(label, "key string, kinds int, row string"))
    share = TRAIN_ROWS // (len(KINDS) + 1)

    def least(chosen: DataFrame, n: int) -> list[tuple[str, str]]:
        return [tuple(r) for r in chosen.select("key", "row").orderBy("key", "row").limit(n).collect()]

    parts = [least(rows.filter(F.col("kinds").bitwiseAND(1 << y) != 0), share) for y in range(len(KINDS) + 1)]
    taken = dict.fromkeys(x for part in [*parts, least(rows, TRAIN_ROWS)] for x in part)
    return [tuple(json.loads(row)) for _, row in sorted(list(taken)[:TRAIN_ROWS])]


def between(spans: list[tuple[str, int, int]], start: int, stop: int) -> list[tuple[str, int, int]]:
    """The spans, ordered by kind and start and disjoint within a kind, that touch the text from start to stop."""
    out = []
    for kind in KINDS:
        at = bisect.bisect_left(spans, (KINDS.index(kind), start + 1), key=lambda s: (KINDS.index(s[0]), s[2]))
        while at < len(spans) and spans[at][0] == kind and spans[at][1] < stop:
            out.append(spans[at])
            at += 1
    return out


def train(table: list[tuple[list[str], list[int]]]) -> RandomField | None:
    rows = [v for words, labels in table for v in variants(words, labels)]
    rows += taught(table)
    if not any(any(labels) for _, labels in rows):
        return None
    return RandomField.trained([[shape(w) for w in words] for words, _ in rows], [labels for _, labels in rows])


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    docs = docs.select("doc_id", "text")
    field = docs.sparkSession.sparkContext.broadcast(train(labelled_table(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows, places = [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                found.append((base, []))
                if field.value is not None and text and HINT.search(text):
                    for words in neighbourhoods(text):
                        rows.append([shape(text[a:b]) for a, b in words])
                        places.append((len(found) - 1, text, words))
            for at in side_by_side([len(r) for r in rows]):
                for j, y in zip(at, field.value.decode([rows[j] for j in at]), strict=True):
                    i, text, words = places[j]
                    if any(y):
                        found[i][1].extend(added_spans(text, words, y, found[i][0]))
            every = [sorted(b + m, key=lambda s: (KINDS.index(s[0]), s[1])) for b, m in found]
            columns = [batch.column("doc_id")]
            columns += [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
            columns.append(pa.array([hashlib.sha256(span_text(b).encode()).hexdigest() for b, _ in found], pa.string()))
            columns.append(pa.array([span_text(s) for s in every], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.mapInArrow(run, schema)


def op9(spark, folder: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{folder}/documents.parquet"))
