"""Ids of texts by a public tokenizer that drops white space, looked up by distinct pieces of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from roomtide.llm.common import LOWER, SPACES, cpu_threads_off, string_bytes, words

BAR = "|"
#: Marks that may end a word of letters; no apostrophe, which the tokenizer joins with some letters.
MARKS = ".,;:!?%#*&$"
_KEPT = np.ones(256, bool)
_KEPT[list(SPACES)] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
#: Pieces whose ids a worker keeps; the table starts anew beyond it.
KNOWN_PIECES = 1_500_000
#: Bytes of texts that are looked up together.
TEXT_BYTES = 8 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the number of the first piece of each text, with a last entry for all.

    The tokenizer drops white space, joins nothing across it, makes letters small and takes letters apart from marks behind
    them. So a word of plain letters and marks is a piece of small letters and a piece of marks; any other word is one piece.
    """
    data, ends = string_bytes(texts)
    starts, stops, first = words(data, ends)
    long = stops - starts
    data = data[_KEPT[data]]
    begin = np.cumsum(long) - long
    odd = ~_LETTER[data]
    inner, ending = begin + long, np.arange(len(begin))  # where a word's last marks begin, and words that may have more
    while len(ending):
        ending = ending[inner[ending] > begin[ending]]
        ending = ending[_MARK[data[inner[ending] - 1]]]
        inner[ending] -= 1
        odd[inner[ending]] = False
    plain = (inner > begin) & ~(np.logical_or.reduceat(odd, begin) if len(begin) else odd[:0])
    data = np.where(np.repeat(plain, long), LOWER[data], data)
    split = np.flatnonzero(plain & (inner < begin + long))
    cuts = np.append(np.insert(begin, split + 1, inner[split]), len(data)).astype(np.int64)
    first = first + np.searchsorted(split, first)
    return pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())]), first


class PieceIds:
    """Ids of pieces: all ids in one array, and for each known piece where its own begin and how many they are."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        cpu_threads_off()
        self.tokenizer = Tokenizer.from_file(path)
        bar = self.encode([BAR])[0]
        self.bar = int(bar[0]) if len(bar) == 1 else -1
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.begin, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, new: list[str]) -> list[bytes]:
        """The ids of each piece. Many are encoded as one text with a bar between them: a bar is one id, which no piece
        without a bar has. Pieces that hold a bar are encoded alone."""
        ids: dict[str, bytes] = {}
        alone = [w for w in new if BAR in w]
        joined = [w for w in new if BAR not in w]
        for start in range(0, len(joined), 2_000):
            part = joined[start : start + 2_000]
            found = self.encode([f" {BAR} ".join(part)])[0]
            cuts = np.flatnonzero(found == self.bar)
            if len(cuts) != len(part) - 1:
                alone += part
                continue
            starts, stops = np.concatenate([[0], cuts + 1]) * 4, np.append(cuts, len(found)) * 4
            data = found.tobytes()
            ids.update(zip(part, (data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), strict=True))
        for start in range(0, len(alone), 2_000):
            part = alone[start : start + 2_000]
            ids.update(zip(part, (x.tobytes() for x in self.encode(part)), strict=True))
        return [ids[w] for w in new]

    def places(self, distinct: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces in the table, which learns the new ones."""
        at = pc.index_in(distinct, value_set=self.known)
        new = distinct.filter(at.is_null())
        if len(new) == 0:
            return at.to_numpy()
        if len(self.known) and len(self.known) + len(new) > KNOWN_PIECES:
            self.clear()
            return self.places(distinct)
        data = self.encoded(new.to_pylist())
        size = np.fromiter(map(len, data), np.int64, len(data)) // 4
        before, old = len(self.ids), len(self.known)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(data), "<u4")])
        self.begin = np.concatenate([self.begin, before + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.known = pa.concat_arrays([self.known, new])
        at = at.fill_null(-1).to_numpy().copy()
        at[at < 0] = np.arange(old, old + len(new))
        return at

    def of(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, `end` behind each text, and the number of ids of each.

        Distinct pieces are looked up once; the rest is picking their ids by number.
        """
        found, first = pieces(texts)
        coded = found.dictionary_encode()
        at = self.places(coded.dictionary)
        size = np.append(self.size[at], 1)
        begin = np.append(self.begin[at], len(self.ids))
        ids = np.append(self.ids, np.uint32(end))
        code = np.insert(coded.indices.to_numpy(), first[1:], len(at))  # the end of each text
        many = size[code]
        upto = np.cumsum(many)
        chosen = ids[np.repeat(begin[code] - (upto - many), many) + np.arange(int(upto[-1]) if len(upto) else 0)]
        last = upto[first[1:] + np.arange(len(texts))] if len(texts) else upto
        return chosen, np.diff(last, prepend=0)


_KNOWN: dict[str, PieceIds] = {}


def piece_ids(path: str) -> PieceIds:
    """The table of this Python worker, which later tasks find filled."""
    if path not in _KNOWN:
        _KNOWN[path] = PieceIds(path)
    return _KNOWN[path]
