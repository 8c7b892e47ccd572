"""Token counts by count-only Viterbi over a unigram vocabulary.

Texts are cut at blanks into units that start with the blank's mark; units do not influence each
other, so each distinct unit of a slice is segmented once.  An Aho-Corasick automaton finds all
vocabulary pieces in all new units in one pass over their joined text.  Dynamic programming then
runs over the positions of all units at the same time and carries only the best score and the
number of pieces on its path.  Ties follow the exact tokenizer: scores are added as 64-bit floats
from left to right, and of equal scores the one whose last piece starts first wins.  A character
that no piece of its own covers costs the lowest score less 10; with byte fallback each of its
bytes counts as a piece, without it a run of such characters counts as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

MARK = "▁"
PENALTY = 10.0

#: Units kept per task; the cache starts afresh beyond.
CACHE = 1_000_000

#: Units of more characters than this are segmented one by one.
LONG = 256


class Unigram:
    """Pieces with scores; the i-th of ``pieces`` is (text, score)."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in {p for p, _ in pieces} for b in (0, 255))
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.length = np.array([len(p) for p, _ in pieces], dtype=np.int64)
        self.score = np.array([s for _, s in pieces])
        self.automaton = ahocorasick.Automaton()
        for i, (text, _) in enumerate(pieces):
            if text:
                self.automaton.add_word(text, i)
        self.automaton.make_automaton()

    def matches(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, length, score) of every piece in ``joined``; end is exclusive."""
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), dtype=np.int64).reshape(-1, 2)
        piece = found[:, 1]
        return found[:, 0] + 1, self.length[piece], self.score[piece]

    def counts(self, units: list[str]) -> np.ndarray:
        """Number of tokens of each unit."""
        size = np.array([len(u) for u in units], dtype=np.int64)
        out = np.zeros(len(units), dtype=np.int64)
        short = np.flatnonzero((size > 0) & (size <= LONG))
        if len(short):
            out[short] = self._together([units[i] for i in short], size[short])
        for i in np.flatnonzero(size > LONG):
            out[i] = self._alone(units[i])
        return out

    def _together(self, units: list[str], size: np.ndarray) -> np.ndarray:
        joined = "".join(units)
        begin = np.cumsum(size) - size
        total = int(size.sum())
        end, length, score = self.matches(joined)
        start = end - length
        word = np.searchsorted(begin, start, "right") - 1
        inside = end <= begin[word] + size[word]  # pieces over a border of units are none
        end, start, score, word = end[inside], start[inside], score[inside], word[inside]
        # characters without a piece of their own
        bare = np.ones(total, dtype=bool)
        bare[start[end - start == 1]] = False
        bare = np.flatnonzero(bare)
        unit = np.repeat(np.arange(len(units)), size)
        wide = _utf8_size(joined)
        end, start, score, word = (np.concatenate(p) for p in ((end, bare + 1), (start, bare), (score, np.full(len(bare), self.unknown)), (word, unit[bare])))
        odd = np.concatenate([np.zeros(len(end) - len(bare), bool), np.ones(len(bare), bool)])
        # unit w has its positions from begin[w] + w on: one more than it has characters
        source, target, place = start + word, end + word, end - begin[word]
        order = np.argsort((place * (total + len(units)) + target) * (1 << 12) - np.minimum(end - start, 1 << 11), kind="stable")
        source, target, score, odd, last = source[order], target[order], score[order], odd[order], end[order] - 1
        best = np.full(total + len(units), -np.inf)
        pieces = np.zeros(total + len(units), dtype=np.int64)
        loose = np.zeros(total + len(units), dtype=bool)  # the best path ends in an unknown character
        best[begin + np.arange(len(units))] = 0.0
        steps = np.searchsorted(place[order], np.arange(1, int(size.max()) + 2))
        for lo, hi in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            to = target[lo:hi]
            value = best[source[lo:hi]] + score[lo:hi]
            new = np.ones(hi - lo, dtype=bool)
            new[1:] = to[1:] != to[:-1]
            head = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            top = np.maximum.reduceat(value, head)
            hit = np.flatnonzero(value == top[group])  # longest pieces come first
            one = np.ones(len(hit), dtype=bool)
            one[1:] = group[hit[1:]] != group[hit[:-1]]
            pick = hit[one] + lo
            at, unknown = target[pick], odd[pick]
            best[at] = top
            step = np.where(unknown, wide[last[pick]] if self.bytes else ~loose[source[pick]], 1)
            pieces[at], loose[at] = pieces[source[pick]] + step, unknown
        return pieces[begin + size + np.arange(len(units))]

    def _alone(self, unit: str) -> int:
        """The same for one unit of any length, in one pass."""
        n = len(unit)
        end, length, score = self.matches(unit)
        order = np.lexsort((end - length, end))
        ends, starts, scores = end[order].tolist(), (end - length)[order].tolist(), score[order].tolist()
        wide = _utf8_size(unit).tolist()
        best, pieces, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        k = 0
        for at in range(1, n + 1):
            top, count, unknown, single = None, 0, False, False
            while k < len(ends) and ends[k] == at:
                s = starts[k]
                value = best[s] + scores[k]
                if top is None or value > top:
                    top, count = value, pieces[s] + 1
                single = single or s == at - 1
                k += 1
            if not single:
                value = best[at - 1] + self.unknown
                if top is None or value > top:
                    top, unknown = value, True
                    count = pieces[at - 1] + (wide[at - 1] if self.bytes else int(not loose[at - 1]))
            best[at], pieces[at], loose[at] = top, count, unknown
        return pieces[n]


def _utf8_size(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


@lru_cache(maxsize=2)
def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def piece_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts the tokens of slices of documents with a cache of units."""

    def __init__(self, model: Unigram, limit: int = CACHE) -> None:
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.hashes, self.count = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.raw = np.zeros(0, dtype=np.uint8)  # the units' bytes, and where each one's are
        self.begin, self.end = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of tokens of each unit; units are told apart by their bytes, which the cache keeps."""
        back, example = K.exact_ids(data, starts, ends)
        starts, ends = starts[example], ends[example]
        key = K.span_hash(data, starts, ends)
        if len(self.hashes) > self.limit:
            self.clear()
        at = np.minimum(np.searchsorted(self.hashes, key), max(0, len(self.hashes) - 1))
        taken = self.hashes[at] == key if len(self.hashes) else np.zeros(len(key), dtype=bool)
        known = taken.copy()
        if len(self.hashes):
            known[known] = K.same_spans(data, starts[known], ends[known], self.raw, self.begin[at[known]], self.end[at[known]])
        out = np.zeros(len(key), dtype=np.int64)
        out[known] = self.count[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            out[new] = self.model.counts([MARK + raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            fresh = new[np.unique(key[new], return_index=True)[1]]
            fresh = fresh[~taken[fresh]]  # of units that share a hash, one is kept
            size = ends[fresh] - starts[fresh]
            stop = len(self.raw) + np.cumsum(size)
            self.raw = np.concatenate([self.raw, *[data[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)]])
            place = np.searchsorted(self.hashes, key[fresh])
            self.hashes, self.count, self.begin, self.end = (np.insert(x, place, y) for x, y in ((self.hashes, key[fresh]), (self.count, out[fresh]), (self.begin, stop - size), (self.end, stop)))
        return out[back]

    def documents(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of tokens of each document: units start at the document's start and at every blank."""
        begin = np.zeros(len(data) + 1, dtype=bool)
        begin[:-1] = data == 0x20
        mark = np.zeros(len(data), dtype=bool)  # the mark itself in a text counts as a blank
        if len(data) > 2:
            mark[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        begin[:-1] |= mark
        begin[off] = True
        begin[len(data)] = False
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        # every unit starts with the mark: in the place of its blank, or added at a document's start
        bare_from = starts + np.where(mark[starts], 3, data[starts] == 0x20)
        total = np.concatenate([[0], np.cumsum(self.units(data, bare_from, ends))])
        return np.diff(total[np.searchsorted(starts, off)])


@lru_cache(maxsize=2)
def load_model(path: str) -> Unigram:
    """The model of a piece table, once for each Python worker."""
    return Unigram(load_pieces(path))


def count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(load_model(path))
        for batch in batches:
            data, off = K.text_arrays(batch.column(1))
            for i, j, part, cut in K.slices(data, off):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(cut)), pa.array(counter.documents(part, cut))], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens.

    Null and empty texts have no tokens; repeated rows are counted each; texts of any length are
    counted whole; other columns are not read, whatever their names; an empty table gives an empty
    result.  The vocabulary is the piece table of a sentencepiece file, read as a unigram model.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count_batches(path or piece_path()), f"doc_id {kind}, n_bytes long, n_tokens long")
