"""Substring dedup of word sequences by prefix-partitioned suffix trees.

Suffixes that matter are those that start in a window around an anchor whose gram occurs in
several documents (see repeats.py); the gram is the prefix that deals them out.  In a bucket they
are split further by prefixes of variable length, one word after another, until a group fits
``ROOM`` suffixes, and each group's tree is then grown level by level: the suffixes under a node
are told apart by their next word, nodes with one suffix are leaves and go no deeper.  Internal
nodes at the depth of a window are the repeats; a node carries the smallest document id below it.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .repeats import I, Part, Repeats, U

#: Suffixes of one tree.
ROOM = 1 << 18


class WordRepeats(Repeats):
    """Windows of words that also start in a document with a smaller id."""

    dtype = np.uint64
    by_document = True

    def __init__(self, length: int = 13, gram: int | None = None) -> None:
        self.length = length
        self.gram = gram or max(1, -(-3 * length // 5))

    def elements(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        starts, ends, first = K.word_spans(data, off)
        return K.span_hash(data, starts, ends), first, (starts, ends)

    def namer(self, seq: np.ndarray):  # noqa: ANN201
        sums: dict[bool, np.ndarray] = {}

        def name(starts: np.ndarray, ends: np.ndarray, second: bool) -> np.ndarray:
            if second not in sums:
                sums[second] = K.prefix_hash(seq, K.OTHER if second else K.BASE)
            return K.prefix_span(sums[second], starts, ends, K.OTHER_INVERSE if second else K.INVERSE)

        return name

    def selection(self, seq: np.ndarray) -> np.ndarray:
        out = np.zeros(len(seq), dtype=U)
        runs = K.run_hash(seq, self.gram)
        out[: len(runs)] = runs
        return out

    def compare(self, gram: np.ndarray, body: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, several: np.ndarray) -> np.ndarray:
        """Bits of the windows under inner nodes: those found in a smaller document than ``value``, then all."""
        code = np.zeros(len(gram), dtype=I)
        for back in range(self.reach + 1):  # windows that start ``back`` words before the anchor
            rows = np.flatnonzero((low >= back) & (high >= self.length - back))
            words = body[:, self.reach - back : self.reach - back + self.length]
            for group in prefix_groups(words, rows, gram):
                for row, head in deep_nodes(words, group, self.length, several):
                    least = np.minimum.reduceat(value[row], head)
                    size = np.diff(np.append(head, len(row)))
                    code[row] |= 1 << (back + self.reach + 1)
                    code[row[np.repeat(least, size) < value[row]]] |= 1 << back
        return code

    def spans(self, code: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        back = np.arange(self.reach + 1)
        has = np.where(later, code >> (self.reach + 1), code)[:, None] >> back & 1 == 1
        return np.where(has, -back, 0), np.where(has, self.length - back, 0)

    def result(self, part: Part, cover: np.ndarray, own: pa.Array) -> pa.Table:
        starts, ends = part.spans
        raw = part.data.tobytes()
        total = np.concatenate([[0], np.cumsum(cover)])
        removed = np.diff(total[part.cut])
        told = []
        cut, off, lost = part.cut.tolist(), part.off.tolist(), removed.tolist()
        for d in range(len(cut) - 1):
            if lost[d] == 0:
                told.append(sha256(b" ".join(_split(raw[off[d] : off[d + 1]]))).hexdigest())
            else:
                keep = np.flatnonzero(~cover[cut[d] : cut[d + 1]]) + cut[d]
                told.append(sha256(b" ".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])).hexdigest())
        return pa.table([own, pa.array(np.diff(part.cut)), pa.array(removed), pa.array(told)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _split(raw: bytes) -> list[bytes]:
    """The words of a text; bytes.split() takes the contract's white space exactly."""
    return raw.split()


def prefix_groups(words: np.ndarray, rows: np.ndarray, gram: np.ndarray):
    """Groups of rows with a common prefix, of variable length, packed up to ROOM suffixes each.

    The first prefix is the gram by which the rows came; where it has too many rows, its groups are
    those of one word more, and so on.  Small groups share a tree: their prefixes tell them apart.
    """
    stack = [(rows, gram[rows], 0)]
    while stack:
        rows, key, depth = stack.pop()
        if len(rows) <= ROOM or depth > words.shape[1]:
            yield rows[np.argsort(key, kind="stable")]
            continue
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(head, len(rows)))
        begin = 0
        for h, s in zip(head.tolist(), size.tolist(), strict=True):
            if s > ROOM:
                if h > begin:
                    yield rows[begin:h]
                part = rows[h : h + s]
                stack.append((part, K.mix(key[h : h + s] + words[part, min(depth, words.shape[1] - 1)]), depth + 1))
                begin = h + s
            elif h + s - begin > ROOM:
                yield rows[begin:h]
                begin = h
        if begin < len(rows):
            yield rows[begin:]


def deep_nodes(words: np.ndarray, rows: np.ndarray, depth: int, several: np.ndarray):
    """Grow a tree over the first ``depth`` words of rows; (rows, heads) of its internal nodes at that depth.

    A row marked ``several`` stands for as many equal suffixes, so it is never alone under a node.
    """
    node = np.zeros(len(rows), dtype=I)
    for level in range(depth):
        if len(rows) == 0:
            return
        word = words[rows, level]
        order = np.lexsort((word, node))
        rows, node, word = rows[order], node[order], word[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (word[1:] != word[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(rows)))
        inner = np.repeat((size > 1) | several[rows[head]], size)  # leaves stay behind
        node = (np.cumsum(new) - 1)[inner]
        rows = rows[inner]
    if len(rows):
        yield rows, np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))


def drop_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A word goes when it lies in a window of ``length`` words that also starts in a document with a
    smaller id; windows are those of the input.  Null and empty texts have no words; rows without
    id count as having the largest id; rows that repeat an id do not remove each other's words;
    texts of any length are read whole; other columns are not read, whatever their names; an empty
    table gives an empty result.
    """
    return WordRepeats(length).run(docs, id_col, text_col, "n_words long, n_removed long, kept_sha256 string")
