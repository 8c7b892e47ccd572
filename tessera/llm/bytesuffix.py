"""Substring dedup of byte sequences by deep-shallow suffix sorting.

The suffixes to sort are those at anchors whose gram occurs more than once (see repeats.py).  A
bucket's suffixes are first sorted to a shallow depth by multikey quicksort, with eight bytes as
a character.  What is left are groups with a long common prefix, where comparing from the front
would read the same bytes again and again; each is ordered by a blind trie, which compares a new
suffix with one other in full and finds its place by that.  The order comes with the lengths of
common prefixes, that is, with the tree of repeats to the right; suffixes under a node of depth R
are compared to the left, where 400 - R bytes must be equal for a window of 400 to be a repeat.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .repeats import I, Part, Repeats, U

#: Characters of eight bytes that multikey quicksort looks at.
SHALLOW = 8


def multikey_quicksort(keys: np.ndarray, rows: np.ndarray, depth: int, limit: int) -> list[np.ndarray]:
    """Rows in order of ``keys`` (rows x characters) from character ``depth`` on.

    The result is a list of groups in order; rows of a group are equal up to character ``limit``.
    """
    out: list[np.ndarray] = []
    stack = [(rows, depth)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) == 0:
            continue
        if len(rows) == 1 or depth == limit:
            out.append(rows)
            continue
        c = keys[rows, depth]
        sample = np.sort(c[:: max(1, len(c) // 64)])
        pivot = sample[len(sample) // 2]
        same = c == pivot
        if same.all():
            stack.append((rows, depth + 1))
            continue
        # taken from the stack in reverse: smaller, equal, larger
        stack.append((rows[c > pivot], depth))
        stack.append((rows[same], depth + 1))
        stack.append((rows[c < pivot], depth))
    return out


class BlindTrie:
    """Orders strings given as big-endian integers of ``size`` bytes and lengths.

    Inner nodes hold only their depth and their children by next byte; -1 stands for the end of a
    string.  Equal strings share a leaf.
    """

    def __init__(self, text: list[bytes], number: list[int], size: int) -> None:
        self.text, self.number, self.size = text, number, size
        self.root: list | None = None

    def common(self, x: int, y: int) -> int:
        """Length of the common prefix of strings x and y."""
        bits = (self.number[x] ^ self.number[y]).bit_length()
        return min((self.size * 8 - bits) // 8, len(self.text[x]), len(self.text[y]))

    def byte(self, x: int, depth: int) -> int:
        t = self.text[x]
        return t[depth] if depth < len(t) else -1

    def insert(self, x: int) -> None:
        # nodes: [depth, {byte: node}] and leaves: [None, [strings]]
        if self.root is None:
            self.root = [None, [x]]
            return
        node = self.root
        while node[0] is not None:  # blindly down to some leaf
            children = node[1]
            node = children.get(self.byte(x, node[0])) or next(iter(children.values()))
        depth = self.common(x, node[1][0])
        if depth == len(self.text[x]) == len(self.text[node[1][0]]):
            node[1].append(x)
            return
        parent, key, other = None, 0, node[1][0]
        node = self.root
        while node[0] is not None and node[0] < depth:
            parent, key = node, self.byte(x, node[0])
            node = node[1][key]
        if node[0] == depth:
            node[1][self.byte(x, depth)] = [None, [x]]
            return
        split = [depth, {self.byte(other, depth): node, self.byte(x, depth): [None, [x]]}]
        if parent is None:
            self.root = split
        else:
            parent[1][key] = split

    def ordered(self) -> tuple[list[int], list[int]]:
        """Strings in order, and the length of the prefix that each shares with the one before."""
        rows: list[int] = []
        common: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, 0)] if self.root else []
        while stack:
            node, depth = stack.pop()
            if node[0] is None:
                for k, x in enumerate(node[1]):
                    rows.append(x)
                    common.append(len(self.text[x]) if k else depth)
                continue
            # the first child meets what came before at this node's entry depth, the others at its own
            children = sorted(node[1].items())
            for k in range(len(children) - 1, -1, -1):
                stack.append((children[k][1], node[0] if k else depth))
        return rows, common


def suffix_order(text: list[bytes], keys: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Order of the suffixes and their common prefixes: shallow by quicksort, deep by blind tries."""
    number = [int.from_bytes(t.ljust(size, b"\0"), "big") for t in text]
    rows: list[int] = []
    common: list[int] = []
    trie = BlindTrie(text, number, size)
    for group in multikey_quicksort(keys, np.arange(len(text)), 0, min(SHALLOW, keys.shape[1])):
        if len(group) == 1:
            x = int(group[0])
            common.append(trie.common(rows[-1], x) if rows else 0)
            rows.append(x)
            continue
        trie.root = None
        for x in group.tolist():
            trie.insert(x)
        own, lcp = trie.ordered()
        if rows and own:
            lcp[0] = trie.common(rows[-1], own[0])
        rows += own
        common += lcp
    return rows, common


def widest(rows: list[int], common: list[int], left: list[int], room: list[int], length: int, reach: int) -> dict[int, tuple[int, int]]:
    """For each suffix of one gram that has a repeat of ``length``: the widest extents to the left and right.

    ``rows`` are suffixes in order, ``common`` their common prefixes; ``left`` the reversed left
    contexts as integers of ``reach`` bytes, ``room`` their lengths.
    """
    best: dict[int, tuple[int, int]] = {}
    where = list(range(len(rows)))  # position -> its node's first position
    members = {k: [x] for k, x in enumerate(rows)}
    at: dict[int, list[int]] = {}
    for k in range(1, len(rows)):
        at.setdefault(common[k], []).append(k)

    def first(k: int) -> int:
        while where[k] != k:
            where[k] = where[where[k]]
            k = where[k]
        return k

    for depth in sorted(at, reverse=True):  # the nodes of the tree from deep to shallow
        need = length - depth
        if need > reach:
            break
        new = set()
        for k in at[depth]:
            x, y = first(k - 1), k
            members[x] += members.pop(y)
            where[y] = x
            new.add(x)
        for x in {first(x) for x in new}:
            by = sorted(members[x], key=lambda i: (left[i], room[i]))
            near = [min((reach * 8 - (left[i] ^ left[j]).bit_length()) // 8, room[i], room[j]) for i, j in zip(by[:-1], by[1:], strict=True)]
            for k, i in enumerate(by):
                same = max(near[k - 1] if k else 0, near[k] if k < len(near) else 0)
                if same >= need:
                    a, b = best.get(i, (0, 0))
                    best[i] = (max(a, same), max(b, depth))
    return best


class ByteRepeats(Repeats):
    """Windows of bytes that also start anywhere else."""

    dtype = np.uint8

    def __init__(self, length: int = 400) -> None:
        if length > 0x7FFF:
            raise ValueError("a string of more than 32,767 bytes does not fit the messages")
        self.length, self.gram = length, max(8, length // 2)

    def elements(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        return data, off, ()

    def namer(self, seq: np.ndarray):  # noqa: ANN201
        return lambda starts, ends, second: K.span_hash(seq, starts, ends, int(second))

    def selection(self, seq: np.ndarray) -> np.ndarray:
        padded = np.concatenate([seq, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(seq),), "<u8", buffer=padded, strides=(1,))
        with np.errstate(over="ignore"):
            return eight * K.BASE

    def compare(self, gram: np.ndarray, body: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, several: np.ndarray) -> np.ndarray:
        """The widest extents, to the left plus one and to the right, of a repeat around the anchor."""
        code = np.zeros(len(gram), dtype=I)
        reach, length = self.reach, self.length
        wide = -(-length // 8) * 8
        right = np.zeros((len(gram), wide), dtype=np.uint8)
        right[:, :length] = body[:, reach:]
        keys = right.view(">u8").astype(U)
        text = [body[i, reach : reach + high[i]].tobytes() for i in range(len(gram))]
        rows, common = suffix_order(text, keys, length)
        back = [body[i, reach - low[i] : reach][::-1].tobytes() for i in range(len(gram))]
        left = [int.from_bytes(t.ljust(reach, b"\0"), "big") for t in back]
        room, twice = low.tolist(), several.tolist()
        begin = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or common[k] < self.gram:  # suffixes of one gram
                best = widest(rows[begin:k], common[begin:k], left, room, length, reach) if k - begin > 1 else {}
                for x in rows[begin:k]:
                    if twice[x] and room[x] + len(text[x]) >= length:  # a leaf of several equal suffixes
                        best[x] = (room[x], len(text[x]))
                for x, (a, b) in best.items():
                    code[x] = (a + 1) << 16 | b
                begin = k
        return code

    def spans(self, code: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -((code >> 16) - 1)[:, None], (code & 0xFFFF)[:, None]

    def result(self, part: Part, cover: np.ndarray, own: pa.Array) -> pa.Table:
        total = np.concatenate([[0], np.cumsum(cover)])
        removed = np.diff(total[part.off])
        begin = cover.copy()
        begin[1:] &= ~cover[:-1]
        edge = part.off[:-1][part.off[:-1] < len(cover)]
        begin[edge] = cover[edge]
        spans = np.diff(np.concatenate([[0], np.cumsum(begin)])[part.off])
        kept = part.data[~cover].tobytes()
        at = (part.off - total[part.off]).tolist()
        told = [sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table([own, pa.array(np.diff(part.off)), pa.array(removed), pa.array(spans), pa.array(told)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes when it lies in a string of ``length`` bytes of its document that also starts
    anywhere else, in the same document too; strings are those of the input.  Null and empty texts
    have no bytes; rows that are repeated lose what they share like any other two; texts of any
    length are read whole; other columns are not read, whatever their names; an empty table gives
    an empty result.
    """
    return ByteRepeats(length).run(docs, id_col, text_col, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
