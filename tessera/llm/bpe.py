"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

Texts are cut into pre-tokens with array operations on code-point classes.  The distinct
pre-tokens of a batch that are not known yet are laid out as one flat array of symbols; each
round looks up the rank of every adjacent pair by binary search over the sorted pair keys, and
merges in each word all occurrences of its lowest-ranked pair.  Words without a mergeable pair
leave the array.  Known pre-tokens stay in a bounded cache of sorted hashes for the rest of the
task.  Every document is decoded again, which compares it with the contents behind its hashes; one
that does not come back byte for byte is encoded without them.  Documents longer than ``PIECE``
bytes are cut where a pre-token starts whatever stands around it, so memory does not follow their
length.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

OTHER, LETTER, NUMBER, SPACE = range(4)

#: Pre-tokens kept per task; the cache starts afresh beyond.
CACHE = 400_000

#: Bytes of a document that are encoded at a time, about.
PIECE = 8 << 20


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point: letters, numbers, white space, others."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
        elif kind == "Z":
            out[c] = SPACE
    out[[0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85]] = SPACE
    return out


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 as it is, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pretokens(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Start positions of the pre-tokens of code points ``points``; none crosses a border in ``cuts``.

    Runs of letters, numbers and other characters, each with one space before it; white space
    otherwise, up to the last character before something else; 's 't 're 've 'm 'll 'd on their own.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    kind = char_classes()[points]
    edge = np.zeros(n + 1, dtype=bool)
    edge[cuts] = True
    run = edge[:n].copy()  # starts of runs of one class
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    after = run & ~edge[:n] & (kind != SPACE)  # a run that follows white space: take its last character, if a blank, along
    after[1:] &= kind[:-1] == SPACE
    after[0] = False
    at = np.flatnonzero(after)
    start[at - 1] = True  # the last white-space character leaves its run
    blank = points[at - 1] == 0x20
    start[at[blank]] = False
    # contractions: an apostrophe that starts a pre-token, alone in its run, before letters
    quote = np.flatnonzero(start[: n - 1] & (points[: n - 1] == 0x27) & run[1:n] & ~edge[1:n] & (kind[1:n] == LETTER)) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        one = points[quote + 1]
        third = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~edge[quote + 2], points[third], 0)
        take = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            take[(one == ord(a)) & (two == ord(b))] = 2
        quote, take = quote[take > 0], take[take > 0]
        start[quote + 1] = False
        nxt = quote + 1 + take
        inside = nxt < n
        nxt = nxt[inside]
        start[nxt[~edge[nxt] & (kind[nxt] == LETTER)]] = True
    return np.flatnonzero(start)


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        size = max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        text: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            text[i] = bytes(letters[c] for c in token)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            text[i] = content
        self.first = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.first[b] = model["vocab"][c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, whole = (np.array([model["vocab"][f(m)] for m in pairs], dtype=np.int64) for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.rank, self.whole = keys[order], order, whole[order]
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self.length = np.array([len(t) for t in text], dtype=np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.decimal = [str(i) for i in range(size)]
        self.none = len(keys)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``none`` if it does not merge) and its place in the key table."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none), at

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many words, flat, and the number of ids of each word.

        ``data`` holds the words' bytes back to back, ``off`` their borders.
        """
        n = len(off) - 1
        done_word: list[np.ndarray] = []
        done_ids: list[np.ndarray] = []
        ids, word = self.first[data], np.repeat(np.arange(n), np.diff(off))
        while len(ids):
            same = np.zeros(len(ids), dtype=bool)
            same[:-1] = word[1:] == word[:-1]
            rank, at = np.full(len(ids), self.none, dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
            pair = np.flatnonzero(same)
            rank[pair], at[pair] = self.ranks(ids[pair], ids[pair + 1])
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(head, len(ids)))
            lowest = np.minimum.reduceat(rank, head)
            alive = np.repeat(lowest < self.none, size)
            if not alive.all():
                done_word.append(word[~alive])
                done_ids.append(ids[~alive])
            hit = alive & (rank == np.repeat(lowest, size))
            # a a a: occurrences that overlap count from the left, every other one
            chain = hit.copy()
            chain[1:] &= hit[:-1]
            if chain.any():
                place = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~chain, place, 0))
                hit &= (place - begin) % 2 == 0
            ids[hit] = self.whole[at[hit]]
            keep = alive
            keep[1:] &= ~hit[:-1]
            ids, word = ids[keep], word[keep]
        if not done_word:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        word, ids = np.concatenate(done_word), np.concatenate(done_ids)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=n)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of token ids."""
        return self.bytes[ranges(self.begin[ids], self.length[ids])]


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers begin[i] .. begin[i] + length[i] - 1 for each i, in a row."""
    total = np.cumsum(length)
    if len(total) == 0 or total[-1] == 0:
        return np.zeros(0, dtype=np.int64)
    return np.arange(total[-1]) + np.repeat(begin - (total - length), length)


class Encoder:
    """Encodes slices of documents with a cache of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary, limit: int = CACHE) -> None:
        self.v, self.limit = vocabulary, limit
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)  # of each hash: where its ids begin, and how many they are
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pre-token's ids stand in ``self.ids``, and how many they are."""
        key = K.span_hash(data, starts, ends)
        own, example, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.hashes) > self.limit:
            self.clear()
        at = np.searchsorted(self.hashes, own)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == own[known]
        new = np.flatnonzero(~known)
        if len(new):
            s, e = starts[example[new]], ends[example[new]]
            ids, size = self.v.encode(data[ranges(s, e - s)], np.concatenate([[0], np.cumsum(e - s)]))
            begin = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            place = np.searchsorted(self.hashes, own[new])
            self.hashes, self.at, self.size = np.insert(self.hashes, place, own[new]), np.insert(self.at, place, begin), np.insert(self.size, place, size)
            at = np.searchsorted(self.hashes, own)
        return self.at[at][back], self.size[at][back]

    def documents(self, data: np.ndarray, off: np.ndarray, hashed: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all documents of a slice, flat, and the borders between documents."""
        pieces, special = self.pieces(data, off)
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.concatenate([[0], np.cumsum(wide)])
        first = pretokens(points, np.searchsorted(byte_at, pieces[:-1]) if len(points) else pieces[:0])
        starts = byte_at[first]
        ends = np.append(starts[1:], len(data))
        if hashed:
            at, size = self.words(data, starts, ends)
            ids = self.ids[ranges(at, size)]
        else:
            ids, size = self.v.encode(data, np.append(starts, len(data)))
        if special:
            # the words of a special piece give way to its one id
            begin = np.cumsum(size) - size
            drop = np.zeros(len(ids), dtype=bool)
            for a, b, i in special:
                w = np.flatnonzero((starts >= a) & (starts < b))
                span = slice(begin[w[0]], begin[w[-1]] + size[w[-1]])
                drop[span] = True
                drop[span.start], ids[span.start] = False, i
                size[w], size[w[0]] = 0, 1
            ids = ids[~drop]
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[np.searchsorted(starts, off)]

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Borders of documents and of special tokens in them; (start, end, id) of the special tokens."""
        raw, found = data.tobytes(), []
        for content, i in self.v.special.items():
            p = raw.find(content)
            while p >= 0:
                q = p + len(content)
                d = int(np.searchsorted(off, p, "right"))
                if q <= off[d]:
                    found.append((p, q, i))
                    p = raw.find(content, q)
                else:
                    p = raw.find(content, p + 1)
        return np.unique(np.concatenate([off, [x for f in found for x in f[:2]]]).astype(np.int64)), found

    def checked(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``documents`` and the decoded bytes; documents that do not come back are encoded without hashes."""
        ids, cut = self.documents(data, off)
        back = self.v.decode(ids)
        if len(back) == len(data) and np.array_equal(back, data):
            return ids, cut, back
        parts, backs = [], []
        for a, b, i, j in zip(off[:-1], off[1:], cut[:-1], cut[1:], strict=True):
            own = ids[i:j]
            if not np.array_equal(self.v.decode(own), data[a:b]):
                own = self.documents(data[a:b], np.array([0, b - a]), hashed=False)[0]
            parts.append(own)
            backs.append(self.v.decode(own))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(backs)


#: A letter, one blank, a letter, none of which can be part of a special token: a pre-token starts at the blank.
SEAM = re.compile(rb"[A-Za-z] (?=[A-Za-z])")


def long_pieces(raw: bytes, special: list[bytes], size: int) -> Iterator[bytes]:
    """A text cut at seams, into pieces of ``size`` bytes or a little more."""
    at = 0
    while len(raw) - at > size:
        m = SEAM.search(raw, at + size)
        while m is not None and any(t in raw[m.start() + 2 - len(t) : m.start() + len(t)] for t in special):
            m = SEAM.search(raw, m.start() + 1)
        if m is None:
            break
        yield raw[at : m.start() + 1]
        at = m.start() + 1
    yield raw[at:]


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """A vocabulary, once for each Python worker."""
    return Vocabulary(path)


def byte_level_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_batches(path: str, with_ids: bool):
    """Arrow function: (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        encoder, decimal = Encoder(vocabulary), vocabulary.decimal

        def row(column: pa.Array, count: list, told: list, text: list, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            columns, names = [column, pa.array(count, pa.int64()), pa.array(told), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            data, off = K.text_arrays(batch.column(1))
            for i, j, part, cut in K.slices(data, off):
                column = batch.column(0).slice(i, j - i)
                if len(part) > 2 * PIECE:  # one document; a slice of several is not as long
                    told, text, found = sha256(), sha256(), []
                    for piece in long_pieces(part.tobytes(), list(vocabulary.special), PIECE):
                        ids, _, back = encoder.checked(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]))
                        told.update((b"," if found else b"") + ",".join([decimal[x] for x in ids.tolist()]).encode())
                        text.update(back.tobytes())
                        found.append(ids.astype(np.int32))
                    ids = np.concatenate(found)
                    yield row(column, [len(ids)], [told.hexdigest()], [text.hexdigest()], ids, np.array([0, len(ids)]))
                    continue
                ids, at, back = encoder.checked(part, cut)
                size = np.concatenate([[0], np.cumsum(vocabulary.length[ids])])[at]
                flat, raw = ids.tolist(), back.tobytes()
                told = [sha256(",".join([decimal[x] for x in flat[a:b]]).encode()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                text = [sha256(raw[a:b]).hexdigest() for a, b in zip(size[:-1], size[1:], strict=True)]
                yield row(column, np.diff(at).tolist(), told, text, ids, at)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless unwanted, the ids.

    Null and empty texts have no tokens; repeated rows are encoded each; texts of any length are
    encoded whole; other columns are not read, whatever their names; an empty table gives an empty
    result.  The vocabulary file must be readable at the same path on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode_batches(path or byte_level_path(), with_ids), schema)
