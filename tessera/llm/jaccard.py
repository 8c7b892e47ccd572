"""N-gram Jaccard join by grouped prefixes.

A document is the set of its word shingles, ordered from rare to common; two sets can only be
similar enough if they share a token of their prefixes.

1. A table of counters over all shingles, of fixed size, orders tokens: by the class of their
   counter, then by hash.  Any order that is the same for all documents gives right results; one
   that puts common passages last keeps the lists short.
2. Documents with equal sets become one: their 64-bit names are checked against a second hash, and
   the sets are named anew should two ever share a name.  Sets with equal prefix and size become
   one group.
3. Groups that share a prefix token are compared by size and by a parity bitmap, which bounds the
   symmetric difference of two sets from below.  Of the pairs that pass, only a spanning forest
   leaves a list, so a list of k groups yields at most k - 1 pairs.
4. The components of these pairs hold every link.  They are expanded, the texts of their members
   are fetched, and their sets are compared shingle by shingle, word by word, until all links that
   could still join two parts are known.

Lists and components beyond a size are cut into chunks and compared as linkage.py says, with
pivots, so that work grows with their size and not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .components import components
from .linkage import forest_by_pivots, linked
from .tables import WORD, materialise, small, spread

#: Counters of the table that orders tokens: 2**COUNTER_BITS, whatever the input.
COUNTER_BITS = 20
#: Bits of the table that tells which documents' texts are fetched: 2**FETCH_BITS, whatever the input.
FETCH_BITS = 24
#: Bits of the parity bitmap of sets of up to as many elements.
BITS = 1024
#: Groups of a list whose pairs are tried one by one; and pairs that pass, for each group, up to which they are told as pairs.
SOME, FEW = 64, 2
#: Members of a list that one task compares; larger ones are cut into chunks.
CHUNK = 2048
#: Bytes of text of a component's members that make a chunk.
WEIGHT = 4 << 20
#: Postings that are added up at a time.
POSTINGS = 1 << 18
#: Rows of the counter table.
BLOCKS = 64
#: The bit of a counter's class that says that it is above CHUNK.
OFTEN = 128


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, flat; and their borders.

    A document with fewer than ``width`` words is one shingle, its whole sequence; one without
    words has none.
    """
    lower = K.LOWER[data]
    starts, ends, first = K.word_spans(lower, off)
    words = K.span_hash(lower, starts, ends)
    n = len(off) - 1
    count = np.diff(first)
    runs = K.run_hash(words, width)
    at = np.flatnonzero(K.inside(first, width, len(words))[: len(runs)])
    token, doc = runs[at], K.owner(first)[at]
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        own = K.BASE + count[few].astype(np.uint64)
        for k in range(width - 1):
            has = count[few] > k
            own[has] = K.fold(own[has], words[first[few][has] + k])
        token, doc = np.concatenate([token, K.mix(own)]), np.concatenate([doc, few])
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(n + 1))


def _counter(token: np.ndarray) -> np.ndarray:
    return (token >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def count_batches(width: int):
    """Arrow function: (text) -> the partition's counters in BLOCKS rows (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for batch in batches:
            data, off = K.text_arrays(batch.column(0))
            for _, _, part, cut in K.slices(data, off):
                token, _ = shingle_sets(part, cut, width)
                table += np.bincount(_counter(token), minlength=len(table))
        if table.any():
            rows = [_short(x) for x in np.split(table, BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(rows, pa.binary())], names=["block", "counts"])

    return run


def _short(x: np.ndarray) -> bytes:
    """Counts as 16 bits, those beyond as the largest: counts only order tokens."""
    return np.minimum(x, 0xFFFF).astype(np.uint16).tobytes()


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counter blocks of a partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(raw, np.uint16).astype(np.int64)
            total[block] = total[block] + x if block in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def token_classes(texts: DataFrame, width: int) -> np.ndarray:
    """Class of each counter: 0 for those near the mean, one more for each doubling (one byte each).

    Counters that reach CHUNK carry OFTEN as well: only their tokens can be in more than CHUNK sets.
    """
    parts = texts.mapInArrow(count_batches(width), "block int, counts binary")
    # BLOCKS rows of fixed size from each of four parts, so that no task reads all partitions' counters
    parts = parts.repartition(BLOCKS * 4, F.col("block"), F.spark_partition_id() % 4).mapInArrow(add_counts, "block int, counts binary")
    table = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
    size = len(table) // BLOCKS
    for block, raw in parts.collect():  # 4 * BLOCKS rows, 16 MB whatever the input
        table[block * size : (block + 1) * size] += np.frombuffer(raw, np.uint32)
    mean = max(4.0, table.sum() / len(table))
    return np.maximum(0, np.log2(np.maximum(table, 1) / mean)).astype(np.uint8) | np.where(table > CHUNK, OFTEN, 0).astype(np.uint8)


def largest_difference(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """How many elements may be in only one of two sets of sizes n and m with Jaccard >= percent/100."""
    both = n + m
    least = -(-percent * both // (100 + percent))
    return both - 2 * least


def set_names(token: np.ndarray, border: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit name of each document's set."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(K.mix(token + K.BASE * np.uint64(1 + salt)), dtype=np.uint64)])
        return K.mix((sums[border[1:]] - sums[border[:-1]]) + np.diff(border).astype(np.uint64) * K.BASE).view(np.int64)


def parity_maps(mixed: np.ndarray, doc: np.ndarray, border: np.ndarray) -> list[bytes]:
    """Of each document: whether an odd number of its elements fall on each bit, by the lowest bits of their hash.

    A map has BITS bits, and more for larger sets: a power of two of at least the set's size, so
    that maps of unlike sets stay unlike.
    """
    n = np.diff(border)
    count = np.bincount(doc * BITS + (mixed & np.uint64(BITS - 1)).astype(np.int64), minlength=len(n) * BITS)
    out = [x.tobytes() for x in np.packbits((count & 1).astype(np.uint8).reshape(len(n), BITS), axis=1)]
    for d in np.flatnonzero(n > BITS).tolist():
        bits = 1 << int(n[d] - 1).bit_length()
        count = np.bincount((mixed[border[d] : border[d + 1]] & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
        out[d] = np.packbits((count & 1).astype(np.uint8)).tobytes()
    return out


def fold(raw: bytes, size: int) -> np.ndarray:
    """A map as words, folded to ``size`` bytes: the parity of bits that agree in the lower part of their number."""
    return np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, size // 8), axis=0)


def feature_batches(width: int, percent: int, classes, salt: int = 0):
    """Arrow function: (doc_id, text, mark) -> doc_id, mark, bytes, n, node, check, prefix (bytes of uint64), bitmap; node names the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        for batch in batches:
            data, off = K.text_arrays(batch.column(1))
            for i, j, part, cut in K.slices(data, off):
                token, at = shingle_sets(part, cut, width)
                n = np.diff(at)
                doc = np.repeat(np.arange(j - i), n)
                mixed = K.mix(token + K.BASE)
                kind = table[_counter(token)] & np.uint8(OFTEN - 1)
                order = np.lexsort((token, kind, doc))
                rank = np.arange(len(token)) - np.repeat(at[:-1], n)
                size = n - -(-percent * n // 100) + 1
                head = token[order][rank < np.repeat(size, n)]
                size = np.where(n > 0, size, 0)
                maps = parity_maps(mixed, doc, at)
                raw, border = head.tobytes(), np.concatenate([[0], np.cumsum(size)]) * 8
                prefix = pa.array([raw[a:b] for a, b in zip(border[:-1], border[1:], strict=True)], pa.binary())
                columns = [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(cut)), pa.array(n), pa.array(set_names(token, at, 2 * salt)), pa.array(set_names(token, at, 2 * salt + 1)), prefix, pa.array(maps, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "bytes", "n", "node", "check", "prefix", "bitmap"])

    return run


def posting_batches(classes):
    """Arrow function: (g, prefix, n) -> (token, g, at, often), a row for each token; only tokens marked ``often`` can have long lists.

    ``at`` is the set's size in its upper, the token's place in the set in its lower 32 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                raw = part.column(1).to_pylist()
                token = np.frombuffer(b"".join(raw), np.int64)
                size = np.array([len(r) // 8 for r in raw], dtype=np.int64)
                g, n = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), size) for c in (0, 2))
                place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                often = table[_counter(token.view(np.uint64))] >= OFTEN
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(g), pa.array(n << 32 | place), pa.array(often)], names=["token", "g", "at", "often"])

    return run


def reachable(at: np.ndarray, to: np.ndarray, percent: int) -> np.ndarray:
    """Can sets that share a token, at places ``at`` and ``to``, be similar enough if it is the first they share?

    What they share is at most what each has from its place on.  Similar sets pass at the first
    token they share, so pairs that do not pass may be left to their other lists.
    """
    n, m = at >> 32, to >> 32
    least = -(-percent * (n + m) // (100 + percent))
    return np.minimum(n - (at & 0xFFFFFFFF), m - (to & 0xFFFFFFFF)) >= least


def list_batches(percent: int):
    """Arrow function: (token, g, at) of a partition -> (list, g, h) for tokens of two groups or more, CHUNK at most.

    Lists of up to SOME groups whose places leave few pairs give these pairs (null, g, h); others
    the members (list, g, null) that some other member's size allows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for column, x in zip(held, batch.columns, strict=True):
                column.append(x.to_numpy(zero_copy_only=False))
        token, group, at = (K.rejoin(c) for c in held)
        order = np.lexsort((at >> 32, token))
        token, group, at = token[order], group[order], at[order]
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else token
        size = np.diff(np.append(head, len(token)))
        pairs, whole = [np.zeros((0, 2), dtype=np.int64)], [head[size > SOME]]
        for k in np.unique(size[(size > 1) & (size <= SOME)]).tolist():
            i, j = np.triu_indices(k, 1)
            rows = head[size == k]
            step = max(1, 200_000 // len(i))
            for s in range(0, len(rows), step):
                own = rows[s : s + step, None]
                ok = reachable(at[own + i], at[own + j], percent)
                many = ok.sum(axis=1) > FEW * k
                whole.append(rows[s : s + step][many])
                ok[many] = False
                pairs.append(np.unique(np.stack([np.minimum(group[own + i], group[own + j])[ok], np.maximum(group[own + i], group[own + j])[ok]], axis=1), axis=0))
        pair = np.unique(np.concatenate(pairs), axis=0)
        yield from _rows(None, pair[:, 0].copy(), pair[:, 1].copy())
        some = np.repeat(np.isin(head, np.concatenate(whole)), size)
        token, group, n = token[some], group[some], at[some] >> 32
        near = np.zeros(len(token), dtype=bool)  # sizes ascend within a list: the next one is the nearest
        near[:-1] = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:])
        near[1:] |= near[:-1].copy()
        yield from _rows(token[near], group[near], None)

    return run


def _rows(key: np.ndarray | None, g: np.ndarray, h: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(g), 50_000):
        part = [pa.nulls(len(g[k : k + 50_000]), pa.int64()) if x is None else pa.array(x[k : k + 50_000]) for x in (key, g, h)]
        yield pa.RecordBatch.from_arrays(part, names=["list", "g", "h"])


class Maps:
    """Parity maps of many sets: folded to BITS bits as a matrix, and the longer ones in full."""

    def __init__(self, columns: list[pa.Array]) -> None:
        raw = [x for c in columns for x in c.to_pylist()]
        self.free = np.array([x is None for x in raw], dtype=bool)
        self.long = {i: x for i, x in enumerate(raw) if x is not None and len(x) > BITS // 8}
        nothing = bytes(BITS // 8)
        self.short = np.frombuffer(b"".join(nothing if x is None or len(x) > BITS // 8 else x for x in raw), np.uint64).reshape(len(raw), -1)
        if self.long:
            self.short = self.short.copy()
            for i, x in self.long.items():
                self.short[i] = fold(x, BITS // 8)


def possible(n: np.ndarray, m: np.ndarray, x: Maps, at: np.ndarray, y: Maps, to: np.ndarray, percent: int) -> np.ndarray:
    """Can sets ``at`` of x, of sizes n, and sets ``to`` of y, of sizes m, be similar enough?  Those without a map can."""
    ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    most = largest_difference(n, m, percent)
    free = x.free[at] | y.free[to]
    ok[ok] = free[ok] | (np.bitwise_count(x.short[at[ok]] ^ y.short[to[ok]]).sum(axis=1).astype(np.int64) <= most[ok])
    if x.long and y.long:
        for k in np.flatnonzero(ok & ~free & (n > BITS) & (m > BITS)).tolist():
            a, b = x.long[int(at[k])], y.long[int(to[k])]
            size = min(len(a), len(b))
            ok[k] = int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum()) <= most[k]
    return ok


def pair_batches(percent: int):
    """Arrow function: (a, b, n, m, bitmap, other) -> the pairs (a, b) that can be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            row = np.arange(batch.num_rows)
            ok = possible(n, m, Maps([batch.column(4)]), row, Maps([batch.column(5)]), row, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return run


def candidate_batches(percent: int):
    """Arrow function: rows (list, g, part, ask, n, bitmap) of whole lists -> of the pairs that pass, those that join parts (see linkage.py)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        columns: list[pa.Array] = []
        for batch in batches:
            for i in range(5):
                cols[i].append(batch.column(i).to_numpy(zero_copy_only=False))
            columns.append(batch.column(5))
        if not columns:
            return
        key, group, part, ask, n = (np.concatenate(c) for c in cols)
        maps = Maps(columns)
        order = np.lexsort((group, n, key))
        head = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
        size = np.diff(np.append(head, len(key)))

        def passes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            a, b = order[a], order[b]
            return possible(n[a], n[b], maps, a, maps, b, percent)

        left, right = [], []
        for h, k in zip(head.tolist(), size.tolist(), strict=True):
            own = order[h : h + k]
            for a, b in forest_by_pivots(k, lambda x, others, h=h: others[passes(np.full(len(others), x + h), others + h)], part[own], ask[own]):
                left.append(group[own[a : a + 1]])
                right.append(group[own[b : b + 1]])
        a, b = K.rejoin(left), K.rejoin(right)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return run


def exact_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Like shingle_sets, but a shingle's number stands for its words themselves: equal numbers, equal words."""
    lower = K.LOWER[data]
    starts, ends, first = K.word_spans(lower, off)
    word = K.exact_ids(lower, starts, ends)[0].astype(np.int32)
    count = np.diff(first)
    at = np.flatnonzero(K.inside(first, width, len(word))[: max(0, len(word) - width + 1)])
    few = np.flatnonzero((count > 0) & (count < width))
    runs = word[at[:, None] + np.arange(width)].ravel() if len(at) else np.zeros(0, np.int32)
    rest = [word[first[d] : first[d + 1]] for d in few.tolist()]
    flat = np.concatenate([runs, *rest])
    size = np.concatenate([np.full(len(at), width), count[few]]).astype(np.int64) * 4
    stop = np.cumsum(size)
    token = K.exact_ids(np.ascontiguousarray(flat).view(np.uint8), stop - size, stop)[0]
    doc = np.concatenate([K.owner(first)[at], few])
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(len(off)))


def verify_block(width: int, percent: int):
    """Arrow function over one block of members: (block, grp, node, part, ask, text) -> the exact links that join parts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("node", "ascending"), ("ask", "descending")])
        grp, node = table.column("grp").to_numpy(), table.column("node").to_numpy()
        once = np.ones(len(node), dtype=bool)  # rows that repeat an id and its text
        once[1:] = (grp[1:] != grp[:-1]) | (node[1:] != node[:-1])
        table, grp, node = table.filter(pa.array(once)), grp[once], node[once]
        part, ask = table.column("part").to_numpy(), np.asarray(table.column("ask").to_pylist(), dtype=bool)
        data, off = K.text_arrays(table.column("text"))
        token, border = exact_sets(data, off, width)
        n = np.diff(border)
        out: list[tuple[int, int]] = []
        head = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]])) if len(grp) else np.zeros(0, np.int64)
        for h, e in zip(head.tolist(), [*head[1:].tolist(), len(grp)], strict=True):
            links = _Overlaps(token[border[h] : border[e]], border[h : e + 1] - border[h], percent)
            out += [(h + a, h + b) for a, b in forest_by_pivots(e - h, links, part[h:e], ask[h:e])]
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


class _Overlaps:
    """Which of a few sets are similar enough to one of them, by lists of the sets that hold each shingle."""

    def __init__(self, token: np.ndarray, border: np.ndarray, percent: int) -> None:
        self.border, self.n, self.percent = border, np.diff(border), percent
        _, self.token = np.unique(token, return_inverse=True)
        own = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        self.holder = own[np.argsort(self.token, kind="stable")]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(self.token))]).astype(np.int64)

    def __call__(self, x: int, others: np.ndarray) -> np.ndarray:
        mine = self.token[self.border[x] : self.border[x + 1]]
        size = self.begin[mine + 1] - self.begin[mine]
        total = np.cumsum(size)
        common = np.zeros(len(self.n), dtype=np.int64)
        at = 0
        while at < len(mine):  # so many postings at a time
            to = max(at + 1, int(np.searchsorted(total, total[at] - size[at] + POSTINGS, "right")))
            s, base = size[at:to], total[at] - size[at]
            spots = np.arange(total[to - 1] - base) + np.repeat(self.begin[mine[at:to]] - (total[at:to] - base - s), s)
            common += np.bincount(self.holder[spots], minlength=len(self.n))
            at = to
        common = common[others]
        return others[100 * common >= self.percent * (self.n[x] + self.n[others] - common)]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents are linked when the Jaccard similarity of their shingle sets is at least
    ``percent`` hundredths.  ``component_id`` is the smallest id that links reach, the row's own
    included.  Null text counts as empty; documents without words are linked with nothing;
    repeated rows are linked with each other; null ids stay null and are never the smallest id of
    others.  Texts of any length are read whole; other columns are not read, whatever their names.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    classes = spark.sparkContext.broadcast(token_classes(rows.select("text"), width))
    features, sets = _named_sets(rows, kind, width, percent, classes)
    maps = features.filter("n > 0").groupBy("prefix", "n").agg(F.min("node").alias("g"), F.max("node").alias("_last"), F.first("bitmap").alias("bitmap"))
    maps = maps.select("g", "n", "prefix", F.when(F.col("g") == F.col("_last"), F.col("bitmap")).alias("bitmap"))
    tied = _candidates(maps, sets, classes, percent)
    tied = tied.unionAll(tied.select(F.col("root").alias("node"), "root").distinct())
    tied = materialise(tied.join(sets.select("node", "rep", "bytes"), "node"))
    # a set's text is that of the row with its smallest id, found by the id and a hash of the text
    compare = lambda blocks: _verified(blocks, rows, sets, width, percent)
    roots = linked(tied.select(F.col("root").alias("grp"), F.col("node").alias("item"), (F.col("bytes") + 64).alias("weight")), WEIGHT, compare)
    whole = sets.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    names = whole.groupBy("root").agg(F.min("rep").alias("low"))
    # derived keys: both sides are dealt out anew, so that a hot component can be split
    whole = whole.select("node", F.struct("root").alias("_key")).join(names.select(F.struct("root").alias("_key"), "low"), "_key")
    whole = whole.select(F.col("node").alias("_node"), F.col("low.id").alias("low"))
    out = features.select("doc_id", "n", "node").join(whole, (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


def _named_sets(rows: DataFrame, kind: str, width: int, percent: int, classes) -> tuple[DataFrame, DataFrame]:
    """The features of all rows, and a row for each distinct set; no two sets have the same name."""
    salt = 0
    while True:
        features = materialise(rows.mapInArrow(feature_batches(width, percent, classes, salt), f"doc_id {kind}, mark long, bytes long, n long, node long, check long, prefix binary, bitmap binary"))
        rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "mark", "bytes"))
        sets = features.filter("n > 0").groupBy("node").agg(rep.alias("rep"), F.first("n").alias("n"), F.min(F.xxhash64("prefix", "n")).alias("like"), F.min("check").alias("_a"), F.max("check").alias("_b"))
        sets = materialise(sets.withColumn("bytes", F.col("rep.bytes")))
        if sets.filter("_a <> _b").isEmpty():
            return features, sets.select("node", "rep", "n", "like", "bytes")
        salt += 1


def _candidates(maps: DataFrame, sets: DataFrame, classes, percent: int) -> DataFrame:
    """(node, root) of every set that may be similar enough to another: the connected parts of the pairs that pass."""
    n = spread(maps.sparkSession) // 2
    posted = maps.select("g", "prefix", "n").mapInArrow(posting_batches(classes), "token long, g long, at long, often boolean")
    long_ = materialise(posted.filter("often").groupBy("token").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > CHUNK).select(F.col("token").alias("_token")))
    some = not long_.isEmpty()
    short = posted.join(small(long_), F.col("token") == F.col("_token"), "left_anti") if some else posted
    lists = materialise(short.select("token", "g", "at").repartition(n, "token").mapInArrow(list_batches(percent), "list long, g long, h long"))
    maps = maps.select(F.col("g").alias("_g"), "n", "bitmap")
    two = lists.filter("list is null").select(F.col("g").alias("a"), F.col("h").alias("b")).distinct()
    two = two.join(maps, F.col("a") == F.col("_g")).select("a", "b", "n", "bitmap")
    two = two.join(maps.select("_g", F.col("n").alias("m"), F.col("bitmap").alias("other")), F.col("b") == F.col("_g")).select("a", "b", "n", "m", "bitmap", "other")

    def compare(blocks: DataFrame) -> DataFrame:
        # a list is a block and a token; both are hashes, so that one number stands for the two
        full = blocks.join(maps, F.col("item") == F.col("_g")).select(F.xxhash64("block", "grp").alias("list"), F.col("item").alias("g"), "part", "ask", "n", "bitmap")
        return full.repartition(n, "list").mapInArrow(candidate_batches(percent), "a long, b long")

    many = lists.filter("list is not null").select(F.col("list").alias("block"), F.col("list").alias("grp"), F.col("g").alias("item"), F.col("g").alias("part"), F.lit(True).alias("ask"))
    pairs = two.mapInArrow(pair_batches(percent), "a long, b long").unionAll(compare(many))
    # members of a group are candidates of each other
    lowest = sets.groupBy("like").agg(F.min("node").alias("g")).select(F.struct("like").alias("_like"), "g")  # a derived key, so that a hot group can be split
    members = sets.join(lowest, F.struct("like") == F.col("_like")).filter("node <> g").select(F.col("node").alias("a"), F.col("g").alias("b"))
    pairs = pairs.unionAll(members)
    if not some:
        return components(pairs)
    hot = posted.join(small(long_), F.col("token") == F.col("_token")).select(F.col("token").alias("grp"), F.col("g").alias("item"), F.lit(1).cast("long").alias("weight"))
    return linked(materialise(hot), CHUNK, compare, materialise(pairs))


def _verified(blocks: DataFrame, rows: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """The exact links that join parts in each block."""
    members = blocks.join(sets.select(F.col("node").alias("_n"), "rep.id", "rep.mark"), F.col("item") == F.col("_n"))
    members = members.select("block", "grp", F.col("item").alias("node"), "part", "ask", "id", F.col("mark").alias("_mark"))
    # a table of bits, at most 2**(FETCH_BITS - 6) rows, keeps the other documents' texts from being moved
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FETCH_BITS))
    wanted = members.select(spot("_mark").alias("bit")).groupBy(F.shiftright("bit", 6).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("_v"))
    texts = rows.withColumn("bit", spot("mark")).join(F.broadcast(wanted), F.shiftright("bit", 6) == F.col("_w"))
    texts = texts.filter(F.expr("(shiftrightunsigned(_v, cast(bit % 64 as int)) & 1L) = 1")).select("doc_id", "mark", "text")
    found = members.join(texts, (F.col("_mark") == F.col("mark")) & F.col("id").eqNullSafe(F.col("doc_id"))).select("block", "grp", "node", "part", "ask", "text")
    return found.groupBy("block").applyInArrow(verify_block(width, percent), T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with all their columns: one of each component stays.

    That is the row with the component's smallest id, null ids last, and of its texts the one with
    the smallest hash; of rows that repeat id and text, one.  Rows without words stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("text"))
    found = near_duplicates(docs.withColumn("_tessera_name", name), "_tessera_name", text_col, width, percent)
    # null ids as a value of their own, so that rows meet by plain equality
    key = lambda c: F.struct(F.col(f"{c}.none").alias("none"), F.coalesce(F.col(f"{c}.id").cast("string"), F.lit("")).alias("id"), F.col(f"{c}.text").alias("text"))
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key("doc_id").alias("_tessera_key")).distinct()
    out = docs.withColumn("_tessera_name", name).withColumn("_tessera_key", key("_tessera_name")).drop("_tessera_name")
    out = out.join(gone, "_tessera_key", "left_anti")  # dealt out as the rows are numbered below, so texts move once
    out = out.withColumn("_tessera_nth", F.row_number().over(W.partitionBy("_tessera_key").orderBy("_tessera_key")))
    wordless = ~F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(WORD)
    return out.filter((F.col("_tessera_nth") == 1) | wordless).select(*[F.col(f"`{c}`") for c in docs.columns])
