"""Windows of a sequence that occur elsewhere in the corpus, found through anchors.

A document is a sequence of elements (bytes, or hashes of words).  A window is ``length``
successive elements.  Every window contains an anchor: the place of the smallest selection value
among its first ``length - gram + 1`` places.  Equal windows have the same anchor at the same
distance, so all that has to be compared are anchors with the same ``gram`` elements at them,
each within its context: up to ``reach = length - gram`` elements before it and ``length`` from
it on.  Rounds of messages (see packed.py) narrow this down; hashes only select what is compared:

1. grams: which anchors' grams occur in more than one place at all;
2. contexts: of each distinct context that has several holders, or shares its gram with another
   context, one holder is asked for its content;
3. contents: the contexts of a gram are compared by a sorted structure of suffixes, those with
   several holders as so many equal suffixes; all holders learn which windows occur elsewhere;
4. a gram whose contexts take more than ``MANY`` bytes is not gathered in one place.  In round 3 its
   windows are counted by hash, over any number of buckets; those that occur more than once then
   pass through the same structure, each on its own, under its whole length as a prefix.

A context or window is known by two independent hashes when a holder takes over what the structure
found for its content.  Documents are shuffled once; the exchange is shared by all rounds.
Subclasses say what elements are, when an occurrence counts (``value``), how contexts are compared
and what becomes of the covered elements.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .packed import DDL, Box, bucket, find, low_bytes, unpack, widened
from .tables import group_count, groups_of

#: Bytes of contexts of one gram that are compared in one place.
MANY = 48 << 20

U, I = np.uint64, np.int64
ONE = U(1)
#: The half of a second hash that answers carry, beside a code.
HALF = U(0xFFFFFFFF00000000)


@dataclass
class Part:
    """A slice of documents with its anchors."""

    ids: np.ndarray  # of documents, as int64
    data: np.ndarray  # bytes
    off: np.ndarray
    seq: np.ndarray  # elements
    cut: np.ndarray  # their borders between documents
    spans: tuple  # byte spans of elements, if they are not bytes
    at: np.ndarray  # anchors
    doc: np.ndarray  # document of each anchor
    gram: np.ndarray  # hash of the gram at each anchor
    low: np.ndarray  # context of each anchor: elements [low, high)
    high: np.ndarray
    name: Callable  # (starts, ends, is it the second hash?) -> hashes of runs of elements


class Repeats:
    """Parameters and hooks; see ByteRepeats and WordRepeats."""

    length: int
    gram: int
    dtype: type
    by_document = False  # does an occurrence in the same document count for nothing?

    def elements(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        raise NotImplementedError

    def selection(self, seq: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def namer(self, seq: np.ndarray) -> Callable:
        """A function (starts, ends, is it the second hash?) -> hashes of runs of elements; the two are independent."""
        raise NotImplementedError

    def compare(self, gram: np.ndarray, body: np.ndarray, low: np.ndarray, high: np.ndarray, value: np.ndarray, several: np.ndarray) -> np.ndarray:
        """For each context, sorted by gram: a code of its windows that occur elsewhere; 0 for none."""
        raise NotImplementedError

    def spans(self, code: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Covered ranges, from the anchor, of each code: two arrays (codes, ranges).

        ``later`` marks holders with a larger document id than the context's ``value``.
        """
        raise NotImplementedError

    def result(self, part: Part, cover: np.ndarray, own: pa.Array) -> pa.Table:
        raise NotImplementedError

    @property
    def reach(self) -> int:
        return self.length - self.gram

    @property
    def width(self) -> int:
        return self.reach + self.length

    def parts(self, table: pa.Table) -> Iterator[tuple[Part, pa.Array]]:
        column = table.column("doc_id").combine_chunks()
        ids = np.asarray(column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max))
        data, off = K.text_arrays(table.column("text"))
        for i, j, piece, cut in K.slices(data, off):
            yield self.part(ids[i:j], piece, cut), column.slice(i, j - i)

    def part(self, ids: np.ndarray, data: np.ndarray, off: np.ndarray) -> Part:
        seq, cut, spans = self.elements(data, off)
        size = np.diff(cut)
        room = np.where(size >= self.length, size - self.gram + 1, 0)  # places of grams in windows
        border = np.concatenate([[0], np.cumsum(room)])
        shift = cut[:-1] - border[:-1]
        place = np.arange(border[-1]) + np.repeat(shift, room)
        values = self.selection(seq)[place] if len(place) else np.zeros(0, U)
        found = K.window_minima(values, border, self.reach + 1)
        doc = np.searchsorted(border, found, "right") - 1
        at = found + shift[doc]
        name = self.namer(seq)
        low, high = np.maximum(at - self.reach, cut[doc]), np.minimum(at + self.length, cut[doc + 1])
        return Part(ids, data, off, seq, cut, spans, at, doc, name(at, at + self.gram, False), low, high, name)

    @property
    def bulk(self) -> int:
        """Bytes of a context."""
        return self.width * np.dtype(self.dtype).itemsize

    def contexts(self, part: Part, sel: np.ndarray) -> Callable:
        """A function (places in ``sel`` or None for all, second?) -> hashes of the contexts of anchors ``sel``; the second one's lowest bit is free."""

        def key(some: np.ndarray | None, second: bool) -> np.ndarray:
            own = sel if some is None else sel[some]
            low = part.low[own]
            out = K.mix(part.name(low, part.high[own], second) + (part.at[own] - low).astype(U) * K.BASE)
            return out & ~ONE if second else out

        return key

    def windows(self, part: Part, sel: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable]:
        """Where the windows around the anchors ``sel`` start, each once; an anchor of each; and a function like that of ``contexts``."""
        start = part.at[sel][:, None] - np.arange(self.reach + 1)
        ok = (start >= part.low[sel][:, None]) & (start + self.length <= part.high[sel][:, None])
        start, first = np.unique(start[ok], return_index=True)
        anchor = np.repeat(sel, ok.sum(axis=1))[first]

        def key(some: np.ndarray | None, second: bool) -> np.ndarray:
            own = start if some is None else start[some]
            out = K.mix(part.name(own, own + self.length, second))
            return out & ~ONE if second else out

        return start, anchor, key

    def held(self, part: Part, at: np.ndarray) -> np.ndarray:
        """What an occurrence at element ``at`` counts: its document, or 1."""
        return part.ids[np.searchsorted(part.cut, at, "right") - 1] if self.by_document else np.ones(len(at), I)

    def told(self, columns: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Columns (gram, first, second, value, origin) -> rows (gram, first, second with the bit "several", value) of a group's distinct keys; an origin of each."""
        gram, first, second, value, origin = (K.rejoin(c, t) for c, t in zip(columns, (U, U, U, I, U), strict=True))
        order = np.lexsort((second, first, gram))
        gram, first, second, value, origin = gram[order], first[order], second[order], value[order], origin[order]
        head = _heads(gram, first, second)
        if len(head) == 0:
            return np.zeros((0, 4), U), origin
        low = np.minimum.reduceat(value, head)
        several = low != np.maximum.reduceat(value, head) if self.by_document else np.diff(np.append(head, len(value))) > 1
        return np.stack([gram[head], first[head], second[head] | several.astype(U), low.view(U)], axis=1), origin[head]

    def merged(self, grp: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``told`` rows of all groups: order, heads of equal keys in it, sizes, and value and "several" of each key."""
        second = rows[:, 2] & ~ONE
        order = np.lexsort((grp, second, rows[:, 1], rows[:, 0]))
        rows, second = rows[order], second[order]
        head = _heads(rows[:, 0], rows[:, 1], second)
        size = np.diff(np.append(head, len(rows)))
        value = rows[:, 3].view(I) if len(rows) else np.zeros(0, I)
        if len(head) == 0:
            return order, head, size, value, np.zeros(0, bool)
        low = np.minimum.reduceat(value, head)
        several = np.bitwise_or.reduceat(rows[:, 2] & ONE, head).astype(bool)
        several |= low != np.maximum.reduceat(value, head) if self.by_document else size > 1
        return order, head, size, low, several

    # round 1

    def ask_grams(self, n: int):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            grp, box = key[0].as_py(), Box()
            grams, docs = [], []
            for part, _ in self.parts(table):
                grams.append(part.gram)
                docs.append(part.ids[part.doc] if self.by_document else np.zeros(len(part.at), I))
            gram, doc = K.rejoin(grams, U), K.rejoin(docs)
            order = np.argsort(gram, kind="stable")
            gram, doc = gram[order], doc[order]
            head = _heads(gram)
            if len(head):
                if self.by_document:
                    several = np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)
                else:
                    several = np.diff(np.append(head, len(gram))) > 1
                own = gram[head]
                # the bucket holds the upper bits; the lower ones tell its grams apart well enough to select by
                box.deal(bucket(own, n), 0, low_bytes(own & ~ONE | several.astype(U)), grp=grp)
            return box.table()

        return run

    def answer_grams(self, table: pa.Table) -> pa.Table:
        box = Box()
        grp, told = unpack(table, 0, (np.uint8, 5))
        told = widened(told)
        own, back, count = np.unique(told & ~ONE, return_inverse=True, return_counts=True)
        hit = count > 1
        hit[back[(told & ONE).astype(bool)]] = True
        keep = hit[back]
        box.deal(grp[keep], 0, low_bytes(told[keep] & ~ONE))
        return box.table()

    # round 2

    def ask_contexts(self, n: int):
        def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
            grp, box = key[0].as_py(), Box()
            wanted = np.sort(widened(unpack(answers, 0, (np.uint8, 5))[1]))
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            if len(wanted):
                for part, _ in self.parts(table):
                    sel = np.flatnonzero(find(wanted, widened(low_bytes(part.gram & ~ONE))) >= 0)
                    key = self.contexts(part, sel)
                    for column, x in zip(columns, (part.gram[sel], key(None, False), key(None, True), self.held(part, part.at[sel]), part.gram[sel]), strict=True):
                        column.append(x)
            rows, _ = self.told(columns)
            box.deal(bucket(rows[:, 0], n), 0, rows, grp=grp)
            return box.table()

        return run

    def answer_contexts(self, table: pa.Table) -> pa.Table:
        """kind 1: both hashes of a context that is wanted; 2: grams to be told window by window."""
        box = Box()
        grp, rows = unpack(table, 0, (U, 4))
        order, head, size, _, several = self.merged(grp, rows)
        grp, rows = grp[order], rows[order]
        kinds = _kinds(rows[head, 0])
        many = kinds * self.bulk > MANY
        ask = head[(several | (kinds > 1)) & ~many]
        box.deal(grp[ask], 1, rows[ask, 1], rows[ask, 2] & ~ONE)
        many = np.repeat(many, size)
        pair = np.unique(np.stack([grp[many].astype(U), rows[many, 0]], axis=1), axis=0)
        box.deal(pair[:, 0].astype(I), 2, pair[:, 1])
        return box.table()

    # round 3

    def ask_contents(self, n: int):
        """kind 1: contents that were wanted; 2: windows of grams with many contexts, as ``told``."""

        def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
            grp, box = key[0].as_py(), Box()
            wanted = Answers(*unpack(answers, 1, U, U)[1:])
            many = np.sort(unpack(answers, 2, U)[1])
            if len(wanted) + len(many) == 0:
                return box.table()
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            sent = np.zeros(len(wanted), dtype=bool)
            for part, _ in self.parts(table):
                every = np.arange(len(part.at))
                key = self.contexts(part, every)
                sel, to = _firsts(*wanted.match(key), sent)
                if len(sel):
                    place, low, high = part.at[sel], part.low[sel], part.high[sel]
                    box.deal(bucket(part.gram[sel], n), 1, _head(key(sel, False), key(sel, True), place - low, high - place), self.contents(part, place, low, high), grp=grp)
                if len(many):
                    start, anchor, key = self.windows(part, every[find(many, part.gram) >= 0])
                    first = key(None, False)
                    for column, x in zip(columns, (first, first, key(None, True), self.held(part, start), part.gram[anchor]), strict=True):
                        column.append(x)
            rows, origin = self.told(columns)
            box.deal(bucket(rows[:, 0], n), 2, rows, origin, grp=grp)
            return box.table()

        return run

    def contents(self, part: Part, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Elements [low, high) around places ``at`` as rows of fixed width; the place is at ``reach``."""
        out = np.zeros((len(at), self.width), dtype=self.dtype)
        place = at[:, None] - self.reach + np.arange(self.width)
        inside = (place >= low[:, None]) & (place < high[:, None])
        out[inside] = part.seq[place[inside]]
        return out

    def settle(self, box: Box, kind: int, grp: np.ndarray, rows: np.ndarray, origin: np.ndarray, head: np.ndarray, body: np.ndarray) -> None:
        """Compare contents and tell all holders (``told`` rows) what was found: first hash; half of the second and code; value; origin."""
        if len(head) == 0:
            return
        order, begin, size, value, several = self.merged(grp, rows)
        grp, rows, origin = grp[order], rows[order], origin[order]
        mine = Answers(rows[begin, 1], rows[begin, 2] & ~ONE)
        sel, to = mine.match(lambda some, second: head[:, int(second)] if some is None else head[some, int(second)])
        order = np.argsort(to, kind="stable")  # by gram
        sel, to = sel[order], to[order]
        code = np.zeros(len(begin), dtype=I)
        code[to] = self.compare(rows[begin[to], 0], body[sel], (head[sel, 2] >> U(32)).astype(I), (head[sel, 2] & U(0xFFFFFFFF)).astype(I), value[to], several[to])
        tell = np.repeat(code != 0, size)
        said = (rows[tell, 2] & HALF) | np.repeat(code, size)[tell].astype(U)
        more = [np.repeat(value, size)[tell]] if self.by_document else []
        box.deal(grp[tell], kind, np.stack([rows[tell, 1], said], axis=1), *([origin[tell]] if kind == 4 else more), *(more if kind == 4 else []))

    def answer_contents(self, asked: pa.Table, table: pa.Table) -> pa.Table:
        """kind 3: what was found for contexts; 5: both hashes of a window that is wanted, and its origin."""
        box = Box()
        _, head, body = unpack(table, 1, (U, 3), (self.dtype, self.width))
        grp, rows = unpack(asked, 0, (U, 4))
        self.settle(box, 3, grp, rows, rows[:, 0], head, body)
        grp, rows, origin = unpack(table, 2, (U, 4), U)
        order, begin, _, _, several = self.merged(grp, rows)
        ask = order[begin[several]]
        box.deal(grp[ask], 5, rows[ask, 1], rows[ask, 2] & ~ONE, origin[ask])
        return box.table()

    # round 4

    def ask_windows(self, n: int):
        """kind 6: the contents of windows that were wanted."""

        def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
            grp, box = key[0].as_py(), Box()
            _, first, second, origin = unpack(answers, 5, U, U, U)
            wanted, grams = Answers(first, second), np.unique(origin)
            sent = np.zeros(len(wanted), dtype=bool)
            for part, _ in self.parts(table) if len(wanted) else ():
                start, _, key = self.windows(part, np.flatnonzero(find(grams, part.gram) >= 0))
                sel, to = _firsts(*wanted.match(key), sent)
                if len(sel):
                    place, first = start[sel], key(sel, False)
                    box.deal(bucket(first, n), 6, _head(first, key(sel, True), np.zeros(len(sel), I), np.full(len(sel), self.length)), self.contents(part, place, place, place + self.length), grp=grp)
            return box.table()

        return run

    def answer_windows(self, asked: pa.Table, table: pa.Table) -> pa.Table:
        """kind 4: what was found for windows."""
        box = Box()
        _, head, body = unpack(table, 6, (U, 3), (self.dtype, self.width))
        self.settle(box, 4, *unpack(asked, 2, (U, 4), U), head, body)
        return box.table()

    # last step

    def finish(self, table: pa.Table, answers: pa.Table) -> pa.Table:
        more = [I] if self.by_document else []
        _, told, *value = unpack(answers, 3, (U, 2), *more)
        contexts = Answers(told[:, 0], told[:, 1], HALF)
        _, window, origin, *window_value = unpack(answers, 4, (U, 2), U, *more)
        windows, grams = Answers(window[:, 0], window[:, 1], HALF), np.unique(origin)
        out = []
        for part, own in self.parts(table):
            flags = np.zeros(len(part.seq) + 1, dtype=I)  # +1 where a covered range starts, -1 behind its end
            if len(contexts):
                sel, to = contexts.match(self.contexts(part, np.arange(len(part.at))))
                self.mark(flags, part, part.at[sel], told[to, 1], *(v[to] for v in value))
            if len(windows):
                start, _, key = self.windows(part, np.flatnonzero(find(grams, part.gram) >= 0))
                sel, to = windows.match(key)
                self.mark(flags, part, start[sel], window[to, 1], *(v[to] for v in window_value))
            out.append(self.result(part, np.cumsum(flags[:-1]) > 0, own))
        return pa.concat_tables(out)

    def mark(self, flags: np.ndarray, part: Part, at: np.ndarray, said: np.ndarray, value: np.ndarray | None = None) -> None:
        code = (said & ~HALF).astype(I)
        a, b = self.spans(code, np.zeros(len(at), dtype=bool) if value is None else self.held(part, at) > value)
        for x, y in zip(a.T, b.T, strict=True):
            hit = y > x
            np.add.at(flags, at[hit] + x[hit], 1)
            np.add.at(flags, at[hit] + y[hit], -1)

    def run(self, docs: DataFrame, id_col: str, text_col: str, schema: str) -> DataFrame:
        n = group_count(docs, text_col)
        base = groups_of(docs, n, id_col, text_col)
        kind = docs.schema[id_col].dataType.simpleString()
        ask = lambda f, told: base.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(f, DDL)
        grams = base.groupBy("grp").applyInArrow(self.ask_grams(n), DDL).groupBy("bucket").applyInArrow(_of_table(self.answer_grams), DDL)
        contexts = ask(self.ask_contexts(n), grams)
        contents = ask(self.ask_contents(n), contexts.groupBy("bucket").applyInArrow(_of_table(self.answer_contexts), DDL))
        found = contexts.groupBy("bucket").cogroup(contents.groupBy("bucket")).applyInArrow(_of_tables(self.answer_contents), DDL)
        windows = ask(self.ask_windows(n), found)
        more = contents.groupBy("bucket").cogroup(windows.groupBy("bucket")).applyInArrow(_of_tables(self.answer_windows), DDL)
        return base.groupBy("grp").cogroup(found.unionAll(more).groupBy("grp")).applyInArrow(_of_tables(self.finish), f"doc_id {kind}, {schema}")


class Answers:
    """What messages say about keys of two hashes; of the second one only the bits of ``mask`` may be known."""

    def __init__(self, first: np.ndarray, second: np.ndarray, mask: np.uint64 = ~U(0)) -> None:
        self.order, self.mask = np.lexsort((second, first)), mask
        self.first, self.second = first[self.order], second[self.order] & mask
        self.nth = np.arange(len(first)) - np.searchsorted(self.first, self.first)  # among keys that share the first hash

    def __len__(self) -> int:
        return len(self.first)

    def match(self, key: Callable) -> tuple[np.ndarray, np.ndarray]:
        """(places, ascending, of keys that are known; the answers to them); key(places or None, second?) gives hashes."""
        sel, to = [], []
        first = key(None, False)
        for k in range(int(self.nth.max()) + 1 if len(self) else 0):  # once, unless keys share the first hash
            own = np.flatnonzero(self.nth == k)
            at = find(self.first[own], first)
            hit = np.flatnonzero(at >= 0)
            hit = hit[self.second[own[at[hit]]] == key(hit, True) & self.mask]
            sel.append(hit)
            to.append(self.order[own[at[hit]]])
        sel, to = K.rejoin(sel), K.rejoin(to)
        order = np.argsort(sel, kind="stable")
        return sel[order], to[order]


def _head(first: np.ndarray, second: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Both hashes of a context, and how many elements it has before its place and from it on."""
    return np.stack([first, second, before.astype(U) << U(32) | after.astype(U)], axis=1)


def _firsts(sel: np.ndarray, to: np.ndarray, sent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of ``sel`` for each of ``to`` that was not sent yet; they are marked as sent."""
    to, first = np.unique(to, return_index=True)
    new = ~sent[to]
    sent[to] = True
    return sel[first[new]], to[new]


def _kinds(gram: np.ndarray) -> np.ndarray:
    """Of the sorted grams of distinct contexts: how many contexts each one's gram has."""
    _, back, count = np.unique(gram, return_inverse=True, return_counts=True)
    return count[back]


def _of_table(method):
    """A bound method as a plain function of one table, as Spark counts its arguments."""
    return lambda table: method(table)


def _of_tables(method):
    return lambda left, right: method(left, right)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys starts."""
    if len(keys[0]) == 0:
        return np.zeros(0, dtype=I)
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)
