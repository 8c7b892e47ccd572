"""Scoring by a Brown class-based bigram model with exchange clustering.

1. Every training token is counted, in buckets of word hashes; the vocabulary stays distributed.
2. A start: words that make up at least 1/SHARE of the tokens, at most SHARE of them, and the
   endings of all other words, in SHAPES units, are clustered on the driver by their bigrams.
   Exchange clustering moves one unit after another to the class that raises the likelihood of
   the class bigrams most, until no unit moves, or ROUNDS times over all of them.
3. Every word of the vocabulary, however rare, is then exchanged on its own: buckets get the
   counts of classes before and after each of their words, over all training tokens, and move
   word after word to its best class against the table of class bigrams.  Nothing of this is
   bounded by a number of words, and no word stays with others because of its ending.  Buckets
   work side by side, so they see each other's moves only in the final table.
4. The class bigrams of the final classes are counted over all training tokens.  A text's
   probability is the product of class transitions and of word emissions within their class.
   Classes and counts of words come from the buckets, which groups of documents ask for their
   distinct words (see packed.py).  Only words that were never trained on get a class by ending.

Smoothing: transitions and emissions add one to each count; each class keeps one more place for
words that were not seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .packed import DDL, Box, bucket, find, unpack
from .tables import group_count, groups_of, materialise

#: A word with at least this share of the tokens (one in SHARE) is a unit of its own at the start.
SHARE = 2000
#: Units of the other words at the start, by their last bytes.
SHAPES = 512
CLASSES = 64
ROUNDS = 20
#: Distinct words that a task counts before it passes them on.
FLUSH = 2_000_000
#: Words that are moved against the same table, at most; together they hold at most 1/STEPS of a bucket's tokens.
BATCH, STEPS = 4096, 1000

U, I = np.uint64, np.int64
#: The hash of the token that ends every text.
END = np.uint64(0xE5D0F7E1A7B3C9D1)


def training(ids: list) -> np.ndarray:
    """Which ids are trained on: crc32 of the id as text, modulo 7, is not 2; null counts as an empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for i in ids], dtype=bool)


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, shape of each token, border of each document); an end follows each document's words."""
    lower = K.LOWER[data]
    starts, ends, first = K.word_spans(lower, off)
    word = K.span_hash(lower, starts, ends)
    tail = np.zeros(len(starts), dtype=U)
    for back in (1, 2, 3):
        has = ends - starts >= back
        tail[has] = tail[has] * U(256) + lower[ends[has] - back]
    shape = (K.mix(tail) % U(SHAPES)).astype(I)
    return np.insert(word, first[1:], END), np.insert(shape, first[1:], 0), first + np.arange(len(first))


def count_batches(n: int):
    """Arrow function: (doc_id, text) -> messages of kind 0 to buckets: word, count, shape, of training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, U), np.zeros(0, I), np.zeros(0, np.int32))

        def told() -> Iterator[pa.RecordBatch]:
            box = Box()
            box.deal(bucket(held[0], n), 0, *held, grp=0)
            yield from box.table().to_batches(max_chunksize=256)

        for batch in batches:
            data, off = K.text_arrays(batch.column(1))
            use = training(batch.column(0).to_pylist())
            for i, j, part, cut in K.slices(data, off):
                word, shape, border = tokens(part, cut)
                keep = np.repeat(use[i:j], np.diff(border))
                word, at, count = np.unique(word[keep], return_index=True, return_counts=True)
                held = merged([held[0], word], [held[1], count], [held[2], shape[keep][at].astype(np.int32)])
            if len(held[0]) > FLUSH:
                yield from told()
                held = (held[0][:0], held[1][:0], held[2][:0])
        yield from told()

    return run


def merged(keys: list[np.ndarray], counts: list[np.ndarray], marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of counts by key, with a mark of each key; keys ascending."""
    key, count, mark = (np.concatenate(x) for x in (keys, counts, marks))
    order = np.argsort(key, kind="stable")
    key, count, mark = key[order], count[order], mark[order]
    if len(key) == 0:
        return key, count, mark
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[head], np.add.reduceat(count, head), mark[head]


def sum_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    _, word, count, shape = unpack(table, 0, U, I, np.int32)
    box = Box()
    box.put(key[0].as_py(), 0, 0, *merged([word], [count], [shape]))
    return box.table()


def frequent_batches(least: float):
    """Arrow function: vocabulary rows -> (word, count, shape, distinct): frequent words each, others summed by shape (word null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, word, count, shape = unpack(pa.Table.from_batches([batch]), 0, U, I, np.int32)
            often = count >= least
            rest = ~often
            total, kinds = np.bincount(shape[rest], weights=count[rest], minlength=SHAPES), np.bincount(shape[rest], minlength=SHAPES)
            some = np.flatnonzero(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*word[often].view(I).tolist(), *[None] * len(some)], pa.int64()), pa.array(np.concatenate([count[often], total[some].astype(I)])), pa.array(np.concatenate([shape[often].astype(I), some])), pa.array(np.concatenate([np.ones(often.sum(), I), kinds[some]]))],
                names=["word", "count", "shape", "kinds"],
            )

    return run


@dataclass
class Units:
    """Words that are units of their own (ascending hashes); the other units follow, by shape."""

    often: np.ndarray

    def of(self, word: np.ndarray, shape: np.ndarray) -> np.ndarray:
        at = find(self.often, word)
        return np.where(at >= 0, at, len(self.often) + shape)

    def __len__(self) -> int:
        return len(self.often) + SHAPES


def bigram_batches(units: Units, n: int):
    """Arrow function: (doc_id, text) -> messages of kind 0 to buckets: pair of units, count, of training documents."""
    size = len(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count = np.zeros(0, I), np.zeros(0, I)
        for batch in batches:
            data, off = K.text_arrays(batch.column(1))
            use = training(batch.column(0).to_pylist())
            for i, j, part, cut in K.slices(data, off):
                word, shape, border = tokens(part, cut)
                unit = units.of(word, shape)
                before = np.empty_like(unit)
                before[1:] = unit[:-1]
                if len(unit):
                    before[0] = unit[-1]  # every document starts after an end; the last token is one
                keep = np.repeat(use[i:j], np.diff(border))
                own, times = np.unique(before[keep] * size + unit[keep], return_counts=True)
                key, count, _ = merged([key, own], [count, times], [key, own])
        box = Box()
        box.deal(key * n // (size * size), 0, key, count, grp=0)
        yield from box.table().to_batches(max_chunksize=256)

    return run


def sum_pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    _, pair, count = unpack(table, 0, I, I)
    own, total, _ = merged([pair], [count], [pair])
    box = Box()
    box.put(key[0].as_py(), 0, 0, own, total)
    return box.table()


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit; ``pairs`` is the square table of bigram counts of units.

    The start gives the most frequent units classes of their own and deals out the others.  Moving
    a unit changes one row and one column of the class table, so all classes are tried at once.
    """
    size = len(pairs)
    weight = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    own = np.zeros(size, dtype=I)
    own[order] = np.arange(size) % classes
    member = np.zeros((size, classes))
    member[np.arange(size), own] = 1.0
    to, by = pairs @ member, pairs.T @ member  # of each unit: bigrams into classes, and from them
    table = member.T @ to
    for _ in range(rounds):
        moved = 0
        for u in order.tolist():
            if weight[u] == 0:
                continue
            a, loop = int(own[u]), pairs[u, u]
            right, left = to[u].copy(), by[u].copy()
            right[a] -= loop
            left[a] -= loop
            table[a, :] -= right
            table[:, a] -= left
            table[a, a] -= loop
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            r, l = right.sum() + loop, left.sum() + loop
            # gain of joining class b: its row, its column, the corner they share, and the margins
            gain = (xlogx(table + right) - xlogx(table)).sum(axis=1) + (xlogx(table + left[:, None]) - xlogx(table)).sum(axis=0)
            corner = np.diagonal(table)
            gain += xlogx(corner + right + left + loop) - xlogx(corner + right) - xlogx(corner + left) + xlogx(corner)
            gain -= xlogx(rows + r) - xlogx(rows) + xlogx(cols + l) - xlogx(cols)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b, :] += right
            table[:, b] += left
            table[b, b] += loop
            if b != a:
                moved += 1
                own[u] = b
                to[:, a] -= pairs[:, u]
                to[:, b] += pairs[:, u]
                by[:, a] -= pairs[u, :]
                by[:, b] += pairs[u, :]
        if moved == 0:
            break
    return own


def combined(word: np.ndarray, code: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of counts by word and code (below ``width``); words ascending."""
    words, at = np.unique(word, return_inverse=True)
    key, total, _ = merged([at * width + code], [count], [at])
    return words[key // width], (key % width).astype(np.int16), total


def context_batches(units: Units, own: np.ndarray, classes: int, n: int):
    """Arrow function: (doc_id, text) -> messages of kind 0 to buckets: word, code, count, of training documents.

    A code below ``classes`` is the class of the word after; from there on, that of the word
    before; the last one counts a word that follows itself.
    """
    width = 2 * classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def told() -> Iterator[pa.RecordBatch]:
            box = Box()
            if held:
                word, code, count = combined(*(np.concatenate(x) for x in zip(*held, strict=True)), width)
                box.deal(bucket(word, n), 0, word, code, count, grp=0)
            held.clear()
            yield from box.table().to_batches(max_chunksize=256)

        for batch in batches:
            data, off = K.text_arrays(batch.column(1))
            use = training(batch.column(0).to_pylist())
            for i, j, part, cut in K.slices(data, off):
                word, shape, border = tokens(part, cut)
                keep = np.repeat(use[i:j], np.diff(border))
                own_class = own[units.of(word, shape)]
                first, before = np.roll(word, 1)[keep], np.roll(own_class, 1)[keep]  # the last token is an end
                second, after = word[keep], own_class[keep]
                same = first == second
                words, codes = np.concatenate([first, second, second[same]]), np.concatenate([after, classes + before, np.full(same.sum(), 2 * classes)])
                held.append(combined(words, codes, np.ones(len(words), I), width))
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield from told()
        yield from told()

    return run


def sweep(at: np.ndarray, code: np.ndarray, count: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Exchange of all words against the class table: the new class of each word.

    Entry k says that word ``at[k]`` (ascending) has ``count[k]`` neighbours by ``code[k]``, see
    context_batches.  Frequent words go first and alone; rare ones go together.
    """
    classes, size = len(table), len(own)
    table, new = table.astype(np.float64), own.copy()
    weight = np.bincount(at, weights=count, minlength=size)
    order = np.argsort(-weight, kind="stable")
    sums = np.concatenate([[0], np.cumsum(weight[order])])
    starts = np.searchsorted(at, np.arange(size + 1))
    i = 0
    while i < size:
        j = max(i + 1, min(int(np.searchsorted(sums, sums[i] + sums[-1] / STEPS, "right")) - 1, i + BATCH))
        u, i = order[i:j], j
        each = starts[u + 1] - starts[u]
        entry = np.repeat(starts[u] - np.cumsum(each) + each, each) + np.arange(each.sum())
        k, a = np.arange(len(u)), own[u]
        dense = np.bincount(np.repeat(k, each) * (2 * classes + 1) + code[entry], weights=count[entry], minlength=len(u) * (2 * classes + 1)).reshape(len(u), -1)
        right, left, loop = dense[:, :classes], dense[:, classes:-1], dense[:, -1]
        right[k, a] -= loop
        left[k, a] -= loop

        def joined(cells: np.ndarray, mine: np.ndarray, other: np.ndarray, a=a, loop=loop) -> np.ndarray:
            """What the word's bigrams on one side add in each class; the word itself is taken out of the table first."""
            out = np.zeros(mine.shape)
            row, c = np.nonzero(mine)
            if len(row):
                times, base = mine[row, c][:, None], cells[c]
                base[np.arange(len(row)), a[row]] -= times[:, 0]
                inner = np.flatnonzero(c == a[row])
                base[inner] -= other[row[inner]]
                base[inner, c[inner]] -= loop[row[inner]]
                np.maximum(base, 0, out=base)
                head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                out[row[head]] = np.add.reduceat(xlogx(base + times) - xlogx(base), head)
            return out

        gain = joined(table.T, right, left) + joined(table, left, right)
        corner, rows, cols = (np.repeat(x[None], len(u), axis=0) for x in (np.diagonal(table), table.sum(axis=1), table.sum(axis=0)))
        r, l, s = right.sum(axis=1) + loop, left.sum(axis=1) + loop, loop[:, None]
        corner[k, a] -= right[k, a] + left[k, a] + loop
        rows[k, a] -= r
        cols[k, a] -= l
        for x in (corner, rows, cols):
            np.maximum(x, 0, out=x)
        gain += xlogx(corner + right + left + s) - xlogx(corner + right) - xlogx(corner + left) + xlogx(corner)
        gain -= xlogx(rows + r[:, None]) - xlogx(rows) + xlogx(cols + l[:, None]) - xlogx(cols)
        b = gain.argmax(axis=1)
        b = np.where(gain[k, b] <= gain[k, a] + 1e-9, a, b)
        new[u] = b
        change = np.zeros((len(u), classes))
        change[k, b] += 1
        change[k, a] -= 1
        table += change.T @ right + left.T @ change + np.diag(change.T @ loop)
        np.maximum(table, 0, out=table)
    return new


def exchange_words(units: Units, own: np.ndarray, table: np.ndarray):
    """A bucket's neighbour counts and vocabulary -> its vocabulary with classes in place of shapes."""

    def run(key: tuple[pa.Scalar, ...], told: pa.Table, vocabulary: pa.Table) -> pa.Table:
        _, known, times, shape = unpack(vocabulary, 0, U, I, np.int32)
        _, word, code, count = unpack(told, 0, U, np.int16, I)
        word, code, count = combined(word, code, count, 2 * len(table) + 1)
        box = Box()
        box.put(key[0].as_py(), 0, 0, known, times, sweep(find(known, word), code, count, own[units.of(known, shape)], table).astype(np.int32))
        return box.table()

    return run


@dataclass
class Model:
    units: Units
    own: np.ndarray  # class of each unit at the start, for words that were not trained on
    space: np.ndarray  # log10 of a class's tokens, words and one more
    total: int  # training tokens
    kinds: int  # distinct training tokens


SUMS = "word long, count long, shape long, kinds long"


def learn(rows: DataFrame, n: int, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model of the training rows of (doc_id, text), and its vocabulary with classes: a message row for each of n buckets."""
    counted = rows.mapInArrow(count_batches(n), DDL)
    vocabulary = materialise(counted.groupBy("bucket").applyInArrow(sum_words, DDL))
    sums = vocabulary.mapInArrow(frequent_batches(np.inf), SUMS).agg(F.sum("count"), F.sum("kinds")).first()
    total, kinds = int(sums[0] or 0), int(sums[1] or 0)
    # at most SHARE words
    table = vocabulary.mapInArrow(frequent_batches(max(1.0, total / SHARE)), SUMS).filter("word is not null").collect()
    units = Units(np.array(sorted(int(np.int64(r["word"]).view(U)) for r in table), dtype=U))
    size = len(units)
    pairs = np.zeros(size * size)
    counted = rows.mapInArrow(bigram_batches(units, n), DDL).groupBy("bucket").applyInArrow(sum_pairs, DDL)
    for a, b in counted.select("a", "b").collect():  # at most (SHARE + SHAPES)**2 counts in all, 100 MB packed
        pairs[np.frombuffer(a, I)] = np.frombuffer(b, I)
    pairs = pairs.reshape(size, size)
    own = exchange(pairs, classes)
    member = np.zeros((size, classes), dtype=np.float64)
    member[np.arange(size), own] = 1.0
    told = rows.mapInArrow(context_batches(units, own, classes, n), DDL)
    moved = told.groupBy("bucket").cogroup(vocabulary.groupBy("bucket")).applyInArrow(exchange_words(units, own, member.T @ (pairs @ member)), DDL)
    vocabulary = materialise(moved)
    space = np.ones(classes)
    for r in vocabulary.mapInArrow(frequent_batches(np.inf), SUMS).groupBy("shape").agg(F.sum("count"), F.sum("kinds")).collect():
        space[r[0]] += r[1] + r[2]
    return Model(units, own, np.log10(space), total, kinds), vocabulary


def ask_words(n: int):
    """A group's distinct words, to their buckets."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        data, off = K.text_arrays(table.column("text"))
        found = np.array([END], dtype=U)
        for _, _, part, cut in K.slices(data, off):
            found = np.union1d(found, tokens(part, cut)[0])
        box = Box()
        box.deal(bucket(found, n), 0, found, grp=key[0].as_py())
        return box.table()

    return run


def answer_words(asked: pa.Table, vocabulary: pa.Table) -> pa.Table:
    """The counts and classes of the words that groups ask a bucket for, to the groups; words not seen are left out."""
    grp, word = unpack(asked, 0, U)
    _, known, count, own = unpack(vocabulary, 0, U, I, np.int32)
    at = find(known, word)
    hit = at >= 0
    box = Box()
    box.deal(grp[hit], 0, word[hit], count[at[hit]], own[at[hit]].astype(np.uint8))
    return box.table()


def class_group(model: Model):
    """Everything about a group's documents but the transitions; the classes of their tokens, a byte each."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        _, known, count, known_class = unpack(answers, 0, U, I, np.uint8)
        order = np.argsort(known)
        known, count, known_class = known[order], count[order], known_class[order]
        ids = table.column("doc_id").combine_chunks()
        held = ~training(ids.to_pylist())
        data, off = K.text_arrays(table.column("text"))
        out: list[list[np.ndarray]] = [[], [], [], []]
        classes: list[bytes] = []
        for _, _, part, cut in K.slices(data, off):
            word, shape, border = tokens(part, cut)
            at = find(known, word)
            times = np.where(at >= 0, count[at] if len(count) else 0, 0)
            own = np.where(at >= 0, known_class[at] if len(count) else 0, model.own[model.units.of(word, shape)]).astype(np.uint8)
            seen = np.log10(times + 1.0)
            head = border[:-1]
            for column, x in zip(out, (np.diff(border), *(np.add.reduceat(x, head) for x in ((times > 0).astype(I), seen - np.log10(model.total + model.kinds + 1.0), seen - model.space[own]))), strict=True):
                column.append(x)
            raw = own.tobytes()
            classes.extend(raw[i:j] for i, j in zip(head.tolist(), border[1:].tolist(), strict=True))
        size, seen, base, score = (np.concatenate(c) for c in out)
        return pa.table([ids, pa.array(held), pa.array(size), pa.array(seen), pa.array(np.full(len(size), model.total, I)), pa.array(base), pa.array(score), pa.array(classes, pa.binary())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "classes"])

    return run


def steps_of(batch: pa.RecordBatch, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(class before times classes plus class, of each token of a batch; first token of each document)."""
    own = np.frombuffer(b"".join(batch.column("classes").to_pylist()), np.uint8).astype(I)
    return np.roll(own, 1) * classes + own, np.concatenate([[0], np.cumsum(batch.column("n_tokens").to_numpy())[:-1]]).astype(I)


def step_batches(classes: int):
    """Arrow function: rows with classes -> the counts of their class bigrams, of training documents; one row for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, I)
        for batch in batches:
            batch = batch.filter(pa.array(~np.asarray(batch.column("held_out").to_pylist(), dtype=bool)))
            if batch.num_rows:
                total += np.bincount(steps_of(batch, classes)[0], minlength=classes * classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes * classes)), pa.array(total)], names=["step", "count"])

    return run


def add_steps(step: np.ndarray):
    """Arrow function: rows with classes -> rows whose score has the transitions as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pair, head = steps_of(batch, len(step))
                score = batch.column("score").to_numpy() + np.add.reduceat(step.ravel()[pair], head)
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(score)], names=batch.schema.names[:7])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is trained on the rows that are not held out; there are at most 256 classes.  Null
    and empty texts are one token, the end; repeated rows count each; a null id is trained on; of
    classes that raise the likelihood alike the first one is taken; texts of any length are read
    whole; other columns are not read, whatever their names; an empty table gives an empty result,
    and with nothing to train on every word is unseen.
    """
    n = group_count(docs, text_col)
    base = groups_of(docs, n, id_col, text_col)
    model, vocabulary = learn(base.select("doc_id", "text"), n, classes)
    asked = base.groupBy("grp").applyInArrow(ask_words(n), DDL)
    told = asked.groupBy("bucket").cogroup(vocabulary.groupBy("bucket")).applyInArrow(answer_words, DDL)
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows = materialise(base.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(class_group(model), f"{ddl}, classes binary"))
    step = np.ones(classes * classes)
    for r in rows.mapInArrow(step_batches(classes), "step long, count long").groupBy("step").agg(F.sum("count")).collect():  # classes**2 rows
        step[r[0]] += r[1]
    step = step.reshape(classes, classes)
    return rows.mapInArrow(add_steps(np.log10(step / step.sum(axis=1, keepdims=True))), ddl)
