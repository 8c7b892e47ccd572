"""Quality rules by weak supervision.

Rules look at five counts of a text and vote *good* or *bad* or abstain.  No rule decides on
its own: expectation-maximisation over the whole corpus estimates how often each rule votes
which way on good and on bad texts, and a text stays when the posterior probability that it is
good reaches a threshold.

The vote of all rules on a text is one of at most 3**R patterns.  Texts with equal patterns have
equal posteriors, so the model is fitted exactly, on every document, from the table of pattern
counts: a table whose size depends on the number of rules and not on the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .tables import materialise

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_lines")

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = True
LETTERS[0xC2:0xF5] = True  # first bytes of longer characters

WINDOW = 8


def count_slice(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The counts of COUNTS for each document of a slice."""
    n = len(off) - 1
    starts, ends, first = K.word_spans(data, off)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(total[off])

    solid = ~K.SPACE[data]
    chars = per_doc(solid & ((data & 0xC0) != 0x80))

    # lines, white space included; those without a word do not count
    edge = np.flatnonzero(data == 10)
    doc = np.searchsorted(off, edge, "right") - 1
    begin, stop = np.concatenate([off[:-1], edge + 1]), np.concatenate([edge, off[1:]])
    own, until = np.concatenate([np.arange(n), doc]), np.concatenate([doc, np.arange(n)])
    order = np.lexsort((begin, own))
    begin, own, stop = begin[order], own[order], stop[np.lexsort((stop, until))]
    lines = np.bincount(own, minlength=n)
    has_word = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, own = begin[has_word], stop[has_word], own[has_word]
    line, kinds = K.exact_ids(data, begin, stop)
    dup_lines = np.bincount(own, minlength=n) - np.bincount(np.unique(own * max(1, len(kinds)) + line) // max(1, len(kinds)), minlength=n)

    # words inside windows that are found again in the same text
    word = K.exact_ids(data, starts, ends)[0].astype(np.int32)
    at = np.flatnonzero(K.inside(first, WINDOW, len(word))[: max(0, len(word) - WINDOW + 1)])
    rows = np.ascontiguousarray(word[at[:, None] + np.arange(WINDOW)]).view(np.uint8).ravel()
    border = np.arange(len(at) + 1) * 4 * WINDOW
    window, kinds = K.exact_ids(rows, border[:-1], border[1:])
    _, back, count = np.unique(K.owner(first)[at] * max(1, len(kinds)) + window, return_inverse=True, return_counts=True)
    at = at[count[back] > 1]
    cover = np.zeros(len(word) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    again = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return [np.diff(first), chars, per_doc(SYMBOLS[data]), dup_lines, np.diff(again[first]), per_doc(LETTERS[data]), lines]


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = K.text_arrays(batch.column(1))
        for i, j, part, cut in K.slices(data, off):
            columns = [pa.array(x.astype(np.int64)) for x in count_slice(part, cut)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["doc_id", *COUNTS])


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and the counts of COUNTS; null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count_batches, schema)


@dataclass(frozen=True)
class Rule:
    """Votes 1 (good) where ``good`` holds, else 0 (bad) where ``bad`` holds, else abstains (2)."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(self.bad, 0).when(self.good, 1).otherwise(2)


def standard_rules() -> list[Rule]:
    """Seven rules, each of which also votes against some good texts: none is to decide alone.

    Symbols for each word and for each character, share of letters, word length, repeated lines,
    words in repeated windows, length.  All bounds differ from those of ``base_failed``.
    """
    words, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("symbols", 100 * F.col("n_symbols") <= 2 * words, 100 * F.col("n_symbols") > 8 * words),
        Rule("symbol_chars", 200 * F.col("n_symbols") <= chars, 50 * F.col("n_symbols") > chars),
        Rule("letters", 100 * F.col("n_letters") >= 93 * chars, 100 * F.col("n_letters") < 90 * chars),
        Rule("word_length", (10 * chars >= 45 * words) & (chars <= 6 * words), (10 * chars < 42 * words) | (10 * chars > 65 * words)),
        Rule("lines", F.col("n_dup_lines") == 0, 100 * F.col("n_dup_lines") > 15 * F.col("n_lines")),
        Rule("windows", F.col("n_repeat_words") == 0, 100 * F.col("n_repeat_words") > 8 * words),
        Rule("length", words >= 80, words < 50),
    ]


@dataclass
class Votes:
    """Label model: P(good), and for each class and rule the chance that a vote cast is bad (0) or good (1).

    An abstention (2) says nothing: how often a rule speaks is taken not to depend on the class.
    """

    good: float
    table: np.ndarray = field(repr=False)  # [class, rule, vote]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good | votes) for each row of ``patterns`` (rows x rules)."""
        silent = np.ones((2, self.table.shape[1], 1))
        odds = np.log(np.concatenate([self.table, silent], axis=2))
        rule = np.arange(patterns.shape[1])
        bad, good = (odds[c][rule, patterns].sum(axis=1) for c in (0, 1))
        return 1 / (1 + np.exp(np.clip(bad + np.log(1 - self.good) - good - np.log(self.good), -700, 700)))

    def accuracies(self) -> np.ndarray:
        """P(vote agrees with the class | vote cast) of each rule."""
        return (1 - self.good) * self.table[0, :, 0] + self.good * self.table[1, :, 1]


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, prior: float = 0.85, belief: float = 0.02) -> Votes:
    """Expectation-maximisation over pattern counts.

    The start takes a bad text to break half of the rules and a good one to break one in fifty.  It
    stays as a prior, pseudo-counts worth ``belief`` of the corpus, so that classes keep their names
    and a rule that hardly speaks is not believed blindly; nothing else holds the estimates.
    """
    rules = patterns.shape[1]
    start = np.empty((2, rules, 2))
    start[0], start[1] = (0.5, 0.5), (0.02, 0.98)
    total = max(1.0, float(counts.sum()))
    model, weight = Votes(prior, start.copy()), belief * total
    for _ in range(rounds):
        p = model.posterior(patterns)
        table = start * weight
        for c, share in ((0, counts * (1 - p)), (1, counts * p)):
            for r in range(rules):
                table[c, r] += np.bincount(patterns[:, r], weights=share, minlength=3)[:2]
        table /= table.sum(axis=2, keepdims=True)
        good = float(np.clip((counts @ p + prior * weight) / (total + weight), 1e-3, 1 - 1e-3))
        done = abs(good - model.good) < 1e-9 and np.abs(table - model.table).max() < 1e-9
        model = Votes(good, table)
        if done:
            break
    return model


def _fitted(counts: DataFrame, rules: list[Rule]) -> tuple[Column, DataFrame]:
    """The votes on a row of counts as one number; and p_good of each such pattern, at most 3**len(rules) rows."""
    pattern = sum((r.vote() * 3**i for i, r in enumerate(rules)), F.lit(0)).cast("int")
    table = counts.groupBy(pattern.alias("pattern")).count().collect()
    codes = np.array([x[0] for x in table], dtype=np.int64)
    votes = codes[:, None] // 3 ** np.arange(len(rules)) % 3 if len(codes) else np.zeros((0, len(rules)), np.int64)
    model = fit(votes, np.array([x[1] for x in table], dtype=float))
    return pattern, counts.sparkSession.createDataFrame([(int(c), float(p)) for c, p in zip(codes, model.posterior(votes), strict=True)], "pattern int, p_good double")


def _judged(counts: DataFrame, pattern: Column, scores: DataFrame, threshold: float) -> DataFrame:
    """Rows with counts, with base_failed, p_good and kept as well."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = counts.withColumn("pattern", pattern).join(F.broadcast(scores), "pattern", "left").withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, p_good and kept.

    ``base_failed`` marks texts of under 20 words and those of which more than 30 % of the words
    stand in repeated windows; they are never kept.  The others stay when ``p_good``, the
    posterior of the votes, is at least ``threshold``.  Lines and windows are compared by content.
    Null ids stay null; empty and null texts fail the base; texts of any length are read whole;
    repeated rows get equal results each; other columns are not read, whatever their names; an
    empty table gives an empty result.
    """
    counts = materialise(text_counts(docs, id_col, text_col))
    out = _judged(counts, *_fitted(counts, rules or standard_rules()), threshold)
    return out.select("doc_id", *COUNTS, "base_failed", "p_good", "kept")


def with_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows of ``docs``, its columns by number (c0, c1, ..), with the counts of their texts."""
    at = docs.columns.index(text_col)
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.text_arrays(batch.column(batch.num_columns - 1))
            for i, j, part, cut in K.slices(data, off):
                columns = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)] + [pa.array(x.astype(np.int64)) for x in count_slice(part, cut)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *COUNTS])

    schema = T.StructType(named.schema.fields + [T.StructField(c, T.LongType()) for c in COUNTS])
    return named.withColumn("_text", F.col(f"c{at}").cast("string")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model keeps, with all their columns; each row is judged by its own text.

    Texts are counted twice, for the model and for the verdicts, and never moved.
    """
    pattern, scores = _fitted(text_counts(docs, id_col, text_col), standard_rules())
    out = _judged(with_counts(docs, text_col), pattern, scores, threshold).filter("kept")
    return out.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
