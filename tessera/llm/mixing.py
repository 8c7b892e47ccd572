"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words.  A document is first taken whole as often as the
ratio of target to source size says in full; what is missing is a sample.  Each document has an
inclusion probability p that grows with its importance, and a random number u, fixed by its id;
documents whose probability would pass 1 are certain, and the others are taken in the order of
(u / (1 - u)) / (p / (1 - p)), random odds over inclusion odds, until the words missing are
reached: a sample of fixed size in words with unequal probabilities.  A document that is too long
for what is missing at its turn is passed over, and those behind it that fit fill the gap.

Running sums along the order are taken over cells of two levels, so no task ever sees more than a
cell's documents or a level's cells, however large the source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import WORD, materialise, row_key, small

#: Cells of each of the two levels of an order.
CELLS = 256
#: Classes of importance in a doubling of it.
CLASSES = 8
WEIGHTS = (3.0, 1.0, 2.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> the same with ``weight`` and ``target``.

    Sources in code-point order, null last, take ``weights`` in turn.  ``share`` times all words
    are dealt out by weight; a target stops at ``most`` times its source, and what it leaves goes
    to the others by weight.  With sources ordered by cap over weight those that stop come first,
    so one pass of running sums finds the level.  The table has one row per source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(turn, ((rank - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", most * F.col("source_size"))
    by = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy(F.lit(0))
    total = share * F.sum("source_size").over(everything)
    rows = rows.withColumn("level", (total - before) / rest)
    level = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("l")))).over(everything)["l"]
    rows = rows.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", "weight", target.cast("double").alias("target"))


def uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) fixed by the columns' values."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, importance: Column | None = None, seed: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``importance``, a positive column of ``docs``, makes inclusion probabilities within a source
    proportional to it; without it, to the square root of a document's size.  Null text has size
    0; null sources are one source of their own; repeated rows are documents of their own, with
    neighbouring ranks; documents of size 0 are taken 0 words.  Sources with no words have target
    0.  No row is taken more than ``most`` times.  Texts of any length are read whole; other
    columns are not read, whatever their names; an empty table gives an empty result.  The same
    rows give the same mix however they are partitioned.
    """
    drawn = _drawn(docs, id_col, text_col, source_col, weights, share, most, importance, seed, F.lit(0))
    return drawn.drop("mark")


def _plan(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row per source: _source, source_size, target, whole, missing, and of its sample: cut, the class from which on documents are certain, and rate, what p is of importance."""
    kind = F.floor(F.log2("importance") * CLASSES).cast("int")
    sums = materialise(rows.groupBy("source", kind.alias("kind")).agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("importance")).alias("weighted"), F.max("importance").alias("top")))
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("missing", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = materialise(plan.select(F.col("source").alias("_source"), "source_size", "target", "whole", "missing"))
    # classes of importance from the top: those above the first whose rate leaves all of it at p <= 1 are certain
    levels = sums.filter("words > 0").join(small(plan.select(F.col("_source").alias("_s"), "missing")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    down = W.partitionBy("source").orderBy(F.col("kind").desc())
    levels = levels.withColumn("above", F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    levels = levels.withColumn("rate", (F.col("missing") - F.col("above")) / F.sum("weighted").over(down.rowsBetween(0, W.unboundedFollowing)))
    fits = (F.col("rate") * F.col("top") <= 1) | (F.col("above") + F.col("words") >= F.col("missing"))
    levels = levels.filter(fits).groupBy("source").agg(F.max_by(F.struct(F.col("kind").alias("cut"), "rate"), "kind").alias("_at")).select(F.col("source").alias("_s"), "_at.*")
    return plan.join(levels, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")


def _ahead(rows: DataFrame) -> DataFrame:
    """``rows`` (source, place in [0, 1), rank, doc_id, size, mark, ..) with ``start``, the words before each in its source's order."""
    at = F.col("place") * CELLS
    rows = rows.withColumn("c1", F.least(F.floor(at), F.lit(CELLS - 1)).cast("int"))
    rows = rows.withColumn("c2", F.least(F.floor((at - F.col("c1")) * CELLS), F.lit(CELLS - 1)).cast("int"))
    fine = rows.groupBy("source", "c1", "c2").agg(F.sum("size").alias("words"))
    coarse = fine.groupBy("source", "c1").agg(F.sum("words").alias("words"))
    ahead = lambda part, order: F.coalesce(F.sum("words").over(W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select(F.col("source").alias("_s"), F.col("c1").alias("_c"), ahead(["source"], "c1").alias("before1"))
    fine = fine.withColumn("before2", ahead(["source", "c1"], "c2"))
    fine = fine.join(coarse, F.col("source").eqNullSafe(F.col("_s")) & (F.col("c1") == F.col("_c")))
    fine = fine.select(F.col("source").alias("_s"), F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), (F.col("before1") + F.col("before2")).alias("before"))
    inner = W.partitionBy("source", "c1", "c2").orderBy("rank", "doc_id", "size", "mark").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(fine, F.col("source").eqNullSafe(F.col("_s")) & (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2")))
    return rows.withColumn("start", F.col("before") + F.col("inner")).drop("c1", "c2", "inner", "before", "_s", "_c1", "_c2")


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float, importance: Column | None, seed: int, mark: Column) -> DataFrame:
    """The mix with a column ``mark`` of ``docs`` that names its rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), (F.lit(None) if importance is None else importance).cast("double").alias("importance"), mark.alias("mark"))
    rows = materialise(rows.withColumn("importance", F.coalesce("importance", F.sqrt(F.col("size").cast("double")))))
    plan = _plan(rows, weights, share, most)
    drawn = rows.join(small(plan), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    kind = F.floor(F.log2("importance") * CLASSES).cast("int")
    # words count towards the sample in three ways: certain, drawn in order, or not at all
    drawn = drawn.withColumn("way", F.when((F.col("missing") <= 0) | (F.col("size") == 0) | F.col("cut").isNull(), 0).when(kind > F.col("cut"), 2).otherwise(1))
    p = F.least(F.col("importance") * F.col("rate"), F.lit(1 - 1e-6))
    u = uniform(seed, F.col("doc_id"))
    odds = F.when(p > 0, (u / (1 - u)) / (p / (1 - p))).otherwise(float("inf"))
    # documents of the source's mean probability stand at their u, so that cells are even
    mean = F.least(F.greatest(F.col("missing") / F.col("source_size"), F.lit(1e-9)), F.lit(1 - 1e-6))
    even = odds * (mean / (1 - mean))
    place = F.when(even < 1e15, even / (1 + even)).otherwise(u)
    order = drawn.filter("way = 1").withColumn("rank", odds).withColumn("place", place)
    sure = drawn.filter("way = 2").groupBy("source").agg(F.sum("size").alias("sure")).select(F.col("source").alias("_s"), "sure")
    order = order.join(small(materialise(sure)), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("open", F.col("missing") - F.coalesce("sure", F.lit(0)))
    first = 2 * (F.col("open") - F.col("start")) >= F.col("size")  # the last one counts if it brings the sum nearer
    order = materialise(_ahead(order).withColumn("extra", F.when(first, 1).otherwise(0)).drop("start"))
    # what is left of a source's words where a long document was passed over goes to those behind it that fit
    left = order.groupBy("source").agg((F.max("open") - F.sum(F.col("extra") * F.col("size"))).alias("gap")).filter("gap > 0").select(F.col("source").alias("_s"), "gap")
    order = order.join(small(materialise(left)), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    fill = (F.col("extra") == 0) & (F.col("size") <= F.col("gap"))
    filled = _ahead(order.filter(fill)).withColumn("extra", F.when(F.col("start") + F.col("size") <= F.col("gap"), 1).otherwise(0)).drop("start")
    names = ["doc_id", "source", "size", "source_size", "target", "whole", "extra", "mark"]
    out = drawn.filter("way <> 1").withColumn("extra", F.when(F.col("way") == 2, 1).otherwise(0)).select(names)
    out = out.unionAll(order.filter(~F.coalesce(fill, F.lit(False))).select(names)).unionAll(filled.select(names))
    copies = F.least(F.col("whole") + F.col("extra"), F.lit(int(most))).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "mark")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, importance: Column | None = None, seed: int = 20) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Rows that share an id, or have none, are taken each by their own text and source; the copies
    of rows that repeat all three are dealt out among them.
    """
    key = row_key(F.col(text_col), F.col(id_col), F.col(source_col))
    copies = _drawn(docs, id_col, text_col, source_col, weights, share, most, importance, seed, key)
    copies = copies.groupBy(F.col("mark").alias("_tessera_key")).agg(F.count(F.lit(1)).alias("_tessera_rows"), F.sum("copies").alias("_tessera_copies")).filter("_tessera_copies > 0")
    out = docs.withColumn("_tessera_key", key).join(copies, "_tessera_key")
    nth = F.row_number().over(W.partitionBy("_tessera_key").orderBy("_tessera_key"))
    rows, total = F.col("_tessera_rows"), F.col("_tessera_copies")
    own = F.floor(total / rows) + F.when(nth <= total % rows, 1).otherwise(0)
    out = out.withColumn("_tessera_own", own.cast("int")).filter("_tessera_own > 0")
    out = out.withColumn("_tessera_nth", F.explode(F.sequence(F.lit(1), F.col("_tessera_own"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
