"""Column profiles: rows, range, distinct values, density, sortedness, equi-depth histogram, sample."""

from __future__ import annotations

import json
import struct
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cost import ColumnStats
from ..functions.predicates import NUMBERS, quoted
from ..plans.ir import Op, Predicate
from .ordered import running_total, with_previous

#: Exact counting up to this many distinct values; rows of a sample; buckets; and
#: distinct values up to which text columns get a histogram.
EXACT_DISTINCT = 10_000
SAMPLE_ROWS = 10_000
BUCKETS = 10
TEXT_DISTINCT = 50
#: Standard error of 4096 registers.
ERROR = 0.016


def numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NUMBERS)


def column_summary(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """One row: rows, lo, hi, ndv, density; lo and hi only mean something for numbers."""
    c = quoted(column)
    ndv = F.count_distinct(c) if exact else F.approx_count_distinct(c, ERROR)
    rows = F.count(F.lit(1))
    return df.agg(rows.alias("rows"), F.min(c).alias("lo"), F.max(c).alias("hi"), ndv.alias("ndv")).withColumn("density", F.least(F.lit(1.0), F.col("ndv").cast("double") / F.col("rows")).cast("float"))


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = False) -> dict[str, int]:
    """Exact up to EXACT_DISTINCT values, estimated beyond; with ``exact``, exact however many there are.

    All estimates come from one pass; only columns whose estimate leaves exactness open are
    counted again, each as a distinct aggregation of its own that combines before its shuffle.
    """
    if not columns:
        return {}
    count = lambda c: df.select(quoted(c).alias("v")).where("v is not null").distinct().count()
    if exact:
        return {c: count(c) for c in columns}
    row = df.agg(*[F.approx_count_distinct(quoted(c), ERROR).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    out = {c: int(row[i]) for i, c in enumerate(columns)}
    few = [c for c in columns if out[c] <= EXACT_DISTINCT * (1 + 5 * ERROR)]
    for c in few:
        n = count(c)
        out[c] = n if n <= EXACT_DISTINCT else out[c]
    return out


def is_ordered(df: DataFrame, column: str, order: str) -> DataFrame:
    """One row, is_ordered: does ``column`` never fall along the integer column ``order``?"""
    rows = with_previous(df.select(quoted(order).alias("o"), quoted(column).alias("v")), "o", ["v"], tie=[F.col("v")])
    return rows.agg(F.coalesce(F.bool_and(F.col("prev_v").isNull() | (F.col("prev_v") <= F.col("v"))), F.lit(True)).alias("is_ordered"))


def reservoir(df: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """A uniform sample of at most ``rows`` rows: those with the smallest random numbers."""
    return df.withColumn("_draw", F.rand(seed)).orderBy("_draw").limit(rows).drop("_draw")


def histogram(df: DataFrame, column: str, buckets: int = BUCKETS, sample: int | None = SAMPLE_ROWS) -> DataFrame:
    """bucket, lo, hi, freq of an equi-depth histogram over a sample, scaled to all rows.

    With ``sample`` None, or no more rows than that, the histogram is exact.  The ranking sees the
    sample only, so its single task is bounded.  Without a sample, values are counted first and
    the ranking runs over distinct values, stretch by stretch.
    """
    values = df.select(quoted(column).alias("v")).where("v is not null")
    if sample is not None:
        held = reservoir(values, sample)
        ranked = held.withColumn("rn", F.row_number().over(W.orderBy("v"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))))
        total = values.agg(F.count(F.lit(1)).alias("total"))
        chunk = F.ceil(F.col("n").cast("double") / F.least(F.lit(buckets), F.col("n")))
        ranked = ranked.withColumn("bucket", F.floor((F.col("rn") - 1) / chunk).cast("int"))
        out = ranked.groupBy("bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
        return out.crossJoin(F.broadcast(total)).select("bucket", "lo", "hi", F.floor(F.col("k") * F.col("total") / F.col("n")).cast("long").alias("freq"))
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    if numeric(df, column):
        ranked = running_total(counts, "v", "k", "upto")
    else:  # text columns have a histogram only if their distinct values are few
        ranked = counts.withColumn("upto", F.sum("k").over(W.partitionBy(F.lit(0)).orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    ranked = ranked.crossJoin(F.broadcast(values.agg(F.count(F.lit(1)).alias("n"))))
    chunk = F.ceil(F.col("n").cast("double") / F.least(F.lit(buckets), F.col("n")))
    first, last = F.floor((F.col("upto") - F.col("k")) / chunk), F.floor((F.col("upto") - 1) / chunk)
    spread = ranked.withColumn("chunk", chunk.cast("long")).withColumn("bucket", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    inside = F.least(F.col("upto"), (F.col("bucket") + 1) * F.col("chunk")) - F.greatest(F.col("upto") - F.col("k"), F.col("bucket") * F.col("chunk"))
    return spread.groupBy("bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(inside).cast("long").alias("freq"))


def profile(df: DataFrame, order: str | None = None, exact: bool = False) -> dict[str, list]:
    """Statistics of every column, in the saved catalog's form; empty lists for an empty table.

    With ``exact``, distinct values are counted, however many there are; histograms stay as they are.
    """
    columns = df.columns
    first = df.agg(F.count(F.lit(1)).alias("rows"), *[f(quoted(c)).alias(f"{n}{i}") for i, c in enumerate(columns) if numeric(df, c) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    rows = first["rows"]
    if rows == 0:
        return {c: [] for c in columns}
    distinct = distinct_counts(df, columns, exact)
    out: dict[str, list] = {}
    for i, c in enumerate(columns):
        stats: list = []
        kind = df.schema[c].dataType
        if order is not None and is_ordered(df, c, order).first()[0]:
            stats.append("IsPhysicallyOrdered")
        tag = {T.IntegerType: "Int32", T.LongType: "Int64", T.FloatType: "Float32", T.DoubleType: "Float64"}.get(type(kind))
        if tag and first[f"lo{i}"] is not None:
            stats.append({"RangeStat": {"lower_bound": {tag: first[f"lo{i}"]}, "upper_bound": {tag: first[f"hi{i}"]}}})
        stats.append({"CardinalityStat": distinct[c]})
        stats.append({"DensityStat": struct.unpack("f", struct.pack("f", min(1.0, distinct[c] / rows)))[0]})
        if tag or (isinstance(kind, T.StringType) and distinct[c] <= TEXT_DISTINCT):
            tag = tag or "String"
            points = [[{"lower_bound": {tag: r["lo"]}, "upper_bound": {tag: r["hi"]}}, r["freq"]] for r in histogram(df, c).orderBy("bucket").collect()]
            stats.append({"HistogramStat": {"frequency_points": points}})
        out[c] = stats
    return out


def quick_stats(df: DataFrame, predicates: Sequence[Predicate] | None = None) -> dict[str, ColumnStats]:
    """What the estimates read of a table, in one pass: rows, ranges, and distinct values by sketches; nothing for an empty table.

    With ``predicates``, no more than these need: distinct values of the columns that they hold
    equal or unequal, ranges of those that they compare otherwise, and always the number of rows.
    """
    exact = {Op.EQ, Op.NE}
    named = lambda ops: {c for p in predicates or () if p.op in ops for c in (p.column, p.value.value if p.value.kind == "Column" else None)}
    equal, ranged = (set(df.columns),) * 2 if predicates is None else (named(exact), named(set(Op) - exact))
    wanted = [(c, i, c in equal, c in ranged and numeric(df, c)) for i, c in enumerate(df.columns) if c in equal | ranged]
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.approx_count_distinct(quoted(c), ERROR).alias(f"n{i}") for c, i, counted, _ in wanted if counted],
        *[f(quoted(c)).alias(f"{n}{i}") for c, i, _, number in wanted if number for n, f in (("lo", F.min), ("hi", F.max))],
    ).first()
    rows = row["rows"]
    if rows == 0:
        return {}
    found = {c: (*((row[f"lo{i}"], row[f"hi{i}"]) if number else (None, None)), *((row[f"n{i}"], min(1.0, row[f"n{i}"] / rows)) if counted else (None, None))) for c, i, counted, number in wanted}
    return {c: ColumnStats(*found.get(c, ()), rows=rows) for c in (found or df.columns[:1])}


def estimator_stats(profiled: dict[str, list]) -> dict[str, ColumnStats]:
    """What the estimates read, out of a table's saved statistics."""
    out = {}
    for column, stats in profiled.items():
        found: dict = {}
        for s in stats:
            if isinstance(s, dict):
                if "RangeStat" in s:
                    (found["low"],), (found["high"],) = s["RangeStat"]["lower_bound"].values(), s["RangeStat"]["upper_bound"].values()
                elif "CardinalityStat" in s:
                    found["distinct"] = s["CardinalityStat"]
                elif "DensityStat" in s:
                    found["density"] = s["DensityStat"]
        out[column] = ColumnStats(**found)
    return out


def to_json(profiled: dict[str, list]) -> str:
    return json.dumps(profiled)
