"""Orders over whole tables, without sorting everything in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a stretch, about; and the most stretches that an order is cut into.
STRETCH, PARTS = 1 << 16, 4096


def stretches(df: DataFrame, order: str, name: str, stretch: int = STRETCH) -> DataFrame:
    """``df`` with an integer column ``name`` that never falls along the numeric column ``order``.

    Stretches hold about as many rows each, wherever the values crowd: their bounds are quantiles.
    Values that are equal share a stretch.  There are at most PARTS.
    """
    rows = df.agg(F.count(order)).first()[0]
    parts = min(PARTS, -(-rows // stretch))
    bounds: list[float] = []
    if parts > 1:
        value = df.select(F.col(order).cast("double").alias("v"))
        bounds = sorted(set(value.approxQuantile("v", [i / parts for i in range(1, parts)], 1 / (4 * parts))))
    if not bounds:
        return df.withColumn(name, F.lit(0))
    held = df.withColumn("_order", F.col(order).cast("double"))
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_order", outputCol=name, handleInvalid="keep")
    return cut.transform(held).withColumn(name, F.col(name).cast("int")).drop("_order")


def with_previous(df: DataFrame, order: str, columns: list[str], stretch: int = STRETCH, tie: list[Column] | None = None) -> DataFrame:
    """``df`` with a column ``prev_c`` for each column c: its value in the row before, null in the first row.

    ``order`` is an integer column.  Rows are dealt out by stretches of it; inside a stretch the
    row before is a plain lag, and only the first row of each stretch looks it up among the last
    rows of the stretches, a table of at most PARTS rows.
    """
    rows = stretches(df, order, "_part", stretch)
    keys = [F.col(order), *(tie or [])]
    inner = W.partitionBy("_part").orderBy(*keys)
    held = F.struct(*[F.col(c) for c in columns])
    rank = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    last = rows.groupBy("_part").agg(F.max_by(held, rank).alias("_last"))
    carry = last.select(F.col("_part"), F.lag("_last").over(W.partitionBy(F.lit(0)).orderBy("_part")).alias("_carry"))
    rows = rows.withColumn("_before", F.lag(held).over(inner)).withColumn("_first", F.row_number().over(inner) == 1)
    rows = rows.join(F.broadcast(carry), "_part", "left")
    before = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_before"))
    return rows.select(*[F.col(c) for c in df.columns], *[before[c].alias(f"prev_{c}") for c in columns])


def running_total(df: DataFrame, order: str, amount: str, name: str, stretch: int = STRETCH) -> DataFrame:
    """``df`` with the running total of ``amount`` along the numeric column ``order``, whose values are distinct."""
    rows = stretches(df, order, "_part", stretch)
    sums = rows.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    ahead = F.coalesce(F.sum("_sum").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(F.broadcast(sums.select("_part", ahead.alias("_ahead"))), "_part")
    inner = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.col("_ahead") + F.sum(amount).over(inner)).drop("_part", "_ahead")
