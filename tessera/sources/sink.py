"""Result sink: each value followed by a pipe, one row a line, no header; and the framed protocol."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formatting import format_float, format_value


def text_lines(df: DataFrame) -> Iterator[str]:
    """Lines of the result in its order; partitions are fetched one at a time."""
    single = [isinstance(f.dataType, T.FloatType) for f in df.schema.fields]
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield "".join(format_value(x, s) + "|" for x, s in zip(row, single, strict=True))


def framed(df: DataFrame) -> Iterator[str]:
    """The lines between the words that open and close a result."""
    yield "validate"
    yield from text_lines(df)
    yield "!"


def write_text(df: DataFrame, path: str) -> None:
    """Distributed: a folder of part files.  Floats keep their shortest form, with a decimal point."""
    shown = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            shown.append(_float_text(c, isinstance(f.dataType, T.FloatType)))
        else:
            shown.append(F.coalesce(c.cast("string"), F.lit("")))
    df.select(F.concat(F.concat_ws("|", *shown), F.lit("|")).alias("value")).write.mode("overwrite").text(path)


def _float_text(c: Column, single: bool) -> Column:
    @F.pandas_udf("string")
    def show(values: pd.Series) -> pd.Series:
        return values.map(lambda x: format_float(x, single))

    return F.when(c.isNull(), F.lit("")).when(F.isnan(c), F.lit("NaN")).otherwise(show(c))
