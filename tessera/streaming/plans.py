"""Plans over streams.

Scan, filter and project compile to the same operations on a stream as on a table, so a plan of
these runs unchanged; products with tables become stream-static joins.  Sorts, and products of two
streams without an equality, have no meaning on an unbounded input and are refused by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.compiler import compile_query
from ..plans.ir import Cross, Filter, Node, PlanError, Project, Query, Scan, Sort
from ..sources.catalog import Catalog


def scans(node: Node) -> list[str]:
    match node:
        case Scan(table):
            return [table]
        case Cross(left, right):
            return scans(left) + scans(right)
        case Filter(_, child) | Project(_, child) | Sort(_, child):
            return scans(child)
    raise TypeError(node)


def _sorts(node: Node) -> bool:
    match node:
        case Sort():
            return True
        case Cross(left, right):
            return _sorts(left) or _sorts(right)
        case Filter(_, child) | Project(_, child):
            return _sorts(child)
    return False


def parquet_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def compile_stream(query: Query, catalog: Catalog) -> DataFrame:
    """The plan over a catalog in which some tables are streams."""
    df = compile_query(query, catalog) if not _sorts(query.root) else None
    if df is None:
        raise PlanError("a stream cannot be sorted")
    if not df.isStreaming:
        raise PlanError(f"none of {scans(query.root)} is a stream")
    return df


def start(query: Query, catalog: Catalog, name: str, checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Run the plan into an in-memory table ``name``."""
    writer = compile_stream(query, catalog).writeStream.format("memory").queryName(name).outputMode("append")
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
