"""Plans to DataFrames.

Each node becomes the declarative DataFrame operation it names, and nothing is scheduled here:
Catalyst pushes filters and columns into the scans, turns a filtered cross product into an equi
or theta join, orders joins and picks their strategy at run time.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import condition, quoted
from ..sources.catalog import Catalog
from .ir import Cross, Filter, Node, PlanError, Project, Query, Scan, Sort


def literal_text(name: str) -> str:
    """The text of a projected literal: the name, without a pair of outer quotes."""
    if len(name) >= 2 and name[0] == name[-1] and name[0] in "'\"":
        return name[1:-1]
    return name


def distinct_names(names: list[str]) -> None:
    # Spark resolves names without regard to case, so names that differ only in case clash as well
    twice = [n for n, k in Counter(n.lower() for n in names).items() if k > 1]
    if twice:
        raise PlanError(f"duplicate column names: {sorted(twice)}; rename them with a projection first")


def compile_node(node: Node, catalog: Catalog, ieee: bool = True) -> DataFrame:
    match node:
        case Scan(table):
            return catalog.table(table)
        case Filter(predicates, child):
            df = compile_node(child, catalog, ieee)
            conditions = [condition(df.schema, p, ieee) for p in predicates]
            return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df
        case Project(columns, child):
            df = compile_node(child, catalog, ieee)
            distinct_names([to for _, to in columns])
            have = set(df.columns)
            return df.select(*[(quoted(source) if source in have else F.lit(literal_text(source))).alias(to) for source, to in columns])
        case Cross(left, right):
            a, b = compile_node(left, catalog, ieee), compile_node(right, catalog, ieee)
            distinct_names([*a.columns, *b.columns])
            return a.crossJoin(b)
        case Sort(keys, child):
            df = compile_node(child, catalog, ieee)
            for k in keys:
                if k.column not in df.columns:
                    raise PlanError(f"unknown sort column {k.column!r}; there are {df.columns}")
            return df.orderBy(*[quoted(k.column).asc() if k.ascending else quoted(k.column).desc() for k in keys]) if keys else df
    raise PlanError(f"not an operator: {node!r}")


def compile_query(query: Query, catalog: Catalog, ieee: bool = True) -> DataFrame:
    return compile_node(query.root, catalog, ieee)
