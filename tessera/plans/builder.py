"""Fluent construction of plans: ``scan("orders").filter("o_totalprice", "GT", f64(1e5)).project("o_orderkey", "id").build()``."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from .ir import Cross, Filter, Node, Op, Predicate, Project, Query, Scan, Sort, SortKey, Value


def col(name: str) -> Value:
    return Value("Column", name)


def i32(x: int) -> Value:
    return Value("I32", x)


def i64(x: int) -> Value:
    return Value("I64", x)


def f32(x: float) -> Value:
    return Value("F32", float(x))


def f64(x: float) -> Value:
    return Value("F64", float(x))


def string(x: str) -> Value:
    return Value("String", x)


def literal(x: Value | str | int | float) -> Value:
    """A Python value as the narrowest value that holds it; strings are strings, not columns."""
    if isinstance(x, Value):
        return x
    if isinstance(x, str):
        return string(x)
    if isinstance(x, int):
        return i32(x) if -(1 << 31) <= x < 1 << 31 else i64(x)
    return f64(x)


def predicate(column: str, op: Op | str, value: Value | str | int | float) -> Predicate:
    return Predicate(column, Op(op), literal(value))


@dataclass(frozen=True)
class Plan:
    """A node with methods that put another one on top; plans are immutable."""

    node: Node

    def filter(self, column: str, op: Op | str, value: Value | str | int | float) -> Plan:
        return self.filter_multiple([(column, op, value)])

    def filter_multiple(self, predicates: Iterable[tuple]) -> Plan:
        """All of the predicates must hold; none at all keeps every row."""
        return Plan(Filter(tuple(predicate(*p) for p in predicates), self.node))

    def cross(self, right: Plan) -> Plan:
        return Plan(Cross(self.node, right.node))

    def sort(self, column: str, ascending: bool = True) -> Plan:
        return self.sort_multiple([(column, ascending)])

    def sort_multiple(self, keys: Iterable[tuple[str, bool]]) -> Plan:
        return Plan(Sort(tuple(SortKey(c, a) for c, a in keys), self.node))

    def project(self, source: str, to: str) -> Plan:
        return self.project_multiple([(source, to)])

    def project_multiple(self, columns: Iterable[tuple[str, str]]) -> Plan:
        return Plan(Project(tuple(columns), self.node))

    def build(self) -> Query:
        return Query(self.node)


def scan(table: str) -> Plan:
    return Plan(Scan(table))
