"""The query algebra: five operators over named columns, and its JSON form.

JSON follows the externally tagged style: an operator is an object with one key, its name; a
predicate's value is an object with one key, its type.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from enum import Enum


class PlanError(ValueError):
    """A plan that has no meaning: unknown column, duplicate name, malformed JSON."""


class Op(str, Enum):
    EQ = "EQ"
    NE = "NE"
    GT = "GT"
    GTE = "GTE"
    LT = "LT"
    LTE = "LTE"


#: Kinds of values a predicate compares a column with; Column names another column.
VALUE_KINDS = ("Column", "I32", "I64", "F32", "F64", "String")


@dataclass(frozen=True)
class Value:
    kind: str
    value: str | int | float

    def __post_init__(self) -> None:
        if self.kind not in VALUE_KINDS:
            raise PlanError(f"unknown kind of value: {self.kind}")
        want = {"Column": str, "String": str, "I32": int, "I64": int, "F32": (int, float), "F64": (int, float)}[self.kind]
        if not isinstance(self.value, want) or isinstance(self.value, bool):
            raise PlanError(f"{self.kind} does not hold {self.value!r}")
        if self.kind in ("I32", "I64"):
            bits = 31 if self.kind == "I32" else 63
            if not -(1 << bits) <= self.value < 1 << bits:
                raise PlanError(f"{self.value} does not fit {self.kind}")


@dataclass(frozen=True)
class Predicate:
    column: str
    op: Op
    value: Value


@dataclass(frozen=True)
class SortKey:
    column: str
    ascending: bool = True


@dataclass(frozen=True)
class Scan:
    table: str


@dataclass(frozen=True)
class Filter:
    predicates: tuple[Predicate, ...]
    child: Node


@dataclass(frozen=True)
class Project:
    columns: tuple[tuple[str, str], ...]  # (from, to)
    child: Node


@dataclass(frozen=True)
class Cross:
    left: Node
    right: Node


@dataclass(frozen=True)
class Sort:
    keys: tuple[SortKey, ...]
    child: Node


Node = Scan | Filter | Project | Cross | Sort


@dataclass(frozen=True)
class Query:
    root: Node

    def to_json(self) -> str:
        return json.dumps({"root": encode(self.root)}, separators=(",", ":"))

    @staticmethod
    def from_json(text: str) -> Query:
        try:
            return Query(decode(json.loads(text)["root"]))
        except (KeyError, TypeError, json.JSONDecodeError) as e:
            raise PlanError(f"not a query: {e!r}") from e


def encode(node: Node) -> dict:
    match node:
        case Scan(table):
            return {"Scan": {"table_id": table}}
        case Filter(predicates, child):
            return {"Filter": {"predicates": [{"column_name": p.column, "operator": p.op.value, "value": {p.value.kind: p.value.value}} for p in predicates], "underlying": encode(child)}}
        case Project(columns, child):
            return {"Project": {"column_name_map": [list(c) for c in columns], "underlying": encode(child)}}
        case Cross(left, right):
            return {"Cross": {"left": encode(left), "right": encode(right)}}
        case Sort(keys, child):
            return {"Sort": {"sort_specs": [{"column_name": k.column, "ascending": k.ascending} for k in keys], "underlying": encode(child)}}
    raise PlanError(f"not an operator: {node!r}")


def decode(data: dict) -> Node:
    if not isinstance(data, dict) or len(data) != 1:
        raise PlanError(f"an operator is an object with one key: {data!r}")
    ((name, body),) = data.items()
    match name:
        case "Scan":
            return Scan(body["table_id"])
        case "Filter":
            return Filter(tuple(_predicate(p) for p in body["predicates"]), decode(body["underlying"]))
        case "Project":
            return Project(tuple((a, b) for a, b in body["column_name_map"]), decode(body["underlying"]))
        case "Cross":
            return Cross(decode(body["left"]), decode(body["right"]))
        case "Sort":
            return Sort(tuple(SortKey(k["column_name"], bool(k["ascending"])) for k in body["sort_specs"]), decode(body["underlying"]))
    raise PlanError(f"unknown operator: {name}")


def _predicate(data: dict) -> Predicate:
    ((kind, value),) = data["value"].items()
    try:
        op = Op(data["operator"])
    except ValueError as e:
        raise PlanError(str(e)) from e
    return Predicate(data["column_name"], op, Value(kind, value))
