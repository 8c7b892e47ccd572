"""Comparison semantics: predicates as Spark conditions.

Same types compare natively, mixed numbers as doubles (integers of two widths exactly), and a
string never compares with a number: such a predicate is false, inequality included.  Floats
follow IEEE: nothing is equal to or ordered with NaN, and everything differs from it; Spark's own
operators treat NaN as the largest number, equal to itself, so the conditions guard against it.
The plain comparison stays a conjunct of its own and so is still pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ir import Op, PlanError, Predicate

FLOATS = (T.FloatType, T.DoubleType)
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = FLOATS + INTEGERS + (T.DecimalType,)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)

LITERALS = {"I32": T.IntegerType(), "I64": T.LongType(), "F32": T.FloatType(), "F64": T.DoubleType(), "String": T.StringType()}


def quoted(name: str) -> Column:
    """A column by its literal name; names may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def compare(op: Op, left: Column, right: Column) -> Column:
    match op:
        case Op.EQ:
            return left == right
        case Op.NE:
            return left != right
        case Op.GT:
            return left > right
        case Op.GTE:
            return left >= right
        case Op.LT:
            return left < right
        case Op.LTE:
            return left <= right


def condition(schema: T.StructType, p: Predicate, ieee: bool = True) -> Column:
    """The predicate over rows of ``schema``; raises PlanError on a column that is not there."""
    types = {f.name: f.dataType for f in schema.fields}
    if p.column not in types:
        raise PlanError(f"unknown column {p.column!r}; there are {sorted(types)}")
    left, kind = quoted(p.column), types[p.column]
    if p.value.kind == "Column":
        if p.value.value not in types:
            raise PlanError(f"unknown column {p.value.value!r}; there are {sorted(types)}")
        right, other, constant = quoted(p.value.value), types[p.value.value], False
    else:
        other, constant = LITERALS[p.value.kind], True
        if isinstance(kind, TIMES) and isinstance(other, T.StringType):
            other = kind  # ISO text against a date or time: a typed literal
        right = F.lit(p.value.value).cast(other)
    if _family(kind) != _family(other):
        return F.lit(False)
    floats = [c for c, t in ((left, kind), (right, other)) if isinstance(t, FLOATS)]
    if floats and type(kind) is not type(other):
        left, right = left.cast("double"), right.cast("double")
    plain = compare(p.op, left, right)
    if not ieee or not floats:
        return plain
    return _guarded(p.op, plain, left, kind, right, other, constant, p.value.value)


def _guarded(op: Op, plain: Column, left: Column, kind: T.DataType, right: Column, other: T.DataType, constant: bool, value: object) -> Column:
    """``plain`` with Spark's view of NaN taken back, where a NaN can make a difference."""
    left_nan = isinstance(kind, FLOATS)
    right_nan = isinstance(other, FLOATS) and not (constant and value == value)
    if constant and value != value:  # a NaN literal: nothing but inequality holds
        return left.isNotNull() if op is Op.NE else F.lit(False)
    if op is Op.NE:
        return plain | (F.isnan(left) & F.isnan(right)) if left_nan and right_nan else plain
    if op is Op.EQ:
        return plain & ~F.isnan(left) if left_nan and right_nan else plain
    # Spark's NaN is larger than everything: the side that is asked to be larger must not be one
    has_nan, side = (left_nan, left) if op in (Op.GT, Op.GTE) else (right_nan, right)
    return plain & ~F.isnan(side) if has_nan else plain


def _family(kind: T.DataType) -> str:
    if isinstance(kind, NUMBERS):
        return "number"
    if isinstance(kind, TIMES):
        return "time"
    return kind.typeName()
