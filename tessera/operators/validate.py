"""Comparing results: ordered and unordered, as text lines or as DataFrames; and suites of queries."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ir import Query

END = "!"


@dataclass(frozen=True)
class Verdict:
    ok: bool
    reason: str = ""

    def __bool__(self) -> bool:
        return self.ok


def _lines(lines: Iterable[str]) -> tuple[list[str], bool]:
    out = []
    for line in lines:
        line = line.strip()
        if line == END:
            return out, True
        out.append(line)
    return out, False


def validate_ordered(got: Iterable[str], expected: Iterable[str]) -> Verdict:
    """Line by line; the result must end with the end mark."""
    lines, ended = _lines(got)
    if not ended:
        return Verdict(False, "the result has no end")
    wanted = [x.strip() for x in expected]
    for i, (a, b) in enumerate(zip(lines, wanted, strict=False)):
        if a != b:
            return Verdict(False, f"line {i + 1}: {a!r}, expected {b!r}")
    return Verdict(len(lines) == len(wanted), "" if len(lines) == len(wanted) else f"{len(lines)} lines, expected {len(wanted)}")


def validate_unordered(got: Iterable[str], expected: Iterable[str]) -> Verdict:
    """As multisets of lines; an empty line is an error."""
    lines, ended = _lines(got)
    if not ended:
        return Verdict(False, "the result has no end")
    if "" in lines:
        return Verdict(False, f"line {lines.index('') + 1} is empty")
    wanted = [x.strip() for x in expected]
    if len(lines) != len(wanted):
        return Verdict(False, f"{len(lines)} lines, expected {len(wanted)}")
    odd = Counter(lines) - Counter(wanted)
    return Verdict(not odd, f"not expected: {next(iter(odd))!r}" if odd else "")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Are two DataFrames equal as multisets of rows?  Compared in one aggregation, distributed."""
    if a.columns != b.columns:
        return False
    both = a.withColumn("_side", F.lit(1)).unionAll(b.withColumn("_side", F.lit(-1)))
    return both.groupBy(*[F.col(f"`{c}`") for c in a.columns]).agg(F.sum("_side").alias("_side")).filter("_side <> 0").isEmpty()


#: Least memory of a query in a suite, in MB.
LEAST_MB = 64


@dataclass(frozen=True)
class SuiteQuery:
    """A query of a suite, with what it is expected to give."""

    execution_name: str
    query: Query
    expected_output_file: str
    disabled: bool = False
    sort_before_check: bool = False
    memory_limit_mb: int = LEAST_MB

    def __post_init__(self) -> None:
        if self.memory_limit_mb < LEAST_MB:
            raise ValueError(f"{self.execution_name}: at least {LEAST_MB} MB")

    @staticmethod
    def from_json(text: str) -> list[SuiteQuery]:
        out = []
        for x in json.loads(text):
            out.append(SuiteQuery(x["execution_name"], Query.from_json(json.dumps(x["query"])), x["expected_output_file"], x.get("disabled", False), x.get("sort_before_check", False), x.get("memory_limit_mb", LEAST_MB)))
        return out


def run_suite(suite: Iterable[SuiteQuery], run: Callable[[Query], Iterable[str]]) -> dict[str, Verdict]:
    """Verdicts of the enabled queries, in order, up to and including the first that fails."""
    out: dict[str, Verdict] = {}
    for q in suite:
        if q.disabled:
            continue
        with open(q.expected_output_file, encoding="utf-8") as f:
            expected = f.read().splitlines()
        check = validate_unordered if q.sort_before_check else validate_ordered
        out[q.execution_name] = check(run(q.query), expected)
        if not out[q.execution_name]:
            break
    return out
