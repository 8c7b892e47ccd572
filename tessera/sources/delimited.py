"""Pipe-delimited text with a schema file: NAME.csv and NAME.schema.

A schema file has two lines, names and types, separated by pipes.  Data has no header and no
quoting, and may end each row with a pipe.  Empty text fields are empty strings.  Unlike a reader
that stops at the first odd row, this one reads files to the end: rows with too few fields get
null in the missing numeric columns.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import quoted
from ..plans.ir import PlanError
from .catalog import TYPES, Catalog, ColumnSpec, TableSpec


def parse_schema(text: str, table: str = "table") -> TableSpec:
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if len(lines) < 2:
        raise PlanError(f"{table}: a schema has a line of names and a line of types")
    names, types = ([x.strip() for x in line.strip("|").split("|")] for line in lines[:2])
    if len(names) != len(types):
        raise PlanError(f"{table}: {len(names)} names, {len(types)} types")
    wrong = [t for t in types if t.upper() not in TYPES]
    if wrong:
        raise PlanError(f"{table}: unknown types {wrong}")
    return TableSpec(table, f"{table}.csv", [ColumnSpec(n, t.upper()) for n, t in zip(names, types, strict=True)])


def read_delimited(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    df = spark.read.schema(spec.schema()).csv(path, sep="|", quote="", escape="", header=False, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.select(*[F.coalesce(quoted(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else quoted(f.name) for f in df.schema.fields])


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder of any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().getName() for f in found)


def discover(spark: SparkSession, folder: str) -> Catalog:
    """Every NAME.csv in ``folder`` with a NAME.schema beside it; others are left out with a warning."""
    out, names = Catalog(spark), names_in(spark, folder)
    for name in names:
        if not name.endswith(".csv"):
            continue
        table = name[:-4]
        if f"{table}.schema" not in names:
            warnings.warn(f"{name} has no schema file and is left out", stacklevel=2)
            continue
        spec = parse_schema(spark.read.text(f"{folder}/{table}.schema", wholetext=True).first()[0], table)
        out.specs[table] = spec
        out.register(table, lambda p=f"{folder}/{name}", s=spec: read_delimited(spark, p, s))
    return out


def write_delimited(df: DataFrame, folder: str, table: str) -> None:
    """A folder NAME.csv of part files, and NAME.schema, as ``discover`` reads them."""
    spark, tags = df.sparkSession, {type(t): n for n, t in TYPES.items()}
    df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).write.mode("overwrite").csv(f"{folder}/{table}.csv", sep="|", quote="", escape="", header=False, emptyValue="")
    lines = ["|".join(df.columns), "|".join(tags[type(f.dataType)] for f in df.schema.fields)]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{table}.schema")
