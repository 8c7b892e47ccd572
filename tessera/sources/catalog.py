"""Tables by name: directories of Parquet files, directories of delimited text, and saved catalogs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.ir import PlanError

#: Type names of catalogs and schema files, and their Spark types.
TYPES = {"I32": T.IntegerType(), "I64": T.LongType(), "FLOAT32": T.FloatType(), "FLOAT64": T.DoubleType(), "STRING": T.StringType()}
#: The same types as catalogs spell them.
CATALOG_TYPES = {"I32": "Int32", "I64": "Int64", "FLOAT32": "Float32", "FLOAT64": "Float64", "STRING": "String"}


@dataclass
class ColumnSpec:
    name: str
    type: str  # a key of TYPES
    stats: list = field(default_factory=list)


@dataclass
class TableSpec:
    name: str
    file_id: str
    columns: list[ColumnSpec]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, TYPES[c.type]) for c in self.columns])


class Catalog:
    """Names to DataFrames; a table is only read when a plan scans it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.specs: dict[str, TableSpec] = {}
        self._load: dict = {}
        self._open: dict[str, DataFrame] = {}

    def register(self, name: str, source) -> Catalog:
        """``source``: a DataFrame, or a function without arguments that makes one."""
        self._load[name] = source if callable(source) else (lambda: source)
        self._open.pop(name, None)
        return self

    def table(self, name: str) -> DataFrame:
        if name not in self._load:
            raise PlanError(f"unknown table {name!r}; there are {sorted(self._load)}")
        if name not in self._open:
            self._open[name] = self._load[name]()
        return self._open[name]

    def names(self) -> list[str]:
        return sorted(self._load)

    def create_views(self) -> None:
        for name in self._load:
            self.table(name).createOrReplaceTempView(name)

    @staticmethod
    def parquet(spark: SparkSession, folder: str, tables: tuple[str, ...]) -> Catalog:
        """Tables ``folder``/NAME.parquet."""
        out = Catalog(spark)
        for name in tables:
            out.register(name, lambda name=name: spark.read.parquet(f"{folder}/{name}.parquet"))
        return out

    # saved form

    def to_json(self) -> str:
        specs = [{"name": s.name, "file_id": s.file_id, "column_specs": [{"column_name": c.name, "data_type": CATALOG_TYPES[c.type], "stats": c.stats or None} for c in s.columns]} for s in self.specs.values()]
        return json.dumps({"table_specs": specs})

    def profile(self, profiler: Callable[[DataFrame], dict[str, list]], tables: tuple[str, ...] = ()) -> Catalog:
        """Fill in the specs of tables (all, if none are named) with their columns and the profiler's statistics."""
        tags = {type(t): n for n, t in TYPES.items()}
        for name in tables or self.names():
            df = self.table(name)
            stats = profiler(df)
            held = self.specs.get(name)
            self.specs[name] = TableSpec(name, held.file_id if held else name, [ColumnSpec(f.name, tags.get(type(f.dataType), "STRING"), stats.get(f.name, [])) for f in df.schema.fields])
        return self

    def stats(self, reader: Callable[[dict[str, list]], dict]) -> dict[str, dict]:
        """What ``reader`` makes of each table's saved statistics."""
        return {s.name: reader({c.name: c.stats for c in s.columns}) for s in self.specs.values()}

    @staticmethod
    def load(spark: SparkSession, text: str, source: Callable[[TableSpec], DataFrame]) -> Catalog:
        """A saved catalog, statistics included; ``source`` opens a table by its spec when a plan scans it."""
        out = Catalog(spark)
        for spec in Catalog.specs_from_json(text):
            out.specs[spec.name] = spec
            out.register(spec.name, lambda spec=spec: source(spec))
        return out

    @staticmethod
    def specs_from_json(text: str) -> list[TableSpec]:
        back = {v: k for k, v in CATALOG_TYPES.items()}
        return [TableSpec(s["name"], s["file_id"], [ColumnSpec(c["column_name"], back[c["data_type"]], c.get("stats") or []) for c in s["column_specs"]]) for s in json.loads(text)["table_specs"]]
