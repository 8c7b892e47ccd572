import json
import warnings

import pytest

from tessera.functions.cost import base_rows
from tessera.functions.formatting import format_float
from tessera.operators import profile as P
from tessera.operators.iocost import Disk, DiskFile, io_cost, micros, request_costs
from tessera.operators.ordered import with_previous
from tessera.operators.validate import SuiteQuery, run_suite, same_rows, validate_ordered, validate_unordered
from tessera.plans.builder import col, predicate, scan
from tessera.plans.compiler import compile_query
from tessera.plans.ir import PlanError
from tessera.sources.catalog import Catalog
from tessera.sources.delimited import discover, parse_schema
from tessera.sources.rowblock import RowBlockSource
from tessera.sources.sink import framed, text_lines, write_text
from tessera.streaming.plans import compile_stream, parquet_stream, start


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1|2|0.5|1.25|"x|\n2|3|1.0|2.0||\n\n3|4|1.5|3.0|z|\n')
    (tmp_path / "a.schema").write_text("i|l|f|d|s\ni32|I64|Float32|FLOAT64|string\n")
    (tmp_path / "b.csv").write_text("1|\n")
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        catalog = discover(spark, str(tmp_path))
    assert any("b.csv" in str(w.message) for w in told) and catalog.names() == ["a"]
    got = [tuple(r) for r in compile_query(scan("a").sort("i").build(), catalog).collect()]
    assert got == [(1, 2, 0.5, 1.25, '"x'), (2, 3, 1.0, 2.0, ""), (3, 4, 1.5, 3.0, "z")]
    specs = Catalog.specs_from_json(catalog.to_json())
    assert [c.type for c in specs[0].columns] == ["I32", "I64", "FLOAT32", "FLOAT64", "STRING"]
    catalog.create_views()
    assert spark.table("a").count() == 3


@pytest.mark.parametrize("text", ["a|b\n", "a|b\nI32\n", "a\nI8\n"])
def test_bad_schema(text):
    with pytest.raises(PlanError):
        parse_schema(text)


def test_floats_as_text():
    cases = {1.0: "1.0", 0.1: "0.1", 12345678.9: "12345678.9", 1e15: "1000000000000000.0", 1e16: "1e16", 1e-5: "1e-5", 0.0001: "0.0001", -0.0: "-0.0", 1.5e300: "1.5e300"}
    assert {x: format_float(x) for x in cases} == cases
    assert format_float(float("nan")) == "NaN" and format_float(float("-inf")) == "-inf" and format_float(0.1, single=True) == "0.1"


def test_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "x"), (2, 1e16, "")], "a int, b double, c string").coalesce(1)
    assert list(text_lines(df)) == ["1|0.5|x|", "2|1e16||"]
    assert list(framed(df))[0] == "validate" and list(framed(df))[-1] == "!"
    write_text(df, str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1|0.5|x|", "2|1e16||"]


def test_row_blocks(spark, tmp_path):
    spark.dataSource.register(RowBlockSource)
    df = spark.range(5000).selectExpr("cast(id as int) i", "id * 3 l", "cast(id / 4 as float) f", "id / 3 d", "concat('täxt', id) s").repartition(3)
    path = str(tmp_path / "blocks")
    df.write.format("rowblock").option("path", path).option("blocksize", 512).mode("append").save()
    back = spark.read.format("rowblock").schema(df.schema).option("path", path).option("blocksize", 512).load()
    assert same_rows(df, back)
    df.limit(10).write.format("rowblock").option("path", path).option("blocksize", 512).mode("overwrite").save()
    assert spark.read.format("rowblock").schema(df.schema).option("path", path).option("blocksize", 512).load().count() == 10


def test_previous_row(spark):
    df = spark.createDataFrame([(k, k * k % 11) for k in [0, 1, 5, 6, 7, 30, 31, 99]], "o long, v long")
    expected = [(o, v, p) for (o, v), p in zip([tuple(r) for r in df.collect()], [None, *[r[1] for r in df.collect()][:-1]], strict=True)]
    for stretch in (1, 3, 10, 1000):
        assert sorted(tuple(r) for r in with_previous(df, "o", ["v"], stretch).collect()) == expected


def test_profile(spark):
    df = spark.createDataFrame([(i, i % 3, float(i) / 2, "ab"[i % 2]) for i in range(40)], "k int, m long, d double, s string")
    p = P.profile(df, order="k")
    assert p["k"][0] == "IsPhysicallyOrdered" and {"CardinalityStat": 40} in p["k"] and {"DensityStat": 1.0} in p["k"]
    assert {"RangeStat": {"lower_bound": {"Int64": 0}, "upper_bound": {"Int64": 2}}} in p["m"] and "IsPhysicallyOrdered" not in p["m"]
    assert [x["HistogramStat"]["frequency_points"][0] for x in p["k"] if "HistogramStat" in x] == [[{"lower_bound": {"Int32": 0}, "upper_bound": {"Int32": 3}}, 4]]
    assert any("HistogramStat" in x for x in p["s"]) and not any("RangeStat" in x for x in p["s"])
    assert json.loads(P.to_json(p)) == p
    assert P.estimator_stats(p)["m"].distinct == 3
    assert P.profile(df.limit(0)) == {"k": [], "m": [], "d": [], "s": []}


def test_histogram_paths_agree(spark):
    df = spark.createDataFrame([(int(x),) for x in [1, 1, 1, 1, 2, 3, 3, 9, 9, 9, 10, 11, 12]], "v int")
    a, b = (sorted(tuple(r) for r in P.histogram(df, "v", buckets=4, sample=s).collect()) for s in (None, 1000))
    assert a == b and sum(r[3] for r in a) == 13
    assert sum(r.freq for r in P.histogram(spark.range(30_000), "id").collect()) == 30_000


def test_disk_cost(spark):
    trace = [(1, 1, 10), (2, 11, 5), (3, 0, 0), (4, 5000, 4096), (5, 100, 1)]
    cost = io_cost(spark.createDataFrame(trace, "seq long, start_block long, n_blocks long")).first()
    disk, cylinder, end, total = Disk(), 0, 0, [0, 0, 0, 0, 0, 0]
    for _, start_block, n in trace:
        total[0] += 1
        if n == 0:
            continue
        total[1] += n
        a, last = start_block // 4096, start_block + n - 1
        far, crossed = abs(cylinder - a), last // 4096 - a
        total[2] += far + crossed
        seek = 0 if far == 0 else 0.8 if far == 1 else 0.8 + 17.2 * (min(1, far / 500_000)) ** 0.5
        total[3] += round((seek + crossed * 0.8) * 1e6)
        total[4] += 0 if start_block == end + 1 else round(0.5 * 60 / 7200 * 1e9)
        total[5] += round(n * 4096 / 1e6 / 150 * 1e9)
        cylinder, end = last // 4096, last
    assert list(cost) == total
    assert micros(1499) == 1 and micros(1500) == 2
    assert request_costs(spark.createDataFrame([], "seq long, start_block long, n_blocks long")).count() == 0
    layout, after = Disk(files=(DiskFile("a", 8192), DiskFile("b", 4096))).layout()
    gap = -(-10_000_000_000 // 4096)
    assert layout == {"a": (0, 2), "b": (2 + gap, 1)} and after == 3 + 2 * gap
    for bad in (Disk(block_size=0), Disk(files=(DiskFile("a b", 4096),)), Disk(files=(DiskFile("a", 5),))):
        with pytest.raises(ValueError):
            bad.check()
    disk.check()


def test_validation(spark, tmp_path, sf):
    assert validate_ordered(["a|", "b|", "!"], ["a|", "b|"]) and not validate_ordered(["b|", "a|", "!"], ["a|", "b|"])
    assert not validate_ordered(["a|"], ["a|"]) and not validate_ordered(["a|", "!"], ["a|", "b|"])
    assert validate_unordered(["b|", "a|", "!"], ["a|", "b|"]) and not validate_unordered(["a|", "a|", "!"], ["a|", "b|"])
    assert not validate_unordered(["", "!"], [""])
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    assert same_rows(a, a.orderBy("v")) and not same_rows(a, a.distinct()) and not same_rows(a, a.withColumnRenamed("k", "q"))
    catalog = Catalog.parquet(spark, sf, ("region",))
    plan = scan("region").sort("r_regionkey").project("r_name", "r_name").build()
    (tmp_path / "ok").write_text("AFRICA|\nAMERICA|\nASIA|\nEUROPE|\nMIDDLE EAST|\n")
    (tmp_path / "bad").write_text("AFRICA|\n")
    item = lambda name, file, **x: {"execution_name": name, "query": json.loads(plan.to_json()), "expected_output_file": str(tmp_path / file), **x}
    suite = SuiteQuery.from_json(json.dumps([item("a", "ok"), item("b", "bad", disabled=True), item("c", "ok", sort_before_check=True), item("d", "bad"), item("e", "ok")]))
    done = run_suite(suite, lambda q: list(framed(compile_query(q, catalog)))[1:])
    assert {k: bool(v) for k, v in done.items()} == {"a": True, "c": True, "d": False}
    with pytest.raises(ValueError):
        SuiteQuery("x", plan, "f", memory_limit_mb=1)


def test_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    catalog = Catalog(spark).register("events", lambda: parquet_stream(spark, str(tmp_path / "in"), schema))
    plan = scan("events").filter("value", "GT", 50.0).project_multiple([("event_id", "id"), ("event_type", "kind")])
    query = start(plan.build(), catalog, "streamed")
    query.awaitTermination()
    static = Catalog.parquet(spark, sf, ("events",))
    assert same_rows(spark.table("streamed"), compile_query(plan.build(), static))
    for bad, where in ((plan.sort("id"), catalog), (plan, static)):
        with pytest.raises(PlanError):
            compile_stream(bad.build(), where)


def test_quick_stats_of_what_is_compared(spark):
    """Only columns that predicates compare are counted or ranged; the rows of the table are known without them."""
    df = spark.createDataFrame([(i, i % 3, float(i), "ab"[i % 2]) for i in range(40)], "k int, m long, d double, s string")
    done = P.quick_stats(df, [predicate("m", "EQ", col("other")), predicate("d", "LT", 3.5)])
    assert set(done) == {"m", "d"} and done["m"].distinct == 3 and (done["d"].low, done["d"].high, done["d"].distinct) == (0.0, 39.0, None)
    assert base_rows({"t": done}, "t") == base_rows({"t": P.quick_stats(df, [])}, "t") == 40
    assert set(P.quick_stats(df)) == {"k", "m", "d", "s"} and P.quick_stats(df.limit(0), []) == {}
