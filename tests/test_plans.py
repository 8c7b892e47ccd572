import pytest
from pyspark.sql import types as T

from tessera.functions.cost import ColumnStats, estimate, selectivity
from tessera.plans.builder import col, f32, f64, i32, i64, literal, predicate, scan, string
from tessera.plans.compiler import compile_query
from tessera.plans.ir import Cross, Filter, PlanError, Project, Query, Scan, Sort, Value
from tessera.plans.rewrite import explain, optimize, output
from tessera.plans.sqltext import from_sql
from tessera.sources.catalog import Catalog

NAN = float("nan")


@pytest.fixture(scope="module")
def tables(spark):
    c = Catalog(spark)
    c.register("t", spark.createDataFrame([(1, 10, 1.0, 1.5, "a"), (2, 20, NAN, NAN, "b"), (3, 1 << 53, -0.0, 0.0, "")], "i int, l long, f float, d double, s string"))
    c.register("u", spark.createDataFrame([(1.0, "a"), (NAN, "x"), (0.0, "")], "x double, y string"))
    c.register("empty", spark.createDataFrame([], "e int, g string"))
    c.register("dotted", spark.createDataFrame([(7,)], T.StructType([T.StructField("a.b", T.IntegerType())])))
    return c


def rows(plan, tables):
    return [tuple(r) for r in compile_query(plan.build(), tables).collect()]


def ids(tables, *predicates):
    return [r[0] for r in rows(scan("t").filter_multiple(predicates).project("i", "i"), tables)]


def test_builder_nodes():
    plan = scan("a").filter("x", "GT", 1).cross(scan("b")).sort("x", False).project("x", "y").build()
    assert isinstance(plan.root, Project) and isinstance(plan.root.child, Sort) and isinstance(plan.root.child.child, Cross)
    assert isinstance(plan.root.child.child.left, Filter) and plan.root.child.child.right == Scan("b")


def test_literals():
    assert literal(1).kind == "I32" and literal(1 << 31).kind == "I64" and literal(1.0).kind == "F64" and literal("x").kind == "String"
    for bad in (lambda: Value("I32", 1 << 31), lambda: Value("Bool", True), lambda: Value("I32", "x"), lambda: Value("I32", True), lambda: predicate("a", "LIKE", 1)):
        with pytest.raises(ValueError):
            bad()


def test_json_is_tagged():
    q = scan("orders").filter("o_totalprice", "GT", f64(1.0)).project("o_orderkey", "id").build()
    assert '"value":{"F64":1.0}' in q.to_json() and '"table_id":"orders"' in q.to_json()
    assert Query.from_json(q.to_json()) == q
    for bad in ("{}", "[]", '{"root":{"Limit":{}}}', '{"root":{"Scan":{}}}', "x"):
        with pytest.raises(PlanError):
            Query.from_json(bad)


@pytest.mark.parametrize(
    ("p", "expected"),
    [
        (("i", "EQ", i32(2)), [2]), (("i", "NE", i32(2)), [1, 3]), (("i", "GTE", i64(2)), [2, 3]), (("l", "EQ", i64((1 << 53) + 1)), []),
        (("d", "EQ", f64(1.5)), [1]), (("d", "NE", f64(1.5)), [2, 3]), (("d", "GT", f64(0.0)), [1]), (("d", "GTE", f64(0.0)), [1, 3]), (("d", "LT", f64(9.0)), [1, 3]),
        (("d", "EQ", f64(NAN)), []), (("d", "NE", f64(NAN)), [1, 2, 3]), (("d", "LTE", f64(NAN)), []), (("d", "EQ", f64(-0.0)), [3]),
        (("f", "EQ", f32(1.0)), [1]), (("f", "LT", f64(2.0)), [1, 3]), (("f", "GT", i32(0)), [1]), (("f", "EQ", col("d")), [3]), (("f", "NE", col("d")), [1, 2]), (("d", "GTE", col("f")), [1, 3]), (("f", "LTE", col("d")), [1, 3]), (("f", "LT", col("d")), [1]),
        (("i", "EQ", f64(2.0)), [2]), (("i", "LT", col("l")), [1, 2, 3]), (("i", "EQ", col("f")), [1]),
        (("s", "EQ", string("a")), [1]), (("s", "GT", string("")), [1, 2]), (("s", "NE", string("a")), [2, 3]),
        (("s", "NE", i32(1)), []), (("i", "NE", string("1")), []), (("s", "EQ", col("i")), []), (("i", "LT", col("s")), []),
    ],
)
def test_predicates(tables, p, expected):
    assert ids(tables, p) == expected


def test_conjunctions(tables):
    assert ids(tables) == [1, 2, 3]
    assert ids(tables, ("i", "GT", 1), ("i", "LT", 3)) == [2]
    assert ids(tables, ("s", "EQ", 3), ("i", "EQ", 1)) == []


def test_integers_of_two_widths_compare_exactly(spark):
    c = Catalog(spark).register("n", spark.createDataFrame([(1 << 53, (1 << 53) + 1)], "a long, b long"))
    assert rows(scan("n").filter("a", "EQ", col("b")), c) == []


def test_projection(tables):
    assert rows(scan("t").filter("i", "EQ", 1).project_multiple([("s", "x"), ("i", "y"), ("s", "z")]), tables) == [("a", 1, "a")]
    assert rows(scan("t").filter("i", "EQ", 1).project_multiple([("'it'", "a"), ('"q"', "b"), ("nothing", "c"), ("''", "d"), ("'", "e")]), tables) == [("it", "q", "nothing", "", "'")]
    assert rows(scan("dotted").project("a.b", "c.d").filter("c.d", "EQ", 7), tables) == [(7,)]
    assert rows(scan("t").project("'k'", "k").filter("k", "EQ", "k"), tables) == [("k",)] * 3


def test_crosses(tables):
    assert len(rows(scan("t").cross(scan("u")), tables)) == 9
    assert rows(scan("t").cross(scan("empty")), tables) == []
    assert sorted(rows(scan("t").cross(scan("u")).filter("s", "EQ", col("y")).project_multiple([("i", "i"), ("y", "y")]), tables)) == [(1, "a"), (3, "")]
    assert rows(scan("t").cross(scan("u")).filter("d", "EQ", col("x")).project("i", "i"), tables) == [(3,)]
    assert compile_query(scan("t").cross(scan("u")).build(), tables).columns == ["i", "l", "f", "d", "s", "x", "y"]


def test_sorts(tables):
    assert [r[0] for r in rows(scan("t").sort("s"), tables)] == [3, 1, 2]
    assert [r[0] for r in rows(scan("t").sort("l", False).project("i", "i"), tables)] == [3, 2, 1]
    assert rows(scan("empty").sort("e"), tables) == []


@pytest.mark.parametrize("plan", [scan("none"), scan("t").filter("zz", "EQ", 1), scan("t").filter("i", "EQ", col("zz")), scan("t").sort("zz"), scan("t").cross(scan("t")), scan("t").project_multiple([("i", "a"), ("s", "A")])])
def test_errors(tables, plan):
    with pytest.raises(PlanError):
        compile_query(plan.build(), tables)


def test_sql_text(tables):
    columns = lambda t: tables.table(t).columns
    q = from_sql("SELECT i, y AS name, 'k' FROM t, (SELECT x, y FROM u WHERE y<>'') v WHERE s=y AND d>=-1.5 AND i<4 ORDER BY i DESC, y", columns)
    assert [tuple(r) for r in compile_query(Query(q.root.child), tables).collect()][0][0] == 1
    q = from_sql("SELECT p.i AS a, q.i AS b FROM t p, t q WHERE p.i<q.i", columns)
    assert sorted(tuple(r) for r in compile_query(q, tables).collect()) == [(1, 2), (1, 3), (2, 3)]
    for bad in ("SELECT i", "SELECT zz FROM t", "SELECT i FROM t WHERE i LIKE 3", "SELECT i FROM t LIMIT 3", "SELECT i FROM t WHERE i ; 3"):
        with pytest.raises(PlanError):
            from_sql(bad, columns)


STATS = {"t": {"i": ColumnStats(0, 100, 50, 0.5), "s": ColumnStats(distinct=4)}, "u": {"x": ColumnStats(density=0.25)}}


def test_estimates():
    s = lambda *p: selectivity(STATS, predicate(*p))
    assert s("i", "EQ", 3) == 1 / 50 and s("i", "NE", 3) == 1 - 1 / 50 and s("i", "LT", 25) == 0.25 and s("i", "GTE", 25) == 0.75
    assert s("i", "GT", 1000) == 0.01 and s("s", "GT", "a") == 0.33 and s("i", "LT", col("x")) == 0.33
    assert s("x", "EQ", 1) == 0.75 and s("x", "NE", 1) == 0.25 and s("q", "EQ", 1) == 0.1 and s("q", "NE", 1) == 0.33
    assert estimate(STATS, scan("t").node) == 50 and estimate(STATS, scan("none").node) == 1000
    assert estimate(STATS, scan("t").filter("i", "EQ", 1).node) == 50 * 0.05
    assert estimate(STATS, scan("t").cross(scan("none")).sort("i").project("i", "i").node) == 50_000


def test_rewrites(tables):
    columns = lambda t: tables.table(t).columns
    plan = scan("t").cross(scan("u")).cross(scan("empty")).filter_multiple([("i", "EQ", 1), ("s", "EQ", col("y")), ("e", "EQ", col("i"))]).sort("i").build()
    done = optimize(plan, columns, STATS)
    assert output(done.root, columns) == output(plan.root, columns)
    shown = explain(done.root, STATS)
    assert "Scan empty" in shown and "rows" in shown
    assert shown.index("Filter i EQ 1") > shown.index("Cross")
    lit = scan("t").project_multiple([("'k'", "k"), ("i", "j")]).filter_multiple([("k", "EQ", "k"), ("j", "EQ", 2)]).build()
    assert [tuple(r) for r in compile_query(optimize(lit, columns), tables).collect()] == [("k", 2)]


def test_reorder_looks_at_what_a_tie_leaves():
    """A table tied by a column of few values comes after a larger one that is tied by its key."""
    columns = {"a": ["a_key", "a_kind"], "b": ["b_key", "b_kind"], "c": ["c_key", "c_a", "c_b"]}
    stats = {"a": {"a_key": ColumnStats(distinct=1_000), "a_kind": ColumnStats(distinct=5)}, "b": {"b_key": ColumnStats(distinct=50_000), "b_kind": ColumnStats(distinct=5)}, "c": {"c_key": ColumnStats(distinct=900_000), "c_a": ColumnStats(distinct=1_000), "c_b": ColumnStats(distinct=50_000)}}
    plan = scan("a").cross(scan("b")).cross(scan("c")).filter_multiple([("a_kind", "EQ", col("b_kind")), ("c_a", "EQ", col("a_key")), ("c_b", "EQ", col("b_key"))]).build()
    done = optimize(plan, columns.__getitem__, stats)
    shown = explain(done.root)
    assert shown.index("Scan a") < shown.index("Scan c") < shown.index("Scan b")
    assert output(done.root, columns.__getitem__) == output(plan.root, columns.__getitem__)
