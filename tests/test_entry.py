import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() == 352


def test_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"q1", "q50", "b10", "io_cost_trace"} <= set(entry.queries())
