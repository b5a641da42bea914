import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).count() >= 0
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and {"p1_found", "p3_found", "p4_found"} <= set(q)
