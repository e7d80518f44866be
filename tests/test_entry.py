import __spark_entry__ as entry


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p2_found", "p3_found", "p4_found"} <= set(queries)
    assert all(callable(f) for f in queries.values())
