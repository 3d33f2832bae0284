import __spark_entry__ as e


def test_registry():
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries)
    if e.corpus_queries is not None:
        assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in queries} and "pipeline" in queries


def test_entry(spark):
    assert e.entry(spark).count() > 0
