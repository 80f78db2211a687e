import __spark_entry__


def test_queries_are_registered(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["s1_id", "tp", "n_pred", "n_true", "f05"] and rows.count() > 0
