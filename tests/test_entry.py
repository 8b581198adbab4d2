import __spark_entry__ as driver
import check_queries
import check_sql


def test_every_query_has_its_sql():
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(check_sql.ORACLES) == set(check_queries.QUERIES) <= set(queries)


def test_flagship(spark):
    rows = driver.entry(spark).collect()
    assert {r.response for r in rows} == {"label", "odd"}
