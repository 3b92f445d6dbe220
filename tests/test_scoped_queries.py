"""What user SQL may name: functions by list, subqueries by scope, views for the time of one query."""

import pytest
from pyspark.sql import functions as F

from citewise.operators.scoped_sql import ScopedQueryError, checked_tables, scoped_sql

REFUSED = [
    "SELECT IDENTIFIER('reflect')('java.lang.System','getProperty','user.home') AS h FROM t",
    "SELECT IDENTIFIER('refl' || 'ect')('java.lang.System','getProperty','user.home') AS h FROM t",
    "SELECT * FROM IDENTIFIER('users')", "SELECT IDENTIFIER('a') FROM t", "SELECT reflect('java.lang.System', 'exit', 1) FROM t",
    "SELECT system.builtin.reflect('a', 'b') FROM t", "SELECT `reflect`('java.lang.System', 'exit', 1) FROM t", "SELECT try_reflect('a', 'b') FROM t",
    "SELECT input_file_name() FROM t", "SELECT current_user() FROM t", "SELECT version() FROM t", "SELECT my_udf(a) FROM t", "SELECT java_method('a', 'b') FROM t",
    "SELECT a FROM t WHERE length(reflect('a', 'b')) > 0", "SELECT max(reflect('a', 'b')) FROM t GROUP BY reflect('c', 'd')",
    "SELECT a FROM t ORDER BY reflect('a', 'b')", "SELECT a FROM t JOIN t u ON reflect('a', 'b') = u.a", "SELECT sum(a) OVER (ORDER BY reflect('a', 'b')) FROM t",
    "SELECT (SELECT reflect('a', 'b')) FROM t", "SELECT transform(array(a), x -> reflect('a', 'b')) FROM t", "SELECT * FROM t LATERAL VIEW explode(array(reflect('a', 'b'))) AS x",
    "SELECT * FROM t LATERAL VIEW java_tvf(a) AS x", "SELECT * FROM t LIMIT reflect('a', 'b')", "SELECT secret('a', 'b')", "SELECT from_json('{}', 'a int', map('mode', 'x')) FROM t",
    "SELECT * FROM t, LATERAL (SELECT * FROM users)", "WITH u AS (SELECT 1 AS x) SELECT * FROM t WHERE a IN (SELECT x FROM users)",
    "SELECT * FROM (WITH users AS (SELECT 1 AS a) SELECT * FROM users) x JOIN users ON TRUE", "SELECT session_user FROM t WHERE a = ai_query('x', 'y')",
    "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r) SELECT * FROM r",
]
ACCEPTED = [
    "SELECT a, b, a + 1 AS c, a % 2, -a, a || b FROM t WHERE a BETWEEN 1 AND 3 AND b LIKE 'x%' OR b IS NULL", "SELECT count(*), count(DISTINCT a), sum(a) FILTER (WHERE a > 1) FROM t",
    "SELECT CASE WHEN a > 1 THEN 'x' ELSE upper(b) END, CAST(a AS STRING), a::double, try_cast(b AS int) FROM t",
    "SELECT EXTRACT(YEAR FROM DATE '2024-01-01'), date_trunc('MONTH', now()), current_date FROM t", "SELECT row_number() OVER (PARTITION BY b ORDER BY a DESC) AS r FROM t",
    "SELECT b, avg(a) AS m FROM t GROUP BY b HAVING avg(a) > 0 ORDER BY m DESC LIMIT 5", "SELECT * FROM t WHERE a IN (SELECT max(a) FROM t) AND EXISTS (SELECT 1 FROM t u WHERE u.a = t.a)",
    "WITH t2 AS (SELECT * FROM t), t3 AS (SELECT * FROM t2) SELECT * FROM t3 x JOIN T2 y ON x.a = y.a", "WITH t AS (SELECT a FROM t) SELECT * FROM t",
    "SELECT b FROM t GROUP BY ROLLUP (b)", "SELECT * FROM t LATERAL VIEW explode(array(1, 2)) x AS y", "SELECT CURRENT_TIMESTAMP, POSITION('a' IN b), SUBSTRING(b FROM 1 FOR 2), TRIM(BOTH ' ' FROM b) FROM t",
    "SELECT a FROM t WHERE NOT (a = 1 OR a <> 2) AND b NOT IN ('x', 'y') AND a <=> 3 AND b RLIKE 'x'", "SELECT median(a), percentile_cont(0.5) WITHIN GROUP (ORDER BY a) FROM t",
    "SELECT INTERVAL '1' DAY + DATE '2024-01-01', a IS DISTINCT FROM 2 FROM t", "SELECT DISTINCT b FROM t",
]


@pytest.fixture
def t(spark):
    return spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "a int, b string")


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    with pytest.raises(ScopedQueryError):
        checked_tables(spark, sql, {"t"})


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted(spark, t, sql):
    assert checked_tables(spark, sql, {"t"}) == ["t"]
    scoped_sql(spark, sql, {"t": t}).collect()


def test_views_of_the_session_stay(spark, t):
    spark.range(7).createOrReplaceTempView("t")
    spark.range(2).createOrReplaceTempView("held")
    try:
        kept = scoped_sql(spark, "WITH held AS (SELECT a FROM t WHERE a > 1) SELECT count(*) AS n FROM held", {"t": t})
        assert spark.table("t").count() == 7 and spark.table("held").count() == 2
        assert kept.first()["n"] == 2 and kept.filter(F.col("n") > 1).count() == 1
    finally:
        spark.catalog.dropTempView("t")
        spark.catalog.dropTempView("held")
    assert scoped_sql(spark, "SELECT * FROM other", {"other": t}).count() == 3
    assert not spark.catalog.tableExists("other")
    assert scoped_sql(spark, "WITH other AS (SELECT 1 AS n) SELECT n FROM other", {}).first()["n"] == 1
