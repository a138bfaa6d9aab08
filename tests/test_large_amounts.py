"""Amounts beyond 4e8: half a unit rounds as in the SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from holdfast.functions.columns import rnd_large
from holdfast.operators.drivers import intervention_priorities
from holdfast.plans.oracles import _CTES

FEATURES = (
    "segment string, current_mrr double, churn_flag int, at_risk_flag int, usage_trend double, payment_failure_flag int, nps_score_recent double, "
    "renewal_near_flag int, feature_adoption_score_recent double, support_tickets_90d bigint"
)


@pytest.mark.parametrize("digits", [0, 2])
def test_large_amounts_round_as_in_sql(spark, digits):
    drawn = random.Random(1)
    values = [0.0, 0.5, -0.4, 1234.5, -2.5, 0.125, 461168601.5, 500000000.5, -500000000.5, 3600000001.5, 1e12 + 0.5]
    values += [drawn.randrange(10**10) + 0.5 for _ in range(200)] + [drawn.randrange(10**9) + 0.125 for _ in range(200)] + [drawn.uniform(-1e10, 1e10) for _ in range(200)]
    (sql,) = zip(*duckdb.connect().execute(f"SELECT CAST(round(CAST(v AS DECIMAL(38,10)), {digits}) AS DOUBLE) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall())
    found = spark.createDataFrame(list(enumerate(values)), "k int, v double").select("k", rnd_large("v", digits).alias("r")).orderBy("k").collect()
    assert [r.r for r in found] == list(sql)
    assert spark.range(1).select(rnd_large(F.lit(None).cast("double"), digits)).first()[0] is None


def test_plays_of_large_revenue_match_their_sql(spark):
    amounts = {"A": [500000000.25, 0.25], "B": [600000001.5], "C": [3600000001.0, 0.5], "D": [1234567890.5]}
    rows = [(s, m, 0, 1, -1.0, 1, -50.0, 1, 10.0, 9) for s, ms in amounts.items() for m in ms] + [("A", 0.0, 1, 0, -1.0, 1, -50.0, 1, 10.0, 9)]
    thr = (5.0, 0.0, 20.0, 30.0)
    con = duckdb.connect()
    con.execute(f"CREATE TABLE feat ({FEATURES.replace('string', 'varchar')})")
    con.execute("CREATE TABLE thr AS SELECT ?::DOUBLE AS q75_tickets, ?::DOUBLE AS q25_nps, ?::DOUBLE AS q25_adoption, ?::DOUBLE AS q40_adoption", thr)
    limits = spark.createDataFrame([thr], "q75_tickets double, q25_nps double, q25_adoption double, q40_adoption double")
    for some in (rows, [r for r in rows if r[0] in "AD"]):
        con.execute("DELETE FROM feat")
        con.executemany("INSERT INTO feat VALUES (?,?,?,?,?,?,?,?,?,?)", some)
        wanted = con.execute(f"WITH ft AS ({_CTES['ft']}) {_CTES['plays']}").fetchall()
        found = intervention_priorities(spark.createDataFrame(some, FEATURES), limits=limits).collect()
        assert sorted(map(tuple, found)) == sorted(wanted)
