import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from memloom.operators import temporal as tp


@pytest.fixture(scope="module")
def odd_orders(tmp_path_factory):
    """Orders whose line items lack a supplier, a line number or a quantity, and parts that lack a name or a type."""
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS p_partkey, CASE WHEN i % 11 <> 0 THEN ['red gear', 'red rod', 'old plate', 'small gear'][i % 4 + 1] END AS p_name,
      CASE WHEN i % 13 <> 0 THEN ['ECONOMY RED', 'SMALL STEEL', 'OLD GEAR'][i % 3 + 1] END AS p_type FROM range(200) t(i)) TO '{folder}/part.parquet'""")
    con.execute(f"""COPY (SELECT i // 5 AS l_orderkey, (i * 37) % 220 AS l_partkey, CASE WHEN i % 45 <> 0 THEN i % 50 END AS l_suppkey,
      CASE WHEN i % 45 <> 18 THEN (i % 5 + 1)::INTEGER END AS l_linenumber, CASE WHEN i % 7 <> 0 THEN (i % 50)::DOUBLE END AS l_quantity, TIMESTAMP '2024-01-01' AS l_shipdate
      FROM range(2000) t(i)) TO '{folder}/lineitem.parquet'""")
    for table in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["operand_token_matching_T12", "distinct_role_assignment_T13", "duration_pair_expansion_T14"])
def test_missing_values_are_treated_as_in_sql(spark, odd_orders, name):
    folder, con = odd_orders
    wanted = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    got = [tuple(r) for r in entry.queries()[name](spark, folder).select(*columns).collect()]
    assert got and sorted(got, key=repr) == sorted(wanted.fetchall(), key=repr)


def test_equal_scores_of_one_unit_number_are_settled_by_id(spark):
    units = [(q, f"1-7-{s}", 10000007, "red gear STEEL started", 1.0) for q in range(40) for s in ((1, 2, 3) if q % 2 else (3, 2, 1))]
    roles = spark.createDataFrame([(q, n, "red gear") for q in range(40) for n in (1, 2)], "question_id long, role_no int, role string")
    rows = spark.createDataFrame(units, "question_id long, unit_id string, unit_no long, text string, ce double")
    picked = tp.assign_roles(tp.role_candidates(roles, rows), roles)
    assert {(r.role_no, r.unit_id) for r in picked.collect()} == {(1, "1-7-1"), (2, "1-7-2")}


@pytest.mark.parametrize("name", ["distinct_role_assignment_T13", "duration_pair_expansion_T14"])
def test_units_are_dealt_by_order_once(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 3  # both sides of the join with parts, then orders
    assert "Python" not in plan and "MapInPandas" not in plan
