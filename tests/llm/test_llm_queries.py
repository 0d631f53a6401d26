import re

import duckdb

import __spark_entry__ as entry
from memloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for name in ("embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    for name, sql in ORACLES.items():
        cursor = con.execute(sql)
        columns = [d[0] for d in cursor.description]
        wanted = sorted(cursor.fetchall())
        assert wanted and sorted(tuple(r) for r in QUERIES[name](spark, FOLDER).select(*columns).collect()) == wanted
