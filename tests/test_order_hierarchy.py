import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from memloom.operators import features as fe
from memloom.operators import hierarchy as hi

# most exchanges of a plan without broadcasts: both sides of every join of small tables, and those that move facts
MOST = {"bridge_packs_H23": 7, "hierarchy_role_map_H25": 13, "hierarchy_features_F04": 4}


@pytest.fixture(scope="module")
def odd_orders(tmp_path_factory):
    """Line items without a supplier or a number, repeated ones, and such without an order or a part."""
    folder = tmp_path_factory.mktemp("orders")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS c_custkey, (i % 3)::INTEGER AS c_nationkey FROM range(60) t(i)) TO '{folder}/customer.parquet'")
    con.execute(f"COPY (SELECT i AS o_orderkey, (i * 7) % 20 AS o_custkey FROM range(150) t(i)) TO '{folder}/orders.parquet'")
    con.execute(f"COPY (SELECT i AS p_partkey, 'Brand#' || i % 3 AS p_brand FROM range(50) t(i)) TO '{folder}/part.parquet'")
    con.execute(f"""COPY (SELECT (i % 800) // 5 AS l_orderkey, (i * 37) % 52 AS l_partkey, CASE WHEN i % 45 <> 0 THEN i % 800 % 30 END AS l_suppkey,
      CASE WHEN i % 50 <> 18 THEN (i % 5 + 1)::INTEGER END AS l_linenumber FROM range(1600) t(i)) TO '{folder}/lineitem.parquet'""")
    for table in ("customer", "orders", "part", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", [*MOST, "topology_index_F01"])
def test_odd_line_items_are_treated_as_in_sql(spark, odd_orders, name):
    folder, con = odd_orders
    wanted = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    rows, expected = entry.queries()[name](spark, folder).select(*columns).collect(), wanted.fetchall()
    if name == "hierarchy_features_F04":  # where a fact has no id, the operator gives 0 for its edge and the SQL null
        node = columns.index("node_id")
        rows, expected = ([r for r in some if r[node] is not None] for some in (rows, expected))
    assert rows and plain(map(tuple, rows)) == plain(expected)


@pytest.mark.parametrize("name", MOST)
def test_facts_move_few_times(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= MOST[name]


def test_paths_give_the_index_of_their_edges(spark):
    rows = [(1, f"f{i}", i // 3, i // 6, i // 6 % 2) for i in range(40)]
    paths = spark.createDataFrame(rows, "conv_id int, fact_id string, event_id long, episode_id long, topic_id int")
    edge = lambda a, b: paths.select("conv_id", F.col(a).alias("child"), F.col(b).alias("parent"), F.lit(0.5).alias("confidence")).distinct()
    names = ["fact_id", "event_id", "episode_id", "topic_id", "event_degree", "episode_events", "episode_facts", "topic_degree"]
    wanted = fe.topology_index(edge("fact_id", "event_id"), edge("event_id", "episode_id"), edge("episode_id", "topic_id"))
    assert sorted(map(tuple, fe.path_index(paths).select(*names).collect())) == sorted(map(tuple, wanted.select(*names).collect()))


def test_linked_packs_equal_bridge_packs(spark):
    rows = [("c", f"c:entitystate:b{i % 3}:1", f"f{i:03}", f"c:event:{i // 2}", f"c:episode:{i // 40}") for i in range(121)] + [("c", "c:entitystate:z:1", "g", "c:event:0", "c:episode:0")]
    links = spark.createDataFrame(rows, "conv_id string, state_id string, fact_id string, event_id string, episode_id string")
    wanted = hi.bridge_packs(links.select("conv_id", "state_id", "fact_id"), links.select("conv_id", "fact_id", "event_id"), links.select("conv_id", "event_id", "episode_id").distinct(), limit=9)
    got = hi.linked_packs(links.select("conv_id", "state_id", "episode_id", "fact_id"), ["conv_id", "state_id", "episode_id"], limit=9)
    tail = F.concat(F.lit("c:pack:bridge:"), F.regexp_replace(F.element_at(F.split("state_id", ":entitystate:"), 2), ":", "_"), F.lit("_"), F.element_at(F.split("episode_id", ":"), 3))
    assert sorted(map(tuple, got.select(tail, "fact_id", "fact_no").collect())) == sorted(map(tuple, wanted.select("pack_id", "fact_id", "fact_no").collect()))


def test_the_last_edge_gives_the_parent(spark):
    facts = spark.createDataFrame([(1, 5, 2, -6, 0), (1, 5, 2, 5, 1), (1, 6, 1, -7, 0)], "conv_id int, f_order long, f_line int, dst long, pos int")
    events = spark.createDataFrame([(1, 5, 50, 0), (1, 5, 51, 1), (2, 5, 52, 1)], "conv_id int, src long, dst long, pos int")
    topics = spark.createDataFrame([(1, 51, 0, 1)], "conv_id int, src long, dst int, pos int")
    got = hi.linked_topics(hi.last_parent(facts, ["f_order", "f_line"], "event_id"), hi.last_parent(events, ["event_id"], "episode_id", "src"), hi.last_parent(topics, ["episode_id"], "topic_id", "src"))
    assert sorted(map(tuple, got.select("f_order", "f_line", "event_id", "episode_id", "topic_id").collect())) == [(5, 2, 5, 51, 0), (6, 1, -7, None, None)]
