"""Streaming queries: the given tables as file streams, results read back from the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.catalog import query
from memloom.catalog.expansion import SEED_SQL
from memloom.catalog.temporal import STATE_SQL, iso_sql
from memloom.sources import artifacts as ar
from memloom.sources import tables as tb
from memloom.streaming import turns as st


def turn_stream(spark, d):
    return tb.as_turns(st.table_stream(spark, d, "conversations.parquet"))


def states_of(events):
    return events.select(
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("entity"), F.col("event_type").alias("attribute"), F.col("event_id").alias("state_id"), F.floor("value").cast("bigint").alias("value"), F.col("ts").cast("timestamp").alias("ts"))


def state_stream(spark, d):
    return states_of(st.table_stream(spark, d, "events.parquet"))


@query("streamed_nodes_W1", "WITH " + SEED_SQL + " SELECT conv_id, node_id, type, text, status FROM nodes WHERE type IN ('RAW', 'FACT')")
def _(spark, d):
    return st.run_available(st.extracted_nodes(turn_stream(spark, d)).select("conv_id", "node_id", "type", "text", "status"), ar.shared_folder(spark))


@query("streamed_session_activity_W2", f"""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id::VARCHAR AS conv_id, count(*) AS turns, count(DISTINCT event_type) AS speakers, {iso_sql('min(ts)')} AS first_ts, {iso_sql('max(ts)')} AS last_ts FROM s GROUP BY user_id, no""")
def _(spark, d):
    e = st.table_stream(spark, d, "events.parquet").select(F.col("user_id").cast("string").alias("conv_id"), F.col("event_type").alias("speaker"), F.col("ts").cast("timestamp").alias("ts"))
    rows = st.session_table(st.run_available(st.session_activity(e), ar.shared_folder(spark)))
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_ts", "last_ts")})


@query("streamed_change_edges_W3", "WITH " + tb.marked_sql(SEED_SQL) + " SELECT conv_id, src, dst, relation, round(similarity, 6) AS similarity FROM e_change")
def _(spark, d):
    stream = tb.as_marked_turns(st.table_stream(spark, d, "conversations.parquet"))
    edges = st.run_available(st.change_edges(stream), ar.shared_folder(spark))
    return edges.select("conv_id", "src", "dst", "relation", F.round("similarity", 6).alias("similarity"))


@query("streamed_state_versions_W4", "WITH " + STATE_SQL + f" SELECT entity, attribute, state_id, value, {iso_sql('valid_from')} AS valid_from, {iso_sql('valid_to')} AS valid_to, next_id, 0::BIGINT AS late_rows FROM sv")
def _(spark, d):
    e = state_stream(spark, d)
    v = st.latest_versions(st.run_available(st.state_versions(e), ar.shared_folder(spark)))
    return v.select("entity", "attribute", "state_id", "value", F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss").alias("valid_from"), F.date_format("valid_to", "yyyy-MM-dd HH:mm:ss").alias("valid_to"), "next_id", "late_rows")


@query("streamed_state_at_time_W4", "WITH " + STATE_SQL + """,
ask AS (SELECT event_id AS ask_id, 'user' || user_id AS entity, event_type AS attribute, ts + to_hours(30) AS att FROM events)
SELECT ask_id, state_id, value FROM ask JOIN sv USING (entity, attribute) WHERE valid_from <= att AND (valid_to IS NULL OR att < valid_to)""")
def _(spark, d):
    states = state_stream(spark, d)
    asked = states_of(tb.table(spark, d, "events")).select(F.col("state_id").alias("ask_id"), "entity", "attribute", (F.col("ts") + F.expr("INTERVAL 30 HOURS")).alias("at"))
    versions = st.latest_versions(st.run_available(st.state_versions(states), ar.shared_folder(spark)))
    return st.versions_at(versions, asked).select("ask_id", "state_id", "value")
