"""The driver's test tables seen as the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import nodes as nd

TURNS_PER_SESSION = 4


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return as_turns(table(spark, folder, "conversations"))


def as_turns(conversations: DataFrame) -> DataFrame:
    """Dialogue turns; sessions are runs of four turns, message times follow conversation and turn numbers."""
    session = F.concat(F.lit("D"), (F.floor(F.col("turn") / TURNS_PER_SESSION) + 1).cast("string"))
    ts = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod("conv_id", F.lit(700)).cast("int"))
    clock = F.concat(F.lit(" "), F.lpad((F.col("turn") % 24).cast("string"), 2, "0"), F.lit(":30:00"))
    return conversations.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conv_id"),
        F.col("turn").alias("pos"),
        F.concat(session, F.lit(":"), (F.col("turn") + 1).cast("string")).alias("turn_id"),
        F.col("role").alias("speaker"),
        "text",
        F.concat(F.date_format(ts, "yyyy-MM-dd"), clock).alias("ts"),
        session.alias("session_id"),
    )


def as_marked_turns(conversations: DataFrame) -> DataFrame:
    """Turns with a change or denial cue added by turn number, for the update and conflict rules."""
    cue = F.when(F.col("turn") % 3 == 0, " and this has changed since yesterday evening").when(
        F.col("turn") % 3 == 1, " and that is not true since yesterday evening").otherwise(" and so on since yesterday evening")
    return as_turns(conversations.withColumn("text", F.concat("text", cue)))


def marked_sql(sql: str) -> str:
    """The oracle's turn table with the same cues."""
    cue = (
        "text || CASE turn % 3 WHEN 0 THEN ' and this has changed since yesterday evening' "
        "WHEN 1 THEN ' and that is not true since yesterday evening' ELSE ' and so on since yesterday evening' END AS text,"
    )
    return sql.replace("role AS speaker, text,", f"role AS speaker, {cue}")


TURNS_SQL = """
turns AS (
  SELECT 'c' || conv_id AS conv_id, turn AS pos,
         'D' || (turn // 4 + 1) || ':' || (turn + 1) AS turn_id, role AS speaker, text,
         strftime(DATE '2023-01-01' + CAST(conv_id % 700 AS INTEGER), '%Y-%m-%d') || ' ' ||
           lpad(CAST(turn % 24 AS VARCHAR), 2, '0') || ':30:00' AS ts,
         'D' || (turn // 4 + 1) AS session_id
  FROM conversations),
clean AS (
  SELECT conv_id, pos, turn_id, speaker, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, ts, session_id
  FROM turns WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
"""

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in nd.tx.CONTENT_STOPWORDS) + "]"


def content_terms_sql(expr: str) -> str:
    """DuckDB form of the content-term tokenizer, for oracle checks."""
    return (
        f"list_filter(list_transform(list_filter(regexp_extract_all({expr}, '[A-Za-z][A-Za-z0-9_''-]+'), "
        f"lambda t: length(t) > 2), lambda t: lower(t)), lambda t: NOT list_contains({STOP_SQL}, t))"
    )


def term_set_sql(expr: str) -> str:
    return f"list_distinct({content_terms_sql(expr)})"


def jaccard_sql(left: str, right: str) -> str:
    inter = f"len(list_intersect({left}, {right}))"
    return (
        f"(CASE WHEN len({left}) > 0 AND len({right}) > 0 THEN "
        f"{inter}::DOUBLE / (len({left}) + len({right}) - {inter}) ELSE 0.0::DOUBLE END)"
    )


NODES_SQL = TURNS_SQL + """
raws AS (
  SELECT conv_id, conv_id || ':raw:' || turn_id AS node_id, 'RAW' AS type, speaker || ': ' || text AS text, ts AS time,
         'active' AS status, 1.0::DOUBLE AS confidence, pos, turn_id, speaker, session_id
  FROM clean),
facts AS (
  SELECT conv_id, conv_id || ':fact:' || turn_id AS node_id, 'FACT' AS type, speaker || ' said: ' || text AS text,
         ts AS time,
         CASE WHEN regexp_matches(lower(speaker || ' said: ' || text), 'not anymore|no longer|changed|instead') THEN 'outdated'
              WHEN regexp_matches(lower(speaker || ' said: ' || text), 'except|unless') THEN 'exception'
              WHEN regexp_matches(lower(speaker || ' said: ' || text), 'maybe|possibly|unclear|not sure') THEN 'disputed'
              ELSE 'active' END AS status,
         0.72::DOUBLE AS confidence, conv_id || ':raw:' || turn_id AS raw_id, pos, turn_id, speaker, session_id
  FROM clean),
labelled AS (
  SELECT conv_id, pos, turn_id, ts, """ + content_terms_sql("text") + """ AS terms FROM clean),
labelled2 AS (
  SELECT *, list_filter(terms, lambda t, i: list_position(terms, t) = i) AS uniq FROM labelled),
labelled3 AS (
  SELECT conv_id, pos, turn_id, ts,
         CASE WHEN len(uniq) = 0 THEN 'General memory' ELSE 'Topic: ' || array_to_string(uniq[1:6], ', ') END AS label
  FROM labelled2),
anchor_first AS (
  SELECT conv_id, lower(label) AS k, min(pos) AS first_pos, min_by(label, pos) AS label, min_by(ts, pos) AS first_ts
  FROM labelled3 GROUP BY ALL),
anchors AS (
  SELECT conv_id, k, conv_id || ':anchor:' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first_pos) AS VARCHAR), 4, '0') AS node_id,
         'ANCHOR' AS type, label AS text, first_ts AS time, 'active' AS status, 0.58::DOUBLE AS confidence, first_pos AS pos
  FROM anchor_first),
anchor_members AS (
  SELECT l.conv_id, a.node_id, a.text, l.conv_id || ':fact:' || l.turn_id AS fact_id, l.pos AS fact_pos
  FROM labelled3 l JOIN anchors a ON a.conv_id = l.conv_id AND a.k = lower(l.label)),
"""


def raw_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return nd.raw_nodes(turns(spark, folder))


def fact_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return nd.fact_nodes(turns(spark, folder))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return nd.extract_nodes(turns(spark, folder))
