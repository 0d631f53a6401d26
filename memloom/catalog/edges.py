"""Edge construction and graph upkeep queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.catalog import BUILT, query
from memloom.operators import edges as ed
from memloom.operators import nodes as nd
from memloom.session import cut_lineage
from memloom.sources import tables as tb
from memloom.sources.tables import NODES_SQL, jaccard_sql, term_set_sql

EDGES_SQL = NODES_SQL + f"""
nodes AS (
  SELECT conv_id, node_id, type, text, time, status, confidence, pos, turn_id, speaker, session_id, NULL::VARCHAR AS raw_id FROM raws UNION ALL
  SELECT conv_id, node_id, type, text, time, status, confidence, pos, turn_id, speaker, session_id, raw_id FROM facts UNION ALL
  SELECT conv_id, node_id, type, text, time, status, confidence, pos, NULL, NULL, NULL, NULL FROM anchors),
e_support AS (SELECT f.conv_id, f.node_id AS src, r.node_id AS dst, 'SUPPORTS' AS relation, 0.98::DOUBLE AS confidence
              FROM facts f JOIN raws r ON r.conv_id = f.conv_id AND r.node_id = f.raw_id),
f_terms AS (SELECT conv_id, node_id, {term_set_sql('text')} AS terms FROM facts),
a_terms AS (SELECT conv_id, node_id, pos, {term_set_sql('text')} AS terms FROM anchors),
pairs AS (
  SELECT f.conv_id, f.node_id AS fact_id, a.node_id AS anchor_id, a.pos AS anchor_pos, len(list_intersect(f.terms, a.terms)) AS shared,
         {jaccard_sql('f.terms', 'a.terms')} AS similarity
  FROM f_terms f JOIN a_terms a ON a.conv_id = f.conv_id),
cand AS (SELECT *, row_number() OVER (PARTITION BY conv_id, fact_id ORDER BY shared DESC, anchor_pos) AS rank FROM pairs WHERE shared > 0),
links AS (SELECT *, row_number() OVER (PARTITION BY conv_id, fact_id ORDER BY similarity DESC, rank) AS lr FROM cand WHERE rank <= 40),
e_anchor AS (SELECT conv_id, fact_id AS src, anchor_id AS dst, 'IS_SPECIFIC_OF' AS relation, least(0.95::DOUBLE, 0.55::DOUBLE + similarity) AS confidence, similarity
             FROM links WHERE lr <= 3 AND similarity >= 0.08),
ordered AS (SELECT f.*, t.terms, row_number() OVER (PARTITION BY f.conv_id ORDER BY f.pos) AS o FROM facts f JOIN f_terms t USING (conv_id, node_id)),
recent AS (
  SELECT n.conv_id, n.node_id AS src, p.node_id AS dst, n.text AS new_text, p.text AS old_text, n.status AS new_status, n.o AS new_no, p.o AS old_no,
         {jaccard_sql('n.terms', 'p.terms')} AS similarity
  FROM ordered n JOIN ordered p ON p.conv_id = n.conv_id AND p.o < n.o AND p.o >= n.o - 20),
kinds AS (SELECT *, CASE WHEN new_status = 'outdated' OR regexp_matches(lower(new_text), 'changed|updated|now|instead|no longer') THEN 'UPDATES'
   WHEN regexp_matches(lower(old_text) || ' ' || lower(new_text), 'not |never|contradict|wrong') THEN 'CONFLICTS_WITH' END AS relation
   FROM recent WHERE similarity >= 0.18),
e_change AS (SELECT conv_id, src, dst, relation, CASE WHEN relation = 'UPDATES' THEN least(0.9::DOUBLE, 0.5::DOUBLE + similarity)
   ELSE least(0.85::DOUBLE, 0.45::DOUBLE + similarity) END AS confidence, similarity FROM kinds WHERE relation IS NOT NULL),
edges AS (SELECT conv_id, src, dst, relation, confidence FROM e_support UNION ALL SELECT conv_id, src, dst, relation, confidence FROM e_anchor
          UNION ALL SELECT conv_id, src, dst, relation, confidence FROM e_change),
"""


def stored(name, build):
    """A table that several parts of one query use, built once per call of the query and kept as a checkpoint."""
    built = BUILT.get({})
    if name not in built:
        built[name] = cut_lineage(build())
    return built[name]


def graph_nodes(spark, d):
    return stored("nodes", lambda: tb.nodes(spark, d))


def graph(spark, d):
    """Node and edge tables of the dialogues, built once and reused by every query over them."""
    nodes = graph_nodes(spark, d)
    return nodes, stored("edges", lambda: ed.build_edges(nodes))


def split(nodes):
    return nodes.filter("type = 'FACT'"), nodes.filter("type = 'ANCHOR'")


@query("support_edges_E01", "WITH " + EDGES_SQL + "z AS (SELECT 1) SELECT * FROM e_support")
def _(spark, d):
    return ed.support_edges(tb.nodes(spark, d)).select("conv_id", "src", "dst", "relation", "confidence")


@query("anchor_candidates_E02", "WITH " + EDGES_SQL + """
alone AS (SELECT conv_id, node_id AS fact_id FROM facts WHERE (conv_id, node_id) NOT IN (SELECT conv_id, fact_id FROM cand)),
firsts AS (SELECT conv_id, node_id AS anchor_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS rank FROM anchors)
SELECT conv_id, fact_id, anchor_id, shared::BIGINT AS shared, rank::INTEGER AS rank FROM cand WHERE rank <= 40 UNION ALL
SELECT a.conv_id, a.fact_id, f.anchor_id, 0::BIGINT, f.rank::INTEGER FROM alone a JOIN firsts f USING (conv_id) WHERE f.rank <= 40""")
def _(spark, d):
    facts, anchors = split(graph_nodes(spark, d))
    return ed.anchor_candidates(facts, anchors).drop("anchor_pos")


@query("anchor_links_E03", "WITH " + EDGES_SQL + "z AS (SELECT 1) SELECT conv_id, src, dst, round(confidence, 6) AS confidence, round(similarity, 6) AS similarity FROM e_anchor")
def _(spark, d):
    return ed.link_anchors(*split(graph_nodes(spark, d))).select(
        "conv_id", "src", "dst", F.round("confidence", 6).alias("confidence"), F.round("similarity", 6).alias("similarity")
    )


@query("recent_fact_pairs_E04", "WITH " + EDGES_SQL + "z AS (SELECT 1) SELECT conv_id, src, dst, round(similarity, 6) AS similarity FROM recent")
def _(spark, d):
    pairs = ed.recent_pairs(tb.fact_nodes(spark, d))
    return pairs.select("conv_id", "src", "dst", F.round(ed.tx.jaccard(F.col("new_terms"), F.col("old_terms")), 6).alias("similarity"))


def marked_facts(spark, d):
    return nd.fact_nodes(tb.as_marked_turns(tb.table(spark, d, "conversations")))


@query("update_edges_E04", "WITH " + tb.marked_sql(EDGES_SQL) + "z AS (SELECT 1) SELECT conv_id, src, dst, round(confidence, 6) AS confidence FROM e_change WHERE relation = 'UPDATES'")
def _(spark, d):
    rows = ed.change_edges(marked_facts(spark, d)).filter("relation = 'UPDATES'")
    return rows.select("conv_id", "src", "dst", F.round("confidence", 6).alias("confidence"))


@query("conflict_edges_E05", "WITH " + tb.marked_sql(EDGES_SQL) + "z AS (SELECT 1) SELECT conv_id, src, dst, round(confidence, 6) AS confidence FROM e_change WHERE relation = 'CONFLICTS_WITH'")
def _(spark, d):
    rows = ed.change_edges(marked_facts(spark, d)).filter("relation = 'CONFLICTS_WITH'")
    return rows.select("conv_id", "src", "dst", F.round("confidence", 6).alias("confidence"))


@query("edge_dedupe_E06", """
SELECT 'o' || l_orderkey AS conv_id, l_partkey % 50 AS src, l_suppkey AS dst, l_returnflag AS relation, min(l_linenumber)::INTEGER AS pos,
 min_by(l_quantity, (l_linenumber, l_partkey, l_quantity)) AS confidence FROM lineitem GROUP BY ALL""")
def _(spark, d):
    rows = tb.table(spark, d, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("conv_id"), (F.col("l_partkey") % 50).alias("src"),
        F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"), F.col("l_linenumber").alias("pos"),
        F.col("l_quantity").alias("confidence"), "l_partkey",
    )
    return ed.first_per(rows, ["conv_id", "src", "dst", "relation"], ["pos", "l_partkey", "confidence"], ["pos", "confidence"])


@query("edge_referential_check_E07", "WITH " + EDGES_SQL + """
cut AS (SELECT conv_id, node_id FROM nodes WHERE NOT (type = 'RAW' AND speaker = 'system'))
SELECT conv_id, src || '->' || relation || '->' || dst AS edge_id, 'dst' AS missing FROM edges
WHERE (conv_id, dst) NOT IN (SELECT conv_id, node_id FROM cut)""")
def _(spark, d):
    nodes, edges = graph(spark, d)
    cut = nodes.filter("NOT (type = 'RAW' AND speaker = 'system')")
    return ed.dangling_edges(edges, cut).select("conv_id", ed.edge_id().alias("edge_id"), "missing")


@query("neighbour_lookup_E08", "WITH " + EDGES_SQL + """
seeds AS (SELECT conv_id, node_id FROM anchors)
SELECT e.conv_id, e.dst AS node_id, e.src AS neighbour, e.relation, round(e.confidence, 6) AS confidence
FROM edges e JOIN seeds s ON s.conv_id = e.conv_id AND s.node_id = e.dst WHERE e.relation = 'IS_SPECIFIC_OF'""")
def _(spark, d):
    nodes, edges = graph(spark, d)
    near = ed.neighbours(ed.partial_order_edges(edges), nodes.filter("type = 'ANCHOR'"), "in", "IS_SPECIFIC_OF")
    return near.withColumn("confidence", F.round("confidence", 6))


def _broken_supports(spark, d):
    """Facts whose supports are bare turn ids, with one unknown value each."""
    nodes = tb.nodes(spark, d)
    is_fact = F.col("type") == "FACT"
    values = F.array(F.col("turn_id"), F.concat_ws(":raw:", "conv_id", "turn_id"), F.concat(F.lit("X"), "turn_id"))
    lost = is_fact & (F.col("speaker") == "system")
    return nodes.withColumn(
        "support_ids",
        F.when(lost, F.array(F.concat(F.lit("X"), "turn_id"))).when(is_fact, values).otherwise(F.col("support_ids")),
    ).withColumn("time", F.when(is_fact, F.lit(None).cast("string")).otherwise(F.col("time")))


@query("provenance_repair_E09", "WITH " + EDGES_SQL + """z AS (SELECT 1)
SELECT f.conv_id, f.node_id, CASE WHEN f.speaker = 'system' THEN NULL ELSE r.node_id END AS support_raw_ids,
 CASE WHEN f.speaker = 'system' THEN NULL ELSE r.text END AS support_texts, CASE WHEN f.speaker = 'system' THEN NULL ELSE r.time END AS time
FROM facts f JOIN raws r ON r.conv_id = f.conv_id AND r.node_id = f.raw_id""")
def _(spark, d):
    return ed.repair_provenance(_broken_supports(spark, d)).select(
        "conv_id", "node_id", F.array_join("support_raw_ids", "|").alias("support_raw_ids"),
        F.array_join("support_texts", "|").alias("support_texts"), "time",
    )


@query("provenance_stats_E09", "WITH " + EDGES_SQL + """z AS (SELECT 1)
SELECT count(*) AS total_facts, count(*) FILTER (speaker = 'system') AS missing_raw_facts, count(DISTINCT 'X' || turn_id) AS unresolved_support_ids,
 round((count(*) - count(*) FILTER (speaker = 'system'))::DOUBLE / count(*), 6) AS fact_with_raw_ratio FROM facts""")
def _(spark, d):
    return ed.provenance_stats(_broken_supports(spark, d)).withColumn("fact_with_raw_ratio", F.round("fact_with_raw_ratio", 6))


@query("added_support_edges_E09", "WITH " + EDGES_SQL + """z AS (SELECT 1)
SELECT conv_id, node_id AS src, raw_id AS dst, 'fact_raw' AS role FROM facts WHERE speaker = 'assistant'""")
def _(spark, d):
    nodes = tb.nodes(spark, d)
    present = ed.support_edges(nodes).filter("NOT src IS NULL").join(
        nodes.filter("speaker = 'assistant'").select("conv_id", F.col("node_id").alias("src")), ["conv_id", "src"], "left_anti"
    )
    return ed.missing_support_edges(nodes, present).select("conv_id", "src", "dst", "role")


@query("view_removal_E10", "WITH " + EDGES_SQL + """z AS (SELECT 1)
SELECT 'node' AS kind, conv_id, node_id AS a, type AS b FROM nodes WHERE type <> 'ANCHOR' UNION ALL
SELECT 'edge', conv_id, src, dst FROM edges WHERE relation <> 'IS_SPECIFIC_OF'""")
def _(spark, d):
    nodes, edges = graph(spark, d)
    kept_nodes, kept_edges = ed.remove_view(nodes, edges, F.col("type") == "ANCHOR", F.col("role") == "pack_member")
    return kept_nodes.select(F.lit("node").alias("kind"), "conv_id", F.col("node_id").alias("a"), F.col("type").alias("b")).unionByName(
        kept_edges.select(F.lit("edge").alias("kind"), "conv_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    )


@query("conversation_subset_E11", "WITH " + EDGES_SQL + """
c AS (SELECT DISTINCT conv_id FROM nodes ORDER BY conv_id LIMIT 25)
SELECT conv_id, node_id, type FROM nodes WHERE conv_id IN (SELECT conv_id FROM c)""")
def _(spark, d):
    return ed.first_conversations(tb.nodes(spark, d), 25).select("conv_id", "node_id", "type")


@query("support_closure_nodes_E12", "WITH " + EDGES_SQL + """
c AS (SELECT conv_id, node_id, raw_id FROM facts WHERE speaker = 'assistant'),
s AS (SELECT conv_id, raw_id AS node_id FROM c),
b AS (SELECT p.conv_id, p.node_id FROM raws p JOIN raws r ON r.conv_id = p.conv_id AND r.session_id = p.session_id AND r.pos = p.pos + 1 JOIN s ON s.node_id = r.node_id),
ids AS (SELECT conv_id, node_id FROM c UNION SELECT * FROM s UNION SELECT * FROM b)
SELECT n.conv_id, n.node_id, n.type FROM nodes n JOIN ids USING (conv_id, node_id)""")
def _(spark, d):
    nodes = tb.nodes(spark, d)
    return ed.support_closure_nodes(nodes.filter("type = 'FACT' AND speaker = 'assistant'"), nodes).select("conv_id", "node_id", "type")


@query("gold_binding_E13", "WITH " + EDGES_SQL + """
g AS (SELECT conv_id AS question_id, max(turn_id) AS turn_id FROM turns GROUP BY conv_id)
SELECT f.conv_id AS question_id, f.node_id AS unit_id, f.turn_id FROM facts f JOIN g ON g.question_id = f.conv_id AND g.turn_id = f.turn_id""")
def _(spark, d):
    units = tb.fact_nodes(spark, d).select(
        F.col("conv_id").alias("question_id"), F.col("node_id").alias("unit_id"), F.col("support_ids").alias("raw_message_ids")
    )
    gold = tb.turns(spark, d).groupBy(F.col("conv_id").alias("question_id")).agg(F.max("turn_id").alias("turn_id"))
    return ed.bind_gold(units, gold).select("question_id", "unit_id", "turn_id")
