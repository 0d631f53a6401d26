"""Graph expansion, route fusion and path queries on the dialogue graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.catalog import query
from memloom.catalog.edges import EDGES_SQL, graph, graph_nodes, stored
from memloom.catalog.hierarchy import VM_SQL, vector_members
from memloom.catalog.retrieval import bm25_sql, exp_sql, ldist_sql
from memloom.catalog.nodes import hash_embedding_sql, names_sql
from memloom.functions import text as tx
from memloom.functions import vectors as vx
from memloom.operators import balls as ba
from memloom.operators import expansion as ex
from memloom.operators import hierarchy as hi
from memloom.operators import nodes as nd
from memloom.operators import retrieval as re_
from memloom.session import cut_lineage
from memloom.sources import tables as tb
from memloom.sources.tables import jaccard_sql, term_set_sql

SEEDS = 20
QNAMES = "list_filter(list_distinct({0}), lambda x: NOT list_contains(['What','When','Where','Which','Would','Could','Should','The','How','Why'], x))"

QUESTIONS_SQL = """
qs AS (SELECT conv_id || ':q0001' AS q, conv_id, arg_max(text, pos) AS text, max(turn_id) AS gold FROM clean GROUP BY conv_id),"""
SEED_SQL = EDGES_SQL + QUESTIONS_SQL + bm25_sql("qs", "(SELECT conv_id, node_id AS doc, text FROM facts)", "conv_id") + f""",
hits AS (SELECT conv_id, q, doc, score, score / max(score) OVER (PARTITION BY q) AS norm, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS rank FROM bscore),
seeds AS (SELECT * FROM hits WHERE rank <= {SEEDS}),
h1 AS (SELECT s.q, s.conv_id, s.doc AS seed_id, e.dst AS node_id, e.relation, e.confidence, s.doc || '->' || e.relation || '->' || e.dst AS edge, 'out' AS direction
  FROM seeds s JOIN edges e ON e.conv_id = s.conv_id AND e.src = s.doc JOIN nodes n ON n.conv_id = s.conv_id AND n.node_id = e.dst
  WHERE (e.relation = 'SUPPORTS' AND n.type = 'RAW') OR (e.relation IN ('UPDATES', 'EXCEPTION_OF', 'CONFLICTS_WITH') AND n.type = 'FACT')
  UNION ALL SELECT s.q, s.conv_id, s.doc, e.src, e.relation, e.confidence, e.src || '->' || e.relation || '->' || s.doc, 'in'
  FROM seeds s JOIN edges e ON e.conv_id = s.conv_id AND e.dst = s.doc JOIN nodes n ON n.conv_id = s.conv_id AND n.node_id = e.src
  WHERE e.relation IN ('UPDATES', 'EXCEPTION_OF', 'CONFLICTS_WITH') AND n.type = 'FACT'),
deg AS (SELECT conv_id, dst AS anchor_id, count(*) AS degree FROM e_anchor GROUP BY ALL),
h2a AS (SELECT s.q, s.conv_id, s.doc AS seed_id, s.rank AS seed_rank, a.dst AS anchor_id, a.confidence AS ac, b.src AS node_id, b.confidence AS bc, degree,
  row_number() OVER (PARTITION BY s.q, s.doc, a.dst ORDER BY b.confidence DESC, b.src) AS sr
  FROM seeds s JOIN e_anchor a ON a.conv_id = s.conv_id AND a.src = s.doc JOIN e_anchor b ON b.conv_id = a.conv_id AND b.dst = a.dst AND b.src <> s.doc
  JOIN deg d ON d.conv_id = a.conv_id AND d.anchor_id = a.dst),
h2 AS (SELECT * FROM h2a WHERE sr <= 2)"""


def questions(spark, d):
    """One question per conversation: its last turn; the gold evidence is that turn."""
    return nd.clean_turns(tb.turns(spark, d)).groupBy("conv_id").agg(
        F.max_by("text", "pos").alias("question"), F.max("turn_id").alias("gold_turn")
    ).select(F.concat("conv_id", F.lit(":q0001")).alias("question_id"), "conv_id", "question", "gold_turn")


def found(spark, d, top=None):
    """Questions, nodes, facts and the facts that BM25 finds per question, ranked: all of them, or the best ``top`` where a query
    reads no others; no edges are built."""
    nodes = graph_nodes(spark, d)
    facts = nodes.filter("type = 'FACT'")
    q = stored("questions", lambda: questions(spark, d))
    hits = stored(f"hits {top}", lambda: re_.normalize_scores(
        re_.bm25_top_k(q, facts, top, "question_id", "node_id", "conv_id", query_text="question")))
    return q, nodes, facts, hits


def seeded(spark, d):
    """Nodes, edges, BM25 hits of all facts per question and the best of them as seeds."""
    q, nodes, facts, hits = found(spark, d)
    return q, nodes, facts, graph(spark, d)[1], hits, hits.filter(F.col("rank") <= SEEDS)


@query("one_hop_expansion_X01", "WITH " + SEED_SQL + "SELECT q AS question_id, seed_id, node_id, relation, direction FROM h1")
def _(spark, d):
    _, nodes, _, edges, _, seeds = seeded(spark, d)
    return ex.one_hop(seeds, edges, nodes, conflicts=True).select("question_id", "seed_id", "node_id", "relation", "direction")


@query("sibling_expansion_X02", "WITH " + SEED_SQL + "SELECT q AS question_id, seed_id, anchor_id, node_id, sr::INTEGER AS sibling_rank FROM h2")
def _(spark, d):
    _, nodes, _, edges, _, seeds = seeded(spark, d)
    return ex.siblings(seeds, ex.anchor_links(edges, nodes), 2).select("question_id", "seed_id", "anchor_id", "node_id", "sibling_rank")


POOL_SQL = SEED_SQL + """,
pl0 AS (SELECT q, doc AS node_id, rank AS seed_rank, 0 AS stage, doc AS tie FROM seeds
  UNION ALL SELECT h1.q, h1.node_id, s.rank, 1, h1.edge FROM h1 JOIN seeds s ON s.q = h1.q AND s.doc = h1.seed_id
  UNION ALL SELECT q, node_id, seed_rank, 2, anchor_id || '|' || lpad(sr::VARCHAR, 6, '0') FROM h2),
pl1 AS (SELECT *, row_number() OVER (PARTITION BY q, node_id ORDER BY seed_rank, stage, tie) AS r FROM pl0),
pl AS (SELECT q AS question_id, node_id, stage > 0 AS expanded, row_number() OVER (PARTITION BY q ORDER BY seed_rank, stage, tie, node_id)::INTEGER AS pool_no FROM pl1 WHERE r = 1)"""


def pool(spark, d):
    q, nodes, facts, edges, hits, seeds = seeded(spark, d)
    hop1 = ex.one_hop(seeds, edges, nodes, conflicts=True)
    hop2 = ex.siblings(seeds, ex.anchor_links(edges, nodes), 2)
    return q, nodes, hits, seeds, hop1, hop2


@query("candidate_pool_X03", "WITH " + POOL_SQL + "SELECT * FROM pl")
def _(spark, d):
    _, _, _, seeds, hop1, hop2 = pool(spark, d)
    return ex.candidate_pool(seeds, hop1, hop2).select("question_id", "node_id", "expanded", "pool_no")


@query("pool_relation_counts_X03", "WITH " + SEED_SQL + """
SELECT q AS question_id, relation, count(*) AS edges FROM (SELECT q, relation FROM h1 UNION ALL SELECT q, 'IS_SPECIFIC_OF' FROM h2 UNION ALL SELECT q, 'IS_SPECIFIC_OF' FROM h2) GROUP BY ALL""")
def _(spark, d):
    _, _, _, _, hop1, hop2 = pool(spark, d)
    return ex.pool_edge_counts(hop1, hop2)


SCORED_SQL = SEED_SQL + """,
rt AS (
  SELECT q, conv_id, doc AS node_id, doc AS seed_id, norm AS sp, 1.0::DOUBLE AS ep, rank AS sr, 0 AS stage, doc AS pk, 0 AS ne, false AS cf FROM seeds
  UNION ALL SELECT h1.q, h1.conv_id, h1.node_id, seed_id, s.norm * CASE WHEN relation = 'SUPPORTS' THEN 0.95 ELSE 0.75 END,
    confidence * CASE relation WHEN 'SUPPORTS' THEN 1 WHEN 'UPDATES' THEN 0.85 WHEN 'CONFLICTS_WITH' THEN -0.6 ELSE 0.65 END, s.rank, 1, seed_id || '>' || h1.node_id, 1, edge LIKE '%CONFLICTS_WITH%'
    FROM h1 JOIN seeds s ON s.q = h1.q AND s.doc = h1.seed_id
  UNION ALL SELECT h2.q, h2.conv_id, node_id, seed_id, s.norm * 0.45, 0.65 * (ac + bc) / 2, seed_rank, 2, seed_id || '>' || anchor_id || '>' || node_id, 2, false FROM h2 JOIN seeds s ON s.q = h2.q AND s.doc = h2.seed_id),
rt2 AS (SELECT rt.*, coalesce(h.norm, 0) AS bp FROM rt LEFT JOIN hits h ON h.q = rt.q AND h.doc = rt.node_id),
rt3 AS (SELECT *, row_number() OVER (PARTITION BY q, node_id ORDER BY -round(sp + bp + ep, 9), sr, stage, pk) AS r FROM rt2),
sc AS (SELECT rt3.*, n.type, n.status, n.text, (sp + 0.8 * bp + 0.4 * ep + 0.3 * CASE n.status WHEN 'active' THEN 1 WHEN 'exception' THEN 0.75 WHEN 'disputed' THEN 0.35 ELSE 0.1 END
  + 0.2 * CASE n.type WHEN 'FACT' THEN 1 ELSE 0.85 END - 0.5 * (CASE WHEN n.status IN ('outdated', 'disputed') THEN 0.5 ELSE 0 END + CASE WHEN cf THEN 0.7 ELSE 0 END))::DOUBLE AS score
  FROM rt3 JOIN nodes n ON n.conv_id = rt3.conv_id AND n.node_id = rt3.node_id WHERE r = 1 AND n.type IN ('FACT', 'RAW'))"""


def scored(spark, d):
    _, nodes, hits, seeds, hop1, hop2 = pool(spark, d)
    return ex.seeded_candidates(seeds, hop1, hop2, hits, nodes)


@query("seeded_candidate_scores_X04", "WITH " + SCORED_SQL + "SELECT q AS question_id, node_id, seed_id, round(score, 6) AS score, pk AS path FROM sc")
def _(spark, d):
    return scored(spark, d).select("question_id", "node_id", "seed_id", F.round("score", 6).alias("score"), F.array_join("path", ">").alias("path"))


@query("seeded_graph_retrieval_X05")
def _(spark, d):
    rows = ex.top_per(scored(spark, d), ["question_id"], [F.desc(F.round("score", 9)), F.asc("node_id")], 100)
    return re_.mmr_select(rows.withColumn("terms", tx.term_set("text")), 5)


ANN_SQL = SEED_SQL + f""",
qt AS (SELECT q, {term_set_sql('text')} AS t, {QNAMES.format(names_sql('text'))} AS n FROM qs),
ft AS (SELECT conv_id, node_id, status, {term_set_sql('text')} AS t, {QNAMES.format(names_sql('text'))} AS n FROM facts)"""
COV = "(CASE WHEN len(qt.t) > 0 AND len(ft.t) > 0 THEN len(list_intersect(qt.t, ft.t))::DOUBLE / len(qt.t) ELSE 0 END)"

SIB_SQL = ANN_SQL + f""",
sb0 AS (SELECT q, conv_id, doc AS node_id, doc AS seed_id, '' AS anchor_id, 0 AS degree, 0 AS hop, true AS is_seed, 1.0::DOUBLE AS edge, rank AS seed_rank FROM seeds
  UNION ALL SELECT q, conv_id, node_id, seed_id, anchor_id, degree, 2, false, least(ac, bc), seed_rank FROM h2a WHERE sr <= 40 AND degree <= 50),
sb1 AS (SELECT sb0.*, coalesce(h.norm, 0) AS bm25, ft.status, CASE WHEN len(qt.n) > 0 AND len(ft.n) > 0 THEN len(list_intersect(qt.n, ft.n))::DOUBLE / len(qt.n) ELSE least(1, {COV}) END AS eo
  FROM sb0 JOIN qt ON qt.q = sb0.q JOIN ft ON ft.conv_id = sb0.conv_id AND ft.node_id = sb0.node_id LEFT JOIN hits h ON h.q = sb0.q AND h.doc = sb0.node_id),
sb2 AS (SELECT *, (bm25 + 0.8 * is_seed::INT + 0.6 * eo + 0.4 * edge + 0.3 * CASE WHEN status = 'active' THEN 1 ELSE 0.2 END - 0.4 * ln(1 + degree) - 0.3 * hop)::DOUBLE AS score FROM sb1),
sb3 AS (SELECT *, row_number() OVER (PARTITION BY q, node_id ORDER BY -round(score, 9), seed_rank, anchor_id) AS r FROM sb2),
sib AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, node_id) AS rank FROM sb3 WHERE r = 1)"""


def sibling_rows(spark, d):
    q, nodes, facts, edges, hits, seeds = seeded(spark, d)
    return ex.sibling_candidates(seeds, hits, ex.anchor_links(edges, nodes), facts, q)


@query("filtered_siblings_X06", "WITH " + SIB_SQL + "SELECT q AS question_id, node_id, seed_id, anchor_id, degree::BIGINT AS anchor_degree, hop, is_seed, round(score, 6) AS score, rank::INTEGER AS rank FROM sib WHERE rank <= 100")
def _(spark, d):
    return sibling_rows(spark, d).select("question_id", "node_id", "seed_id", "anchor_id", "anchor_degree", "hop", "is_seed", F.round("score", 6).alias("score"), "rank")


# facts → events (two neighbouring turns) → topics (conversation)
HIER_SQL = ANN_SQL + """,
fe AS (SELECT conv_id, node_id AS fact_id, conv_id || ':event:' || (pos // 2) AS event_id, pos, 0.6 + (pos % 4) / 10.0::DOUBLE AS ec, text FROM facts),
evs AS (SELECT conv_id, event_id, conv_id || ':topic:' || min(pos) // 4 AS topic_id, string_agg(text, ' ' ORDER BY pos) AS text, count(*) AS deg FROM fe GROUP BY conv_id, event_id),
tds AS (SELECT topic_id, sum(deg) AS td FROM evs GROUP BY ALL),
loc AS (SELECT s.q, s.conv_id, s.doc AS seed_id, s.rank AS seed_rank, fe.event_id, evs.topic_id FROM seeds s JOIN fe ON fe.fact_id = s.doc JOIN evs USING (event_id)),
fno AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pos, fact_id) AS fno FROM fe)
"""


def order_fact_event(facts):
    return facts.select(
        "conv_id", F.col("node_id").alias("fact_id"), F.concat(F.col("conv_id"), F.lit(":event:"), F.floor(F.col("pos") / 2).cast("string")).alias("event_id"),
        "pos", (0.6 + (F.col("pos") % 4) / 10.0).alias("edge_confidence"), "text")


def event_table(fact_event):
    rows = fact_event.groupBy("conv_id", "event_id").agg(F.min("pos").alias("p"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return rows.select("conv_id", "event_id", F.concat("conv_id", F.lit(":topic:"), F.floor(F.col("p") / 4).cast("string")).alias("topic_id"),
                       F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


ECOV = "(CASE WHEN len(qt.t) > 0 AND len(et.t) > 0 THEN len(list_intersect(qt.t, et.t))::DOUBLE / len(qt.t) ELSE 0 END)"
EVT_SQL = HIER_SQL + f""",
et AS (SELECT event_id, {term_set_sql('text')} AS t FROM evs),
op AS (SELECT loc.q, loc.conv_id, seed_id, seed_rank, evs.event_id, evs.topic_id, evs.event_id = loc.event_id AS own,
  row_number() OVER (PARTITION BY loc.q, seed_id ORDER BY evs.event_id = loc.event_id DESC, {ECOV} DESC, evs.deg DESC, evs.event_id) AS en
  FROM loc JOIN tds ON tds.topic_id = loc.topic_id AND td <= 160 JOIN evs ON evs.topic_id = loc.topic_id JOIN et ON et.event_id = evs.event_id JOIN qt ON qt.q = loc.q),
hc0 AS (SELECT q, conv_id, seed_id, seed_rank, seed_id AS node_id, event_id, topic_id, 'seed' AS source, 0 AS hop, 1.0::DOUBLE AS ec, 0 AS stage FROM loc
  UNION ALL SELECT loc.q, loc.conv_id, seed_id, seed_rank, f.fact_id, loc.event_id, topic_id, 'same_event', 2, f.ec, 1 FROM loc JOIN fno f ON f.event_id = loc.event_id AND fno <= 30 AND f.fact_id <> seed_id
  UNION ALL SELECT op.q, op.conv_id, seed_id, seed_rank, f.fact_id, op.event_id, topic_id, CASE WHEN own THEN 'same_event' ELSE 'same_topic' END, CASE WHEN own THEN 2 ELSE 4 END, f.ec, 2
    FROM op JOIN fno f ON f.event_id = op.event_id AND fno <= 12 AND f.fact_id <> seed_id WHERE en <= 8),
hc1 AS (SELECT hc0.*, evs.deg, coalesce(h.norm, 0) AS bm25, {COV} AS ov FROM hc0 JOIN evs ON evs.event_id = hc0.event_id JOIN qt ON qt.q = hc0.q JOIN ft ON ft.node_id = hc0.node_id
  LEFT JOIN hits h ON h.q = hc0.q AND h.doc = hc0.node_id),
hc2 AS (SELECT *, (bm25 + 0.8 * (source = 'seed')::INT + CASE source WHEN 'same_event' THEN 0.65 WHEN 'same_topic' THEN 0.35 ELSE 0 END + 0.45 * ov + 0.35 * ec - 0.25 * ln(1 + greatest(deg, 1)) - 0.20 * hop)::DOUBLE AS score FROM hc1),
hc3 AS (SELECT *, row_number() OVER (PARTITION BY q, node_id ORDER BY -round(score, 9), seed_rank, stage, event_id) AS r FROM hc2),
hc AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, node_id) AS rank FROM hc3 WHERE r = 1)"""


def hierarchy_rows(spark, d, mode="event_topic"):
    q, nodes, facts, edges, hits, seeds = seeded(spark, d)
    fact_event = order_fact_event(facts)
    return ex.hierarchy_candidates(seeds, hits, facts, q, fact_event.drop("text"), event_table(fact_event), mode)


@query("event_topic_expansion_X07", "WITH " + EVT_SQL + "SELECT q AS question_id, node_id, source, seed_id, event_id, hop, round(score, 6) AS score, rank::INTEGER AS rank FROM hc WHERE rank <= 100")
def _(spark, d):
    return hierarchy_rows(spark, d).select("question_id", "node_id", "source", "seed_id", "event_id", "hop", F.round("score", 6).alias("score"), "rank")


@query("same_event_expansion_X07", "WITH " + EVT_SQL.replace("WHERE en <= 8)", "WHERE false)") +
       "SELECT q AS question_id, node_id, source, seed_id, round(score, 6) AS score, rank::INTEGER AS rank FROM hc WHERE rank <= 100")
def _(spark, d):
    return hierarchy_rows(spark, d, "same_event").select("question_id", "node_id", "source", "seed_id", F.round("score", 6).alias("score"), "rank")


def _vector_hierarchy(spark, d):
    """Embeddings as facts, groups of six as events, groups of twenty-four as topics."""
    m = vector_members(spark, d)
    fact_event = m.select("conv_id", F.col("member_id").alias("fact_id"), F.col("cluster_id").alias("event_id"), "pos")
    topic = F.concat(F.lit("t"), F.floor(F.col("member_id") / 24).cast("string"))
    ev = hi.mean_vector(m, 64)
    topics = hi.mean_vector(m.withColumn("topic_id", topic), 64, ["conv_id", "topic_id"])
    places = m.select("conv_id", "cluster_id", topic.alias("topic_id")).distinct()
    events = ev.join(places, ["conv_id", "cluster_id"]).select("conv_id", F.col("cluster_id").alias("event_id"), "topic_id", F.col("centroid").alias("vector"))
    queries = hi.mean_vector(m, 64, ["conv_id"]).select(F.concat("conv_id", F.lit(":q0001")).alias("question_id"), "conv_id", F.col("centroid").alias("query_vector"))
    return queries, events, topics.select("conv_id", "topic_id", F.col("centroid").alias("vector")), fact_event


def _hyper_route(queries, events, topics, fact_event):
    """Points are computed once per question, event and topic, not per pair."""
    point = lambda c, s: vx.exp_map(vx.scale(F.col(c), F.lit(s)))
    return ex.topdown_candidates(
        queries.withColumn("query_vector", point("query_vector", 0.72)), events.withColumn("vector", point("vector", 0.6)), topics.withColumn("vector", point("vector", 0.6)), fact_event, ba.lorentz(), "hyp")


def _nmean(keys: str, name: str) -> str:
    return f"""
{name}0 AS (SELECT {keys}, i.i AS i, avg(vector[i.i]) AS x FROM vt CROSS JOIN range(1, 65) i(i) GROUP BY ALL),
{name}1 AS (SELECT {keys}, list(x ORDER BY i) AS r FROM {name}0 GROUP BY ALL),
{name} AS (SELECT {keys}, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS v FROM {name}1)"""


VH_SQL = VM_SQL + """,
vt AS (SELECT *, 't' || (member_id // 24) AS topic_id FROM vm),""" + _nmean("conv_id, topic_id, cluster_id", "ev") + "," + _nmean("conv_id, topic_id", "tp") + "," + _nmean("conv_id", "qv")


def td_sql(score: str, route: str) -> str:
    es, ts = score.format("qv.v", "ev.v"), score.format("qv.v", "tp.v")
    return f"""
{route}ps AS (SELECT conv_id, ev.topic_id, ev.cluster_id AS event_id, {es} AS es FROM qv JOIN ev USING (conv_id)),
{route}be AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(es, 9) DESC, event_id) AS rr FROM {route}ps),
{route}bt0 AS (SELECT conv_id, tp.topic_id, {ts} AS tsc FROM qv JOIN tp USING (conv_id)),
{route}bt AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(tsc, 9) DESC, topic_id) AS tr FROM {route}bt0),
{route}in AS (SELECT p.conv_id, p.topic_id, p.event_id, 0.55 * tsc + 0.45 * es AS qs, tr, row_number() OVER (PARTITION BY p.conv_id, p.topic_id ORDER BY round(es, 9) DESC, event_id) AS er
  FROM {route}ps p JOIN {route}bt b ON b.conv_id = p.conv_id AND b.topic_id = p.topic_id WHERE tr <= 3),
{route}rows AS (
  SELECT conv_id, topic_id, event_id, es AS qs, rr, 0 AS er, '{route}_event' AS route FROM {route}be WHERE rr <= 20
  UNION ALL SELECT conv_id, topic_id, event_id, qs, tr, er, '{route}_topic' FROM {route}in WHERE er <= 3),
{route}f AS (SELECT r.*, vm.member_id AS node_id, row_number() OVER (PARTITION BY r.conv_id, r.route, r.event_id ORDER BY vm.pos) - 1 AS fo FROM {route}rows r JOIN vm ON vm.conv_id = r.conv_id AND vm.cluster_id = r.event_id),
{route}c AS (SELECT *, qs - 0.002 * fo AS bs FROM {route}f WHERE fo < 8)"""


EU, HYP = "list_dot_product({0}, {1})", "-" + ldist_sql("{0}", "{1}")
HYP_SQL = lambda: "-" + ldist_sql("(" + exp_sql("list_transform({0}, lambda x: x * 0.72)") + ")", "(" + exp_sql("list_transform({1}, lambda x: x * 0.6)") + ")")
TD_SELECT = "SELECT conv_id || ':q0001' AS question_id, node_id, event_id, topic_id, route, rr::INTEGER AS route_rank, er::INTEGER AS event_rank, fo::INTEGER AS fact_offset, round(bs, 6)::DOUBLE AS base_score FROM {0}c"
HYP_BODY = HYP_SQL().replace("{0}", "@q").replace("{1}", "@v").replace("{", "{{").replace("}", "}}").replace("@q", "{0}").replace("@v", "{1}")


def td_columns(df):
    return df.select("question_id", "node_id", "event_id", "topic_id", "route", "route_rank", "event_rank", "fact_offset", F.round("base_score", 6).alias("base_score"))


@query("topdown_euclidean_X08", "WITH " + VH_SQL + "," + td_sql(EU, "eu") + TD_SELECT.format("eu"))
def _(spark, d):
    queries, events, topics, fact_event = _vector_hierarchy(spark, d)
    return td_columns(ex.topdown_candidates(queries, events, topics, fact_event, ba.EUCLIDEAN, "eu"))


@query("topdown_hyperbolic_X09", "WITH " + VH_SQL + "," + td_sql(HYP_BODY, "hyp") + TD_SELECT.format("hyp"))
def _(spark, d):
    queries, events, topics, fact_event = _vector_hierarchy(spark, d)
    return td_columns(_hyper_route(queries, events, topics, fact_event))


MERGE_SQL = VH_SQL + "," + td_sql(EU, "eu") + "," + td_sql(HYP_BODY, "hyp") + """,
al AS (SELECT * FROM euc UNION ALL SELECT * FROM hypc),
mg AS (SELECT conv_id, node_id, string_agg(DISTINCT route, '+' ORDER BY route) AS route_source, max(bs) AS base_score, max(qs) AS semantic_score,
  coalesce(min(rr) FILTER (route = 'eu_event'), 0) AS ee, coalesce(min(rr) FILTER (route = 'eu_topic'), 0) AS et, coalesce(min(rr) FILTER (route = 'hyp_event'), 0) AS he, coalesce(min(rr) FILTER (route = 'hyp_topic'), 0) AS ht
  FROM al GROUP BY ALL)"""


def both_routes(spark, d):
    queries, events, topics, fact_event = _vector_hierarchy(spark, d)
    return ex.topdown_candidates(queries, events, topics, fact_event, ba.EUCLIDEAN, "eu").unionByName(
        _hyper_route(queries, events, topics, fact_event))


@query("route_merge_X10", "WITH " + MERGE_SQL + """
SELECT conv_id || ':q0001' AS question_id, node_id, route_source, round(base_score, 6)::DOUBLE AS base_score, round(semantic_score, 6)::DOUBLE AS semantic_score,
 ee::INTEGER AS eu_event_rank, et::INTEGER AS eu_topic_rank, he::INTEGER AS hyp_event_rank, ht::INTEGER AS hyp_topic_rank FROM mg""")
def _(spark, d):
    return ex.merge_routes(both_routes(spark, d)).select(
        "question_id", "node_id", "route_source", F.round("base_score", 6).alias("base_score"), F.round("semantic_score", 6).alias("semantic_score"),
        "eu_event_rank", "eu_topic_rank", "hyp_event_rank", "hyp_topic_rank")


BFS_SQL = EDGES_SQL + """
fl AS (SELECT conv_id, dst AS cur, src AS nxt, 0 AS way, confidence, src || '->' || relation || '->' || dst AS edge FROM edges UNION ALL
       SELECT conv_id, src, dst, 1, confidence, src || '->' || relation || '->' || dst FROM edges),
adj0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, cur ORDER BY confidence DESC, way, edge) AS b FROM fl),
adj AS (SELECT * FROM adj0 WHERE b <= 8),
bf AS (SELECT conv_id, node_id AS start, node_id AS cur, [node_id] AS path, []::BIGINT[] AS trail FROM anchors
  UNION ALL SELECT f.conv_id, f.start, a.nxt, list_append(f.path, a.nxt), list_append(f.trail, a.b) FROM bf f JOIN adj a ON a.conv_id = f.conv_id AND a.cur = f.cur
  WHERE len(f.path) < 4 AND NOT list_contains(f.path, a.nxt)),
term AS (SELECT * FROM bf WHERE len(path) = 4 OR NOT EXISTS (SELECT 1 FROM adj a WHERE a.conv_id = bf.conv_id AND a.cur = bf.cur AND NOT list_contains(bf.path, a.nxt))),
fin AS (SELECT *, row_number() OVER (PARTITION BY conv_id, start ORDER BY len(trail), trail) AS pn FROM term)
"""


@query("bounded_paths_X11", "WITH RECURSIVE " + BFS_SQL + "SELECT conv_id, start, array_to_string(path, '>') AS path, pn::INTEGER AS path_no FROM fin WHERE pn <= 20")
def _(spark, d):
    nodes, edges = graph(spark, d)
    paths = ex.bounded_paths(nodes.filter("type = 'ANCHOR'"), edges)
    return paths.select("conv_id", "start", F.array_join("path", ">").alias("path"), "path_no")


def anchor_paths(spark, d, per_question: int = 5):
    """Anchors close to each question by text and vector, their paths, and all points."""
    nodes, edges = graph(spark, d)
    anchors = nodes.filter("type = 'ANCHOR'")
    q = questions(spark, d)
    vectors = stored("node_vectors", lambda: nd.hash_embedding(nodes, ["node_id"], 31))
    points = vectors.join(nodes.select("conv_id", "node_id", "type", "status", "confidence"), "node_id").select(
        "conv_id", "node_id", "vector", vx.project_node(F.col("vector"), F.col("type"), F.col("status"), F.col("confidence")).alias("point"))
    q_vec = nd.hash_embedding(q.select("question_id", F.col("question").alias("text")), ["question_id"], 31)
    by_text = re_.bm25_top_k(q, anchors, per_question, "question_id", "node_id", "conv_id", query_text="question").select("question_id", "node_id", "rank", F.lit(1).alias("way"))
    by_vector = re_.scoped_top_k(
        q.join(q_vec, "question_id").select("question_id", "conv_id", F.col("vector").alias("query_vector")),
        points.join(anchors.select("conv_id", "node_id"), ["conv_id", "node_id"], "left_semi").select("conv_id", F.col("node_id").alias("item_id"), "vector"),
        vx.dot(F.col("query_vector"), F.col("vector")), per_question).filter("score > 0").select("question_id", F.col("item_id").alias("node_id"), "rank", F.lit(0).alias("way"))
    chosen = ex.top_per(ex.first_per(by_vector.unionByName(by_text), ["question_id", "node_id"], ["way", "rank"], ["way", "rank"]),
                        ["question_id"], [F.asc("way"), F.asc("rank")], per_question, "anchor_no")
    starts = anchors.join(chosen.select("node_id").distinct(), "node_id", "left_semi")
    paths = cut_lineage(ex.bounded_paths(starts, edges))
    wanted = chosen.select("question_id", F.col("node_id").alias("start"), "anchor_no").join(paths, "start").select(
        "question_id", "conv_id", F.concat_ws("#", "start", F.lpad(F.col("path_no").cast("string"), 3, "0")).alias("path_id"), "path", "path_edges")
    q_points = q_vec.select("question_id", vx.project_query(F.col("vector")).alias("query_point"))
    return wanted, nodes, edges, q, points.select("conv_id", "node_id", "point"), q_points


@query("anchor_path_retrieval_X12")
def _(spark, d):
    paths, nodes, edges, q, points, q_points = anchor_paths(spark, d)
    return ex.score_paths(paths, nodes, edges, q, points, q_points).select(
        "question_id", "path_id", F.array_join("path", ">").alias("path"), F.round("score", 6).alias("score"), "rank")


@query("path_scores_X13", "WITH " + SEED_SQL + "," + hash_embedding_sql("nodes", "node_id", "text", 31) + "," +
       hash_embedding_sql("qs", "q", "text", 31).replace("hv AS", "hv2 AS").replace("FROM hv ", "FROM hv2 ").replace("cells AS", "cells2 AS").replace("FROM cells ", "FROM cells2 ").replace("size_ AS", "size2 AS").replace("JOIN size_", "JOIN size2").replace("JOIN cells c", "JOIN cells2 c").replace("grid AS", "grid2 AS").replace("FROM grid ", "FROM grid2 ").replace("vec AS", "vec2 AS") + f""",
st AS (SELECT q, conv_id, doc AS path_id, doc AS node_id FROM seeds UNION ALL SELECT q, conv_id, doc, replace(doc, ':fact:', ':raw:') FROM seeds
       UNION ALL SELECT s.q, s.conv_id, s.doc, a.dst FROM seeds s JOIN e_anchor a ON a.conv_id = s.conv_id AND a.src = s.doc),
sn AS (SELECT st.q, st.conv_id, st.path_id, n.*, {exp_sql('list_transform(v.vector, lambda x: x * sc)')} AS pt FROM st
  JOIN (SELECT node_id AS nid, type, status, text, confidence, (0.45 + CASE type WHEN 'RAW' THEN 0.05 WHEN 'FACT' THEN 0.2 ELSE -0.15 END + CASE status WHEN 'outdated' THEN -0.1 WHEN 'exception' THEN 0.08 WHEN 'disputed' THEN -0.05 ELSE 0 END + 0.2 * confidence)::DOUBLE
    * CASE WHEN type = 'ANCHOR' THEN 0.75 ELSE 1 END AS sc FROM nodes) n ON n.nid = st.node_id JOIN vec v ON v.k = st.node_id),
qp AS (SELECT k AS q, {exp_sql('list_transform(vector, lambda x: x * 0.55)')} AS qp FROM vec2),
ag AS (SELECT sn.q, path_id, list_distinct(flatten(list({term_set_sql('text')}))) AS terms, avg((status = 'active')::INT) AS temporal, avg((type IN ('FACT', 'RAW'))::INT) AS support,
  1 - count(DISTINCT text)::DOUBLE / count(*) AS redundancy, sum(len(string_split(trim(text), ' ')))::BIGINT AS token_cost, avg({ldist_sql('qp.qp', 'sn.pt')}) AS md, count(*) AS n FROM sn JOIN qp ON qp.q = sn.q GROUP BY sn.q, path_id),
cn AS (SELECT c.q, c.path_id, avg(greatest(0, acos(greatest(-1, least(1, list_dot_product(c.pt[2:], p.pt[2:]) / greatest(sqrt(list_dot_product(c.pt[2:], c.pt[2:])) * sqrt(list_dot_product(p.pt[2:], p.pt[2:])), 1e-7)))) - (0.1 + (1 - p.confidence) * 0.9))) AS vi
  FROM sn c JOIN e_anchor e ON e.src = c.nid JOIN sn p ON p.q = c.q AND p.path_id = c.path_id AND p.nid = e.dst GROUP BY ALL),
fs AS (SELECT ag.q, ag.path_id, (CASE WHEN len(qt.t) > 0 AND len(terms) > 0 THEN len(list_intersect(qt.t, terms))::DOUBLE / len(qt.t) ELSE 0 END + 0.7 * (0.5 / (1 + md) + 0.5 / (1 + coalesce(vi, 0)))
  + 0.3 * temporal + 0.5 * support - 0.25 * redundancy - 0.002 * token_cost - 0.05 * n)::DOUBLE AS score
  FROM ag JOIN (SELECT q, {term_set_sql('text')} AS t FROM qs) qt ON qt.q = ag.q LEFT JOIN cn ON cn.q = ag.q AND cn.path_id = ag.path_id)
SELECT q AS question_id, path_id, round(score, 5) AS score FROM fs""")
def _(spark, d):
    q, nodes, facts, edges, hits, seeds = seeded(spark, d)
    up = ex.anchor_links(edges, nodes).groupBy("conv_id", F.col("fact_id").alias("node_id")).agg(F.array_sort(F.collect_list("anchor_id")).alias("anchors"))
    none = F.array().cast("array<string>")
    paths = seeds.join(up, ["conv_id", "node_id"], "left").select(
        "question_id", "conv_id", F.col("node_id").alias("path_id"),
        F.concat(F.array("node_id", F.regexp_replace("node_id", ":fact:", ":raw:")), F.coalesce("anchors", none)).alias("path"),
        F.array(F.concat(F.col("node_id"), F.lit("->SUPPORTS->"), F.regexp_replace("node_id", ":fact:", ":raw:"))).alias("path_edges"))
    points = nd.hash_embedding(nodes, ["node_id"], 31).join(nodes.select("conv_id", "node_id", "type", "status", "confidence"), "node_id").select(
        "conv_id", "node_id", vx.project_node(F.col("vector"), F.col("type"), F.col("status"), F.col("confidence")).alias("point"))
    q_points = nd.hash_embedding(q.select("question_id", F.col("question").alias("text")), ["question_id"], 31).select("question_id", vx.project_query(F.col("vector")).alias("query_point"))
    return ex.score_paths(paths, nodes, edges, q, points, q_points, SEEDS).select("question_id", "path_id", F.round("score", 5).alias("score"))


@query("maximal_marginal_relevance_X14", "WITH RECURSIVE " + SEED_SQL + f""",
cd AS (SELECT q, doc, norm AS score, rank, {term_set_sql('text')} AS t FROM hits JOIN facts f ON f.node_id = doc),
mm AS (SELECT q, 1 AS k, arg_min(doc, (-score, rank)) AS doc, [arg_min(doc, (-score, rank))] AS picked FROM cd GROUP BY q
  UNION ALL
  SELECT x.q, x.k + 1, arg_min(x.cdoc, (-x.v, x.rank)), list_append(any_value(x.picked), arg_min(x.cdoc, (-x.v, x.rank))) FROM (
    SELECT m.q, m.k, m.picked, c.doc AS cdoc, c.rank, c.score - 0.3 * max({jaccard_sql('c.t', 'p.t')}) AS v
    FROM mm m JOIN cd c ON c.q = m.q AND NOT list_contains(m.picked, c.doc) JOIN cd p ON p.q = m.q AND list_contains(m.picked, p.doc) WHERE m.k < 3 GROUP BY m.q, m.k, m.picked, c.doc, c.rank, c.score
    ) x GROUP BY x.q, x.k)
SELECT q AS question_id, doc AS node_id, k::INTEGER AS mmr_rank FROM mm""")
def _(spark, d):
    _, _, facts, hits = found(spark, d)
    rows = hits.join(facts.select("node_id", tx.term_set("text").alias("terms")), "node_id").select("question_id", "node_id", F.col("norm").alias("score"), "rank", "terms")
    return re_.mmr_select(rows, 3).select("question_id", "node_id", "mmr_rank")


@query("source_calibration_X15", "WITH " + SIB_SQL + """,
ca AS (SELECT q, node_id, (((length(node_id) * 7 + rank) % 10) / 10.0::DOUBLE + 0.15 * bm25 + 0.08 * eo + CASE WHEN is_seed THEN 0.18 ELSE 0.10 END + 0.04 * edge - 0.06 * ln(1 + degree) - 0.08 * hop)::DOUBLE AS c FROM sib WHERE rank <= 100),
cr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(c, 9) DESC, node_id) AS r FROM ca)
SELECT q AS question_id, node_id, round(c, 6) AS calibrated, r::INTEGER AS calibrated_rank FROM cr WHERE r <= 20""")
def _(spark, d):
    rows = sibling_rows(spark, d).withColumn("ce", ((F.length("node_id") * 7 + F.col("rank")) % 10) / 10.0).withColumn("source", F.lit("filtered_sibling"))
    return ex.calibrate(rows.drop("rank"), 20).select("question_id", "node_id", F.round("calibrated", 6).alias("calibrated"), F.col("rank").alias("calibrated_rank"))


@query("external_rerank_X16", "WITH " + SEED_SQL + """,
px AS (SELECT q, doc, norm, (length(doc) * 13 + rank * 7) % 11 / 11.0::DOUBLE AS ps FROM hits),
py AS (SELECT *, min(ps) OVER w AS mn, max(ps) OVER w AS mx, avg(ps) OVER w AS av, row_number() OVER (PARTITION BY q ORDER BY ps DESC, doc) AS r FROM px WINDOW w AS (PARTITION BY q))
SELECT q AS question_id, doc AS node_id, round(norm, 6) AS base, round(ps, 6) AS pair_score, round(mn, 6) AS min_score, round(mx, 6) AS max_score, round(av, 6) AS mean_score, r::INTEGER AS rerank_rank FROM py WHERE r <= 20""")
def _(spark, d):
    hits = found(spark, d)[3]
    scores = hits.select("question_id", "node_id", (((F.length("node_id") * 13 + F.col("rank") * 7) % 11) / 11.0).alias("pair_score"))
    rows = ex.rerank(hits.select("question_id", "node_id", F.col("norm").alias("base")), scores, 20)
    return rows.select("question_id", "node_id", *[F.round(c, 6).alias(c) for c in ("base", "pair_score", "min_score", "max_score", "mean_score")], "rerank_rank")


@query("path_texts_X17", "WITH " + SEED_SQL + """
SELECT q AS question_id, doc AS path_id, '[FACT] ' || f.text || chr(10) || '[RAW] ' || r.text AS text FROM seeds JOIN facts f ON f.node_id = doc JOIN raws r ON r.node_id = f.raw_id""")
def _(spark, d):
    _, nodes, _, hits = found(spark, d, SEEDS)
    seeds = hits.filter(F.col("rank") <= SEEDS)
    raw = F.regexp_replace("node_id", ":fact:", ":raw:")
    paths = seeds.select("question_id", "conv_id", F.col("node_id").alias("path_id"), F.col("node_id").alias("evidence_id"), F.array(raw, F.col("node_id"), raw).alias("path"))
    return ex.path_texts(paths, nodes).select("question_id", "path_id", "text")


@query("four_route_fusion_X18", "WITH " + MERGE_SQL + """,
bu AS (SELECT conv_id, member_id AS node_id, row_number() OVER (PARTITION BY conv_id ORDER BY member_id DESC) AS br, cluster_id AS event_id FROM vm),
al2 AS (SELECT conv_id, node_id, route, rr, bs FROM al UNION ALL SELECT conv_id, node_id, 'bottom_up', br, 1.0::DOUBLE / br FROM bu WHERE br <= 30),
m2 AS (SELECT conv_id, node_id, string_agg(DISTINCT route, '+' ORDER BY route) AS route_source, max(bs) AS bs,
  min(rr) FILTER (route IN ('eu_event', 'eu_topic')) AS er, min(rr) FILTER (route IN ('hyp_event', 'hyp_topic')) AS hr, min(rr) FILTER (route = 'bottom_up') AS br FROM al2 GROUP BY ALL),
m3 AS (SELECT *, coalesce(1.0::DOUBLE / (60 + er), 0) + coalesce(1.0::DOUBLE / (60 + hr), 0) + coalesce(1.0::DOUBLE / (60 + br), 0) AS rrf FROM m2),
m4 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(rrf, 12) DESC, round(bs, 9) DESC, node_id) AS fr FROM m3)
SELECT conv_id || ':q0001' AS question_id, node_id, route_source, round(rrf, 9) AS rrf, fr::INTEGER AS fused_rank FROM m4 WHERE fr <= 150""")
def _(spark, d):
    m = vector_members(spark, d)
    ranked = ex.top_per(m, ["conv_id"], [F.desc("member_id")], 30)
    bottom = ex.bottom_up_route(ranked.select(
        F.concat("conv_id", F.lit(":q0001")).alias("question_id"), "conv_id", F.col("member_id").alias("node_id"), F.col("cluster_id").alias("event_id"),
        F.lit("").alias("topic_id"), (1.0 / F.col("rank")).alias("score"), "rank"))
    rows = both_routes(spark, d)
    fused = ex.fuse_routes(ex.merge_routes(rows.unionByName(bottom.select(rows.columns))))
    return fused.select("question_id", "node_id", "route_source", F.round("rrf", 9).alias("rrf"), "fused_rank")


@query("reciprocal_rank_fusion_X19", """
SELECT event_id, round(CASE WHEN user_id % 7 > 0 THEN 1.0::DOUBLE / (60 + user_id % 7) ELSE 0 END + CASE WHEN event_id % 5 > 0 THEN 1.0::DOUBLE / (60 + event_id % 5) ELSE 0 END
 + CASE WHEN event_id % 11 > 0 THEN 1.0::DOUBLE / (60 + event_id % 11) ELSE 0 END, 9) AS rrf FROM events""")
def _(spark, d):
    e = tb.table(spark, d, "events")
    return e.select("event_id", F.round(re_.reciprocal_rank(F.col("user_id") % 7, F.col("event_id") % 5, F.col("event_id") % 11), 9).alias("rrf"))
