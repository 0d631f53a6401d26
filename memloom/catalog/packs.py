"""Reconstruction queries: contracts, quotes, units, packs and reader tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.catalog import query
from memloom.catalog.edges import graph_nodes
from memloom.catalog.expansion import SEED_SQL, found, questions
from memloom.catalog.temporal import _pick
from memloom.operators import packs as pk
from memloom.operators.ordering import top_per
from memloom.plans.answer import evidence_packs
from memloom.sources import tables as tb

# Twelve question shapes over customers, with their operation.
SHAPES = ["Do we know the balance of {c}?", "What did you recommend for {c}?", "How many orders has {c}?", "What is the latest order of {c}?", "When did {c} buy it?", "What is the favorite color of {c}?",
          "Compare {c} and Bob", "What were the gifts of {c}?", "Tell me everything across sessions about {c} in total", "Where lives {c}?", "How long ago did {c} pay and how many days passed?", "Would {c} likely spend money?"]
OPS = ["answerability", "assistant_recall", "count", "update", "temporal", "preference", "compare", "list", "aggregate", "lookup", "temporal", "lookup"]
OPS[10] = "count"
SQL_SHAPES = "[" + ", ".join("'" + s.replace("{c}", "@") + "'" for s in SHAPES) + "]"
ASK_SQL = f"asked AS (SELECT c_custkey AS question_id, c_custkey % 12 AS k, replace({SQL_SHAPES}[c_custkey % 12 + 1], '@', 'Ann' || repeat('a', (c_custkey % 5)::BIGINT)) AS question FROM customer)"


def asked(spark, d):
    c = tb.table(spark, d, "customer")
    name = F.concat(F.lit("Ann"), F.repeat(F.lit("a"), (F.col("c_custkey") % 5).cast("int")))
    shape = _pick([s.replace("{c}", "@") for s in SHAPES], F.col("c_custkey") % 12)
    return c.select(F.col("c_custkey").alias("question_id"), F.replace(shape, F.lit("@"), name).alias("question"))


def _slots(op):
    return "|".join(s[0] for s in pk.SLOTS[op])


def _by_shape(values):
    return "[" + ", ".join("'" + str(v) + "'" for v in values) + "][k + 1]"


@query("query_contract_P01", "WITH " + ASK_SQL + f"""
SELECT question_id, {_by_shape(OPS)} AS operation, {_by_shape([_slots(o) for o in OPS])} AS slots, CASE WHEN k = 1 THEN 'assistant' ELSE 'user' END AS target_speaker, k IN (6, 8) AS needs_multiple_sessions,
 {_by_shape(['historical' if False else 'unspecified', 'unspecified', 'unspecified', 'latest', 'relative_or_event_time'] + ['unspecified'] * 7)} AS temporal_mode_base, k IN (1, 2, 3, 4, 7, 10) AS needs_raw_quote,
 (CASE WHEN k IN (9, 11) THEN 0.72 ELSE 0.92 END)::DOUBLE AS confidence FROM asked""".replace("temporal_mode_base", "temporal_mode").replace("'unspecified', 'unspecified', 'unspecified', 'latest'", "'latest', 'unspecified', 'unspecified', 'latest'"))
def _(spark, d):
    c = pk.query_contract(asked(spark, d))
    return c.select("question_id", "operation", F.array_join(F.transform("slots", lambda s: s["slot_id"]), "|").alias("slots"), "target_speaker", "needs_multiple_sessions", "temporal_mode", "needs_raw_quote", "confidence")


@query("named_speaker_contract_P02", "WITH " + ASK_SQL + """, w AS (SELECT question_id, list_filter(regexp_extract_all(question, '[\\p{L}\\p{N}_]+'), lambda t: regexp_full_match(t, '[A-Z][a-z]+')
 AND NOT list_contains(['After','Before','Did','Does','How','If','In','On','What','When','Where','Which','Who','Why','Would'], t)) AS n FROM asked)
SELECT question_id, 'any' AS target_speaker, array_to_string(list_filter(n, lambda t, i: list_position(n, t) = i), '|') AS entities FROM w""")
def _(spark, d):
    return pk.query_contract(asked(spark, d), named_speakers=True).select("question_id", "target_speaker", F.array_join("target_entities", "|").alias("entities"))


QUOTE_SQL = SEED_SQL + """,
qd AS (SELECT f.conv_id, f.node_id, r.node_id AS message_id, r.text, r.speaker, r.session_id, r.pos, f.text AS claim FROM facts f JOIN raws r ON r.conv_id = f.conv_id AND r.node_id = f.raw_id),
qc AS (SELECT q.conv_id, q.node_id, p.node_id AS message_id, p.text, CASE WHEN q.speaker = 'assistant' THEN 'request_pair' ELSE 'antecedent_context' END AS kind FROM qd q JOIN raws p ON p.conv_id = q.conv_id AND p.session_id = q.session_id AND p.pos = q.pos - 1
  WHERE q.speaker = 'assistant' OR regexp_matches(regexp_replace(q.claim, '[À-ÖØ-öø-ÿ]', 'z', 'g'), '(?i)\\b(it|this|that|these|those|they|them|he|she)\\b')),
qa AS (SELECT conv_id, node_id, 0 AS quote_no, message_id, CASE WHEN length(text) > 1800 THEN rtrim(left(text, 1780)) || ' [quote truncated]' ELSE text END AS text, kind FROM qc
  UNION ALL SELECT conv_id, node_id, 1, message_id, CASE WHEN length(text) > 3200 THEN rtrim(left(text, 3180)) || ' [quote truncated]' ELSE text END, 'direct' FROM qd)"""


@query("support_closure_P03", "WITH " + QUOTE_SQL + " SELECT node_id, quote_no::INTEGER AS quote_no, message_id, text, kind AS support_kind FROM qa")
def _(spark, d):
    nodes = graph_nodes(spark, d)
    return pk.support_quotes(nodes.filter("type = 'FACT'"), nodes).select("node_id", "quote_no", "message_id", "text", "support_kind")


def _candidates(spark, d):
    """The best 100 BM25 hits of a conversation's question as candidates with a route and a role."""
    _, nodes, _, hits = found(spark, d, 100)
    route = _pick(["eu_event", "eu_event+hyp_event", "bottom_up,eu_topic+hyp_topic"], F.col("rank") % 3)
    rows = hits.select("question_id", "conv_id", "node_id", "rank", route.alias("route_source"), F.col("norm").alias("ce"), F.when(F.col("rank") % 4 == 0, "old_state").alias("role"))
    return rows, nodes


UNIT_SQL = QUOTE_SQL + """,
un AS (SELECT h.q, h.conv_id, 'unit:' || h.doc AS unit_id, h.doc AS node_id, h.rank, f.text AS claim, f.speaker, f.session_id, h.norm AS ce, [1, 2, 3][h.rank % 3 + 1] AS routes, CASE WHEN h.rank % 4 = 0 THEN 'old_state' END AS role,
  (SELECT string_agg(message_id, '|' ORDER BY quote_no) FROM qa WHERE qa.node_id = h.doc) AS mids, greatest(1, ceil((length(f.text) + (SELECT sum(length(text)) FROM qa WHERE qa.node_id = h.doc)) / 4.0))::BIGINT AS token_cost
  FROM hits h JOIN facts f ON f.node_id = h.doc WHERE h.rank <= 50)"""


def units(spark, d):
    rows, nodes = _candidates(spark, d)
    return pk.evidence_units(rows, nodes)


@query("evidence_units_P04", "WITH " + UNIT_SQL + " SELECT unit_id, claim, speaker, session_id, mids AS raw_message_ids, token_cost, round(routes / 6.0, 6)::DOUBLE AS route_agreement, rank::INTEGER AS rank FROM un")
def _(spark, d):
    return units(spark, d).select("unit_id", "claim", "speaker", "session_id", F.array_join("raw_message_ids", "|").alias("raw_message_ids"), "token_cost", F.round("route_agreement", 6).alias("route_agreement"), "rank")


def _contracts(spark, d):
    """One contract per conversation, cycling through the question shapes."""
    q = tb.turns(spark, d).select("conv_id").distinct()
    number = F.regexp_extract("conv_id", "([0-9]+)", 1).cast("bigint")
    asked_ = q.select(F.concat("conv_id", F.lit(":q0001")).alias("question_id"), F.replace(_pick([s.replace("{c}", "@") for s in SHAPES], number % 12), F.lit("@"), F.lit("Ann")).alias("question"))
    return pk.query_contract(asked_)


COVER_SQL = UNIT_SQL + """,
ct AS (SELECT DISTINCT conv_id || ':q0001' AS q, substr(conv_id, 2)::BIGINT % 12 AS k FROM turns),
cv AS (SELECT un.*, k, CASE WHEN k = 1 THEN 'assistant' ELSE 'user' END AS target, CASE k WHEN 0 THEN ['direct_support'] WHEN 1 THEN CASE WHEN speaker = 'assistant' THEN ['assistant_response'] ELSE []::VARCHAR[] END WHEN 2 THEN ['counted_items'] WHEN 10 THEN ['counted_items']
  WHEN 3 THEN CASE WHEN role = 'old_state' THEN ['previous_state', 'change_time'] ELSE ['current_state', 'change_time'] END WHEN 4 THEN ['event', 'time_anchor'] WHEN 5 THEN ['preference', 'constraints'] WHEN 6 THEN ['left_item', 'right_item'] WHEN 7 THEN ['items'] WHEN 8 THEN ['items'] ELSE ['answer'] END AS covered
  FROM un JOIN ct USING (q))"""


def covered(spark, d):
    return pk.slot_coverage(units(spark, d), _contracts(spark, d))


@query("slot_coverage_P05", "WITH " + COVER_SQL + " SELECT unit_id, array_to_string(covered, '|') AS covered FROM cv")
def _(spark, d):
    return covered(spark, d).select("unit_id", F.array_join("covered", "|").alias("covered"))


def selected(spark, d, budget=400):
    return pk.select_within_budget(covered(spark, d), budget)


BUDGET_SQL = COVER_SQL + """,
od AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY speaker <> target, rank) AS o, lower(claim) || '#' || mids AS fp FROM cv),
bs AS (SELECT q, 1 AS o, unit_id, token_cost AS used, true AS kept, [fp] AS seen FROM od WHERE o = 1
  UNION ALL SELECT od.q, od.o, od.unit_id, CASE WHEN bs.used + od.token_cost > 400 OR list_contains(bs.seen, fp) THEN bs.used ELSE bs.used + od.token_cost END, NOT (bs.used + od.token_cost > 400 OR list_contains(bs.seen, fp)),
   CASE WHEN bs.used + od.token_cost > 400 THEN bs.seen ELSE list_append(bs.seen, fp) END FROM bs JOIN od ON od.q = bs.q AND od.o = bs.o + 1),
sl AS (SELECT cv.*, bs.used FROM cv JOIN bs ON bs.q = cv.q AND bs.unit_id = cv.unit_id WHERE kept)"""


@query("budgeted_selection_P06", "WITH RECURSIVE " + BUDGET_SQL + " SELECT q AS question_id, unit_id, used::BIGINT AS used FROM sl")
def _(spark, d):
    return selected(spark, d).select("question_id", "unit_id", "used")


PACK_SQL = BUDGET_SQL + """,
pa AS (SELECT ct.q, ct.k, list_sort(list_distinct(flatten(list(covered)))) AS cs, count(*) FILTER (speaker = target) AS onsp, count(DISTINCT session_id) AS se, sum(token_cost)::BIGINT AS tc, count(*) AS n FROM ct JOIN sl ON sl.q = ct.q GROUP BY ct.q, ct.k),
pb AS (SELECT *, [['direct_support'],['assistant_response'],['counted_items'],['current_state'],['event','time_anchor'],['preference'],['left_item','right_item'],['items'],['items'],['answer'],['counted_items'],['answer']][k + 1] AS req FROM pa),
pc AS (SELECT *, list_concat(list_filter(req, lambda r: NOT list_contains(cs, r)), list_concat(CASE WHEN k IN (6, 8) AND se < 2 THEN ['distinct_sessions'] ELSE []::VARCHAR[] END, CASE WHEN onsp = 0 THEN ['speaker:' || CASE WHEN k = 1 THEN 'assistant' ELSE 'user' END] ELSE []::VARCHAR[] END)) AS ms FROM pb),
pd AS (SELECT *, CASE WHEN len(ms) = 0 THEN 'SUPPORTED' WHEN len(cs) > 0 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS ans FROM pc)"""


def packs(spark, d):
    s = selected(spark, d)
    return s, pk.assemble_packs(s, _contracts(spark, d))


@query("pack_assembly_P07", "WITH RECURSIVE " + PACK_SQL + " SELECT q AS question_id, array_to_string(cs, '|') AS covered_slots, array_to_string(ms, '|') AS missing_slots, ans AS answerability, se AS sessions, tc AS token_cost, n AS units FROM pd")
def _(spark, d):
    return packs(spark, d)[1].select("question_id", F.array_join("covered_slots", "|").alias("covered_slots"), F.array_join("missing_slots", "|").alias("missing_slots"), "answerability", "sessions", "token_cost", "units")


@query("evidence_groups_P07", "WITH RECURSIVE " + BUDGET_SQL + ", g AS (SELECT q, unnest(covered) AS slot_id, rank, unit_id FROM sl) SELECT q AS question_id, slot_id, string_agg(unit_id, '|' ORDER BY rank) AS unit_ids FROM g GROUP BY ALL")
def _(spark, d):
    return pk.evidence_groups(selected(spark, d)).select("question_id", "slot_id", F.array_join("unit_ids", "|").alias("unit_ids"))


@query("pack_rendering_P08")
def _(spark, d):
    return pk.render_packs(selected(spark, d), with_quotes=True, max_chars=3000)


@query("pack_summary_P09", "WITH RECURSIVE " + PACK_SQL + """ SELECT count(*) AS packs, count(*) FILTER (ans = 'SUPPORTED') AS supported, count(*) FILTER (ans = 'PARTIALLY_SUPPORTED') AS partially_supported, count(*) FILTER (ans = 'UNSUPPORTED') AS unsupported,
 round(avg(n), 6) AS avg_units, round(avg(tc), 6) AS avg_tokens, 1.0::DOUBLE AS grounded_ratio FROM pd""")
def _(spark, d):
    s = pk.pack_summary(packs(spark, d)[1])
    return s.withColumn("avg_units", F.round("avg_units", 6)).withColumn("avg_tokens", F.round("avg_tokens", 6))


def records(spark, d):
    """The best 100 BM25 hits as ranked paths seed → raw with card columns derived from its rank."""
    rows, nodes = _candidates(spark, d)
    r = F.col("rank")
    paths = rows.select(
        "question_id", "conv_id", "rank", F.array(F.regexp_replace("node_id", ":fact:", ":raw:"), F.col("node_id")).alias("node_ids"), (r % 3 == 1).alias("is_card"), (r % 5 == 0).alias("quota"),
        F.round("ce", 6).alias("cardce"), F.lit(0.0).alias("selector"), F.lit(0.5).alias("ce"), F.when(r % 4 == 1, "Ann").alias("card_entity"), F.when(r % 2 == 0, "state").alias("card_type"),
        F.concat(F.lit("card"), (r % 2).cast("string")).alias("card_key"), F.lit("").alias("event_id"))
    return pk.evidence_records(paths, nodes), nodes


REC_SQL = SEED_SQL + """,
rec AS (SELECT h.q, h.conv_id, h.rank, h.doc AS node_id, round(h.norm, 6) AS cardce, h.rank % 3 = 1 AS is_card, h.rank % 5 = 0 AS quota, f.raw_id, f.session_id, f.pos, f.text, f.time FROM hits h JOIN facts f ON f.node_id = h.doc WHERE h.rank <= 100)"""


@query("evidence_records_P10", "WITH " + REC_SQL + " SELECT q AS question_id, node_id, rank::INTEGER AS rank, text AS claim, time, raw_id AS raw_ids FROM rec")
def _(spark, d):
    return records(spark, d)[0].select("question_id", "node_id", "rank", "claim", "time", F.array_join("raw_ids", "|").alias("raw_ids"))


@query("key_records_P11", "WITH " + REC_SQL + ", ky AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(3 * quota::INT + is_card::INT + 1.0::DOUBLE / greatest(rank, 1), 9) DESC, cardce DESC, rank) AS r FROM rec) SELECT q AS question_id, node_id, rank::INTEGER AS rank FROM ky WHERE r <= 4")
def _(spark, d):
    return pk.key_records(records(spark, d)[0], 4).select("question_id", "node_id", "rank")


WINDOW_SQL = REC_SQL + """,
pl AS (SELECT conv_id, session_id, node_id, row_number() OVER (PARTITION BY conv_id, session_id ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY conv_id, session_id) AS turns FROM raws),
sp AS (SELECT q, pl.conv_id, pl.session_id, rank, greatest(0, place - 1) AS s, least(turns, place + 2) AS e FROM rec JOIN pl ON pl.node_id = rec.raw_id ),
fl AS (SELECT *, max(e) OVER (PARTITION BY q, session_id ORDER BY s, e, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
il AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY q, session_id ORDER BY s, e, rank ROWS UNBOUNDED PRECEDING) AS island FROM fl),
wi AS (SELECT q, conv_id, session_id, island, min(s) AS s, max(e) AS e, min(rank) AS mr FROM il GROUP BY ALL),
wr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY mr, s, e, session_id) AS wn FROM wi)"""


@query("message_windows_P12", "WITH " + WINDOW_SQL + " SELECT wr.q AS question_id, wr.session_id, wn::INTEGER AS window_no, s::BIGINT AS \"start\", e::BIGINT AS \"end\", mr::INTEGER AS min_rank, pl.node_id FROM wr JOIN pl ON pl.conv_id = wr.conv_id AND pl.session_id = wr.session_id AND place >= s AND place < e WHERE wn <= 12")
def _(spark, d):
    rows, nodes = records(spark, d)
    return pk.message_windows(rows, nodes.filter("type = 'RAW'"), 1).select("question_id", "session_id", "window_no", "start", "end", "min_rank", "node_id")


@query("message_chunks_P13", "WITH " + REC_SQL + ", ch AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY substr(session_id, 2)::INT, pos, raw_id) AS c FROM rec) SELECT q AS question_id, raw_id AS node_id, rank::INTEGER AS rank, c::INTEGER AS chunk_no FROM ch WHERE c <= 24")
def _(spark, d):
    rows, nodes = records(spark, d)
    return pk.message_chunks(rows, nodes.filter("type = 'RAW'")).select("question_id", "node_id", "rank", "chunk_no")


@query("grouped_facts_P14", "WITH " + REC_SQL + ", g AS (SELECT *, CASE WHEN rank % 4 = 1 THEN 'Ann' WHEN rank % 2 = 0 THEN 'state' ELSE 'ungrouped' END AS fg FROM rec) SELECT q AS question_id, fg AS fact_group, min(rank) OVER (PARTITION BY q, fg)::INTEGER AS group_rank, rank::INTEGER AS rank, node_id FROM g")
def _(spark, d):
    return pk.grouped_facts(records(spark, d)[0])


@query("relation_card_table_P15", "WITH " + REC_SQL + """, g AS (SELECT q, 'card' || (rank % 2) AS card_key, max(cardce) AS cardce, count(*) AS facts, string_agg(node_id, '|' ORDER BY rank) AS fact_ids, string_agg(raw_id, '|' ORDER BY rank) AS raw_ids FROM rec WHERE is_card GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cardce DESC, facts DESC, card_key) AS n FROM g) SELECT q AS question_id, card_key, cardce, facts, fact_ids, raw_ids, n::INTEGER AS card_no FROM r WHERE n <= 8""")
def _(spark, d):
    return pk.relation_cards(records(spark, d)[0])


@query("entity_summaries_P16", "WITH " + REC_SQL + """, ef AS (SELECT conv_id, conv_id || ':' || speaker AS e, 'ENTITY' AS ty, node_id AS f FROM facts UNION ALL SELECT conv_id, conv_id || ':' || speaker || ':' || session_id, 'ENTITY_STATE', node_id FROM facts),
sz AS (SELECT e, count(DISTINCT f) AS fc FROM ef GROUP BY e), ov AS (SELECT q, e, ty, count(*) AS o FROM rec JOIN ef ON ef.f = rec.node_id GROUP BY ALL),
r AS (SELECT ov.*, fc, row_number() OVER (PARTITION BY q ORDER BY ty = 'ENTITY_STATE' DESC, o DESC, fc DESC, ov.e) AS n FROM ov JOIN sz ON sz.e = ov.e) SELECT q AS question_id, e AS entity_node_id, o AS overlap, fc AS fact_count, n::INTEGER AS entity_no FROM r WHERE n <= 14""")
def _(spark, d):
    rows, nodes = records(spark, d)
    facts = nodes.filter("type = 'FACT'")
    entity = F.concat_ws(":", "conv_id", "speaker")
    pairs = facts.select("conv_id", entity.alias("entity_node_id"), F.lit("ENTITY").alias("entity_type"), F.col("node_id").alias("fact_id")).unionByName(
        facts.select("conv_id", F.concat_ws(":", entity, F.col("session_id")).alias("entity_node_id"), F.lit("ENTITY_STATE").alias("entity_type"), F.col("node_id").alias("fact_id")))
    return pk.entity_summaries(rows, pairs).select("question_id", "entity_node_id", "overlap", "fact_count", "entity_no")


CLASSES = ["detail", "detail", "count", "detail", "temporal", "detail", "detail", "detail", "detail", "detail", "temporal", "inference"]


@query("question_classes_P17", "WITH " + ASK_SQL + f"""
SELECT question_id, {_by_shape(['detail', 'detail', 'count', 'detail', 'temporal', 'detail', 'detail', 'detail', 'detail', 'detail', 'count', 'inference'])} AS count_first, {_by_shape(CLASSES)} AS temporal_first,
 {_by_shape(['other', 'detail', 'count', 'detail', 'temporal', 'detail', 'other', 'other', 'other', 'detail', 'count', 'inference'])} AS with_other FROM asked""")
def _(spark, d):
    q = F.col("question")
    return asked(spark, d).select("question_id", pk.question_class(q).alias("count_first"), pk.question_class(q, temporal_first=True).alias("temporal_first"), pk.question_class(q, with_other=True).alias("with_other"))


@query("answer_operation_P18", "WITH " + ASK_SQL + f"SELECT question_id, {_by_shape(['detail', 'detail', 'item-count', 'detail', 'temporal', 'detail', 'detail', 'detail', 'detail', 'detail', 'duration-total', 'money-total'])} AS operation, k = 1 AS recommendation FROM asked")
def _(spark, d):
    return asked(spark, d).select("question_id", pk.answer_operation(F.col("question")).alias("operation"), pk.is_recommendation(F.col("question")).alias("recommendation"))


@query("quantity_tables_P19", "WITH " + ASK_SQL + """,
oo AS (SELECT o_custkey AS q, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders),
t AS (SELECT q, rank, o_orderdate, o_orderkey, CASE WHEN k = 11 AND o_orderkey % 3 > 0 THEN '$' || o_orderkey || '.50, $7' WHEN k = 10 THEN CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 9 = 3 THEN '3 days, 2 weeks' ELSE (o_orderkey % 9) || ' days, 2 weeks, 3 days' END WHEN 1 THEN NULL ELSE '4 hours' END END AS qty,
  CASE WHEN k = 2 THEN (o_orderkey % 2 = 0)::INT END AS ov, k FROM oo JOIN asked ON question_id = q),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN k = 4 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END, rank) AS n FROM t WHERE (k IN (10, 11) AND qty IS NOT NULL) OR (k = 2 AND (ov > 0 OR rank <= 8)) OR k = 4)
SELECT q AS question_id, CASE k WHEN 11 THEN 'money-total' WHEN 10 THEN 'duration-total' WHEN 2 THEN 'item-count' ELSE 'temporal' END AS operation, n::INTEGER AS row_no, rank::INTEGER AS rank, qty AS quantities, ov::INTEGER AS overlap FROM r WHERE n <= 14""")
def _(spark, d):
    o = top_per(tb.table(spark, d, "orders"), ["o_custkey"], [F.asc("o_orderkey")], 1 << 30)
    key, k = F.col("o_orderkey"), F.col("o_custkey") % 12
    money = F.when(key % 3 > 0, F.concat(F.lit("paid $ "), key.cast("string"), F.lit(".50 then $7"))).otherwise("paid nothing")
    time = F.when(key % 3 == 0, F.concat((key % 9).cast("string"), F.lit(" days and two weeks on a three-day-long trip"))).when(key % 3 == 1, "a while").otherwise("four hours")
    item = F.when(key % 2 == 0, "many orders here").otherwise("nothing")
    rows = o.select(F.col("o_custkey").alias("question_id"), "rank", F.when(k == 11, money).when(k == 10, time).when(k == 2, item).otherwise("x").alias("text"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("time"))
    return pk.quantity_rows(rows, asked(spark, d))


@query("context_mode_P20", "WITH " + ASK_SQL + """ SELECT question_id, CASE WHEN question_id % 2 = 0 THEN CASE WHEN k IN (2, 4, 10) THEN 'compiled' ELSE 'raw' END ELSE 'summary' END AS mode, CASE WHEN length(question) > 30 THEN left(question, 30) || chr(10) || chr(10) || '[context truncated]' ELSE question END AS context FROM asked""")
def _(spark, d):
    mode = F.when(F.col("question_id") % 2 == 0, "hybrid").otherwise("summary")
    return asked(spark, d).select("question_id", pk.context_mode(mode, F.col("question")).alias("mode"), pk.cut_context(F.col("question"), 30).alias("context"))


@query("extraction_budget_P21", "WITH " + REC_SQL + """, b AS (SELECT q, rank, 2 + sum(length(text) + 1) OVER (PARTITION BY q ORDER BY rank ROWS UNBOUNDED PRECEDING) AS e FROM rec), o AS (SELECT *, max((rank > 1 AND e > 900)::INT) OVER (PARTITION BY q ORDER BY rank ROWS UNBOUNDED PRECEDING) AS st FROM b)
SELECT q AS question_id, rank::INTEGER AS rank, e::BIGINT AS "end" FROM o WHERE st = 0""")
def _(spark, d):
    rows = records(spark, d)[0].select("question_id", "rank", F.col("claim").alias("chunk"))
    return pk.extraction_budget(rows, 900).select("question_id", "rank", "end")


@query("evidence_path_rows_P22", "WITH " + REC_SQL + " SELECT q AS question_id, rank::INTEGER AS rank, conv_id || CASE WHEN rank % 2 = 0 THEN ' -> ' || session_id ELSE '' END || ' -> ' || node_id AS path FROM rec WHERE rank <= 20")
def _(spark, d):
    rows = records(spark, d)[0].withColumn("topic_id", F.col("conv_id")).withColumn("episode_id", F.lit("")).withColumn(
        "event_id", F.when(F.col("rank") % 2 == 0, F.regexp_extract("node_id", ":fact:(D[0-9]+)", 1)))
    return pk.evidence_path_rows(rows)


@query("dialogue_to_packs_E2E")
def _(spark, d):
    """From the turns of all dialogues to the pack of each one's question, with the reader's text."""
    packs_, selected_ = evidence_packs(tb.turns(spark, d), questions(spark, d).select("question_id", "conv_id", "question"))
    return packs_.join(pk.render_packs(selected_), "question_id", "left").select(
        "question_id", F.array_join("covered_slots", "|").alias("covered_slots"), F.array_join("missing_slots", "|").alias("missing_slots"), "answerability", "sessions", "token_cost", "units", "grounded_units", "text")
