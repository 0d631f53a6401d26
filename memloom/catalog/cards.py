"""Relation-card and ranking-model queries. Card replies are JSON built from the candidates of each question."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.catalog import query
from memloom.catalog.features import CAND_SQL, ROUTE_SOURCES, candidates, route_rows
from memloom.catalog.temporal import _pick
from memloom.operators import cards as ca
from memloom.operators import features as fe
from memloom.operators import metrics as me
from memloom.session import cut_lineage
from memloom.sources import tables as tb

Q = "question_id"


@query("card_context_C01", "WITH " + CAND_SQL + """, cx AS (SELECT ca.q, ca.node_id, row_number() OVER (PARTITION BY ca.q ORDER BY ca.rank) AS r, string_split(trim(f.text), ' ')[1:20] AS w FROM ca JOIN facts f ON f.node_id = ca.node_id WHERE ca.rank % 4 <> 3)
SELECT q AS question_id, node_id, r::INTEGER AS context_rank, array_to_string(w, ' ') AS text FROM cx WHERE r <= 50""")
def _(spark, d):
    rows, nodes, _, _ = candidates(spark, d)
    return ca.card_context(rows.withColumn("is_completion", F.col("rank") % 4 == 3), nodes, 50, 20).select(Q, "node_id", "context_rank", "text")


def replies(spark, d):
    """Per question with three candidates: a state card, a card of unknown type and a single-fact card."""
    rows, nodes, _, q = candidates(spark, d)
    f = rows.filter("rank <= 3").groupBy(Q).agg(F.array_sort(F.collect_list(F.struct("rank", "node_id"))).alias("c")).filter(F.size("c") >= 3)
    fact = lambda i: F.col("c")[i]["node_id"]
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    text = F.concat(
        F.lit('{"cards":[{"type":"State","entity":" Ann ","aspect":"home","confidence":1.4,"needed_roles":["New State","missing"],"support_facts":['), quote(fact(1)), F.lit(',"nowhere"],"roles":{"Old State":{"value":"a","fact_ids":['), quote(fact(0)),
        F.lit(']},"new-state":{"value":"b","fact_ids":['), quote(fact(1)), F.lit(',"nowhere"]},"mood":{"value":"c","fact_ids":['), quote(fact(2)), F.lit(']}}},{"type":"gossip","support_facts":['), quote(fact(0)), F.lit(","), quote(fact(1)),
        F.lit(']},{"type":"change","confidence":0.6,"support_facts":['), quote(fact(0)), F.lit(","), quote(fact(2)), F.lit("]}]}"))
    return f.select(Q, text.alias("reply")), rows, nodes, q


CARD_SQL = CAND_SQL + """,
t3 AS (SELECT q, max(CASE WHEN rank = 1 THEN node_id END) AS a, max(CASE WHEN rank = 2 THEN node_id END) AS b, max(CASE WHEN rank = 3 THEN node_id END) AS c FROM ca GROUP BY q HAVING count(*) FILTER (rank <= 3) = 3),
vc AS (SELECT q, 1 AS card_no, 'state' AS card_type, 'old_state' AS role, a AS node_id, 1.0::DOUBLE AS confidence, false AS is_needed, 3 AS size FROM t3 UNION ALL SELECT q, 1, 'state', 'new_state', b, 1.0, true, 3 FROM t3 UNION ALL SELECT q, 1, 'state', 'evidence', c, 1.0, false, 3 FROM t3
  UNION ALL SELECT q, 3, 'change', 'evidence', a, 0.6, true, 2 FROM t3 UNION ALL SELECT q, 3, 'change', 'evidence', c, 0.6, true, 2 FROM t3)"""


def valid(spark, d):
    r, rows, nodes, q = replies(spark, d)
    return ca.validate_cards(r, rows), rows, nodes, q


@query("card_validation_C02", "WITH " + CARD_SQL + " SELECT q AS question_id, card_no, card_type, role, node_id, confidence, is_needed, size::BIGINT AS size FROM vc")
def _(spark, d):
    return valid(spark, d)[0].select(Q, "card_no", "card_type", "role", "node_id", "confidence", "is_needed", "size")


@query("card_annotation_C03", "WITH " + CARD_SQL + """, bs AS (SELECT q, node_id, arg_min(card_type, (-confidence, card_no)) AS card_type, arg_min(role, (-confidence, card_no)) AS role, max(confidence) AS confidence FROM vc WHERE is_needed GROUP BY ALL)
SELECT ca.q AS question_id, ca.node_id, bs.card_type, bs.role, bs.confidence, bs.role IS NOT NULL AS is_card, row_number() OVER (PARTITION BY ca.q ORDER BY norm DESC, ca.node_id)::INTEGER AS position FROM ca LEFT JOIN bs ON bs.q = ca.q AND bs.node_id = ca.node_id""")
def _(spark, d):
    cards, rows, _, _ = valid(spark, d)
    return ca.annotate_candidates(rows, cards).select(Q, "node_id", "card_type", "role", "confidence", "is_card", "position")


@query("card_coverage_C04", "WITH " + CARD_SQL + """, cf AS (SELECT DISTINCT q, node_id FROM vc WHERE is_needed), fo AS (SELECT cf.q, count(*) AS n FROM cf JOIN facts f ON f.node_id = cf.node_id JOIN qs ON qs.q = cf.q AND qs.gold = f.turn_id GROUP BY cf.q)
SELECT count(*) AS questions, count(t3.q) AS card_questions, round(avg(CASE WHEN t3.q IS NULL THEN 0 ELSE 2 END), 6) AS avg_cards, round(avg(coalesce((SELECT count(*) FROM cf WHERE cf.q = qs.q), 0)), 6) AS avg_card_facts, round(avg((fo.n IS NOT NULL)::INT), 6) AS card_hit, coalesce(sum(fo.n), 0)::BIGINT AS card_gold_facts
FROM qs LEFT JOIN t3 ON t3.q = qs.q LEFT JOIN fo ON fo.q = qs.q""")
def _(spark, d):
    cards, _, nodes, q = valid(spark, d)
    s = ca.card_coverage(q.select(Q, "conv_id"), cards, me.node_evidence(nodes), q.select(Q, F.col("gold_turn").alias("evidence")))
    return s.select("questions", "card_questions", *[F.round(c, 6).alias(c) for c in ("avg_cards", "avg_card_facts", "card_hit")], "card_gold_facts")


POOL_SQL = """
po AS (SELECT user_id AS q, event_id AS n, value / 10 AS ce, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, 'ev' || (event_id % 12) AS ev, 'tp' || (event_id % 4) AS tp, event_id % 120 AS ed, event_id % 90 AS td, CASE WHEN event_id % 3 = 0 THEN 0.8 ELSE 0.5 END AS cc FROM events)"""


def pool_rows(spark, d):
    """Events of a user as the ranked pool of a question, grouped into events and topics."""
    e = F.col("event_id")
    t = tb.table(spark, d, "events").select(
        F.col("user_id").alias(Q), e.alias("node_id"), (F.col("value") / 10).alias("ce"), F.concat(F.lit("ev"), (e % 12).cast("string")).alias("event_id"), F.concat(F.lit("tp"), (e % 4).cast("string")).alias("topic_id"),
        (e % 120).alias("event_degree"), (e % 90).alias("topic_degree"), F.when(e % 3 == 0, 0.8).otherwise(0.5).alias("card_confidence"))
    return ca.top_per(t, [Q], [F.asc("node_id")], 1 << 30)


@query("card_guided_expansion_C05", "WITH " + POOL_SQL + """, hd AS (SELECT * FROM po WHERE rank <= 5), te AS (SELECT DISTINCT q, ev FROM hd WHERE cc >= 0.75), tt AS (SELECT DISTINCT q, tp FROM hd WHERE cc >= 0.75),
tl AS (SELECT po.*, CASE WHEN te.q IS NOT NULL THEN 2.0 - least(ed / 100.0, 0.5) WHEN tt.q IS NOT NULL THEN 1.0 - least(td / 100.0, 0.5) ELSE 0 END AS s, CASE WHEN te.q IS NOT NULL THEN 'same_event' WHEN tt.q IS NOT NULL THEN 'same_topic' END AS src
  FROM po LEFT JOIN te ON te.q = po.q AND te.ev = po.ev LEFT JOIN tt ON tt.q = po.q AND tt.tp = po.tp WHERE rank > 5), rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, ce DESC, rank) AS x FROM tl WHERE s > 0)
SELECT q AS question_id, n AS node_id, NULL::VARCHAR AS expansion_source FROM hd UNION ALL SELECT q, n, src FROM rk WHERE x <= 20""")
def _(spark, d):
    return ca.guided_expansion(pool_rows(spark, d), 5, 20).select(Q, "node_id", "expansion_source")


@query("card_score_index_C06", "SELECT user_id AS question_id, event_id % 40 AS node_id, max(value) AS card_score FROM events WHERE event_id % 2 = 0 GROUP BY ALL")
def _(spark, d):
    e = F.col("event_id")
    return ca.card_index(tb.table(spark, d, "events").select(F.col("user_id").alias(Q), (e % 40).alias("node_id"), F.col("value").alias("card_score"), (e % 2 == 0).alias("is_selected")))


QUOTA_SQL = POOL_SQL + """,
qx AS (SELECT *, CASE WHEN n % 5 = 0 THEN (n % 17) / 10.0::DOUBLE END AS cs, (n % 23) / 10.0::DOUBLE AS ms FROM po),
qy AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cs DESC NULLS LAST, ms DESC, rank) AS cr FROM qx),
qz AS (SELECT *, cs IS NOT NULL AND cr <= 5 AS qsel, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN cs IS NOT NULL AND cr <= 5 THEN cr ELSE 1073741824 END, ms DESC, rank) AS sn FROM qy)"""


def quota(spark, d):
    rows = pool_rows(spark, d).withColumn("model_score", (F.col("node_id") % 23) / 10.0)
    index = rows.filter("node_id % 5 = 0").select(Q, "node_id", ((F.col("node_id") % 17) / 10.0).alias("card_score"))
    return ca.quota_selection(rows, index, 20, ca.quota_for(20))


@query("card_quota_selection_C07", "WITH " + QUOTA_SQL + " SELECT q AS question_id, n AS node_id, coalesce(cs, 0)::DOUBLE AS card_score, qsel AS quota_selected, sn::INTEGER AS selected_no FROM qz WHERE sn <= 20")
def _(spark, d):
    return quota(spark, d).drop("model_score")


@query("selected_card_summary_C08", "WITH " + QUOTA_SQL + """, s AS (SELECT *, n % 3 = 0 AS gold FROM qz WHERE sn <= 20 AND cs > 0) SELECT count(*) AS card_facts, count(*) FILTER (gold) AS card_gold_facts, round(count(*) FILTER (gold)::DOUBLE / count(*), 6) AS card_gold_rate, count(*) FILTER (qsel) AS quota_facts,
 count(*) FILTER (qsel AND gold) AS quota_gold_facts, round(count(*) FILTER (qsel AND gold)::DOUBLE / count(*) FILTER (qsel), 6) AS quota_gold_rate, count(DISTINCT CASE WHEN gold THEN q END) AS questions_with_card_gold FROM s""")
def _(spark, d):
    labels = pool_rows(spark, d).select(Q, "node_id", (F.col("node_id") % 3 == 0).cast("int").alias("label"))
    s = ca.selected_summary(quota(spark, d), labels)
    return s.withColumn("card_gold_rate", F.round("card_gold_rate", 6)).withColumn("quota_gold_rate", F.round("quota_gold_rate", 6))


def training_rows(spark, d):
    """The features of the main ranking model for the candidates of each conversation question, with their labels.

    Routes and cards follow from a candidate's rank and position; a fold is whole conversations, by hash.
    """
    rows, nodes, _, q = candidates(spark, d)
    r, key = F.col("rank"), F.pmod(F.xxhash64("node_id"), F.lit(24)).cast("int")
    rows = cut_lineage(rows.withColumn("route_source", _pick(ROUTE_SOURCES, key % 8)).withColumns({
        "from_both": key % 3 == 0, "fact_offset": key % 4, "semantic_score": F.col("ce") / 2, "hyperbolic_score": -1 - F.col("ce"),
        **{n: F.lit(0.0) for n in ("eu_event_score", "eu_topic_score", "hyp_event_score", "hyp_topic_score", "hyp_bottom_score")},
        **{n: (r + i) % 13 for i, n in enumerate(fe.RANKS)},
        "is_card": key % 2 == 0, "nary_type": _pick(["change", "state", "preference"], key % 3), "nary_role": _pick(["old_state", "new_state", "evidence"], key % 3),
        "nary_seed_route": _pick(ROUTE_SOURCES, key % 8), "nary_extractor": F.lit(""), **{n: key % 5 for n in fe.CARD_NUMBERS},
    }))
    features = fe.retrieval_features(rows, nodes, q).join(fe.route_features(rows), [Q, "node_id"]).join(fe.card_features(rows), [Q, "node_id"])
    gold = q.select(Q, F.col("gold_turn").alias("evidence"))
    labelled = features.join(fe.labels(rows, me.node_evidence(nodes), gold), [Q, "node_id"])
    return labelled.select(Q, "conv_id", "node_id", "label", *fe.MODEL_FEATURES, F.pmod(F.xxhash64("conv_id"), F.lit(3)).cast("int").alias("fold"))


@query("ranking_model_C09")
def _(spark, d):
    rows = cut_lineage(training_rows(spark, d))
    trees = ca.fit_boosted(rows, fe.MODEL_FEATURES)
    return ca.score_boosted(trees, rows, fe.MODEL_FEATURES, [Q, "node_id"]).withColumn("model_score", F.round("model_score", 6))


@query("cross_validated_scores_C10")
def _(spark, d):
    return ca.cross_validate_boosted(training_rows(spark, d), [0, 1, 2], fe.MODEL_FEATURES)[0].withColumn("model_score", F.round("model_score", 6))


@query("feature_importance_C10")
def _(spark, d):
    return ca.cross_validate_boosted(training_rows(spark, d), [0, 1, 2], fe.MODEL_FEATURES)[1].withColumn("importance", F.round("importance", 6))


@query("holdout_split_C10", "WITH l AS (SELECT DISTINCT conv_id FROM conversations ORDER BY 'c' || conv_id DESC LIMIT 10) SELECT 'c' || c.conv_id AS conv_id, turn AS pos, l.conv_id IS NOT NULL AS is_test FROM conversations c LEFT JOIN l ON l.conv_id = c.conv_id")
def _(spark, d):
    return ca.holdout(tb.turns(spark, d).select("conv_id", "pos"), 10)


@query("score_application_C11", "WITH " + POOL_SQL + ", r AS (SELECT q, n, (n % 23) / 10.0::DOUBLE AS ms, row_number() OVER (PARTITION BY q ORDER BY n % 23 DESC, n) AS x FROM po) SELECT q AS question_id, n AS node_id, ms AS model_score, x::INTEGER AS model_rank FROM r WHERE x <= 10")
def _(spark, d):
    rows = pool_rows(spark, d)
    scores = rows.select(Q, "node_id", ((F.col("node_id") % 23) / 10.0).alias("model_score"))
    return ca.apply_scores(rows, scores, 10).select(Q, "node_id", "model_score", "model_rank")


@query("feature_subset_C12", "SELECT user_id AS question_id, event_id AS node_id, [1, 2, 1, 3, 1, 2, 1, 0][event_id % 8 + 1]::DOUBLE AS route_source_count, [1, 2, 1, 3, 1, 2, 1, 0][event_id % 8 + 1] / 5.0::DOUBLE AS route_overlap_score FROM events")
def _(spark, d):
    f = fe.route_features(route_rows(spark, d))
    return fe.select_features(f, ["route_overlap_score", "route_source_count", "all_route_hit"], ["all_route_hit"])
