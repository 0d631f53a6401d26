"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.catalog import query
from memloom.catalog.expansion import POOL_SQL, SEED_SQL, SEEDS, found, pool, questions
from memloom.catalog.retrieval import BENCH_SQL, bench_hits, bench_postings
from memloom.functions import text as tx
from memloom.operators import expansion as ex
from memloom.operators import metrics as me
from memloom.operators.ordering import first_per
from memloom.sources import tables as tb
from memloom.sources.artifacts import written

MEANS = ["hit", "recall", "full_cover"]
GOLD_SQL = "gold AS (SELECT b.item_id AS q, d.doc_id AS e FROM benchmark b JOIN documents d ON contains(d.text, b.text)),"


def _rows_sql(hits: str, k: int) -> str:
    return f"""
gs AS (SELECT q, count(*) AS g FROM gold GROUP BY q),
ms AS (SELECT gold.q, count(*) AS m FROM gold JOIN {hits} h ON h.q = gold.q AND h.doc = gold.e WHERE h.rank <= {k} GROUP BY gold.q),
mr AS (SELECT item_id AS q, coalesce(g, 0) AS gold, coalesce(m, 0) AS matched, (coalesce(m, 0) > 0)::INT::DOUBLE AS hit, CASE WHEN coalesce(g, 0) > 0 THEN coalesce(m, 0)::DOUBLE / g ELSE 0 END AS recall,
  (coalesce(g, 0) > 0 AND coalesce(m, 0) = g)::INT::DOUBLE AS full_cover FROM benchmark LEFT JOIN gs ON gs.q = item_id LEFT JOIN ms ON ms.q = item_id)"""


BENCH_ROWS = "WITH " + BENCH_SQL + "," + GOLD_SQL + _rows_sql("bhit", 20)


def bench_gold(spark, d):
    """Documents that contain a benchmark passage verbatim.

    A document that contains a passage contains its inner words as whole tokens, so candidates are the documents that hold the
    passage's rarest inner word (passages have at least three words); only their texts are read and compared in full.
    """
    b, docs = tb.table(spark, d, "benchmark"), tb.table(spark, d, "documents")
    held = bench_postings(spark, d)
    words = tx.lexical_tokens("text")
    inner = b.select(F.col("item_id").alias("question_id"), F.explode(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))).alias("term"))
    frequency = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = written(first_per(inner.join(frequency, "term"), ["question_id"], ["df", "term"], ["term"]))
    candidates = written(held.join(rarest, "term").select("question_id", "doc_id"))
    passages = b.select(F.col("item_id").alias("question_id"), F.col("text").alias("passage"))
    return candidates.join(docs.select("doc_id", "text"), "doc_id").join(passages, "question_id").filter(
        F.col("text").contains(F.col("passage"))).select("question_id", F.col("doc_id").alias("evidence"))


def bench_rows(spark, d, k=20):
    asked = tb.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"))
    found = bench_hits(spark, d, k).select("question_id", F.col("doc_id").alias("evidence"))
    return me.coverage_rows(asked, found, bench_gold(spark, d))


@query("evidence_ids_M01", "SELECT conv_id || ':raw:D1:' || turn AS node_id, 'D1:' || turn AS evidence FROM conversations UNION ALL SELECT 'x:fact:y:fact:' || conv_id || '_' || turn, conv_id || '_' || turn FROM conversations")
def _(spark, d):
    c = tb.table(spark, d, "conversations")
    one = c.select(F.concat(F.col("conv_id").cast("string"), F.lit(":raw:D1:"), F.col("turn").cast("string")).alias("node_id"))
    two = c.select(F.concat(F.lit("x:fact:y:fact:"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("node_id"))
    return one.unionByName(two).select("node_id", me.evidence_id("node_id").alias("evidence"))


@query("node_evidence_M02", "WITH " + SEED_SQL + "SELECT conv_id, node_id, turn_id AS evidence FROM raws UNION SELECT conv_id, node_id, turn_id FROM facts")
def _(spark, d):
    return me.node_evidence(tb.nodes(spark, d))


@query("retrieval_rows_M03", BENCH_ROWS + "SELECT q AS question_id, gold, matched, hit, round(recall, 6)::DOUBLE AS recall, full_cover FROM mr")
def _(spark, d):
    return bench_rows(spark, d).withColumn("recall", F.round("recall", 6))


@query("path_metrics_M03", "WITH " + SEED_SQL + """
SELECT s.q AS question_id, 1::BIGINT AS gold, max((f.turn_id = qs.gold)::INT)::BIGINT AS matched, sum(len(string_split(trim(f.text), ' ')) + len(string_split(trim(r.text), ' ')))::BIGINT AS tokens, 2.0::DOUBLE AS path_len
FROM seeds s JOIN qs ON qs.q = s.q JOIN facts f ON f.node_id = s.doc JOIN raws r ON r.node_id = f.raw_id GROUP BY s.q""")
def _(spark, d):
    q, nodes, _, hits = found(spark, d, 100)
    paths = hits.filter(F.col("rank") <= SEEDS).select("question_id", "conv_id", "rank", F.array("node_id", F.regexp_replace("node_id", ":fact:", ":raw:")).alias("node_ids"))
    gold = q.select("question_id", F.col("gold_turn").alias("evidence"))
    return me.retrieval_rows(q, paths, nodes, gold, SEEDS).select("question_id", "gold", "matched", "tokens", "path_len")


@query("retrieval_quality_summary_M04", BENCH_ROWS + "SELECT count(*) AS num_questions, round(avg(hit), 6) AS hit, round(avg(recall), 6)::DOUBLE AS recall, round(avg(full_cover), 6) AS full_cover FROM mr")
def _(spark, d):
    s = me.summarize(bench_rows(spark, d), MEANS)
    return s.select("num_questions", *[F.round(c, 6).alias(c) for c in MEANS])


@query("candidate_pool_upper_bound_M05", "WITH " + POOL_SQL + """,
pe AS (SELECT pl.question_id, max((coalesce(r.turn_id, f.turn_id) = qs.gold)::INT) AS hit, count(*) AS n FROM pl JOIN qs ON qs.q = pl.question_id LEFT JOIN raws r ON r.node_id = pl.node_id LEFT JOIN facts f ON f.node_id = pl.node_id GROUP BY ALL)
SELECT question_id, hit::DOUBLE AS recall, n AS candidates FROM pe""")
def _(spark, d):
    q, nodes, _, seeds, hop1, hop2 = pool(spark, d)
    members = ex.candidate_pool(seeds, hop1, hop2)
    found = members.join(me.node_evidence(nodes), "node_id").select("question_id", "evidence")
    rows = me.coverage_rows(members.select("question_id").distinct(), found, q.select("question_id", F.col("gold_turn").alias("evidence")))
    sizes = members.groupBy("question_id").agg(F.count(F.lit(1)).alias("candidates"))
    return rows.join(sizes, "question_id").select("question_id", "recall", "candidates")


LABELLED = "SELECT l.*, d.lang, d.source FROM labels l JOIN documents d USING (doc_id)"


def labelled(spark, d):
    return tb.table(spark, d, "labels").join(tb.table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")


@query("metrics_by_group_M06", f"WITH x AS ({LABELLED}) SELECT lang, count(*) AS num_questions, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM x GROUP BY lang UNION ALL SELECT 'ALL', count(*), round(avg(quality), 6), round(avg(toxic), 6) FROM x")
def _(spark, d):
    s = me.summarize_with_total(labelled(spark, d), ["quality", "toxic"], ["lang"])
    return s.select("lang", "num_questions", F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"))


@query("fold_spread_M07", f"WITH x AS ({LABELLED}), f AS (SELECT source, lang, avg(quality) AS q FROM x GROUP BY ALL) SELECT lang, round(avg(q), 6) AS q_mean, round(stddev_pop(q), 6) AS q_std FROM f GROUP BY lang")
def _(spark, d):
    folds = labelled(spark, d).groupBy("source", "lang").agg(F.avg("quality").alias("q"))
    return me.fold_spread(folds, ["lang"], ["q"]).select("lang", F.round("q_mean", 6).alias("q_mean"), F.round("q_std", 6).alias("q_std"))


@query("paired_comparison_M08", """SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS both, count(*) FILTER (quality = 1 AND toxic = 0) AS left_only, count(*) FILTER (quality = 0 AND toxic = 1) AS right_only,
 count(*) FILTER (quality = 0 AND toxic = 0) AS neither, count(*) FILTER (quality = 0 AND toxic = 1) - count(*) FILTER (quality = 1 AND toxic = 0) AS net FROM labels""")
def _(spark, d):
    l = tb.table(spark, d, "labels")
    return me.paired_counts(l.select("doc_id", F.col("quality").alias("ok")), l.select("doc_id", F.col("toxic").alias("ok")), "doc_id", "ok")


@query("fix_break_counts_M09", f"""WITH x AS ({LABELLED}) SELECT lang, count(*) AS questions, round(avg(quality), 6) AS accuracy_before, round(avg(toxic), 6) AS accuracy_after, count(*) FILTER (quality = 0 AND toxic = 1) AS fix,
 count(*) FILTER (quality = 1 AND toxic = 0) AS "break", count(*) FILTER (quality = 1 AND toxic = 1) AS unchanged_correct, count(*) FILTER (quality = 0 AND toxic = 0) AS unchanged_wrong FROM x GROUP BY lang""")
def _(spark, d):
    rows = me.change_counts(labelled(spark, d), "quality", "toxic", ["lang"])
    return rows.withColumn("accuracy_before", F.round("accuracy_before", 6)).withColumn("accuracy_after", F.round("accuracy_after", 6))


@query("exact_match_M10", "SELECT a.conv_id, a.turn, (lower(trim(a.role)) = lower(trim(b.role)))::INT::DOUBLE AS same_role, (lower(trim(a.text)) = lower(trim(b.text)))::INT::DOUBLE AS same_text FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def _(spark, d):
    c = tb.table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("role2"), F.col("text").alias("text2"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", me.exact_match(F.col("role"), F.col("role2")).alias("same_role"), me.exact_match(F.col("text"), F.col("text2")).alias("same_text"))


@query("recall_at_k_M10", "WITH " + BENCH_SQL + "," + GOLD_SQL.rstrip(",") + " SELECT g.q AS question_id, round(avg((h.doc IS NOT NULL)::INT), 6) AS recall FROM gold g LEFT JOIN bhit h ON h.q = g.q AND h.doc = g.e AND h.rank <= 5 GROUP BY g.q")
def _(spark, d):
    predicted = bench_hits(spark, d).select("question_id", "rank", F.col("doc_id").alias("evidence"))
    return me.recall_at_k(predicted, bench_gold(spark, d), 5).withColumn("recall", F.round("recall", 6))


def metric_tokens_sql(expr: str) -> str:
    clean = f"regexp_replace(lower({expr}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
    return f"list_filter(string_split(regexp_replace({clean}, '\\s+', ' ', 'g'), ' '), lambda t: t <> '' AND NOT list_contains(['a', 'an', 'the'], t))"


@query("token_f1_bleu_M11", f"""
WITH x AS (SELECT a.conv_id, a.turn, {metric_tokens_sql('a.text')} AS p, {metric_tokens_sql('b.text')} AS g FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
tp AS (SELECT conv_id, turn, t, count(*) AS c FROM (SELECT conv_id, turn, unnest(p) AS t FROM x) GROUP BY ALL),
tg AS (SELECT conv_id, turn, t, count(*) AS c FROM (SELECT conv_id, turn, unnest(g) AS t FROM x) GROUP BY ALL),
cm AS (SELECT conv_id, turn, sum(least(tp.c, tg.c)) AS common FROM tp JOIN tg USING (conv_id, turn, t) GROUP BY ALL),
y AS (SELECT x.conv_id, x.turn, len(p) AS np, len(g) AS ng, coalesce(common, 0)::DOUBLE AS c FROM x LEFT JOIN cm USING (conv_id, turn))
SELECT conv_id, turn, round(CASE WHEN np = 0 AND ng = 0 THEN 1 WHEN np = 0 OR ng = 0 OR c = 0 THEN 0 ELSE 2 * (c / np) * (c / ng) / (c / np + c / ng) END, 6)::DOUBLE AS f1,
 round(CASE WHEN np = 0 AND ng = 0 THEN 1 WHEN np = 0 OR ng = 0 THEN 0 ELSE (c / np) * CASE WHEN np > ng THEN 1 ELSE exp(1 - ng::DOUBLE / np) END END, 6)::DOUBLE AS bleu1 FROM y""")
def _(spark, d):
    c = tb.table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = me.token_overlap(c.join(nxt, ["conv_id", "turn"]), ["conv_id", "turn"], "text", "answer")
    return rows.withColumn("f1", F.round("f1", 6)).withColumn("bleu1", F.round("bleu1", 6))


@query("usage_totals_M12", """SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS questions, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS tokens_total, round(sum(json_extract(props, '$.k')::BIGINT)::DOUBLE / count(*), 6) AS tokens_per_call,
 round(sum(json_extract(props, '$.k')::BIGINT)::DOUBLE / count(DISTINCT user_id), 6) AS tokens_per_question, round(sum(value), 4) AS seconds_total, round(sum(value) / count(*), 6) AS seconds_per_call, round(sum(value) / count(DISTINCT user_id), 6) AS seconds_per_question FROM events GROUP BY event_type""")
def _(spark, d):
    e = tb.table(spark, d, "events").select("event_type", F.col("user_id").alias("question_id"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), F.col("value").alias("seconds"))
    u = me.usage_totals(e, ["tokens", "seconds"], ["event_type"])
    return u.select("event_type", "calls", "questions", "tokens_total", F.round("tokens_per_call", 6).alias("tokens_per_call"), F.round("tokens_per_question", 6).alias("tokens_per_question"),
                    F.round("seconds_total", 4).alias("seconds_total"), F.round("seconds_per_call", 6).alias("seconds_per_call"), F.round("seconds_per_question", 6).alias("seconds_per_question"))


@query("percentiles_M13", """
WITH o AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY event_type), n AS (SELECT *, len(v) AS n FROM o)
SELECT event_type, v[1 + greatest(0, least(n - 1, round_even((n - 1) * 0.9::DOUBLE, 0)))::BIGINT] AS p_round, v[1 + least(n - 1, floor((n - 1) * 0.95::DOUBLE))::BIGINT] AS p_trunc,
 v[greatest(1, ceil(0.95::DOUBLE * n))::BIGINT] AS p_ceil FROM n""")
def _(spark, d):
    e = tb.table(spark, d, "events")
    a = me.percentile_rank(e, ["event_type"], "value", 0.9, "round").withColumnRenamed("percentile", "p_round")
    b = me.percentile_rank(e, ["event_type"], "value", 0.95, "trunc").withColumnRenamed("percentile", "p_trunc")
    c = me.percentile_rank(e, ["event_type"], "value", 0.95, "ceil").withColumnRenamed("percentile", "p_ceil")
    return a.join(b, "event_type").join(c, "event_type")


@query("gate_report_M14", """
WITH r AS (SELECT value > 5 AS fc, value > 10 AS ex, value > 15 AS co, value > 20 AS tk, user_id % 2 = 0 AS ok, event_id % 3 = 0 AS bok, event_id % 4 AS an, least(event_id % 4, user_id % 3) AS va FROM events)
SELECT count(*) AS questions, round(avg(fc::INT), 6) AS role_coverage, round(avg(ex::INT), 6) AS executable_rate, round(avg(co::INT), 6) AS consensus_rate, round(avg(tk::INT), 6) AS takeover_rate,
 round(count(*) FILTER (tk AND ok)::DOUBLE / count(*) FILTER (tk), 6) AS takeover_precision, round(count(*) FILTER (NOT tk AND bok)::DOUBLE / count(*) FILTER (NOT tk), 6) AS fallback_accuracy,
 round(sum(va)::DOUBLE / sum(an), 6) AS anchor_valid_ratio FROM r""")
def _(spark, d):
    v = F.col("value")
    rows = tb.table(spark, d, "events").select(
        (v > 5).alias("full_cover"), (v > 10).alias("executable"), (v > 15).alias("consensus"), (v > 20).alias("takeover"), (F.col("user_id") % 2 == 0).alias("correct"),
        (F.col("event_id") % 3 == 0).alias("baseline_correct"), (F.col("event_id") % 4).alias("anchors"), F.least(F.col("event_id") % 4, F.col("user_id") % 3).alias("valid_anchors"))
    report = me.gate_report(rows)
    return report.select("questions", *[F.round(c, 6).alias(c) for c in report.columns if c != "questions"])


AUDIT_SQL = BENCH_ROWS + ", au AS (SELECT q, gold, matched, q % 2 = 0 AS ok, CASE WHEN gold > 0 AND matched = gold THEN 'full' WHEN matched > 0 THEN 'partial' ELSE 'none' END AS st FROM mr)"


@query("error_audit_M15", AUDIT_SQL + " SELECT st AS evidence_state, count(*) AS questions, round(avg(ok::INT), 6) AS accuracy, count(*) FILTER (NOT ok AND matched > 0) AS wrong_despite_hit FROM au GROUP BY st")
def _(spark, d):
    rows = bench_rows(spark, d).withColumn("correct", F.col("question_id") % 2 == 0)
    return me.error_audit(rows).withColumn("accuracy", F.round("accuracy", 6))


@query("error_rows_M15", AUDIT_SQL + " SELECT q AS question_id, st AS evidence_state FROM au WHERE NOT ok")
def _(spark, d):
    rows = bench_rows(spark, d).withColumn("correct", F.col("question_id") % 2 == 0)
    return me.error_rows(rows).select("question_id", "evidence_state")


@query("failure_funnel_M16", "SELECT event_type AS failure_type, count(*) AS questions, count(*) FILTER (value > 5) AS repairable, count(*) FILTER (value > 15) AS converted FROM events GROUP BY event_type")
def _(spark, d):
    e = tb.table(spark, d, "events").select(F.col("event_type").alias("failure_type"), (F.col("value") > 5).alias("repairable"), (F.col("value") > 15).alias("converted"))
    return me.failure_funnel(e)


@query("graph_diagnostics_M17", "WITH " + SEED_SQL + """
SELECT 'nodes:' || type AS metric, count(*)::DOUBLE AS value FROM nodes GROUP BY type UNION ALL
SELECT 'edges:fact_event', count(*)::DOUBLE FROM facts WHERE speaker <> 'system' UNION ALL
SELECT 'cross_conversation_edges', count(*)::DOUBLE FROM facts WHERE speaker <> 'system' AND pos = 3 UNION ALL SELECT 'fact_without_event', count(*)::DOUBLE FROM facts WHERE speaker = 'system'""")
def _(spark, d):
    nodes = tb.nodes(spark, d)
    edges = nodes.filter("type = 'FACT' AND speaker <> 'system'").select(
        F.col("conv_id").alias("src_conv"), F.when(F.col("pos") == 3, F.lit("other")).otherwise(F.col("conv_id")).alias("dst_conv"),
        F.lit("fact_event").alias("role"), F.col("node_id").alias("src"), F.col("session_id").alias("dst"))
    return me.graph_diagnostics(nodes, edges)


@query("cluster_size_statistics_M17", "WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) SELECT count(*) AS clusters, round(avg(n), 6) AS mean_size, median(n)::DOUBLE AS median_size, max(n) AS max_size, round(avg((n = 1)::INT), 6) AS singleton_ratio FROM s")
def _(spark, d):
    s = me.size_statistics(tb.table(spark, d, "orders"), ["o_custkey"])
    return s.withColumn("mean_size", F.round("mean_size", 6)).withColumn("singleton_ratio", F.round("singleton_ratio", 6))


@query("refusal_detection_M18", """SELECT event_id, event_type IN ('error', 'click') AS refused FROM events""")
def _(spark, d):
    text = F.when(F.col("event_type") == "error", "Insufficient evidence.").when(F.col("event_type") == "click", "I cannot determine that").otherwise(F.concat(F.lit("It was known: "), "event_type"))
    return tb.table(spark, d, "events").select("event_id", me.is_refusal(text).alias("refused"))


@query("judged_labels_M19", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'CORRECT' ELSE 'WRONG' END AS label FROM events""")
def _(spark, d):
    n = F.col("event_id") % 5
    fenced = F.lit('```json\n{"label": "correct", "reason": "ok"}\n```')
    text = F.when(n == 0, fenced).when(n == 1, F.lit('{"label": "CORRECT"}')).when(n == 2, F.lit('{"label": "WRONG"}')).when(n == 3, F.lit("CORRECT")).otherwise(F.lit(None).cast("string"))
    return tb.table(spark, d, "events").select("event_id", me.judged_label(text).alias("label"))


@query("split_summaries_M20", BENCH_ROWS + """, sp AS (SELECT 'all' AS split, * FROM mr UNION ALL SELECT 'answerable', * FROM mr WHERE q % 4 <> 0 UNION ALL SELECT 'abstention', * FROM mr WHERE q % 4 = 0 UNION ALL SELECT 'gold_bearing', * FROM mr WHERE gold > 0)
SELECT split, count(*) AS num_questions, round(avg(hit), 6) AS hit, round(avg(recall), 6)::DOUBLE AS recall, round(avg(full_cover), 6) AS full_cover FROM sp GROUP BY split""")
def _(spark, d):
    rows = bench_rows(spark, d).withColumn("is_abstention", F.col("question_id") % 4 == 0)
    s = me.split_summaries(rows, MEANS)
    return s.select("split", "num_questions", *[F.round(c, 6).alias(c) for c in MEANS])


@query("ingestion_counts_M21", """
WITH q AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS g, conv_id % 10 = 0 AS ab, CASE WHEN conv_id % 3 = 0 THEN 'temporal' WHEN conv_id % 3 = 1 THEN 'update' END AS ty FROM conversations GROUP BY conv_id)
SELECT 'instances' AS metric, count(*) AS value FROM q UNION ALL SELECT 'turns', count(*) FROM conversations UNION ALL SELECT 'gold_turns', sum(g)::BIGINT FROM q UNION ALL SELECT 'abstentions', count(*) FILTER (ab) FROM q
UNION ALL SELECT 'type:' || coalesce(ty, 'unknown'), count(*) FROM q GROUP BY ty""")
def _(spark, d):
    turns = tb.table(spark, d, "conversations")
    n = F.col("conv_id") % 3
    asked = turns.groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "assistant", F.col("turn"))).alias("gold_evidence")).select(
        "conv_id", "gold_evidence", (F.col("conv_id") % 10 == 0).alias("is_abstention"), F.when(n == 0, "temporal").when(n == 1, "update").alias("question_type"))
    return me.ingestion_counts(turns, asked)
