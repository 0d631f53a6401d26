"""First-stage retrieval and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.catalog import BUILT, query
from memloom.catalog.hierarchy import VM_SQL, cos_sql, vector_members
from memloom.catalog.nodes import lexical_sql, names_sql
from memloom.functions import text as tx
from memloom.functions import vectors as vx
from memloom.operators import balls as ba
from memloom.operators import hierarchy as hi
from memloom.operators import retrieval as re_
from memloom.sources import tables as tb
from memloom.sources.tables import TURNS_SQL, jaccard_sql, term_set_sql


def bm25_sql(questions: str, docs: str, scope: str | None, prefix: str = "b") -> str:
    """CTE ``{prefix}score`` (question, doc, score); inputs are (q, text[, scope]) and (doc, text[, scope])."""
    s = f"{scope}, " if scope else ""
    using = f"USING ({scope}, term)" if scope else "USING (term)"
    totals = f"JOIN {prefix}tot USING ({scope})" if scope else f"CROSS JOIN {prefix}tot"
    return f"""
{prefix}tok AS (SELECT {s}doc, {lexical_sql('text')} AS t FROM {docs}),
{prefix}tot AS (SELECT {s}count(*) AS n, avg(len(t)) AS al FROM {prefix}tok GROUP BY ALL),
{prefix}post AS (SELECT {s}doc, len(t) AS dl, unnest(t) AS term FROM {prefix}tok),
{prefix}tf AS (SELECT {s}doc, dl, term, count(*) AS tf FROM {prefix}post GROUP BY ALL),
{prefix}df AS (SELECT {s}term, count(*) AS df FROM {prefix}tf GROUP BY ALL),
{prefix}q AS (SELECT {s}q, unnest({lexical_sql('text')}) AS term FROM {questions}),
{prefix}qt AS (SELECT {s}q, term, count(*) AS times FROM {prefix}q GROUP BY ALL),
{prefix}score AS (SELECT {s}q, doc, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(al, 1e-6)))))::DOUBLE AS score
  FROM {prefix}qt JOIN {prefix}tf {using} JOIN {prefix}df {using} {totals} GROUP BY {s}q, doc)"""


BENCH_SQL = bm25_sql("(SELECT item_id AS q, text FROM benchmark)", "(SELECT doc_id AS doc, text FROM documents)", None) + """,
bhit AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc) AS rank FROM bscore)
"""


def bench_questions(spark, d):
    return tb.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")


def bench_tables(spark, d):
    return bench_questions(spark, d), tb.table(spark, d, "documents").select("doc_id", "text")


def bench_counts(spark, d):
    """How often documents use the terms of benchmark passages, counted once per call of a query."""
    built = BUILT.get({})
    if "bench counts" not in built:
        built["bench counts"] = re_.count_terms(*bench_tables(spark, d))
    return built["bench counts"]


def bench_postings(spark, d):
    """``doc_id, term`` of the terms of benchmark passages."""
    counted = bench_counts(spark, d)
    return counted.postings() if counted is not None else re_.used_postings(*bench_tables(spark, d)).filter("term <> ''").select("doc_id", "term")


def bench_hits(spark, d, k: int = 20):
    return re_.bm25_top_k(*bench_tables(spark, d), k, counted=bench_counts(spark, d))


@query("lexical_tokens_R01", f"SELECT doc_id, array_to_string({lexical_sql('text')}, ' ') AS tokens FROM documents")
def _(spark, d):
    return tb.table(spark, d, "documents").select("doc_id", F.array_join(tx.lexical_tokens("text"), " ").alias("tokens"))


@query("term_statistics_R02", "WITH " + BENCH_SQL + "SELECT term, df, sum(tf)::BIGINT AS cf, n AS n_docs, round(al, 6) AS avg_len FROM btf JOIN bdf USING (term) CROSS JOIN btot GROUP BY ALL")
def _(spark, d):
    postings, frequency, totals = re_.term_statistics(tb.table(spark, d, "documents"))
    counts = postings.groupBy("term").agg(F.sum("tf").alias("cf"))
    rows = frequency.join(counts, "term").withColumn("n_docs", totals.select("n_docs").scalar())
    return rows.withColumn("avg_len", F.round(totals.select("avg_len").scalar(), 6))


@query("bm25_top20_R03", "WITH " + BENCH_SQL + "SELECT q AS question_id, doc AS doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM bhit WHERE rank <= 20")
def _(spark, d):
    return bench_hits(spark, d).withColumn("score", F.round("score", 6))


@query("score_normalisation_R04", "WITH " + BENCH_SQL + """
SELECT q AS question_id, doc AS doc_id, round(score / max(score) OVER (PARTITION BY q), 6) AS norm, rank::INTEGER AS rank FROM bhit WHERE rank <= 300""")
def _(spark, d):
    return re_.normalize_scores(bench_hits(spark, d, 300)).select("question_id", "doc_id", F.round("norm", 6).alias("norm"), "rank")


EMB = "(SELECT *, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
LABEL_SQL = f"""
lab AS (SELECT label, list(x ORDER BY i) AS qv FROM (SELECT label, i.i AS i, avg(v[i.i]) AS x FROM {EMB} CROSS JOIN range(1, 65) i(i) GROUP BY ALL) GROUP BY label)"""


def embeddings(spark, d):
    return tb.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


def label_means(spark, d):
    e = embeddings(spark, d)
    means = e.groupBy("label").agg(*[F.avg(F.col("vector")[i]).alias(f"_{i}") for i in range(64)])
    return means.select(F.col("label").alias("query_id"), F.array(*[F.col(f"_{i}") for i in range(64)]).alias("vector"))


@query("dense_top20_R05", f"""WITH {LABEL_SQL},
sc AS (SELECT label AS query_id, vec_id AS item_id, list_dot_product(qv, v) AS score FROM {EMB.replace('*', 'vec_id, embedding')} JOIN lab ON true),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM sc WHERE score > 0)
SELECT query_id, item_id, round(score, 6) AS score, rank::INTEGER AS rank FROM rk WHERE rank <= 20""")
def _(spark, d):
    items = embeddings(spark, d).select(F.col("vec_id").alias("item_id"), "vector")
    return re_.dense_top_k(label_means(spark, d), items, 20).withColumn("score", F.round("score", 6))


CONVQ_SQL = VM_SQL + """,
cq0 AS (SELECT conv_id, i.i AS i, avg(vector[i.i]) AS x FROM vm CROSS JOIN range(1, 65) i(i) GROUP BY ALL),
cq AS (SELECT conv_id, list(x ORDER BY i) AS qv FROM cq0 GROUP BY ALL)"""


def _scoped_queries(spark, d):
    means = hi.mean_vector(vector_members(spark, d), 64, ["conv_id"])
    return means.select(F.concat("conv_id", F.lit(":q0001")).alias("question_id"), "conv_id", F.col("centroid").alias("query_vector"))


CONVN_SQL = CONVQ_SQL + """,
cn AS (SELECT conv_id, list_transform(qv, lambda x: x / sqrt(list_dot_product(qv, qv))) AS qv FROM cq)"""


@query("scoped_dense_top10_R06", f"""WITH {CONVN_SQL},
sc AS (SELECT vm.conv_id, member_id, list_dot_product(qv, vector) AS score FROM vm JOIN cn USING (conv_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9) DESC, member_id) AS rank FROM sc)
SELECT conv_id || ':q0001' AS question_id, conv_id, member_id AS item_id, round(score, 6) AS score, rank::INTEGER AS rank FROM rk WHERE rank <= 10""")
def _(spark, d):
    items = vector_members(spark, d).select("conv_id", F.col("member_id").alias("item_id"), F.col("cluster_id").alias("ball"), "vector")
    return ba.ball_top_k(_scoped_queries(spark, d), items, ba.EUCLIDEAN, 10).drop("ball").withColumn("score", F.round("score", 6))


def exp_sql(t: str) -> str:
    """Exponential map of a list expression (unit curvature)."""
    n = f"sqrt(list_dot_product({t}, {t}))"
    sp = f"list_transform({t}, lambda x: x * (sinh({n}) / greatest({n}, 1e-7)))"
    return f"list_prepend(sqrt(1 + list_dot_product({sp}, {sp})), {sp})"


def ldist_sql(a: str, b: str) -> str:
    return f"acosh(greatest(2 * {a}[1] * {b}[1] - list_dot_product({a}, {b}), 1.0000001::DOUBLE))"


CELLS = "array_to_string(list_transform({0}, lambda x: CAST(CAST(round(x * 100000) AS BIGINT) AS VARCHAR)), ',')"


def cells(column):
    return F.array_join(F.transform(column, lambda x: F.round(x * 100000).cast("bigint").cast("string")), ",")


TYPES_SQL = f"""
ty AS (SELECT vec_id, v, ['RAW','FACT','EVENT','ANCHOR','TOPIC'][vec_id % 5 + 1] AS type, ['active','outdated','exception','disputed'][vec_id % 4 + 1] AS status, (vec_id % 10) / 10.0::DOUBLE AS conf FROM {EMB}),
sc1 AS (SELECT *, (0.45 + CASE type WHEN 'RAW' THEN 0.05 WHEN 'FACT' THEN 0.2 WHEN 'EVENT' THEN 0.12 WHEN 'ANCHOR' THEN -0.15 ELSE 0 END
  + CASE status WHEN 'outdated' THEN -0.1 WHEN 'exception' THEN 0.08 WHEN 'disputed' THEN -0.05 ELSE 0 END + 0.2 * conf)::DOUBLE * CASE WHEN type = 'ANCHOR' THEN 0.75 ELSE 1 END AS s1,
  (CASE type WHEN 'TOPIC' THEN 0.36 WHEN 'EVENT' THEN 0.58 WHEN 'FACT' THEN 0.80 WHEN 'RAW' THEN 0.95 WHEN 'ANCHOR' THEN 0.42 ELSE 0.65 END + 0.06 * conf)::DOUBLE AS s2 FROM ty),
tn AS (SELECT *, list_transform(v, lambda x: x * s1) AS t1, list_transform(v, lambda x: x * s2) AS t2 FROM sc1)"""


def typed_vectors(spark, d):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("vec_id") % n + 1).cast("int"))
    return embeddings(spark, d).select(
        "vec_id", "vector", pick(["RAW", "FACT", "EVENT", "ANCHOR", "TOPIC"], 5).alias("type"),
        pick(["active", "outdated", "exception", "disputed"], 4).alias("status"), ((F.col("vec_id") % 10) / 10.0).alias("conf"))


@query("lorentz_projection_R07", f"WITH {TYPES_SQL} SELECT vec_id, {CELLS.format(exp_sql('t1'))} AS point FROM tn")
def _(spark, d):
    t = typed_vectors(spark, d)
    return t.select("vec_id", cells(vx.project_node(F.col("vector"), F.col("type"), F.col("status"), F.col("conf"))).alias("point"))


@query("level_projection_R08", f"WITH {TYPES_SQL} SELECT vec_id, {CELLS.format(exp_sql('t2'))} AS point FROM tn")
def _(spark, d):
    t = typed_vectors(spark, d)
    return t.select("vec_id", cells(vx.project_level(F.col("vector"), F.col("type"), F.col("conf"))).alias("point"))


WEIGHTS = [[((i * 7 + j * 3) % 11 - 5) / 20.0 for j in range(64)] for i in range(8)]
BIAS = [(i - 4) / 10.0 for i in range(8)]


@query("learned_projection_R09", f"""
WITH w AS (SELECT i.i AS i, list(((i.i * 7 + j.j * 3) % 11 - 5) / 20.0::DOUBLE ORDER BY j.j) AS w FROM range(0, 8) i(i) CROSS JOIN range(0, 64) j(j) GROUP BY i.i),
t AS (SELECT vec_id, list(0.9 * tanh(list_dot_product(v, w.w) + (w.i - 4) / 10.0::DOUBLE) ORDER BY w.i) AS t FROM {EMB} CROSS JOIN w GROUP BY vec_id)
SELECT vec_id, array_to_string(list_transform({exp_sql('t')}, lambda x: CAST(CAST(round(x * 100000) AS BIGINT) AS VARCHAR)), ',') AS point FROM t""")
def _(spark, d):
    points = re_.learned_points(embeddings(spark, d).select(F.col("vec_id").alias("id"), "vector"), WEIGHTS, BIAS)
    return points.select(F.col("id").alias("vec_id"), cells("point").alias("point"))


PAIR_SQL = f"WITH {TYPES_SQL}, pt AS (SELECT vec_id, v, conf, {exp_sql('t1')} AS p FROM tn), pr AS (SELECT a.vec_id, a.v AS av, b.v AS bv, a.p AS ap, b.p AS bp, a.conf FROM pt a JOIN pt b ON b.vec_id = a.vec_id + 1)"


def point_pairs(spark, d):
    """Each vector with the next one, as vectors and as hyperbolic points."""
    t = typed_vectors(spark, d)
    p = t.withColumn("p", vx.project_node(F.col("vector"), F.col("type"), F.col("status"), F.col("conf")))
    left = p.select("vec_id", F.col("vector").alias("av"), F.col("p").alias("ap"), "conf")
    right = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("bv"), F.col("p").alias("bp"))
    return left.join(right, "vec_id")


@query("lorentz_metrics_R10", PAIR_SQL + f"""
SELECT vec_id, round(list_dot_product(ap, bp) - 2 * ap[1] * bp[1], 6) AS inner_product, round({ldist_sql('ap', 'bp')}, 5) AS distance,
 round(acosh(greatest(ap[1], 1.0000001::DOUBLE)), 5) AS radius, round(ap[2] / (ap[1] + 1), 6) AS poincare_x FROM pr""")
def _(spark, d):
    a, b = F.col("ap"), F.col("bp")
    return point_pairs(spark, d).select(
        "vec_id", F.round(vx.lorentz_inner(a, b), 6).alias("inner_product"), F.round(vx.lorentz_distance(a, b), 5).alias("distance"),
        F.round(vx.lorentz_radius(a), 5).alias("radius"), F.round(vx.to_poincare(a)[0], 6).alias("poincare_x"))


@query("scoped_lorentz_top10_R11", f"""WITH {CONVN_SQL},
pt AS (SELECT conv_id, member_id, {exp_sql('list_transform(vector, lambda x: x * 0.8)')} AS p FROM vm),
qp AS (SELECT conv_id, {exp_sql('list_transform(qv, lambda x: x * 0.72)')} AS p FROM cn),
sc AS (SELECT pt.conv_id, member_id, -{ldist_sql('qp.p', 'pt.p')} AS score FROM pt JOIN qp USING (conv_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9) DESC, member_id) AS rank FROM sc)
SELECT conv_id || ':q0001' AS question_id, conv_id, member_id AS item_id, round(score, 6) AS score, rank::INTEGER AS rank FROM rk WHERE rank <= 10""")
def _(spark, d):
    items = vector_members(spark, d).select("conv_id", F.col("member_id").alias("item_id"), F.col("cluster_id").alias("ball"), vx.exp_map(vx.scale(F.col("vector"), F.lit(0.8))).alias("vector"))
    queries = _scoped_queries(spark, d).withColumn("query_vector", vx.project_level_query(F.col("query_vector")))
    return ba.ball_top_k(queries, items, ba.lorentz(), 10).drop("ball").withColumn("score", F.round("score", 6))


@query("cone_violation_R12", PAIR_SQL + f"""
SELECT vec_id, round(0.1 + (1 - conf) * 0.9, 6)::DOUBLE AS aperture,
 round(greatest(0, acos(greatest(-1, least(1, list_dot_product(ap[2:], bp[2:]) / greatest(sqrt(list_dot_product(ap[2:], ap[2:])) * sqrt(list_dot_product(bp[2:], bp[2:])), 1e-7)))) - (0.1 + (1 - conf) * 0.9)), 6)::DOUBLE AS violation FROM pr""")
def _(spark, d):
    return point_pairs(spark, d).select("vec_id", F.round(vx.cone_aperture(F.col("conf")), 6).alias("aperture"),
                                        F.round(vx.cone_violation(F.col("ap"), F.col("bp"), F.col("conf")), 6).alias("violation"))


CONSEC_SQL = "WITH " + TURNS_SQL + f"""
tt AS (SELECT conv_id, pos, {term_set_sql('text')} AS t, list_distinct({names_sql('text')}) AS n,
   list_filter(list_distinct({names_sql('text')}), lambda x: NOT list_contains(['What','When','Where','Which','Would','Could','Should','The','How','Why'], x)) AS qn FROM turns),
tp AS (SELECT a.conv_id, a.pos, a.t AS lt, b.t AS bt, a.qn AS an, b.qn AS bn FROM tt a JOIN tt b ON b.conv_id = a.conv_id AND b.pos = a.pos + 1)"""


def consecutive(spark, d):
    t = tb.turns(spark, d).select("conv_id", "pos", tx.term_set("text").alias("t"), tx.query_names("text").alias("n"))
    left = t.select("conv_id", "pos", F.col("t").alias("at"), F.col("n").alias("an"))
    return left.join(t.select("conv_id", (F.col("pos") - 1).alias("pos"), F.col("t").alias("bt"), F.col("n").alias("bn")), ["conv_id", "pos"])


COVER = "(CASE WHEN len(lt) > 0 AND len(bt) > 0 THEN len(list_intersect(lt, bt))::DOUBLE / len(lt) ELSE 0::DOUBLE END)"


@query("lexical_overlap_R13", CONSEC_SQL + f"SELECT conv_id, pos, round({jaccard_sql('lt', 'bt')}, 6) AS redundancy, round({COVER}, 6) AS coverage FROM tp")
def _(spark, d):
    a, b = F.col("at"), F.col("bt")
    return consecutive(spark, d).select("conv_id", "pos", F.round(tx.jaccard(a, b), 6).alias("redundancy"), F.round(tx.coverage(a, b), 6).alias("coverage"))


@query("entity_overlap_R14", CONSEC_SQL + f"""
SELECT conv_id, pos, round(CASE WHEN len(an) > 0 AND len(bn) > 0 THEN len(list_intersect(an, bn))::DOUBLE / len(an) ELSE least(1, {COVER}) END, 6)::DOUBLE AS overlap FROM tp""")
def _(spark, d):
    value = tx.entity_or_term_overlap(F.col("an"), F.col("at"), F.col("bn"), F.col("bt"))
    return consecutive(spark, d).select("conv_id", "pos", F.round(value, 6).alias("overlap"))


@query("cosine_R15", PAIR_SQL + f"SELECT vec_id, round({cos_sql('av', 'bv')}, 6)::DOUBLE AS cosine FROM pr")
def _(spark, d):
    return point_pairs(spark, d).select("vec_id", F.round(vx.cosine(F.col("av"), F.col("bv")), 6).alias("cosine"))
