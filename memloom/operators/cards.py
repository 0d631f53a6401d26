"""Relation cards, card-guided expansion, quota selection and the cross-validated ranking model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.operators.ordering import dense_ordinal, first_per, top_per
from memloom.session import cut_lineage

Q = "question_id"
# Accepted card types and roles.
TYPES = ["change", "preference", "state", "plan_constraint", "temporal"]
ROLES = ["old_state", "new_state", "preference_value", "polarity", "state_value", "plan_goal", "constraint", "temporal_scope", "reason_or_trigger", "exception", "context", "location", "decision", "progress", "evidence"]
REPLY = T.StructType([T.StructField("cards", T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("entity", T.StringType()), T.StructField("aspect", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("needed_roles", T.ArrayType(T.StringType())), T.StructField("support_facts", T.ArrayType(T.StringType())),
    T.StructField("roles", T.MapType(T.StringType(), T.StructType([
        T.StructField("value", T.StringType()), T.StructField("fact_ids", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType())]))),
])))])


def token(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[- ]", "_")


def card_context(candidates: DataFrame, nodes: DataFrame, top: int = 50, words: int = 70) -> DataFrame:
    """First ``top`` non-completion candidates per question with their text cut to ``words`` words."""
    ranked = top_per(candidates.filter("NOT is_completion"), [Q], [F.asc("rank"), F.asc("node_id")], top, "context_rank")
    text = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, words), " ")
    return ranked.join(nodes.select("conv_id", "node_id", text.alias("text"), "time"), ["conv_id", "node_id"])


def validate_cards(replies: DataFrame, context: DataFrame, max_cards: int = 3) -> DataFrame:
    """(question, card, role, fact) rows of valid cards from JSON replies.

    Facts must be in the question's context, a card needs two of them, unknown roles become evidence; needed
    roles default to the first three of the card. ``replies``: (question_id, reply).
    """
    cards = replies.select(Q, F.posexplode(F.slice(F.from_json("reply", REPLY)["cards"], 1, max_cards)).alias("i", "card")).filter(token(F.col("card.type")).isin(TYPES))
    base = cards.select(Q, (F.col("i") + 1).alias("card_no"), token(F.col("card.type")).alias("card_type"), F.trim(F.coalesce("card.entity", F.lit(""))).alias("entity"), F.trim(F.coalesce("card.aspect", F.lit(""))).alias("aspect"),
                        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("card.confidence", F.lit(0.8)))).alias("confidence"), F.transform("card.needed_roles", token).alias("needed"), "card.roles", "card.support_facts")
    entries = base.select(Q, "card_no", F.posexplode(F.map_entries("roles")).alias("role_pos", "e")).select(
        Q, "card_no", "role_pos", F.when(token(F.col("e.key")).isin(ROLES), token(F.col("e.key"))).otherwise("evidence").alias("role"), F.coalesce("e.value.confidence", F.lit(1.0)).alias("role_confidence"),
        F.posexplode("e.value.fact_ids").alias("fact_pos", "node_id"))
    known = context.select(Q, "node_id").distinct()
    by_role = entries.join(known, [Q, "node_id"], "left_semi")
    listed = base.select(Q, "card_no", F.posexplode("support_facts").alias("fact_pos", "node_id")).join(known, [Q, "node_id"], "left_semi")
    support = by_role.select(Q, "card_no", "node_id").unionByName(listed.select(Q, "card_no", "node_id")).distinct()
    big = support.groupBy(Q, "card_no").agg(F.count(F.lit(1)).alias("size")).filter("size >= 2")
    bare = listed.join(by_role.select(Q, "card_no").distinct(), [Q, "card_no"], "left_anti").select(
        Q, "card_no", F.lit(0).alias("role_pos"), F.lit("evidence").alias("role"), F.lit(0.8).alias("role_confidence"), "fact_pos", "node_id")
    columns = [Q, "card_no", "role_pos", "role", "role_confidence", "fact_pos", "node_id"]
    # two unknown roles both become evidence; the later one counts, in the place of the first
    last = F.max("role_pos").over(Window.partitionBy(Q, "card_no", "role"))
    kept = by_role.withColumn("last_pos", last).filter("role_pos = last_pos").drop("last_pos")
    rows = kept.select(columns).unionByName(bare.select(columns))
    role_no = by_role.select(columns).unionByName(bare.select(columns)).groupBy(Q, "card_no", "role").agg(F.min("role_pos").alias("role_pos2"))
    order = Window.partitionBy(Q, "card_no").orderBy("role_pos2", "role")
    role_no = role_no.withColumn("role_no", F.row_number().over(order)).withColumn("role_count", F.count(F.lit(1)).over(Window.partitionBy(Q, "card_no"))).drop("role_pos2")
    joined = rows.join(role_no, [Q, "card_no", "role"]).join(big, [Q, "card_no"]).join(base.select(Q, "card_no", "card_type", "entity", "aspect", "confidence", "needed"), [Q, "card_no"])
    asked = F.coalesce(F.array_contains("needed", F.col("role")), F.lit(False))
    named = F.max(asked.cast("int")).over(Window.partitionBy(Q, "card_no"))
    marked = joined.withColumn("asked", asked).withColumn("named", named)
    return marked.withColumn("is_needed", F.when(F.col("named") == 1, F.col("asked")).otherwise(F.col("role_no") <= 3)).drop("needed", "asked", "named", "role_pos", "fact_pos").distinct()


def annotate_candidates(candidates: DataFrame, cards: DataFrame) -> DataFrame:
    """Candidates with the columns of their best card (confidence, then earlier card), ordered by score ``ce``.

    Scores equal to nine digits count as ties, in node order: sums in another order differ in the last digits.
    """
    needed = cards.filter("is_needed")
    sets = needed.groupBy(Q, "card_no").agg(F.collect_set("role").alias("needed_roles"))
    both = lambda a, b: (F.array_contains("needed_roles", a) & F.array_contains("needed_roles", b)).cast("int")
    rows = needed.join(sets, [Q, "card_no"])
    best = first_per(rows.withColumn("minus", -F.col("confidence")), [Q, "node_id"], ["minus", "card_no", "role_no"],
                     ["card_no", "card_type", "role", "size", "confidence", "role_confidence", "role_count", "entity", "aspect", "needed_roles"])
    joined = candidates.join(best, [Q, "node_id"], "left")
    ranked = Window.partitionBy(Q).orderBy(F.desc(F.round("ce", 9)), "node_id")
    return joined.withColumn("is_card", F.col("card_no").isNotNull()).withColumn("has_old_and_new", F.coalesce(both("old_state", "new_state"), F.lit(0))).withColumn(
        "has_preference_and_constraint", F.coalesce(both("preference_value", "constraint"), F.lit(0))).withColumn("position", F.row_number().over(ranked)).drop("needed_roles")


def card_coverage(questions: DataFrame, cards: DataFrame, evidence: DataFrame, gold: DataFrame) -> DataFrame:
    """Average cards and card facts, hit and full cover of gold by card facts, as one row.

    ``questions``: (question_id, conv_id).
    """
    facts = cards.filter("is_needed").select(Q, "node_id").distinct()
    found = facts.join(questions, Q).join(evidence, ["conv_id", "node_id"]).join(gold, [Q, "evidence"], "left_semi").select(Q, "evidence").distinct().groupBy(Q).agg(F.count(F.lit(1)).alias("found"))
    wanted = gold.select(Q, "evidence").distinct().groupBy(Q).agg(F.count(F.lit(1)).alias("wanted"))
    per = questions.select(Q).join(cards.select(Q, "card_no").distinct().groupBy(Q).agg(F.count(F.lit(1)).alias("cards")), Q, "left").join(
        facts.groupBy(Q).agg(F.count(F.lit(1)).alias("facts")), Q, "left").join(found, Q, "left").join(wanted, Q, "left").fillna(0)
    return per.agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(F.col("cards") > 0).alias("card_questions"), F.avg("cards").alias("avg_cards"), F.avg("facts").alias("avg_card_facts"),
        F.avg((F.col("found") > 0).cast("double")).alias("card_hit"), F.avg(((F.col("wanted") > 0) & (F.col("found") == F.col("wanted"))).cast("double")).alias("card_full_cover"), F.sum("found").alias("card_gold_facts"))


def guided_expansion(candidates: DataFrame, base: int = 100, extra: int = 20, min_confidence: float = 0.75) -> DataFrame:
    """Base candidates plus the best tail candidates of the events and topics of confident cards.

    ``candidates``: (question_id, node_id, rank, ce, event_id, topic_id, event_degree, topic_degree, card_confidence).
    """
    head, tail = candidates.filter(F.col("rank") <= base), candidates.filter(F.col("rank") > base)
    trusted = head.filter(F.col("card_confidence") >= min_confidence)
    events = trusted.filter("event_id <> ''").select(Q, "event_id").distinct().withColumn("in_event", F.lit(1))
    topics = trusted.filter("topic_id <> ''").select(Q, "topic_id").distinct().withColumn("in_topic", F.lit(1))
    damp = lambda degree: F.least(F.col(degree) / 100.0, F.lit(0.5))
    rows = tail.join(events, [Q, "event_id"], "left").join(topics, [Q, "topic_id"], "left").withColumn(
        "expansion_score", F.when(F.col("in_event") == 1, 2.0 - damp("event_degree")).when(F.col("in_topic") == 1, 1.0 - damp("topic_degree")).otherwise(0.0)).withColumn(
        "expansion_source", F.when(F.col("in_event") == 1, "same_event").when(F.col("in_topic") == 1, "same_topic"))
    chosen = top_per(rows.filter("expansion_score > 0"), [Q], [F.desc("expansion_score"), F.desc("ce"), F.asc("rank")], extra, "extra_no")
    columns = [Q, "node_id", "rank", "ce", "event_id", "topic_id"]
    return head.select(*columns, F.lit(None).cast("string").alias("expansion_source")).unionByName(chosen.select(*columns, "expansion_source"))


def card_index(selected: DataFrame) -> DataFrame:
    """Best card score per (question, fact) among selected rows."""
    return selected.filter("is_selected").groupBy(Q, "node_id").agg(F.max("card_score").alias("card_score"))


def quota_selection(candidates: DataFrame, index: DataFrame, k: int, quota: int) -> DataFrame:
    """``quota`` best card facts by (card score, model score), filled by model score without repeats up to ``k``.

    ``candidates``: (question_id, node_id, model_score, rank).
    """
    rows = candidates.join(index, [Q, "node_id"], "left")
    with_card = F.col("card_score").isNotNull()
    card_order = Window.partitionBy(Q).orderBy(F.desc_nulls_last("card_score"), F.desc("model_score"), "rank")
    marked = rows.withColumn("card_rank", F.row_number().over(card_order)).withColumn("quota_selected", with_card & (F.col("card_rank") <= quota))
    order = F.when(F.col("quota_selected"), F.col("card_rank")).otherwise(F.lit(1 << 30))
    picked = top_per(marked, [Q], [order.asc(), F.desc("model_score"), F.asc("rank")], k, "selected_no")
    return picked.select(Q, "node_id", "model_score", F.coalesce("card_score", F.lit(0.0)).alias("card_score"), "quota_selected", "selected_no")


def quota_for(k: int, strength: str = "light") -> int:
    """Fixed quotas: light 2 or 5, medium 3 or 10 for short and long cuts."""
    return {"light": (2, 5), "medium": (3, 10)}[strength][0 if k <= 5 else 1]


def selected_summary(selected: DataFrame, labels: DataFrame) -> DataFrame:
    """Selected card facts and their gold rates, overall and by quota, as one row."""
    rows = selected.join(labels, [Q, "node_id"], "left").withColumn("gold", F.coalesce("label", F.lit(0)) == 1).filter("card_score > 0")
    rate = lambda a, b: a / F.greatest(b, F.lit(1))
    n, gold, q, qgold = F.count(F.lit(1)), F.count_if("gold"), F.count_if("quota_selected"), F.count_if(F.col("quota_selected") & F.col("gold"))
    return rows.agg(n.alias("card_facts"), gold.alias("card_gold_facts"), rate(gold, n).alias("card_gold_rate"), q.alias("quota_facts"), qgold.alias("quota_gold_facts"), rate(qgold, q).alias("quota_gold_rate"),
                    F.countDistinct(F.when(F.col("gold"), F.col(Q))).alias("questions_with_card_gold"))


def ranking_pairs(rows: DataFrame, features: Sequence[str], partners: int = 8, seed: int = 13) -> DataFrame:
    """Feature differences of a relevant and another row of the same question, with label 1, and turned round with label 0.

    Rows that are not relevant are numbered in a hashed order; a relevant row meets ``partners`` of them by number, so pairs
    grow with the rows and not with their square.
    """
    vector = F.array(*[F.col(f).cast("double") for f in features])
    marked = rows.select(Q, "node_id", "label", vector.alias("x"), F.xxhash64(Q, "node_id", F.lit(seed)).alias("h"))
    others = dense_ordinal(marked.filter("label = 0").select(Q, F.col("x").alias("y"), "h", F.shiftrightunsigned("h", 1).alias("place")), [Q], "place", "number", 1 << 55)
    sizes = others.groupBy(Q).agg((F.max("number") + 1).alias("size"))
    asked = marked.filter("label = 1").join(sizes, Q).withColumn("j", F.explode(F.sequence(F.lit(0), F.least(F.col("size"), F.lit(partners)) - 1)))
    met = asked.withColumn("number", F.pmod(F.pmod("h", "size") + F.col("j"), F.col("size"))).join(others.select(Q, "number", "y"), [Q, "number"])
    turned = met.select(F.zip_with("x", "y", lambda a, b: a - b).alias("d"), F.pmod(F.xxhash64("h", "j"), F.lit(2)).cast("double").alias("label"))
    return turned.select("label", array_to_vector(F.when(F.col("label") == 1, F.col("d")).otherwise(F.transform("d", lambda v: -v))).alias("features"))


def fit_ranker(rows: DataFrame, features: Sequence[str], iterations: int = 50, ridge: float = 1e-4, partners: int = 8, seed: int = 13) -> list[float]:
    """Weights of a linear score that puts relevant rows before others of the same question: logistic regression on pairs."""
    model = LogisticRegression(maxIter=iterations, regParam=ridge, fitIntercept=False).fit(ranking_pairs(rows, features, partners, seed))
    return [float(w) for w in model.coefficients]


def score_rows(weights: Sequence[float], rows: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    total = sum((F.col(f).cast("double") * w for f, w in zip(features, weights)), F.lit(0.0))
    return rows.select(*keep, total.alias("model_score"))


def cross_validate(rows: DataFrame, folds: Sequence, features: Sequence[str], fold: str = "conv_id", seed: int = 13, **params) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores, and the weight of each feature per standard deviation, averaged over the folds.

    For every fold value the model trains on the other folds. ``folds`` is the caller's list (one conversation each,
    or groups of them on large data); training itself is distributed.
    """
    spread = rows.agg(*[F.coalesce(F.stddev(F.col(f).cast("double")), F.lit(0.0)).alias(f) for f in features]).first()
    scored, importances = None, []
    for number, value in enumerate(folds):
        weights = fit_ranker(rows.filter(F.col(fold) != value), features, seed=seed + number, **params)
        part = score_rows(weights, rows.filter(F.col(fold) == value), features, [Q, "node_id", fold])
        scored = part if scored is None else scored.unionByName(part)
        importances += [(number, name, abs(weight) * spread[name]) for name, weight in zip(features, weights)]
    table = rows.sparkSession.createDataFrame(importances, "fold int, feature string, importance double")
    return scored, table.groupBy("feature").agg(F.avg("importance").alias("importance"))


def listwise_targets(rows: DataFrame) -> DataFrame:
    """Adds ``target`` and ``weight``, the Newton step of each row and its curvature, for the listwise softmax loss of its question.

    A row pulls its score up by its share of the question's relevance less its share of the softmax of scores. Both shares
    come from per-question sums, so no rows are paired. Questions without a relevant row teach nothing.
    """
    sums = rows.groupBy(Q).agg(F.sum(F.exp("score")).alias("_mass"), F.sum("label").alias("_relevance")).filter("_relevance > 0")
    share = F.exp("score") / F.col("_mass")
    gradient, curvature = F.col("label") / F.col("_relevance") - share, share * (1 - share)
    joined = rows.join(sums, Q).withColumn("weight", curvature + 1e-3).withColumn("target", gradient / F.col("weight"))
    return joined.drop("_mass", "_relevance")


def _assembled(rows: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return rows.select(*keep, array_to_vector(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])).alias("features"))


def _boosted_score(trees: Sequence, rows: DataFrame, rate: float) -> DataFrame:
    """Adds ``score``, the trees' predictions summed at the learning rate."""
    scored = rows.withColumn("score", F.lit(0.0))
    for tree in trees:
        scored = tree.transform(scored).withColumn("score", F.col("score") + rate * F.col("prediction")).drop("prediction")
    return scored


def fit_boosted(rows: DataFrame, features: Sequence[str], rounds: int = 8, depth: int = 4, rate: float = 0.5, least: int = 5, seed: int = 13) -> list:
    """Regression trees that together rank relevant rows of a question first: each fits the listwise steps of those before it.

    All rows train; a round is one pass of per-question sums and one distributed tree. ``rows``: (question_id, label, features).
    """
    table = cut_lineage(_assembled(rows, features, [Q, "label"]))
    trees: list = []
    for number in range(rounds):
        steps = listwise_targets(_boosted_score(trees, table, rate))
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="target", weightCol="weight", maxDepth=depth, minInstancesPerNode=least, seed=seed + number)
        trees.append(tree.fit(steps.select("features", "target", "weight")))
    return trees


def score_boosted(trees: Sequence, rows: DataFrame, features: Sequence[str], keep: Sequence[str], rate: float = 0.5) -> DataFrame:
    return _boosted_score(trees, _assembled(rows, features, keep), rate).select(*keep, F.col("score").alias("model_score"))


def cross_validate_boosted(rows: DataFrame, folds: Sequence, features: Sequence[str], fold: str = "fold", seed: int = 13, **params) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores of boosted trees, and the share of each feature in their splits, averaged over the folds.

    A fold is whole conversations: one each on small data, groups of them by hash on large.
    """
    rows = cut_lineage(rows)
    scored, shares = None, []
    for number, value in enumerate(folds):
        trees = fit_boosted(rows.filter(F.col(fold) != value), features, seed=seed + number, **params)
        part = score_boosted(trees, rows.filter(F.col(fold) == value), features, [Q, "node_id", fold], params.get("rate", 0.5))
        scored = part if scored is None else scored.unionByName(part)
        total = [sum(float(t.featureImportances[i]) for t in trees) / max(1, len(trees)) for i in range(len(features))]
        shares += list(zip([number] * len(features), features, total))
    table = rows.sparkSession.createDataFrame(shares, "fold int, feature string, importance double")
    return scored, table.groupBy("feature").agg(F.avg("importance").alias("importance"))


def ndcg(scored: DataFrame, k: int = 10) -> DataFrame:
    """``question_id, ndcg`` of rows (question_id, node_id, label, model_score), for questions with a relevant row."""
    gain = (F.pow(F.lit(2.0), F.col("label")) - 1) / F.log2(F.col("place") + 1)
    total = lambda order: top_per(scored, [Q], order, k, "place").groupBy(Q).agg(F.sum(gain).alias("gain"))
    got = total([F.desc(F.round("model_score", 9)), F.asc("node_id")])
    best = total([F.desc("label"), F.asc("node_id")]).withColumnRenamed("gain", "best").filter("best > 0")
    return best.join(got, Q).select(Q, (F.col("gain") / F.col("best")).alias("ndcg"))


def holdout(rows: DataFrame, count: int) -> DataFrame:
    """Rows marked as test when their conversation is among the last ``count`` in order."""
    last = rows.select("conv_id").distinct().orderBy(F.desc("conv_id")).limit(count).withColumn("is_test", F.lit(True))
    return rows.join(last, "conv_id", "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def apply_scores(candidates: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Candidates with their model score, best ``k`` per question."""
    return top_per(candidates.drop("model_score").join(scores.select(Q, "node_id", "model_score"), [Q, "node_id"]), [Q], [F.desc(F.round("model_score", 9)), F.asc("node_id")], k, "model_rank")
