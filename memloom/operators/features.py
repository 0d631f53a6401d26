"""Candidate features as columns: one join per lookup table, one window per question pool, the rest projections.

Candidate rows carry typed columns; absent ranks and scores are 0, absent nodes give 0 in every feature of theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.functions import vectors as vx
from memloom.operators.metrics import evidence_id
from memloom.operators.ordering import dense_ordinal, top_per
from memloom.operators.retrieval import log1p
from memloom.sources.artifacts import written

Q = "question_id"
RANKS = ["route_rank", "eu_event_rank", "eu_topic_rank", "eu_topic_event_rank", "hyp_event_rank", "hyp_topic_rank", "hyp_topic_event_rank", "hyp_bottom_rank", "bottom_up_rank"]
# The features of the main ranking model, in order.
MODEL_FEATURES = [
    "ce_score", "base_score", "bm25_norm", "ce_rank", "ce_reciprocal_rank", "query_term_overlap", "text_token_count", "query_token_count",
    "has_topdown_route", "has_bottom_up_route", "route_from_both", "is_eu_route", "is_hyp_route", "route_source_count", "route_overlap_score",
    "eu_hyp_agreement", "bottom_up_eu_agreement", "bottom_up_hyp_agreement", "route_consistency_entropy", "is_nary_completion",
    "nary_hyperedge_size", "nary_hyperedge_confidence", "nary_same_hyperedge_count_in_candidate_pool", "nary_role_coverage_potential",
]


def flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def zero(value: Column | str) -> Column:
    return F.coalesce(tx.col_of(value).cast("double"), F.lit(0.0))


def inverse(rank: Column) -> Column:
    return F.when(rank > 0, 1.0 / rank).otherwise(F.lit(0.0))


def rrf(rank: Column, constant: float = 60.0) -> Column:
    return F.when(rank > 0, 1.0 / (constant + rank)).otherwise(F.lit(0.0))


def min_positive(*values: Column) -> Column:
    return F.coalesce(F.array_min(F.filter(F.array(*values), lambda v: v > 0)), F.lit(0.0))


def max_positive(*values: Column) -> Column:
    """Largest positive value, else the largest of all."""
    whole = F.array(*values)
    return F.coalesce(F.array_max(F.filter(whole, lambda v: v > 0)), F.array_max(whole))


def rank_gap(left: Column, right: Column) -> Column:
    return F.when((left > 0) & (right > 0), left - right).otherwise(F.lit(0.0))


def parent_index(child_edges: DataFrame) -> DataFrame:
    """Children per parent and the strongest edge of each pair: (conv_id, child, parent, confidence, siblings).

    Edges are dealt by parent once; pairs, counts and their join, and a join by the caller on the parent, stay where they lie.
    """
    pairs = child_edges.repartition("conv_id", "parent").groupBy("conv_id", "child", "parent").agg(F.max("confidence").alias("confidence"))
    counts = pairs.groupBy("conv_id", "parent").agg(F.count(F.lit(1)).alias("siblings"))
    return pairs.join(counts, ["conv_id", "parent"])


def topology_index(fact_event: DataFrame, event_episode: DataFrame, episode_topic: DataFrame) -> DataFrame:
    """fact → event → episode → topic with child and fact counts on every level; events are completed before facts join them."""
    fe = parent_index(fact_event).select("conv_id", F.col("child").alias("fact_id"), F.col("parent").alias("event_id"), F.col("confidence").alias("event_edge"), F.col("siblings").alias("event_degree"))
    ee = parent_index(event_episode).select("conv_id", F.col("child").alias("event_id"), F.col("parent").alias("episode_id"), F.col("confidence").alias("episode_edge"), F.col("siblings").alias("episode_events"))
    et = parent_index(episode_topic).select("conv_id", F.col("child").alias("episode_id"), F.col("parent").alias("topic_id"), F.col("confidence").alias("topic_edge"))
    sizes = fe.groupBy("conv_id", "event_id").agg(F.count(F.lit(1)).alias("n"))
    levels = ee.select("conv_id", "event_id", "episode_id").join(et.select("conv_id", "episode_id", "topic_id"), ["conv_id", "episode_id"], "left").join(sizes, ["conv_id", "event_id"])
    episode_facts = levels.groupBy("conv_id", "episode_id").agg(F.sum("n").alias("episode_facts"))
    topic_facts = levels.groupBy("conv_id", "topic_id").agg(F.sum("n").alias("topic_degree"))
    events = ee.join(et, ["conv_id", "episode_id"], "left").join(episode_facts, ["conv_id", "episode_id"], "left").join(topic_facts, ["conv_id", "topic_id"], "left")
    return fe.join(events, ["conv_id", "event_id"], "left")


def path_index(paths: DataFrame) -> DataFrame:
    """``topology_index`` of rows that carry a fact's whole path, where an event has one episode: the child and fact counts of every level.

    Paths are (conv_id, event_id, episode_id, topic_id, fact columns) without repeats. They are dealt by episode once; only a topic's total crosses
    tasks. Totals are stored, so that their size is known before paths move for them.
    """
    event, episode = Window.partitionBy("conv_id", "episode_id", "event_id"), Window.partitionBy("conv_id", "episode_id")
    totals = written(paths.groupBy("conv_id", "topic_id").agg(F.count(F.lit(1)).alias("topic_degree")))
    placed = paths.repartition("conv_id", "episode_id").withColumn("event_no", F.dense_rank().over(episode.orderBy("event_id")))
    counted = placed.select("*", F.count(F.lit(1)).over(event).alias("event_degree"), F.count(F.lit(1)).over(episode).alias("episode_facts"),
                            F.max("event_no").over(episode).cast("bigint").alias("episode_events"))
    return counted.drop("event_no").join(totals, ["conv_id", "topic_id"])


def retrieval_features(candidates: DataFrame, nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """Scores, ranks, hop and name evidence, text lengths and term overlap.

    ``candidates``: (question_id, conv_id, node_id, ce, base, bm25, ce_rank, hop, is_seed, entity_overlap, source).
    """
    words = lambda c: F.size(F.split(F.trim(c), r"\s+")).cast("double")
    asked = questions.select(Q, F.col("conv_id").alias("q_conv"), tx.term_set("question").alias("q_terms"), words("question").alias("query_token_count"), zero("category").alias("category"))
    known = nodes.select("conv_id", "node_id", tx.term_set("text").alias("n_terms"), words("text").alias("text_token_count"), F.col("confidence").alias("node_confidence"), "status",
                         F.size("support_ids").cast("double").alias("support_count"), F.col("source").alias("node_source"))
    rows = candidates.join(known, ["conv_id", "node_id"], "left").join(asked, Q)
    overlap = F.size(F.array_intersect("q_terms", "n_terms")) / F.greatest(F.size("q_terms"), F.lit(1))
    columns = {
        "ce_score": zero("ce"), "base_score": zero("base"), "bm25_norm": zero("bm25"), "ce_rank": zero("ce_rank"), "ce_reciprocal_rank": 1.0 / F.greatest(zero("ce_rank"), F.lit(1.0)),
        "is_seed": flag(F.col("is_seed")), "hop": zero("hop"), "is_hop_0": flag(F.col("hop") == 0), "is_hop_2": flag(F.col("hop") == 2), "entity_overlap": zero("entity_overlap"),
        "same_conversation": flag(F.col("q_conv") == F.col("conv_id")), "node_confidence": zero("node_confidence"), "is_active": flag(F.col("status") == "active"),
        "is_outdated": flag(F.col("status") == "outdated"), "is_exception": flag(F.col("status") == "exception"), "support_count": zero("support_count"), "text_token_count": zero("text_token_count"),
        "query_token_count": zero("query_token_count"), "query_term_overlap": F.coalesce(F.when(F.size("q_terms") > 0, overlap), F.lit(0.0)), "category": zero("category"),
        "from_filtered_sibling": flag(F.col("source") == "filtered_sibling"), "from_seed": flag(F.col("source") == "seed"), "from_same_event": flag(F.col("source") == "same_event"),
        "from_same_topic": flag(F.col("source") == "same_topic"), "is_observation": flag(F.col("node_source").contains("observation")), "is_summary": flag(F.col("node_source").contains("summary")),
    }
    return rows.select(Q, "conv_id", "node_id", *[c.alias(n) for n, c in columns.items()])


def seed_features(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shared session, speaker, source and supports of a candidate and its seed. Rows carry ``seed_id``."""
    info = lambda p: nodes.select("conv_id", *[F.col(c).alias(f"{p}_{c}") for c in ("node_id", "session_id", "speaker", "source")],
                                  F.array_distinct(F.transform("support_ids", evidence_id)).alias(f"{p}_supports"))
    rows = candidates.join(info("c").withColumnRenamed("c_node_id", "node_id"), ["conv_id", "node_id"], "left").join(info("s").withColumnRenamed("s_node_id", "seed_id"), ["conv_id", "seed_id"], "left")
    same = lambda c: flag((F.col(f"c_{c}") == F.col(f"s_{c}")) & (F.col(f"c_{c}") != ""))
    return rows.select(Q, "conv_id", "node_id", "seed_id", same("session_id").alias("same_session_as_seed"), same("speaker").alias("same_speaker_as_seed"), same("source").alias("same_source_as_seed"),
                       F.coalesce(tx.jaccard(F.col("c_supports"), F.col("s_supports")), F.lit(0.0)).alias("support_overlap_with_seed"))


def hierarchy_features(candidates: DataFrame, index: DataFrame, levels: DataFrame) -> DataFrame:
    """Event, episode and topic size, confidence, coherence and agreement with the seed.

    ``candidates`` carries node_id and seed_id; ``levels``: (conv_id, level_id, confidence, coherence).
    """
    for level in ("event", "episode", "topic"):
        index = index.join(levels.select("conv_id", F.col("level_id").alias(f"{level}_id"), F.col("confidence").alias(f"{level}_confidence"), F.col("coherence").alias(f"{level}_coherence")), ["conv_id", f"{level}_id"], "left")
    mine = index.withColumnRenamed("fact_id", "node_id")
    seeds = index.select("conv_id", F.col("fact_id").alias("seed_id"), F.col("event_id").alias("seed_event"), F.col("topic_id").alias("seed_topic")).join(candidates.select("conv_id", "seed_id").distinct(), ["conv_id", "seed_id"], "left_semi")
    return hierarchy_columns(candidates.join(mine, ["conv_id", "node_id"], "left").join(seeds, ["conv_id", "seed_id"], "left"))


def hierarchy_columns(rows: DataFrame) -> DataFrame:
    """The features of candidates that carry their index and levels, ``seed_event`` and ``seed_topic``."""
    columns = {
        "has_event": flag(F.col("event_id").isNotNull()), "event_degree": zero("event_degree"), "event_log_degree": log1p(zero("event_degree")), "event_confidence": zero("event_confidence"),
        "event_coherence": zero("event_coherence"), "event_edge": zero("event_edge"), "same_event_as_seed": flag(F.col("event_id") == F.col("seed_event")),
        "has_topic": flag(F.col("topic_id").isNotNull()), "topic_degree": zero("topic_degree"), "topic_log_degree": log1p(zero("topic_degree")), "topic_confidence": zero("topic_confidence"),
        "topic_coherence": zero("topic_coherence"), "topic_edge": zero("topic_edge"), "same_topic_as_seed": flag(F.col("topic_id") == F.col("seed_topic")),
        "has_episode": flag(F.col("episode_id").isNotNull()), "episode_events": zero("episode_events"), "episode_log_events": log1p(zero("episode_events")), "episode_facts": zero("episode_facts"),
        "episode_log_facts": log1p(zero("episode_facts")), "episode_coherence": zero("episode_coherence"), "episode_is_singleton": flag(F.col("episode_events") == 1), "episode_edge": zero("episode_edge"),
    }
    return rows.select(Q, "conv_id", "node_id", *[c.alias(n) for n, c in columns.items()])


def anchor_features(candidates: DataFrame, links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchor degree, confidence, child count and edge confidence. ``candidates`` carries anchor_id and anchor_degree."""
    edges = parent_index(links.select("conv_id", F.col("fact_id").alias("child"), F.col("anchor_id").alias("parent"), "confidence"))
    counts = edges.select("conv_id", F.col("parent").alias("anchor_id"), "siblings").distinct()
    pair = edges.select("conv_id", F.col("child").alias("node_id"), F.col("parent").alias("anchor_id"), F.col("confidence").alias("edge"))
    known = anchors.select("conv_id", F.col("node_id").alias("anchor_id"), F.col("confidence").alias("anchor_confidence"))
    rows = candidates.join(known, ["conv_id", "anchor_id"], "left").join(counts, ["conv_id", "anchor_id"], "left").join(pair, ["conv_id", "node_id", "anchor_id"], "left")
    return rows.select(Q, "conv_id", "node_id", zero("anchor_degree").alias("anchor_degree"), log1p(zero("anchor_degree")).alias("anchor_log_degree"), flag(F.col("anchor_confidence").isNotNull()).alias("has_anchor"),
                       zero("anchor_confidence").alias("anchor_confidence"), zero("siblings").alias("anchor_child_count"), zero("edge").alias("anchor_edge_confidence"))


def route_flags(source: Column) -> dict[str, Column]:
    s = F.coalesce(source, F.lit(""))
    has = {name: s.contains(name) for name in ("eu_event", "eu_topic", "hyp_event", "hyp_topic", "hyp_bottom", "bottom_up", "temporal_session")}
    has["eu"] = has["eu_event"] | has["eu_topic"]
    has["hyp"] = has["hyp_event"] | has["hyp_topic"] | has["hyp_bottom"]
    has["top_down"] = has["eu_event"] | has["eu_topic"] | has["hyp_event"] | has["hyp_topic"]
    return has


def route_features(candidates: DataFrame) -> DataFrame:
    """Presence, agreement, ranks, gaps and fusion scores of the retrieval routes of each candidate."""
    has = route_flags(F.col("route_source"))
    r = {name: zero(name) for name in RANKS}
    five = [has["bottom_up"], has["eu_event"], has["eu_topic"], has["hyp_event"] | has["hyp_bottom"], has["hyp_topic"]]
    active = sum((flag(f) for f in five[1:]), flag(five[0]))
    eu_best = min_positive(r["eu_event_rank"], r["eu_topic_rank"], r["eu_topic_event_rank"])
    hyp_best = min_positive(r["hyp_event_rank"], r["hyp_topic_rank"], r["hyp_topic_event_rank"], r["hyp_bottom_rank"])
    top_best = min_positive(eu_best, hyp_best, r["route_rank"])
    any_best = min_positive(*r.values())
    eu_score = max_positive(zero("semantic_score"), zero("eu_event_score"), zero("eu_topic_score"))
    hyp_score = max_positive(zero("hyperbolic_score"), zero("hyp_event_score"), zero("hyp_topic_score"), zero("hyp_bottom_score"))
    bu, bottom = has["bottom_up"], r["bottom_up_rank"]
    eu_path, hyp_path = has["eu_event"] & has["eu_topic"], has["hyp_event"] & has["hyp_topic"]
    event_best, topic_best = min_positive(r["eu_event_rank"], r["hyp_event_rank"]), min_positive(r["eu_topic_rank"], r["hyp_topic_rank"])
    columns = {
        "has_topdown_route": flag(has["top_down"]), "has_bottom_up_route": flag(bu), "route_from_both": flag(F.coalesce("from_both", F.lit(False)) | (has["top_down"] & bu)),
        "is_eu_event": flag(has["eu_event"]), "is_eu_topic": flag(has["eu_topic"]), "is_hyp_event": flag(has["hyp_event"]), "is_hyp_topic": flag(has["hyp_topic"]),
        "is_eu_route": flag(has["eu"]), "is_hyp_route": flag(has["hyp"]), "route_source_count": active, "route_overlap_score": active / 5.0, "eu_hyp_agreement": flag(has["eu"] & has["hyp"]),
        "bottom_up_eu_agreement": flag(bu & has["eu"]), "bottom_up_hyp_agreement": flag(bu & has["hyp"]), "route_consistency_entropy": F.when(active > 1, F.ln(active)).otherwise(0.0),
        "route_min_rank": any_best, "route_min_reciprocal": inverse(any_best), "bottom_up_only": flag(bu & ~has["eu"] & ~has["hyp"]), "eu_only": flag(has["eu"] & ~bu & ~has["hyp"]),
        "hyp_only": flag(has["hyp"] & ~bu & ~has["eu"]), "eu_hyp_only": flag(has["eu"] & has["hyp"] & ~bu), "all_route_hit": flag(bu & has["eu"] & has["hyp"]),
        "eu_best_rank": eu_best, "hyp_best_rank": hyp_best, "topdown_best_rank": top_best, "eu_best_reciprocal": inverse(eu_best), "hyp_best_reciprocal": inverse(hyp_best),
        "topdown_best_reciprocal": inverse(top_best), "eu_best_score": eu_score, "hyp_best_score": hyp_score, "topdown_best_score": max_positive(eu_score, hyp_score), "eu_hyp_score_gap": eu_score - hyp_score,
        "eu_hyp_rank_gap": rank_gap(eu_best, hyp_best), "bottom_up_eu_rank_gap": rank_gap(bottom, eu_best), "bottom_up_hyp_rank_gap": rank_gap(bottom, hyp_best), "eu_rrf": rrf(eu_best), "hyp_rrf": rrf(hyp_best),
        "bottom_up_rrf": rrf(bottom), "topdown_rrf": rrf(top_best), "fused_rrf": rrf(eu_best) + rrf(hyp_best) + rrf(bottom), "eu_path_complete": flag(eu_path), "hyp_path_complete": flag(hyp_path),
        "topdown_path_complete": flag(eu_path | hyp_path), "best_event_rank": event_best, "best_topic_rank": topic_best, "event_topic_rank_gap": rank_gap(event_best, topic_best),
        "fact_offset_reciprocal": 1.0 / (zero("fact_offset") + 1.0), "fact_offset": zero("fact_offset"),
    }
    for name in RANKS:
        columns[name] = r[name]
        columns[name.replace("_rank", "_reciprocal")] = inverse(r[name])
    for name in ("semantic_score", "eu_event_score", "eu_topic_score", "hyperbolic_score", "hyp_event_score", "hyp_topic_score"):
        columns[name] = zero(name)
    return candidates.select(Q, "node_id", *[c.alias(n) for n, c in columns.items()])


def episode_pool_features(candidates: DataFrame) -> DataFrame:
    """Per (question, episode): candidate count, best score, routes that reached it. Rows carry episode_id, ce, route_source."""
    pool = Window.partitionBy(Q, "episode_id")
    has = route_flags(F.col("route_source"))
    seen = lambda name: F.max(has[name].cast("double")).over(pool)
    known = F.col("episode_id").isNotNull()
    keep = lambda c: F.when(known, c).otherwise(F.lit(0.0))
    best = F.greatest(F.lit(0.0), F.max("ce").over(pool))
    rows = candidates.withColumn("episode_best_ce", keep(best)).withColumn("episode_candidates", keep(F.count(F.lit(1)).over(pool).cast("double")))
    for name in ("bottom_up", "top_down", "eu", "hyp"):
        rows = rows.withColumn(f"episode_seen_{name}", keep(seen(name)))
    return rows.select(
        Q, "node_id", "episode_candidates", "episode_best_ce", F.when(F.col("episode_best_ce") != 0, F.col("ce") - F.col("episode_best_ce")).otherwise(0.0).alias("episode_distance_to_best"),
        *[f"episode_seen_{n}" for n in ("bottom_up", "top_down", "eu", "hyp")], (F.col("episode_seen_bottom_up") * F.col("episode_seen_top_down")).alias("episode_both_directions"),
        (F.col("episode_seen_eu") * F.col("episode_seen_hyp")).alias("episode_both_geometries"))


def temporal_session_features(candidates: DataFrame, event_sessions: DataFrame) -> DataFrame:
    """Rank and degree of the temporal route, sessions of the event and shared sessions with the seed's event.

    ``candidates``: (question_id, node_id, route_source, temporal_rank, temporal_session, event_id, seed_event);
    ``event_sessions``: (event_id, session_id) rows.
    """
    pairs = event_sessions.distinct()
    degree = pairs.groupBy(F.col("session_id").alias("temporal_session")).agg(F.count(F.lit(1)).alias("degree"))
    counts = pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("sessions"))
    shared = candidates.select("event_id", "seed_event").distinct().join(pairs, "event_id").join(
        pairs.select(F.col("event_id").alias("seed_event"), "session_id"), ["seed_event", "session_id"], "left_semi").select("event_id", "seed_event").distinct().withColumn("shared", F.lit(1))
    rows = candidates.join(degree, "temporal_session", "left").join(counts, "event_id", "left").join(shared, ["event_id", "seed_event"], "left")
    has = route_flags(F.col("route_source"))
    t, d = zero("temporal_rank"), zero("degree")
    return rows.select(Q, "node_id", flag(has["temporal_session"]).alias("has_temporal_route"), t.alias("temporal_rank"), inverse(t).alias("temporal_reciprocal"), d.alias("temporal_degree"), log1p(d).alias("temporal_log_degree"),
                       zero("sessions").alias("event_session_count"), zero("shared").alias("shares_session_with_seed"), flag(has["temporal_session"] & has["bottom_up"]).alias("temporal_and_bottom_up"),
                       flag(has["temporal_session"] & has["top_down"]).alias("temporal_and_topdown"))


# Card types, roles and numbers that are features.
CARD_TYPES = ["change", "preference", "state", "plan_constraint"]
CARD_ROLES = ["old_state", "new_state", "preference_value", "polarity", "state_value", "plan_goal", "constraint", "temporal_scope", "reason_or_trigger", "exception", "context"]
CARD_NUMBERS = [
    "nary_seed_fact_rank", "nary_seed_fact_score", "nary_hyperedge_size", "nary_hyperedge_confidence", "nary_role_confidence", "nary_same_hyperedge_count_in_candidate_pool", "nary_role_coverage_potential",
    "nary_completion_rank", "nary_pool_covered_roles_count", "nary_pool_required_roles_covered", "nary_pool_has_preference_and_constraint", "nary_pool_has_old_and_new_state", "nary_pool_has_reason", "nary_pool_has_time_scope",
]


def card_features(candidates: DataFrame) -> DataFrame:
    """One-hot card type and role, seed-route flags and card numbers of annotated candidates."""
    token = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[- ]", "_")
    kind, role, seed = token("nary_type"), token("nary_role"), route_flags(F.col("nary_seed_route"))
    extractor = F.lower(F.coalesce("nary_extractor", F.lit("")))
    columns = {"is_nary_completion": flag(F.col("is_card"))}
    columns |= {f"nary_type_{t}": flag(kind == t) for t in CARD_TYPES}
    columns |= {f"nary_role_{t}": flag(role == t) for t in CARD_ROLES}
    columns |= {"nary_seed_bottom_up": flag(seed["bottom_up"]), "nary_seed_topdown": flag(seed["top_down"]), "nary_seed_eu": flag(seed["eu"]), "nary_seed_hyp": flag(seed["hyp"]),
                "nary_from_qwen": flag(extractor.contains("qwen")), "nary_from_gpt": flag(extractor.contains("gpt") | extractor.contains("4o"))}
    columns |= {name: zero(name) for name in CARD_NUMBERS}
    columns["nary_completion_reciprocal"] = inverse(zero("nary_completion_rank"))
    return candidates.select(Q, "node_id", *[c.alias(n) for n, c in columns.items()])


def labels(candidates: DataFrame, evidence: DataFrame, gold: DataFrame) -> DataFrame:
    """1 when a candidate's evidence ids meet the question's gold ids."""
    hit = candidates.select(Q, "conv_id", "node_id").join(evidence, ["conv_id", "node_id"]).join(gold, [Q, "evidence"], "left_semi").select(Q, "node_id").distinct().withColumn("label", F.lit(1))
    return candidates.select(Q, "node_id").join(hit, [Q, "node_id"], "left").select(Q, "node_id", F.coalesce("label", F.lit(0)).alias("label"))


def support_day_gap(question_id: Column, support_ids: Column) -> Column:
    """Smallest distance between the day of a question id and the days of its supports; 0 without days."""
    day = lambda c: F.nullif(F.regexp_extract(c, r"D([0-9]+):", 1), F.lit("")).cast("bigint")
    gaps = F.array_compact(F.transform(support_ids, lambda s: F.abs(day(s) - day(question_id))))
    return F.coalesce(F.array_min(gaps).cast("double"), F.lit(0.0))


def _cos(left: Column, right: Column) -> Column:
    return F.when(left.isNotNull() & right.isNotNull(), vx.cosine(left, right)).otherwise(F.lit(0.0))


def _near(left: Column, right: Column) -> Column:
    return F.when(left.isNotNull() & right.isNotNull(), -vx.lorentz_distance(left, right)).otherwise(F.lit(0.0))


def _radius(point: Column) -> Column:
    return F.when(point.isNotNull(), vx.lorentz_radius(point)).otherwise(F.lit(0.0))


def anchor_geometry(rows: DataFrame) -> DataFrame:
    """Similarities among query, seed, anchor and candidate in both geometries, radii and radial order.

    Rows carry q_vec, c_vec, s_vec, a_vec, q_pt, c_pt, s_pt, a_pt and the anchor's euc_coherence and hyp_coherence.
    """
    c = {n: F.col(n) for n in ("q_vec", "c_vec", "s_vec", "a_vec", "q_pt", "c_pt", "s_pt", "a_pt")}
    gap = F.when(c["c_pt"].isNotNull() & c["a_pt"].isNotNull(), _radius(c["c_pt"]) - _radius(c["a_pt"])).otherwise(F.lit(0.0))
    columns = {
        "euc_cos_query_candidate": _cos(c["q_vec"], c["c_vec"]), "euc_cos_seed_candidate": _cos(c["s_vec"], c["c_vec"]), "euc_cos_anchor_candidate": _cos(c["a_vec"], c["c_vec"]), "euc_anchor_child_coherence": zero("euc_coherence"),
        "hyp_neg_dist_query_candidate": _near(c["q_pt"], c["c_pt"]), "hyp_neg_dist_seed_candidate": _near(c["s_pt"], c["c_pt"]), "hyp_neg_dist_anchor_candidate": _near(c["a_pt"], c["c_pt"]),
        "hyp_candidate_radius": _radius(c["c_pt"]), "hyp_anchor_radius": _radius(c["a_pt"]), "hyp_radius_gap_candidate_anchor": gap, "hyp_radial_order_valid": flag(gap > 0), "hyp_anchor_child_coherence": zero("hyp_coherence"),
    }
    return rows.select(Q, "node_id", *[v.alias(n) for n, v in columns.items()])


def level_geometry(rows: DataFrame, prefix: str = "g2", seeds: bool = False) -> DataFrame:
    """Similarities along query, fact, event and topic, radii, gaps and coherence; ``seeds`` adds seed–fact terms.

    Rows carry q/f/e/t vectors (``q_vec`` …) and points (``q_pt`` …), coherences per level, and s_vec, s_pt for seeds.
    """
    v = {n: F.col(f"{n}_vec") for n in "qfet"}
    p = {n: F.col(f"{n}_pt") for n in "qfet"}
    down = F.when(p["f"].isNotNull() & p["e"].isNotNull(), _radius(p["f"]) - _radius(p["e"])).otherwise(F.lit(0.0))
    up = F.when(p["e"].isNotNull() & p["t"].isNotNull(), _radius(p["e"]) - _radius(p["t"])).otherwise(F.lit(0.0))
    pairs = [("query", "q", "fact", "f"), ("query", "q", "event", "e"), ("query", "q", "topic", "t"), ("fact", "f", "event", "e"), ("event", "e", "topic", "t")]
    columns = {f"{prefix}_euc_cos_{a}_{b}": _cos(v[x], v[y]) for a, x, b, y in pairs}
    columns |= {f"{prefix}_euc_event_child_coherence": zero("event_euc"), f"{prefix}_euc_topic_event_coherence": zero("topic_euc")}
    columns |= {f"{prefix}_hyp_neg_dist_{a}_{b}": _near(p[x], p[y]) for a, x, b, y in pairs}
    columns |= {f"{prefix}_hyp_{n}_radius": _radius(p[k]) for n, k in (("fact", "f"), ("event", "e"), ("topic", "t"))}
    columns |= {f"{prefix}_hyp_radius_gap_fact_event": down, f"{prefix}_hyp_radius_gap_event_topic": up, f"{prefix}_hyp_radial_order_fact_event": flag(down > 0), f"{prefix}_hyp_radial_order_event_topic": flag(up > 0),
                f"{prefix}_hyp_event_child_coherence": zero("event_hyp"), f"{prefix}_hyp_topic_event_coherence": zero("topic_hyp")}
    if seeds:
        columns |= {f"{prefix}_euc_cos_seed_fact": _cos(F.col("s_vec"), v["f"]), f"{prefix}_hyp_neg_dist_seed_fact": _near(F.col("s_pt"), p["f"])}
    return rows.select(Q, "node_id", *[c.alias(n) for n, c in columns.items()])


def child_coherence(children: DataFrame, limit: int = 50) -> DataFrame:
    """Mean pairwise cosine and negative mean pairwise distance of the first ``limit`` children; 0 below two.

    ``children``: (conv_id, parent_id, child_id, pos, vector, point). The cut comes before the self-join.
    """
    first = top_per(children, ["conv_id", "parent_id"], [F.asc("pos"), F.asc("child_id")], limit, "child_no").select("conv_id", "parent_id", "child_no", "vector", "point")
    left = first.select("conv_id", "parent_id", F.col("child_no").alias("i"), F.col("vector").alias("va"), F.col("point").alias("pa"))
    right = first.select("conv_id", "parent_id", F.col("child_no").alias("j"), F.col("vector").alias("vb"), F.col("point").alias("pb"))
    pairs = left.join(right, ["conv_id", "parent_id"]).filter("i < j").groupBy("conv_id", "parent_id").agg(
        F.avg(vx.cosine(F.col("va"), F.col("vb"))).alias("euc"), F.avg(vx.lorentz_distance(F.col("pa"), F.col("pb"))).alias("dist"))
    parents = first.select("conv_id", "parent_id").distinct()
    return parents.join(pairs, ["conv_id", "parent_id"], "left").select("conv_id", "parent_id", F.coalesce("euc", F.lit(0.0)).alias("euc_coherence"), F.coalesce(-F.col("dist"), F.lit(0.0)).alias("hyp_coherence"))


def structure_checks(edges: DataFrame, margin: float = 0.1) -> DataFrame:
    """Mean radial-order and cone violation of parent edges. Rows: (child_pt, parent_pt, confidence)."""
    radial = F.greatest(F.lit(0.0), margin + vx.lorentz_radius(F.col("parent_pt")) - vx.lorentz_radius(F.col("child_pt")))
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.avg(radial).alias("radial_order"), F.avg(vx.cone_violation(F.col("parent_pt"), F.col("child_pt"), F.col("confidence"))).alias("cone_order"))


def triplet_check(triplets: DataFrame, margin: float = 0.1) -> DataFrame:
    """Mean branch-triplet violation. Rows: (anchor_pt, positive_pt, negative_pt)."""
    gap = margin + vx.lorentz_distance(F.col("anchor_pt"), F.col("positive_pt")) - vx.lorentz_distance(F.col("anchor_pt"), F.col("negative_pt"))
    return triplets.agg(F.count(F.lit(1)).alias("triplets"), F.avg(F.greatest(F.lit(0.0), gap)).alias("branch_triplet"))


def contrastive_check(rows: DataFrame, tau: float = 0.1) -> DataFrame:
    """Mean contrastive loss of true parents against sampled ones by log-sum-exp.

    Rows: (edge_id, is_positive, distance), one positive and a few negatives per edge.
    """
    logit = -F.col("distance") / tau
    per = rows.groupBy("edge_id").agg(F.max(logit).alias("top"), F.max(F.when(F.col("is_positive"), logit)).alias("pos"))
    sums = rows.join(per, "edge_id").groupBy("edge_id", "top", "pos").agg(F.sum(F.exp(-F.col("distance") / tau - F.col("top"))).alias("z"))
    return sums.agg(F.count(F.lit(1)).alias("edges"), F.avg(F.ln("z") + F.col("top") - F.col("pos")).alias("contrastive"))


def sample_negatives(edges: DataFrame, parents: DataFrame, count: int, seed: int = 7) -> DataFrame:
    """``count`` other parents of the same type per edge, drawn by hash through an ordinal join.

    ``edges``: (edge_id, parent_id); ``parents``: (parent_id, parent_type, pos) with unique ``pos`` per type.
    The draw skips the true parent by shifting the ordinal, so no rejection loop and no pair blow-up is needed.
    """
    pool = dense_ordinal(parents, ["parent_type"], "pos", "place")
    sizes = pool.groupBy("parent_type").agg((F.max("place") + 1).alias("pool"))
    placed = edges.join(pool.select("parent_id", "parent_type", "place"), "parent_id").join(sizes, "parent_type").filter("pool > 1")
    draws = placed.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(count))))
    number = F.conv(F.left(F.md5(F.concat_ws("|", F.col("edge_id").cast("string"), F.col("draw").cast("string"), F.lit(str(seed)))), F.lit(8)), 16, 10).cast("bigint")
    target = F.pmod(number, F.col("pool") - 1)
    draws = draws.withColumn("place2", target + F.when(target >= F.col("place"), 1).otherwise(0))
    other = pool.select("parent_type", F.col("place").alias("place2"), F.col("parent_id").alias("negative_id"))
    return draws.join(other, ["parent_type", "place2"]).select("edge_id", "parent_id", "draw", "negative_id")


def sample_branches(members: DataFrame, seed: int = 7) -> DataFrame:
    """(anchor, positive, negative) facts: neighbours of one event and a fact outside it, drawn by hash.

    ``members``: (fact_id, event_id, pos) with ``pos`` unique and events contiguous in it.
    """
    numbered = dense_ordinal(members.withColumn("_all", F.lit(1)), ["_all"], "pos", "place").drop("_all")
    total = numbered.agg((F.max("place") + 1).alias("total")).scalar()
    spans = numbered.groupBy("event_id").agg(F.min("place").alias("lo"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = numbered.join(spans, "event_id").filter(F.col("place") < F.col("lo") + F.col("n") - 1).withColumn("total", total).filter(F.col("total") > F.col("n"))
    number = F.conv(F.left(F.md5(F.concat_ws("|", F.col("fact_id").cast("string"), F.lit(str(seed)))), F.lit(8)), 16, 10).cast("bigint")
    far = F.pmod(F.col("lo") + F.col("n") + F.pmod(number, F.col("total") - F.col("n")), F.col("total"))
    rows = pairs.select(F.col("fact_id").alias("anchor_id"), (F.col("place") + 1).alias("p1"), far.alias("p2"))
    at = lambda name, place: numbered.select(F.col("fact_id").alias(name), F.col("place").alias(place))
    return rows.join(at("positive_id", "p1"), "p1").join(at("negative_id", "p2"), "p2").select("anchor_id", "positive_id", "negative_id")


def select_features(rows: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] = (), keys: Sequence[str] = (Q, "node_id")) -> DataFrame:
    """Chosen feature columns in table order; unknown names are an error."""
    names = [c for c in rows.columns if c not in keys]
    unknown = [n for n in [*(include or []), *exclude] if n not in names]
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    kept = [n for n in names if (include is None or n in include) and n not in exclude]
    return rows.select(*keys, *kept)
