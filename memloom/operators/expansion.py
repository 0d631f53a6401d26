"""Graph expansion around seeds and fusion of retrieval routes.

Tables: seeds ``(question_id, conv_id, node_id, score, rank)``, nodes and edges as built by the library. Hubs are
cut with degree tables before an expanding join, ranked cuts come before rows widen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.functions import vectors as vx
from memloom.operators.balls import Metric, ball_top_k
from memloom.operators.edges import edge_id
from memloom.operators.ordering import first_per, top_per
from memloom.operators.retrieval import log1p, reciprocal_rank

# Weight of an edge kind on a path.
EDGE_WEIGHTS = {"SUPPORTS": 1.0, "IS_SPECIFIC_OF": 0.65, "UPDATES": 0.85, "EXCEPTION_OF": 0.8, "CONFLICTS_WITH": -0.6}
CHANGE = ["UPDATES", "EXCEPTION_OF"]
FOLLOWED = ["IS_SPECIFIC_OF", "UPDATES", "EXCEPTION_OF", "CONFLICTS_WITH", "SUPPORTS"]


def edge_weight(relation: Column) -> Column:
    result = F.lit(0.0)
    for name, value in EDGE_WEIGHTS.items():
        result = F.when(relation == name, F.lit(value)).otherwise(result)
    return result


def _typed(nodes: DataFrame, node: str, kind: str) -> DataFrame:
    return nodes.select("conv_id", F.col("node_id").alias(node), F.col("type").alias(kind))


def one_hop(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, conflicts: bool = False, parents: bool = False) -> DataFrame:
    """Neighbours of seeds: RAW supports, updated or updating facts, optionally conflicts and parent anchors."""
    changes = CHANGE + (["CONFLICTS_WITH"] if conflicts else [])
    start = seeds.select("question_id", "conv_id", F.col("node_id").alias("seed_id"))
    out = start.join(edges.select("conv_id", F.col("src").alias("seed_id"), F.col("dst").alias("node_id"), "relation", "confidence"), ["conv_id", "seed_id"])
    back = start.join(edges.select("conv_id", F.col("dst").alias("seed_id"), F.col("src").alias("node_id"), "relation", "confidence"), ["conv_id", "seed_id"])
    kinds = _typed(nodes, "node_id", "kind")
    keep_out = ((F.col("relation") == "SUPPORTS") & (F.col("kind") == "RAW")) | (F.col("relation").isin(changes) & (F.col("kind") == "FACT"))
    if parents:
        keep_out = keep_out | ((F.col("relation") == "IS_SPECIFIC_OF") & (F.col("kind") == "ANCHOR"))
    keep_back = F.col("relation").isin(changes) & (F.col("kind") == "FACT")
    forward = out.join(kinds, ["conv_id", "node_id"]).filter(keep_out).withColumn("edge", edge_id("seed_id", "relation", "node_id"))
    reverse = back.join(kinds, ["conv_id", "node_id"]).filter(keep_back).withColumn("edge", edge_id("node_id", "relation", "seed_id"))
    return forward.withColumn("direction", F.lit("out")).unionByName(reverse.withColumn("direction", F.lit("in")))


def anchor_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fact, anchor, confidence) rows of the partial order."""
    anchors = nodes.filter("type = 'ANCHOR'").select("conv_id", F.col("node_id").alias("anchor_id"))
    return edges.filter("relation = 'IS_SPECIFIC_OF'").select(
        "conv_id", F.col("src").alias("fact_id"), F.col("dst").alias("anchor_id"), "confidence"
    ).join(anchors, ["conv_id", "anchor_id"], "left_semi")


def siblings(seeds: DataFrame, links: DataFrame, limit: int, max_degree: int | None = None) -> DataFrame:
    """Facts that share an anchor with a seed: the ``limit`` strongest per seed and anchor.

    An anchor needs only its ``limit + 1`` strongest facts, so links are cut per anchor before the join and a
    crowded anchor never meets its seeds pair by pair; anchors above ``max_degree`` are dropped.
    """
    degree = links.groupBy("conv_id", "anchor_id").agg(F.count(F.lit(1)).alias("anchor_degree"))
    if max_degree is not None:
        degree = degree.filter(F.col("anchor_degree") <= max_degree)
    strongest = top_per(links, ["conv_id", "anchor_id"], [F.desc("confidence"), F.asc("fact_id")], limit + 1, "link_rank").select(
        "conv_id", "anchor_id", F.col("fact_id").alias("node_id"), F.col("confidence").alias("sibling_confidence"), "link_rank"
    )
    up = seeds.select("question_id", "conv_id", F.col("node_id").alias("seed_id")).join(
        links.select("conv_id", F.col("fact_id").alias("seed_id"), "anchor_id", F.col("confidence").alias("anchor_confidence")), ["conv_id", "seed_id"]
    ).join(degree, ["conv_id", "anchor_id"])
    pairs = up.join(strongest, ["conv_id", "anchor_id"]).filter(F.col("node_id") != F.col("seed_id"))
    return top_per(pairs, ["question_id", "seed_id", "anchor_id"], [F.asc("link_rank")], limit, "sibling_rank")


def candidate_pool(seeds: DataFrame, hop1: DataFrame, hop2: DataFrame) -> DataFrame:
    """Ordered distinct union of seeds, their neighbours and their siblings (first place wins)."""
    rank = seeds.select("question_id", F.col("node_id").alias("seed_id"), F.col("rank").alias("seed_rank"))
    direct = seeds.select("question_id", "node_id", F.col("rank").alias("seed_rank"), F.lit(0).alias("stage"), F.col("node_id").alias("tie"))
    near = hop1.join(rank, ["question_id", "seed_id"]).select("question_id", "node_id", "seed_rank", F.lit(1).alias("stage"), F.col("edge").alias("tie"))
    far = hop2.join(rank, ["question_id", "seed_id"]).select(
        "question_id", "node_id", "seed_rank", F.lit(2).alias("stage"), F.concat_ws("|", "anchor_id", F.lpad(F.col("sibling_rank").cast("string"), 6, "0")).alias("tie")
    )
    pool = first_per(direct.unionByName(near).unionByName(far), ["question_id", "node_id"], ["seed_rank", "stage", "tie"], ["seed_rank", "stage", "tie"])
    order = Window.partitionBy("question_id").orderBy("seed_rank", "stage", "tie", "node_id")
    return pool.withColumn("pool_no", F.row_number().over(order)).withColumn("expanded", F.col("stage") > 0)


def pool_edge_counts(hop1: DataFrame, hop2: DataFrame) -> DataFrame:
    """How often each relation brought a candidate."""
    used = hop1.select("question_id", "relation").unionByName(
        hop2.select("question_id", F.explode(F.array(F.lit("IS_SPECIFIC_OF"), F.lit("IS_SPECIFIC_OF"))).alias("relation"))
    )
    return used.groupBy("question_id", "relation").agg(F.count(F.lit(1)).alias("edges"))


def _time_score(status: Column) -> Column:
    return F.when(status == "active", 1.0).when(status == "exception", 0.75).when(status == "disputed", 0.35).otherwise(0.1)


def seeded_candidates(seeds: DataFrame, hop1: DataFrame, hop2: DataFrame, bm25: DataFrame, nodes: DataFrame) -> DataFrame:
    """Scored FACT and RAW candidates around seeds.

    Every route to a node gives a (seed, bm25, edge) triple; the best sum per node counts.
    ``seeds.norm`` is the seed score over the best seed; ``bm25`` is (question_id, node_id, norm).
    """
    share = seeds.select("question_id", F.col("node_id").alias("seed_id"), F.col("norm").alias("seed_norm"), F.col("rank").alias("seed_rank"))
    plain = seeds.select("question_id", "conv_id", "node_id", F.col("node_id").alias("seed_id"), F.col("norm").alias("seed_part"),
                         F.lit(1.0).alias("edge_part"), F.array("node_id").alias("path"), F.array().cast("array<string>").alias("path_edges"),
                         F.col("rank").alias("seed_rank"), F.lit(0).alias("stage"))
    near = hop1.join(share, ["question_id", "seed_id"]).select(
        "question_id", "conv_id", "node_id", "seed_id",
        (F.col("seed_norm") * F.when(F.col("relation") == "SUPPORTS", 0.95).otherwise(0.75)).alias("seed_part"),
        (edge_weight(F.col("relation")) * F.col("confidence")).alias("edge_part"), F.array("seed_id", "node_id").alias("path"),
        F.array("edge").alias("path_edges"), "seed_rank", F.lit(1).alias("stage"))
    far = hop2.join(share, ["question_id", "seed_id"]).select(
        "question_id", "conv_id", "node_id", "seed_id", (F.col("seed_norm") * 0.45).alias("seed_part"),
        (F.lit(EDGE_WEIGHTS["IS_SPECIFIC_OF"]) * (F.col("anchor_confidence") + F.col("sibling_confidence")) / 2).alias("edge_part"),
        F.array("seed_id", "anchor_id", "node_id").alias("path"),
        F.array(edge_id("seed_id", F.lit("IS_SPECIFIC_OF"), "anchor_id"), edge_id("node_id", F.lit("IS_SPECIFIC_OF"), "anchor_id")).alias("path_edges"),
        "seed_rank", F.lit(2).alias("stage"))
    routes = plain.unionByName(near).unionByName(far).join(
        bm25.select("question_id", "node_id", F.col("norm").alias("bm25_part")), ["question_id", "node_id"], "left"
    ).withColumn("bm25_part", F.coalesce("bm25_part", F.lit(0.0)))
    routes = routes.withColumn("path_key", F.array_join("path", ">"))
    total = F.round(F.col("seed_part") + F.col("bm25_part") + F.col("edge_part"), 9)
    best = first_per(
        routes.withColumn("order_total", -total), ["question_id", "conv_id", "node_id"], ["order_total", "seed_rank", "stage", "path_key"],
        ["seed_id", "seed_part", "bm25_part", "edge_part", "path", "path_edges"],
    )
    typed = best.join(nodes.filter("type IN ('FACT', 'RAW')").select("conv_id", "node_id", "type", "text", "status"), ["conv_id", "node_id"])
    noise = (
        F.when(F.col("status").isin("outdated", "disputed"), 0.5).otherwise(0.0)
        + F.when(F.exists("path_edges", lambda e: e.contains("CONFLICTS_WITH")), 0.7).otherwise(0.0)
        + F.greatest(F.lit(0), F.size("path_edges") - 2) * 0.15
    )
    kind = F.when(F.col("type") == "FACT", 1.0).otherwise(0.85)
    return typed.withColumn("time_part", _time_score(F.col("status"))).withColumn("type_part", kind).withColumn("noise_part", noise).withColumn(
        "score", F.col("seed_part") + 0.8 * F.col("bm25_part") + 0.4 * F.col("edge_part") + 0.3 * F.col("time_part") + 0.2 * F.col("type_part") - 0.5 * F.col("noise_part")
    )


def sibling_candidates(
    seeds: DataFrame, bm25: DataFrame, links: DataFrame, facts: DataFrame, questions: DataFrame, max_degree: int = 50,
    limit: int = 40, top: int = 100, min_bm25: float = 0.0, require_entity: bool = False,
) -> DataFrame:
    """Seeds and their anchor siblings scored by text, name and edge evidence; best entry per fact, best ``top``."""
    near = siblings(seeds, links, limit, max_degree).select(
        "question_id", "conv_id", "node_id", "seed_id", "anchor_id", "anchor_degree", F.lit(2).alias("hop"), F.lit(False).alias("is_seed"),
        F.least("anchor_confidence", "sibling_confidence").alias("edge"))
    own = seeds.select(
        "question_id", "conv_id", "node_id", F.col("node_id").alias("seed_id"), F.lit("").alias("anchor_id"), F.lit(0).cast("bigint").alias("anchor_degree"),
        F.lit(0).alias("hop"), F.lit(True).alias("is_seed"), F.lit(1.0).alias("edge"))
    asked = questions.select("question_id", tx.query_names("question").alias("q_names"), tx.term_set("question").alias("q_terms"))
    known = facts.select("conv_id", "node_id", "status", tx.query_names("text").alias("names"), tx.term_set("text").alias("terms"))
    rank = seeds.select("question_id", F.col("node_id").alias("seed_id"), F.col("rank").alias("seed_rank"))
    rows = (
        own.unionByName(near).join(rank, ["question_id", "seed_id"]).join(known, ["conv_id", "node_id"]).join(asked, "question_id")
        .join(bm25.select("question_id", "node_id", "norm"), ["question_id", "node_id"], "left")
        .withColumn("bm25", F.coalesce("norm", F.lit(0.0)))
        .withColumn("entity_overlap", tx.entity_or_term_overlap(F.col("q_names"), F.col("q_terms"), F.col("names"), F.col("terms")))
    )
    rows = rows.filter(F.col("is_seed") | ((F.col("bm25") >= min_bm25) & (F.lit(not require_entity) | (F.col("entity_overlap") > 0))))
    score = (
        F.col("bm25") + 0.8 * F.col("is_seed").cast("double") + 0.6 * F.col("entity_overlap") + 0.4 * F.col("edge")
        + 0.3 * F.when(F.col("status") == "active", 1.0).otherwise(0.2) - 0.4 * log1p(F.col("anchor_degree")) - 0.3 * F.col("hop")
    )
    scored = rows.withColumn("score", score).withColumn("ordering", -F.round("score", 9))
    best = first_per(scored, ["question_id", "conv_id", "node_id"], ["ordering", "seed_rank", "anchor_id"],
                     ["score", "bm25", "entity_overlap", "edge", "anchor_degree", "hop", "is_seed", "seed_id", "anchor_id", "seed_rank"])
    return top_per(best, ["question_id"], [F.desc(F.round("score", 9)), F.asc("node_id")], top)


def hierarchy_candidates(
    seeds: DataFrame, bm25: DataFrame, facts: DataFrame, questions: DataFrame, fact_event: DataFrame, events: DataFrame,
    mode: str = "event_topic", same_event_limit: int = 30, topic_events: int = 8, topic_facts: int = 12,
    max_topic_degree: int = 160, top: int = 100, min_bm25: float = 0.0,
) -> DataFrame:
    """Seeds plus facts of their event and of the best events of their topic.

    ``fact_event``: (conv_id, fact_id, event_id, pos, edge_confidence); ``events``: (conv_id, event_id, topic_id, text).
    A topic above ``max_topic_degree`` contributes nothing; the seed's own event still does.
    """
    sizes = fact_event.groupBy("conv_id", "event_id").agg(F.count(F.lit(1)).alias("event_degree"))
    placed = events.join(sizes, ["conv_id", "event_id"], "left").withColumn("event_degree", F.coalesce("event_degree", F.lit(0)))
    topics = placed.groupBy("conv_id", "topic_id").agg(F.sum("event_degree").alias("topic_degree"))
    ranked = top_per(fact_event, ["conv_id", "event_id"], [F.asc("pos"), F.asc("fact_id")], max(same_event_limit, topic_facts), "fact_no").select(
        "conv_id", "event_id", F.col("fact_id").alias("node_id"), "fact_no", "edge_confidence")
    asked = questions.select("question_id", tx.term_set("question").alias("q_terms"))
    located = (
        seeds.select("question_id", "conv_id", F.col("node_id").alias("seed_id"), F.col("rank").alias("seed_rank"))
        .join(fact_event.select("conv_id", F.col("fact_id").alias("seed_id"), "event_id"), ["conv_id", "seed_id"], "left")
        .join(placed.select("conv_id", "event_id", "topic_id"), ["conv_id", "event_id"], "left")
    )
    columns = ["question_id", "conv_id", "seed_id", "seed_rank", "node_id", "event_id", "topic_id", "source", "hop", "edge_confidence", "stage"]
    rows = located.select(
        "question_id", "conv_id", "seed_id", "seed_rank", F.col("seed_id").alias("node_id"), "event_id", "topic_id", F.lit("seed").alias("source"),
        F.lit(0).alias("hop"), F.lit(1.0).alias("edge_confidence"), F.lit(0).alias("stage"))
    if mode in {"same_event", "event_topic"}:
        same = located.join(ranked.filter(F.col("fact_no") <= same_event_limit), ["conv_id", "event_id"]).filter("node_id <> seed_id")
        rows = rows.unionByName(same.withColumn("source", F.lit("same_event")).withColumn("hop", F.lit(2)).withColumn("stage", F.lit(1)).select(columns))
    if mode in {"same_topic", "same_topic_only", "event_topic"}:
        small = topics.filter(F.col("topic_degree") <= max_topic_degree).select("conv_id", "topic_id")
        # a topic within the degree cap has at most that many events, so this join stays narrow
        options = (
            located.withColumnRenamed("event_id", "seed_event").join(small, ["conv_id", "topic_id"])
            .join(placed.select("conv_id", "topic_id", "event_id", "event_degree", tx.term_set("text").alias("e_terms")), ["conv_id", "topic_id"])
            .join(asked, "question_id")
            .withColumn("overlap", tx.coverage(F.col("q_terms"), F.col("e_terms")))
            .withColumn("own", F.col("event_id") == F.col("seed_event"))
        )
        chosen = top_per(options, ["question_id", "seed_id"],
                         [F.desc("own"), F.desc("overlap"), F.desc("event_degree"), F.asc("event_id")], topic_events, "event_no")
        if mode == "same_topic_only":
            chosen = chosen.filter("NOT own")
        wide = chosen.join(ranked.filter(F.col("fact_no") <= topic_facts), ["conv_id", "event_id"]).filter("node_id <> seed_id")
        wide = wide.withColumn("source", F.when(F.col("own"), "same_event").otherwise("same_topic")).withColumn(
            "hop", F.when(F.col("own"), 2).otherwise(4)).withColumn("stage", F.lit(2))
        gate = bm25.select("question_id", "node_id", "norm")
        if min_bm25 > 0:
            wide = wide.join(gate.filter(F.col("norm") >= min_bm25).select("question_id", "node_id"), ["question_id", "node_id"], "left_semi")
        rows = rows.unionByName(wide.select(columns))
    scored = (
        rows.join(sizes, ["conv_id", "event_id"], "left")
        .join(bm25.select("question_id", "node_id", F.col("norm").alias("bm25")), ["question_id", "node_id"], "left")
        .join(facts.select("conv_id", "node_id", tx.term_set("text").alias("terms")), ["conv_id", "node_id"])
        .join(asked, "question_id")
        .withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
        .withColumn("overlap", tx.coverage(F.col("q_terms"), F.col("terms")))
        .withColumn("event_degree", F.coalesce("event_degree", F.lit(0)))
    )
    bonus = F.when(F.col("source") == "same_event", 0.65).when(F.col("source") == "same_topic", 0.35).otherwise(0.0)
    score = (
        F.col("bm25") + 0.8 * (F.col("source") == "seed").cast("double") + bonus + 0.45 * F.col("overlap") + 0.35 * F.col("edge_confidence")
        - 0.25 * log1p(F.greatest(F.col("event_degree"), F.lit(1))) - 0.20 * F.col("hop")
    )
    best = first_per(scored.withColumn("score", score).withColumn("ordering", -F.round("score", 9)), ["question_id", "conv_id", "node_id"],
                     ["ordering", "seed_rank", "stage", "event_id"],
                     ["score", "source", "seed_id", "event_id", "topic_id", "hop", "bm25", "overlap", "edge_confidence", "event_degree"])
    return top_per(best, ["question_id"], [F.desc(F.round("score", 9)), F.asc("node_id")], top)


def topdown_candidates(
    queries: DataFrame, events: DataFrame, topics: DataFrame, fact_event: DataFrame, metric: Metric, route: str,
    event_top: int = 20, topic_top: int = 3, events_per_topic: int = 3, facts_per_event: int = 8, top: int = 100,
) -> DataFrame:
    """Route rows from the closest events and from the closest topics' closest events.

    The events of a topic lie in one ball, so a question scores only events of topics that can hold one of its closest, and
    of its best topics. ``route`` names the metric (``eu`` or ``hyp``). ``events``: (conv_id, event_id, topic_id, vector),
    ``topics``: (conv_id, topic_id, vector), ``queries``: (question_id, conv_id, query_vector). Rows are per (question, fact, sub-route).
    """
    items = events.select("conv_id", F.col("event_id").alias("item_id"), F.col("topic_id").alias("ball"), "vector")
    by_event = ball_top_k(queries, items, metric, event_top).select(
        "question_id", "conv_id", F.col("item_id").alias("event_id"), F.col("ball").alias("topic_id"), F.col("score").alias("query_score"), F.col("rank").alias("route_rank"),
        F.lit(0).alias("event_rank"), F.lit(f"{route}_event").alias("route"))
    best_topics = top_per(
        queries.join(topics.select("conv_id", "topic_id", "vector"), "conv_id").withColumn("topic_score", metric.score(F.col("query_vector"), F.col("vector"))).drop("vector"),
        ["question_id"], [F.desc(F.round("topic_score", 9)), F.asc("topic_id")], topic_top, "topic_rank",
    )
    within = best_topics.join(events.select("conv_id", "topic_id", "event_id", "vector"), ["conv_id", "topic_id"])
    within = within.withColumn("event_score", metric.score(F.col("query_vector"), F.col("vector"))).drop("vector", "query_vector")
    inside = top_per(within, ["question_id", "topic_id"], [F.desc(F.round("event_score", 9)), F.asc("event_id")], events_per_topic, "event_rank")
    by_topic = inside.select(
        "question_id", "conv_id", "event_id", "topic_id", (0.55 * F.col("topic_score") + 0.45 * F.col("event_score")).alias("query_score"),
        F.col("topic_rank").alias("route_rank"), "event_rank", F.lit(f"{route}_topic").alias("route"))
    first = top_per(fact_event, ["conv_id", "event_id"], [F.asc("pos"), F.asc("fact_id")], facts_per_event, "fact_no").select(
        "conv_id", "event_id", F.col("fact_id").alias("node_id"), (F.col("fact_no") - 1).alias("fact_offset"))
    return by_event.unionByName(by_topic).join(first, ["conv_id", "event_id"]).withColumn(
        "base_score", F.col("query_score") - 0.002 * F.col("fact_offset"))


ROUTES = ["eu_event", "eu_topic", "hyp_event", "hyp_topic", "bottom_up", "hyp_bottom"]


def merge_routes(rows: DataFrame, top: int | None = None) -> DataFrame:
    """One row per (question, fact): joined route names, best scores, smallest positive ranks per route."""
    cells = []
    for name in ROUTES:
        here = F.col("route") == name
        cells.append(F.coalesce(F.max(F.when(here, F.col("query_score"))), F.lit(0.0)).alias(f"{name}_score"))
        cells.append(F.coalesce(F.min(F.when(here & (F.col("route_rank") > 0), F.col("route_rank"))), F.lit(0)).alias(f"{name}_rank"))
    ordering = F.struct(-F.round("base_score", 9), "route", "event_id")
    merged = rows.groupBy("question_id", "conv_id", "node_id").agg(
        F.array_join(F.array_sort(F.collect_set("route")), "+").alias("route_source"),
        F.max("base_score").alias("base_score"), F.max("query_score").alias("semantic_score"),
        F.min_by("event_id", ordering).alias("event_id"), F.min_by("topic_id", ordering).alias("topic_id"), *cells,
    )
    if top is None:
        return merged
    return top_per(merged, ["question_id"], [F.desc(F.round("base_score", 9)), F.asc("node_id")], top)


def fuse_routes(merged: DataFrame, top: int = 150) -> DataFrame:
    """Four-route union ordered by reciprocal-rank fusion of the Euclidean, hyperbolic and bottom-up ranks."""
    best = lambda *names: F.array_min(F.array_compact(F.array(*[F.nullif(F.col(n), F.lit(0)) for n in names])))
    fused = reciprocal_rank(best("eu_event_rank", "eu_topic_rank"), best("hyp_event_rank", "hyp_topic_rank", "hyp_bottom_rank"), F.col("bottom_up_rank"))
    return top_per(merged.withColumn("rrf", fused), ["question_id"], [F.desc(F.round("rrf", 12)), F.desc(F.round("base_score", 9)), F.asc("node_id")], top, "fused_rank")


def bottom_up_route(candidates: DataFrame, route: str = "bottom_up") -> DataFrame:
    """Ranked bottom-up candidates (conv_id, question_id, node_id, score, rank, event_id, topic_id) as route rows."""
    return candidates.select(
        "question_id", "conv_id", "event_id", "topic_id", F.col("score").alias("query_score"), F.col("rank").alias("route_rank"),
        F.lit(0).alias("event_rank"), F.lit(route).alias("route"), "node_id", F.lit(0).alias("fact_offset"), F.col("score").alias("base_score"))


def bounded_paths(starts: DataFrame, edges: DataFrame, max_len: int = 4, max_branch: int = 8, max_paths: int = 20) -> DataFrame:
    """Breadth-first paths from start nodes in both directions over the strongest edges, without revisits.

    A path ends at ``max_len`` nodes or where nothing new can be reached; the first ``max_paths`` in queue order
    per start stay. Adjacency is cut to the ``max_branch`` strongest edges per node before any join.
    """
    followed = edges.filter(F.col("relation").isin(FOLLOWED)).select("conv_id", "src", "dst", "relation", "confidence")
    into = followed.select("conv_id", F.col("dst").alias("at"), F.col("src").alias("next"), F.lit(0).alias("way"), "confidence", edge_id().alias("edge"))
    out = followed.select("conv_id", F.col("src").alias("at"), F.col("dst").alias("next"), F.lit(1).alias("way"), "confidence", edge_id().alias("edge"))
    adjacency = top_per(into.unionByName(out), ["conv_id", "at"], [F.desc("confidence"), F.asc("way"), F.asc("edge")], max_branch, "branch").select(
        "conv_id", "at", "next", "edge", "branch")
    options = adjacency.groupBy("conv_id", "at").agg(F.array_sort(F.collect_list(F.struct("branch", "next", "edge"))).alias("options"))
    empty = F.array().cast("array<string>")
    paths = starts.select("conv_id", F.col("node_id").alias("start"), F.col("node_id").alias("at"), F.array("node_id").alias("path"),
                          empty.alias("path_edges"), F.array().cast("array<int>").alias("trail"), F.lit(False).alias("done"))
    for _ in range(max_len - 1):
        fresh = F.when(~F.col("done"), F.filter("options", lambda o: ~F.array_contains(F.col("path"), o["next"])))
        step = paths.join(options, ["conv_id", "at"], "left").withColumn("o", F.explode_outer(fresh))
        more = F.col("o").isNotNull()
        paths = step.select(
            "conv_id", "start", F.when(more, F.col("o.next")).otherwise(F.col("at")).alias("at"),
            F.when(more, F.array_append("path", F.col("o.next"))).otherwise(F.col("path")).alias("path"),
            F.when(more, F.array_append("path_edges", F.col("o.edge"))).otherwise(F.col("path_edges")).alias("path_edges"),
            F.when(more, F.array_append("trail", F.col("o.branch"))).otherwise(F.col("trail")).alias("trail"), (~more).alias("done"))
    # queue order: shorter paths leave the queue first, then the branch numbers along the way
    return top_per(paths.withColumn("hops", F.size("trail")), ["conv_id", "start"], [F.asc("hops"), F.asc("trail")], max_paths, "path_no").select(
        "conv_id", "start", "path", "path_edges", "path_no")


def score_paths(paths: DataFrame, nodes: DataFrame, edges: DataFrame, questions: DataFrame, points: DataFrame, query_points: DataFrame, top: int = 5) -> DataFrame:
    """Relevance, geometry, freshness and cost of paths; best ``top`` per question.

    ``paths``: (question_id, conv_id, path_id, path, path_edges); ``points``: (conv_id, node_id, point);
    ``query_points``: (question_id, query_point).
    """
    key = ["question_id", "conv_id", "path_id"]
    steps = paths.select(*key, F.posexplode("path").alias("step", "node_id")).join(
        nodes.select("conv_id", "node_id", "type", "status", "text", "confidence"), ["conv_id", "node_id"]).join(points, ["conv_id", "node_id"])
    asked = questions.select("question_id", tx.term_set("question").alias("q_terms"))
    per_path = (
        steps.join(query_points, "question_id").withColumn("distance", vx.lorentz_distance(F.col("query_point"), F.col("point")))
        .groupBy(*key).agg(
            F.array_distinct(F.flatten(F.collect_list(tx.term_set("text")))).alias("terms"),
            F.avg((F.col("status") == "active").cast("double")).alias("temporal"),
            F.avg(F.col("type").isin("FACT", "RAW").cast("double")).alias("support"),
            (1 - F.countDistinct("text") / F.count(F.lit(1))).alias("redundancy"),
            F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("token_cost"),
            F.avg("distance").alias("mean_distance"))
    )
    inside = edges.filter("relation = 'IS_SPECIFIC_OF'").select("conv_id", "src", "dst")
    child = steps.select(*key, F.col("node_id").alias("src"), F.col("point").alias("child_point"))
    parent = steps.select(*key, F.col("node_id").alias("dst"), F.col("point").alias("parent_point"), F.col("confidence").alias("parent_confidence"))
    cones = child.join(inside, ["conv_id", "src"]).join(parent, [*key, "dst"]).groupBy(*key).agg(
        F.avg(vx.cone_violation(F.col("parent_point"), F.col("child_point"), F.col("parent_confidence"))).alias("violation"))
    distinct_edges = F.array_distinct("path_edges")
    own = paths.select(*key, "path", "path_edges", F.size("path").alias("length_cost"), F.when(F.size(distinct_edges) > 0, F.size(
        F.filter(distinct_edges, lambda e: e.contains("->CONFLICTS_WITH->"))) / F.size(distinct_edges)).otherwise(0.0).alias("conflict"))
    scored = per_path.join(own, key).join(cones, key, "left").join(asked, "question_id").withColumn("relevance", tx.coverage(F.col("q_terms"), F.col("terms"))).withColumn(
        "geometry", 0.5 / (1 + F.col("mean_distance")) + 0.5 / (1 + F.coalesce("violation", F.lit(0.0))))
    score = (F.col("relevance") + 0.7 * F.col("geometry") + 0.3 * F.col("temporal") + 0.5 * F.col("support") - 0.8 * F.col("conflict")
             - 0.25 * F.col("redundancy") - 0.002 * F.col("token_cost") - 0.05 * F.col("length_cost"))
    return top_per(scored.withColumn("score", score), ["question_id"], [F.desc(F.round("score", 9)), F.asc("path_id")], top).drop("terms", "q_terms")


def calibrate(candidates: DataFrame, top: int = 20) -> DataFrame:
    """Source-calibrated scores: cross-encoder, text, name and edge evidence, source priors, degree and hop penalties.

    Columns: ce, bm25, entity_overlap, edge, anchor_degree, hop, is_seed, source.
    """
    prior = F.when(F.col("is_seed") | (F.col("source") == "bm25_fact"), 0.18).otherwise(0.0) + F.when(
        F.col("source").isin("filtered_sibling", "seed_sibling") & ~F.col("is_seed"), 0.10).otherwise(0.0)
    score = (F.col("ce") + 0.15 * F.col("bm25") + 0.08 * F.col("entity_overlap") + prior + 0.04 * F.col("edge")
             - 0.06 * log1p(F.col("anchor_degree")) - 0.08 * F.col("hop"))
    return top_per(candidates.withColumn("calibrated", score), ["question_id"], [F.desc(F.round("calibrated", 9)), F.asc("node_id")], top)


def rerank(candidates: DataFrame, scores: DataFrame, top: int = 20) -> DataFrame:
    """Candidates ordered by an external pair score; base score and score spread per question are kept."""
    joined = candidates.join(scores.select("question_id", "node_id", "pair_score"), ["question_id", "node_id"])
    whole = Window.partitionBy("question_id")
    spread = joined.withColumn("min_score", F.min("pair_score").over(whole)).withColumn("max_score", F.max("pair_score").over(whole)).withColumn(
        "mean_score", F.avg("pair_score").over(whole))
    return top_per(spread, ["question_id"], [F.desc("pair_score"), F.asc("node_id")], top, "rerank_rank")


def path_texts(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``[TYPE] text`` lines of a path, evidence node first, each node once.

    ``paths``: (question_id, conv_id, path_id, evidence_id, path); paths are bounded lists.
    """
    key = ["question_id", "conv_id", "path_id"]
    ordered = F.array_distinct(F.concat(F.array("evidence_id"), F.col("path")))
    lines = paths.select(*key, F.posexplode(ordered).alias("line_no", "node_id")).join(
        nodes.select("conv_id", "node_id", F.concat(F.lit("["), "type", F.lit("] "), "text").alias("line")), ["conv_id", "node_id"])
    return lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l")).select(
        *key, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))
