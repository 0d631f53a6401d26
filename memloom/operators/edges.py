"""Typed edges between nodes and upkeep of the graph tables. Every join carries the conversation key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.operators.ordering import dense_ordinal, first_per, top_per
from memloom.session import cut_lineage

EDGE_COLUMNS = ["conv_id", "src", "dst", "relation", "role", "view", "confidence", "similarity"]


def edge_id(src: Column | str = "src", relation: Column | str = "relation", dst: Column | str = "dst") -> Column:
    return F.concat_ws("->", src, relation, dst)


def _edge(df: DataFrame, relation: Column, confidence: Column, similarity: Column | None = None,
          role: str | None = None, view: str | None = None) -> DataFrame:
    nothing = F.lit(None).cast("double")
    return df.select(
        "conv_id", "src", "dst", relation.alias("relation"),
        F.lit(role).cast("string").alias("role"), F.lit(view).cast("string").alias("view"),
        confidence.alias("confidence"), (similarity if similarity is not None else nothing).alias("similarity"),
    )


def support_edges(nodes: DataFrame) -> DataFrame:
    """FACT to RAW for each support id that exists."""
    wanted = nodes.filter("type = 'FACT'").select("conv_id", F.col("node_id").alias("src"), F.explode("support_ids").alias("dst"))
    raws = nodes.filter("type = 'RAW'").select("conv_id", F.col("node_id").alias("dst"))
    return _edge(wanted.join(raws, ["conv_id", "dst"], "left_semi"), F.lit("SUPPORTS"), F.lit(0.98))


def _scored(pairs: DataFrame, fact_sets: DataFrame, anchor_sets: DataFrame) -> DataFrame:
    return _compared(pairs.join(fact_sets, ["conv_id", "fact_id"]).join(anchor_sets, ["conv_id", "anchor_id"]))


def _compared(pairs: DataFrame) -> DataFrame:
    return (
        pairs.withColumn("shared", F.size(F.array_intersect("fact_terms", "anchor_terms")).cast("bigint"))
        .withColumn("similarity", tx.jaccard(F.col("fact_terms"), F.col("anchor_terms")))
        .select("conv_id", "fact_id", "anchor_id", "anchor_pos", "shared", "similarity")
    )


def _longer(rows: DataFrame, key: str, crowded: DataFrame) -> DataFrame:
    """Rows ``(conv_id, key, terms, last, combo)`` of crowded combinations, longer by each later term of ``terms``."""
    kept = rows.join(crowded.select("conv_id", "combo"), ["conv_id", "combo"], "left_semi")
    later = F.expr("explode(filter(transform(terms, (t, i) -> struct(i, t)), x -> x.i > last))")
    return kept.select("conv_id", key, "terms", "combo", later.alias("next")).select(
        "conv_id", key, "terms", F.col("next.i").alias("last"), F.concat("combo", F.array("next.t")).alias("combo"))


#: Facts times anchors of a conversation up to which all its pairs are compared.
SMALL_PAIRS = 10_000


def _sharing_pairs(facts: DataFrame, anchors: DataFrame, limit: int, small_pairs: int = SMALL_PAIRS) -> DataFrame:
    """Fact and anchor pairs that can be among a fact's ``limit`` anchors with most shared terms.

    All pairs of a conversation are compared where they are few, about a hundred a fact at most; other conversations go by words.
    """
    count = lambda rows, name: rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias(name))
    sizes = count(facts, "n_facts").join(count(anchors, "n_anchors"), "conv_id")
    few = F.col("n_facts") * F.col("n_anchors") <= small_pairs
    large = sizes.filter(~few).select("conv_id")
    terms = lambda rows, name, *more: rows.select("conv_id", F.col("node_id").alias(f"{name}_id"), *more, tx.term_set("text").alias(f"{name}_terms"))
    near = terms(facts.join(sizes.filter(few).select("conv_id"), "conv_id", "left_semi"), "fact")
    direct = _compared(near.join(terms(anchors, "anchor", F.col("pos").alias("anchor_pos")), "conv_id")).filter("shared > 0")
    if large.isEmpty():
        return direct
    return direct.unionByName(_pairs_by_words(*(rows.join(large, "conv_id", "left_semi") for rows in (facts, anchors)), limit))


def _pairs_by_words(facts: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """The pairs of :func:`_sharing_pairs` by way of the words that both sides hold.

    A combination of terms is looked up in the first ``limit`` anchors that hold it all. It is crowded if more do: then an
    anchor beyond them that shares just this combination cannot rank, since they share as much and come earlier. So level by
    level, from single terms on, only crowded combinations grow by a term, and what a fact has not seen must share more terms
    than the level has, and no fewer than the ``limit``-th best it has seen. Of ``n`` crowded terms, rarest first, an
    anchor that shares ``r`` has ``k`` among the first ``n - r + k``: longer combinations stay inside that prefix. The loop ends
    when no fact can share enough; a fact meets ``limit`` anchors per combination, however many hold its words.
    """
    fact_sets = facts.select("conv_id", F.col("node_id").alias("fact_id"), tx.term_set("text").alias("fact_terms"))
    anchor_sets = anchors.select(
        "conv_id", F.col("node_id").alias("anchor_id"), F.col("pos").alias("anchor_pos"), tx.term_set("text").alias("anchor_terms")
    )
    fact_rows = fact_sets.select("conv_id", "fact_id", F.explode("fact_terms").alias("term"))
    postings = anchor_sets.select("conv_id", "anchor_id", "anchor_pos", F.explode("anchor_terms").alias("term"))
    first = top_per(postings, ["conv_id", "term"], [F.asc("anchor_pos")], limit, "list_no")
    pairs = fact_rows.join(first.select("conv_id", "term", "anchor_id"), ["conv_id", "term"]).select("conv_id", "fact_id", "anchor_id").distinct()
    crowded = postings.groupBy("conv_id", "term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > limit)
    if crowded.isEmpty():
        return _scored(pairs, fact_sets, anchor_sets)

    crowded = cut_lineage(crowded)
    ordered = lambda rows, key: rows.join(crowded, ["conv_id", "term"]).groupBy("conv_id", key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("df", "term"))), lambda x: x["term"]).alias("terms"))
    start = lambda rows, key: rows.select("conv_id", key, "terms", F.posexplode("terms").alias("last", "term")).select("conv_id", key, "terms", "last", F.array("term").alias("combo"))
    fact_combos, anchor_combos = start(ordered(fact_rows, "fact_id"), "fact_id"), start(ordered(postings, "anchor_id"), "anchor_id")
    places = anchor_sets.select("conv_id", "anchor_id", "anchor_pos")
    seen = cut_lineage(_scored(pairs, fact_sets, anchor_sets))
    dense = crowded.select("conv_id", F.array("term").alias("combo"))
    level = 1
    while True:
        level += 1
        worst = top_per(seen, ["conv_id", "fact_id"], [F.desc("shared"), F.asc("anchor_pos")], limit, "place").filter(F.col("place") == limit)
        needed = F.greatest(F.lit(level), F.coalesce("shared", F.lit(0)))
        grown = _longer(fact_combos, "fact_id", dense).join(worst.select("conv_id", "fact_id", "shared"), ["conv_id", "fact_id"], "left")
        fact_combos = cut_lineage(grown.filter(F.col("last") < F.size("terms") - needed + level).drop("shared"))
        if fact_combos.isEmpty():
            return seen
        anchor_combos = cut_lineage(_longer(anchor_combos, "anchor_id", dense))
        held = anchor_combos.join(fact_combos.select("conv_id", "combo").distinct(), ["conv_id", "combo"], "left_semi").join(places, ["conv_id", "anchor_id"])
        counted = held.groupBy("conv_id", "combo").agg(F.count(F.lit(1)).alias("df"))
        dense = cut_lineage(counted.filter(F.col("df") > limit).drop("df"))
        lists = top_per(held, ["conv_id", "combo"], [F.asc("anchor_pos")], limit, "list_no").select("conv_id", "combo", "anchor_id")
        found = fact_combos.join(lists, ["conv_id", "combo"]).select("conv_id", "fact_id", "anchor_id").distinct()
        fresh = found.join(seen.select("conv_id", "fact_id", "anchor_id"), ["conv_id", "fact_id", "anchor_id"], "left_anti")
        seen = cut_lineage(seen.unionByName(_scored(fresh, fact_sets, anchor_sets)))


def anchor_candidates(facts: DataFrame, anchors: DataFrame, limit: int = 40) -> DataFrame:
    """Per fact the ``limit`` anchors of its conversation with most shared terms; without any shared term the
    first ``limit`` anchors stand in. Ties go to the earlier anchor."""
    shared = _sharing_pairs(facts, anchors, limit)
    matched = top_per(shared, ["conv_id", "fact_id"], [F.desc("shared"), F.asc("anchor_pos")], limit)
    first = top_per(
        anchors.select("conv_id", F.col("node_id").alias("anchor_id"), F.col("pos").alias("anchor_pos")),
        ["conv_id"], [F.asc("anchor_pos")], limit,
    )
    alone = facts.select("conv_id", F.col("node_id").alias("fact_id")).join(
        shared.select("conv_id", "fact_id").distinct(), ["conv_id", "fact_id"], "left_anti"
    )
    fallback = alone.join(first, "conv_id").withColumn("shared", F.lit(0).cast("bigint"))
    columns = ["conv_id", "fact_id", "anchor_id", "anchor_pos", "shared", "rank"]
    return matched.select(columns).unionByName(fallback.select(columns))


def link_anchors(
    facts: DataFrame, anchors: DataFrame, min_score: float = 0.08, max_links: int = 3, candidates: int = 40
) -> DataFrame:
    """FACT to ANCHOR edges by term similarity: best ``max_links`` of the candidates at or above ``min_score``."""
    scored = _sharing_pairs(facts, anchors, candidates)
    kept = top_per(scored, ["conv_id", "fact_id"], [F.desc("shared"), F.asc("anchor_pos")], candidates, "shared_rank")
    best = top_per(kept, ["conv_id", "fact_id"], [F.desc("similarity"), F.asc("shared_rank")], max_links, "link_rank")
    linked = best.filter(F.col("similarity") >= min_score).select(
        "conv_id", F.col("fact_id").alias("src"), F.col("anchor_id").alias("dst"), "similarity"
    )
    return _edge(linked, F.lit("IS_SPECIFIC_OF"), F.least(F.lit(0.95), F.lit(0.55) + F.col("similarity")), F.col("similarity"))


def recent_pairs(facts: DataFrame, window: int = 20) -> DataFrame:
    """Each fact with its ``window`` predecessors in the conversation, as an equi join on position blocks.

    Blocks hold ``window`` facts, so no task meets more than a few rows of one conversation.
    """
    numbered = dense_ordinal(facts, ["conv_id"], "pos").select(
        "conv_id", "node_id", "text", "status", "ordinal", tx.term_set("text").alias("terms")
    )
    block = F.floor(F.col("ordinal") / F.lit(window))
    new = numbered.select(
        "conv_id", F.col("node_id").alias("src"), F.col("text").alias("new_text"), F.col("status").alias("new_status"),
        F.col("ordinal").alias("new_no"), F.col("terms").alias("new_terms"), F.explode(F.array(block, block - 1)).alias("block"),
    )
    old = numbered.select(
        "conv_id", F.col("node_id").alias("dst"), F.col("text").alias("old_text"), F.col("ordinal").alias("old_no"),
        F.col("terms").alias("old_terms"), block.alias("block"),
    )
    return new.join(old, ["conv_id", "block"]).filter(
        (F.col("old_no") < F.col("new_no")) & (F.col("old_no") >= F.col("new_no") - window)
    ).drop("block")


def change_edges(facts: DataFrame, window: int = 20, min_similarity: float = 0.18) -> DataFrame:
    """UPDATES and CONFLICTS_WITH edges from newer to older similar facts."""
    similar = (
        recent_pairs(facts, window)
        .withColumn("similarity", tx.jaccard(F.col("new_terms"), F.col("old_terms")))
        .filter(F.col("similarity") >= min_similarity)
    )
    is_update = (F.col("new_status") == "outdated") | tx.looks_like_update("new_text")
    relation = F.when(is_update, "UPDATES").when(
        tx.looks_conflicting(F.col("old_text"), F.col("new_text")), "CONFLICTS_WITH"
    )
    confidence = F.when(F.col("kind") == "UPDATES", F.least(F.lit(0.9), F.lit(0.5) + F.col("similarity"))).otherwise(
        F.least(F.lit(0.85), F.lit(0.45) + F.col("similarity"))
    )
    return _edge(
        similar.withColumn("kind", relation).filter(F.col("kind").isNotNull()),
        F.col("kind"), confidence, F.col("similarity"),
    )


def build_edges(nodes: DataFrame) -> DataFrame:
    """Support, anchor, update and conflict edges of a node table, first edge per (src, dst, relation)."""
    facts, anchors = nodes.filter("type = 'FACT'"), nodes.filter("type = 'ANCHOR'")
    return support_edges(nodes).unionByName(link_anchors(facts, anchors)).unionByName(change_edges(facts))


def dedupe_edges(edges: DataFrame, order: str = "pos") -> DataFrame:
    """First edge per (src, dst, relation) in input order."""
    return first_per(edges, ["conv_id", "src", "dst", "relation"], [order])


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with a missing end; an intact graph gives no rows."""
    ids = nodes.select("conv_id", "node_id")
    lost_src = edges.join(ids.withColumnRenamed("node_id", "src"), ["conv_id", "src"], "left_anti").withColumn("missing", F.lit("src"))
    lost_dst = edges.join(ids.withColumnRenamed("node_id", "dst"), ["conv_id", "dst"], "left_anti").withColumn("missing", F.lit("dst"))
    return lost_src.unionByName(lost_dst)


def neighbours(edges: DataFrame, seeds: DataFrame, direction: str = "out", relation: str | None = None) -> DataFrame:
    """Edges leaving (``out``) or entering (``in``) the given nodes, optionally of one relation."""
    rows = edges if relation is None else edges.filter(F.col("relation") == relation)
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    return rows.join(seeds.select("conv_id", F.col("node_id").alias(near)), ["conv_id", near]).select(
        "conv_id", F.col(near).alias("node_id"), F.col(far).alias("neighbour"), "relation", "confidence"
    )


def partial_order_edges(edges: DataFrame) -> DataFrame:
    return edges.filter("relation = 'IS_SPECIFIC_OF'")


def resolve_supports(nodes: DataFrame) -> DataFrame:
    """Support values of facts resolved to RAW ids, directly or through (conversation, turn id)."""
    values = nodes.filter("type = 'FACT'").select(
        "conv_id", F.col("node_id").alias("fact_id"), F.posexplode("support_ids").alias("sup_pos", "value")
    ).withColumn("value", F.trim("value")).filter("value <> ''")
    turn = F.when(F.col("value").contains(":raw:"), F.regexp_extract("value", r"(?s):raw:(.*)$", 1)).otherwise(F.col("value"))
    raws = nodes.filter("type = 'RAW'").select(
        "conv_id", F.col("node_id").alias("raw_id"), "turn_id", "text", "time", "pos"
    )
    direct = raws.select("conv_id", F.col("raw_id").alias("value"), F.col("raw_id").alias("by_id"))
    by_turn = raws.groupBy("conv_id", "turn_id").agg(F.max_by("raw_id", "pos").alias("by_turn"))
    return (
        values.withColumn("turn_id", turn)
        .join(direct, ["conv_id", "value"], "left")
        .join(by_turn, ["conv_id", "turn_id"], "left")
        .withColumn("raw_id", F.coalesce("by_id", "by_turn"))
        .select("conv_id", "fact_id", "sup_pos", "value", "raw_id")
    )


def repair_provenance(nodes: DataFrame) -> DataFrame:
    """Facts with resolved, distinct RAW supports, their texts, times and turn ids; null times filled."""
    resolved = first_per(
        resolve_supports(nodes).filter("raw_id IS NOT NULL"), ["conv_id", "fact_id", "raw_id"], ["sup_pos"], ["sup_pos"]
    )
    raws = nodes.filter("type = 'RAW'").select(
        "conv_id", F.col("node_id").alias("raw_id"), F.col("text").alias("raw_text"), F.col("time").alias("raw_time"),
        F.col("turn_id").alias("raw_turn"),
    )
    lists = resolved.join(raws, ["conv_id", "raw_id"]).groupBy("conv_id", "fact_id").agg(
        F.array_sort(F.collect_list(F.struct("sup_pos", "raw_id", "raw_text", "raw_time", "raw_turn"))).alias("s")
    ).select(
        "conv_id", F.col("fact_id").alias("node_id"),
        F.transform("s", lambda x: x["raw_id"]).alias("support_raw_ids"),
        F.transform("s", lambda x: x["raw_text"]).alias("support_texts"),
        F.array_compact(F.transform("s", lambda x: x["raw_time"])).alias("support_times"),
        F.transform("s", lambda x: x["raw_turn"]).alias("support_turn_ids"),
    )
    return nodes.filter("type = 'FACT'").join(lists, ["conv_id", "node_id"], "left").withColumn(
        "time", F.coalesce("time", F.get("support_times", F.lit(0)))
    )


def missing_support_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SUPPORTS edges that provenance repair adds."""
    wanted = resolve_supports(nodes).filter("raw_id IS NOT NULL").select(
        "conv_id", F.col("fact_id").alias("src"), F.col("raw_id").alias("dst")
    ).distinct()
    present = edges.filter("relation = 'SUPPORTS'").select("conv_id", "src", "dst")
    return _edge(
        wanted.join(present, ["conv_id", "src", "dst"], "left_anti"), F.lit("SUPPORTS"), F.lit(0.98),
        role="fact_raw", view="provenance",
    )


def provenance_stats(nodes: DataFrame) -> DataFrame:
    """Facts, facts without any RAW support, their ratio and unresolved values, as one row."""
    facts = nodes.filter("type = 'FACT'").select("conv_id", F.col("node_id").alias("fact_id"))
    resolved = resolve_supports(nodes)
    has_raw = resolved.groupBy("conv_id", "fact_id").agg(F.max(F.col("raw_id").isNotNull().cast("int")).alias("ok"))
    totals = facts.join(has_raw, ["conv_id", "fact_id"], "left").agg(
        F.count(F.lit(1)).alias("total_facts"),
        F.sum(F.when(F.coalesce("ok", F.lit(0)) == 0, 1).otherwise(0)).alias("missing_raw_facts"),
    )
    lost = resolved.filter("raw_id IS NULL").select("value").distinct().agg(F.count(F.lit(1)).alias("unresolved_support_ids"))
    return totals.withColumn("unresolved_support_ids", lost.scalar()).withColumn(
        "fact_with_raw_ratio",
        F.when(F.col("total_facts") > 0, (F.col("total_facts") - F.col("missing_raw_facts")) / F.col("total_facts")).otherwise(0.0),
    )


def remove_view(nodes: DataFrame, edges: DataFrame, generated: Column, edge_generated: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without a generated view, so that the view can be rebuilt."""
    gone = nodes.filter(generated).select("conv_id", "node_id")
    kept_nodes = nodes.filter(~F.coalesce(generated, F.lit(False)))
    kept_edges = (
        edges.filter(~F.coalesce(edge_generated, F.lit(False)))
        .join(gone.withColumnRenamed("node_id", "src"), ["conv_id", "src"], "left_anti")
        .join(gone.withColumnRenamed("node_id", "dst"), ["conv_id", "dst"], "left_anti")
    )
    return kept_nodes, kept_edges


def first_conversations(rows: DataFrame, count: int) -> DataFrame:
    """Rows of the first ``count`` conversation ids in order."""
    chosen = rows.select("conv_id").distinct().orderBy("conv_id").limit(count)
    return rows.join(chosen, "conv_id", "left_semi")


def support_closure_nodes(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate nodes, their supports and the turn before each support, as far as they exist."""
    wanted = candidates.select("conv_id", "node_id").distinct()
    found = nodes.join(wanted, ["conv_id", "node_id"], "left_semi")
    supports = found.select("conv_id", F.explode("support_ids").alias("node_id")).unionByName(
        found.filter("type = 'RAW'").select("conv_id", "node_id")
    ).distinct()
    raws = nodes.filter("type = 'RAW'").select("conv_id", "node_id", "session_id", "pos")
    place = raws.join(supports, ["conv_id", "node_id"], "left_semi").select(
        "conv_id", "session_id", (F.col("pos") - 1).alias("pos")
    )
    before = raws.join(place, ["conv_id", "session_id", "pos"], "left_semi").select("conv_id", "node_id")
    ids = wanted.unionByName(supports).unionByName(before).distinct()
    return nodes.join(ids, ["conv_id", "node_id"], "left_semi")


def bind_gold(units: DataFrame, gold: DataFrame) -> DataFrame:
    """(unit, gold turn) rows where a unit quotes a gold turn of its question."""
    turns = units.select("question_id", "unit_id", F.explode("raw_message_ids").alias("raw_id")).select(
        "question_id", "unit_id",
        F.when(F.col("raw_id").contains(":raw:"), F.regexp_extract("raw_id", r"(?s)^.*?:raw:(.*)$", 1)).otherwise(F.col("raw_id")).alias("turn_id"),
    ).filter("turn_id <> ''").distinct()
    return turns.join(gold.select("question_id", "turn_id").distinct(), ["question_id", "turn_id"])
