"""Clusters as tables: centroids, coherence, labels, nodes, edges, views and evidence packs.

Cluster members come as ``(conv_id, cluster_id, member_id, pos)``; caps of the clustering folds bound the size
of a cluster, so lists are only ever built per cluster. Conversations, sessions and entities stay long-form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.functions import vectors as vx
from memloom.operators.nodes import pad_number
from memloom.operators.ordering import first_per, top_per

KEYS = ["conv_id", "cluster_id"]


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def mean_vector(members: DataFrame, dim: int, keys: Sequence[str] = KEYS, vector: str = "vector") -> DataFrame:
    """Normalised element-wise mean per key; one map-side combinable average per dimension, no exploding."""
    cells = [F.avg(F.col(vector)[i]).alias(f"_{i}") for i in range(dim)]
    means = members.groupBy(*keys).agg(*cells)
    return means.select(*keys, vx.normalize(F.array(*[F.col(f"_{i}") for i in range(dim)])).alias("centroid"))


def segment_coherence(members: DataFrame) -> DataFrame:
    """Mean cosine of consecutive members, clipped to [0, 1]; 0.5 for a single member."""
    order = Window.partitionBy(*KEYS).orderBy("pos")
    steps = members.withColumn("step", vx.cosine(F.lag("vector").over(order), F.col("vector"))).withColumn(
        "step", F.when(F.row_number().over(order) > 1, F.col("step"))
    )
    return steps.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("size"), F.coalesce(clip(F.avg("step")), F.lit(0.5)).alias("coherence")
    )


def segment_keywords(terms: DataFrame, entities: DataFrame, limit: int = 8) -> DataFrame:
    """Best words per cluster: terms count 1, lower-cased entities 1.5; ties alphabetical.

    Both inputs are ``(conv_id, cluster_id, value)`` rows, one per member and distinct value.
    """
    rows = terms.select(*KEYS, F.col("value").alias("keyword"), F.lit(1.0).alias("w")).unionByName(
        entities.select(*KEYS, F.lower("value").alias("keyword"), F.lit(1.5).alias("w"))
    )
    totals = rows.groupBy(*KEYS, "keyword").agg(F.sum("w").alias("weight"))
    return top_per(totals, KEYS, [F.desc("weight"), F.asc("keyword")], limit)


def keyword_list(ranked: DataFrame, value: str, alias: str) -> DataFrame:
    """Ranked rows (bounded per cluster) to one ordered list per cluster."""
    packed = F.array_sort(F.collect_list(F.struct("rank", value)))
    return ranked.groupBy(*KEYS).agg(packed.alias("_v")).select(
        *KEYS, F.transform("_v", lambda x: x[value]).alias(alias)
    )


def segment_labels(keywords: DataFrame, entities: DataFrame, limit: int = 8) -> DataFrame:
    """``Topic: …`` and ``Event: …`` texts of segments from their keywords and distinct entities."""
    first_entities = keyword_list(
        top_per(entities.select(*KEYS, "value").distinct(), KEYS, [F.asc("value")], 12), "value", "entities"
    )
    words = keyword_list(keywords, "keyword", "keywords")
    none = F.array().cast("array<string>")
    joined = words.join(first_entities, KEYS, "full").select(
        *KEYS, F.coalesce("keywords", none).alias("keywords"), F.coalesce("entities", none).alias("entities")
    )
    lowered = F.transform("entities", F.lower)
    label = F.slice(F.concat(F.slice("entities", 1, 3), F.filter("keywords", lambda k: ~F.array_contains(lowered, k))), 1, limit)
    return joined.select(
        *KEYS, "keywords", "entities",
        F.concat(F.lit("Topic: "), F.when(F.size("keywords") > 0, F.array_join("keywords", ", ")).otherwise("general memory")).alias("topic_text"),
        F.concat(F.lit("Event: "), F.when(F.size(label) > 0, F.array_join(label, ", ")).otherwise("memory episode")).alias("event_text"),
    )


def segment_confidence(coherence: Column) -> tuple[Column, Column, Column]:
    """Confidence of a topic segment, an event segment and their edges."""
    return (
        F.least(F.lit(0.92), 0.55 + 0.35 * coherence),
        F.least(F.lit(0.94), 0.58 + 0.34 * coherence),
        F.least(F.lit(0.96), 0.62 + 0.32 * coherence),
    )


def centroid_scores(members: DataFrame, dim: int) -> DataFrame:
    """Members with their cosine to the normalised mean of their cluster."""
    return members.join(mean_vector(members, dim), KEYS).withColumn("centrality", vx.cosine(F.col("vector"), F.col("centroid")))


def centroid_coherence(members: DataFrame, dim: int) -> DataFrame:
    """Mean cosine to the centroid with the cluster confidence; 0.5 for a single member."""
    scored = centroid_scores(members, dim).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("size"), clip(F.avg("centrality")).alias("mean_cos")
    )
    coherence = F.when(F.col("size") < 2, F.lit(0.5)).otherwise(F.col("mean_cos"))
    return scored.select(
        *KEYS, "size", coherence.alias("coherence"), F.least(F.lit(0.96), 0.58 + 0.36 * coherence).alias("confidence")
    )


def pairwise_coherence(members: DataFrame) -> DataFrame:
    """Mean non-negative cosine over member pairs of capped clusters; 0.5 below two members."""
    left = members.select(*KEYS, F.col("member_id").alias("a"), F.col("vector").alias("va"))
    right = members.select(*KEYS, F.col("member_id").alias("b"), F.col("vector").alias("vb"))
    pairs = left.join(right, KEYS).filter("a < b").groupBy(*KEYS).agg(
        F.avg(F.greatest(F.lit(0.0), vx.cosine(F.col("va"), F.col("vb")))).alias("mean_cos")
    )
    sizes = members.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(pairs, KEYS, "left").select(*KEYS, "size", F.coalesce(clip(F.col("mean_cos")), F.lit(0.5)).alias("coherence"))


def representatives(members: DataFrame, dim: int, count: int = 1) -> DataFrame:
    """Members closest to the centroid; equal to nine digits counts as a tie and the earlier one wins."""
    return top_per(centroid_scores(members, dim), KEYS, [F.desc(F.round("centrality", 9)), F.asc("pos")], count)


def ranked_values(items: DataFrame, limit: int) -> DataFrame:
    """Most frequent values per cluster by lower-cased form; the first seen spelling is shown.

    ``items``: (conv_id, cluster_id, value, seen) with ``seen`` ordering the appearances.
    """
    totals = items.groupBy(*KEYS, F.lower("value").alias("key")).agg(
        F.count(F.lit(1)).alias("count"), F.min_by("value", F.struct("seen", "value")).alias("value")
    )
    return top_per(totals, KEYS, [F.desc("count"), F.asc("key")], limit)


def _without_label(text: Column, label: str) -> Column:
    value = F.trim(text)
    return F.when(F.lower(value).startswith(f"{label}:"), F.trim(F.regexp_replace(value, r"(?s)^[^:]*:", ""))).otherwise(value)


def event_summary(representative: Column, entities: Column, limit: int = 260) -> Column:
    prefix = F.when(
        F.size(entities) > 0, F.concat(F.lit("Event involving "), F.array_join(F.slice(entities, 1, 3), ", "), F.lit(": "))
    ).otherwise(F.lit("Event: "))
    return tx.truncate_at_word(F.concat(prefix, _without_label(representative, "event")), limit)


def topic_summary(event_texts: Column, entities: Column, keywords: Column, limit: int = 360) -> Column:
    subjects = F.when(F.size(entities) > 0, F.slice(entities, 1, 3)).otherwise(F.slice(keywords, 1, 4))
    prefix = F.when(F.size(subjects) > 0, F.concat(F.lit("Topic about "), F.array_join(subjects, ", "), F.lit(". "))).otherwise(F.lit("Topic. "))
    details = F.array_join(F.transform(event_texts, lambda t: _without_label(t, "event")), "; ")
    return tx.truncate_at_word(F.concat(prefix, F.lit("Includes "), details), limit)


def episode_summary(event_texts: Column, keywords: Column, limit: int = 360) -> Column:
    label = F.array_join(event_texts, "; ")
    cut = F.when(
        F.length(label) > limit, F.concat(F.regexp_replace(F.left(label, F.lit(limit - 3)), r"\s+$", ""), F.lit("..."))
    ).otherwise(label)
    words = F.array_join(keywords, ", ")
    return F.concat(
        F.lit("Episode: "),
        F.when(cut != "", cut).when(words != "", words).otherwise(F.lit("memory episode")),
    )


def cluster_view(members: DataFrame, dim: int) -> DataFrame:
    """One row per cluster: normalised mean vector, union of terms, entities and sessions, first position."""
    unions = members.groupBy(*KEYS).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("entities"),
        F.array_sort(F.array_compact(F.collect_set(F.nullif("session", F.lit(""))))).alias("sessions"),
        F.min("pos").alias("first_pos"),
        F.count(F.lit(1)).alias("size"),
    )
    return unions.join(mean_vector(members, dim), KEYS).withColumnRenamed("centroid", "vector")


def cluster_rows(members: DataFrame, dim: int, kind: str, max_entities: int = 5, max_keywords: int = 8) -> DataFrame:
    """EVENT, TOPIC or EPISODE rows from capped clusters.

    ``members``: (conv_id, cluster_id, member_id, text, vector, terms, entities, sessions, supports, pos).
    """
    picks = representatives(members, dim, 1 if kind == "event" else 2)
    texts = picks.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("rank", "text", "member_id"))).alias("_r")).select(
        *KEYS, F.transform("_r", lambda x: x["text"]).alias("rep_texts"), F.col("_r")[0]["member_id"].alias("representative_id")
    )
    entities = keyword_list(
        ranked_values(members.select(*KEYS, F.explode("entities").alias("value"), F.col("pos").alias("seen")), max_entities), "value", "entities"
    )
    keywords = keyword_list(
        ranked_values(members.select(*KEYS, F.explode("terms").alias("value"), F.col("pos").alias("seen")), max_keywords), "value", "keywords"
    )
    lists = members.groupBy(*KEYS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "member_id"))), lambda x: x["member_id"]).alias("member_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("supports")))).alias("support_raw_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sessions")))).alias("session_ids"),
    )
    none = F.array().cast("array<string>")
    rows = (
        centroid_coherence(members, dim).join(texts, KEYS).join(lists, KEYS)
        .join(entities, KEYS, "left").join(keywords, KEYS, "left")
        .withColumn("entities", F.coalesce("entities", none)).withColumn("keywords", F.coalesce("keywords", none))
    )
    if kind == "event":
        text = event_summary(F.col("rep_texts")[0], F.col("entities"))
    elif kind == "topic":
        text = topic_summary(F.col("rep_texts"), F.col("entities"), F.col("keywords"))
    else:
        text = episode_summary(F.col("rep_texts"), F.col("keywords"))
    return rows.withColumn("text", text).drop("rep_texts")


def membership_edges(members: DataFrame, clusters: DataFrame, role: str) -> DataFrame:
    """Member to cluster edges at the cluster's confidence."""
    return members.select(*KEYS, "member_id").join(clusters.select(*KEYS, "confidence"), KEYS).select(
        "conv_id", F.col("member_id").alias("src"), F.col("cluster_id").alias("dst"),
        F.lit("IS_SPECIFIC_OF").alias("relation"), F.lit(role).alias("role"), "confidence",
    )


def alias_edges(aliases: DataFrame, members: DataFrame) -> DataFrame:
    """Alias facts point to the event of their first supported raw turn.

    ``aliases``: (conv_id, node_id, support_ids); ``members``: (conv_id, cluster_id, pos, support_ids) of canonical facts.
    """
    raw_event = members.select("conv_id", "cluster_id", "pos", F.explode("support_ids").alias("raw_id")).groupBy(
        "conv_id", "raw_id"
    ).agg(F.min_by("cluster_id", F.struct("pos", "cluster_id")).alias("event_id"))
    wanted = aliases.select("conv_id", "node_id", F.posexplode("support_ids").alias("sup_pos", "raw_id"))
    return wanted.join(raw_event, ["conv_id", "raw_id"]).groupBy("conv_id", F.col("node_id").alias("src")).agg(
        F.min_by("event_id", "sup_pos").alias("dst")
    ).select(
        "conv_id", "src", "dst", F.lit("IS_SPECIFIC_OF").alias("relation"), F.lit("lexical_alias_event").alias("role"),
        F.lit(0.90).alias("confidence"),
    )


def episode_edges(episode_members: DataFrame, episodes: DataFrame) -> DataFrame:
    """event→episode and episode→topic edges; members carry (conv_id, cluster_id, member_id, topic_id)."""
    confident = episode_members.join(episodes.select(*KEYS, "confidence"), KEYS)
    up = confident.select(
        "conv_id", F.col("member_id").alias("src"), F.col("cluster_id").alias("dst"), F.lit("event_episode").alias("role"), "confidence"
    )
    top = confident.select(
        "conv_id", F.col("cluster_id").alias("src"), F.col("topic_id").alias("dst"), F.lit("episode_topic").alias("role"), "confidence"
    ).distinct()
    return up.unionByName(top)


def episode_stats(episode_members: DataFrame) -> DataFrame:
    """Episodes, mean and largest size, share of single-event episodes."""
    sizes = episode_members.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("episode_nodes"), F.sum("n").alias("event_episode_edges"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_events_per_episode"),
        F.coalesce(F.avg((F.col("n") == 1).cast("double")), F.lit(0.0)).alias("singleton_episode_ratio"),
        F.coalesce(F.max("n"), F.lit(0)).alias("episode_size_max"),
    )


# --- sessions and conversations --------------------------------------------------------------------------


def session_nodes(raws: DataFrame) -> DataFrame:
    """SESSION rows: first time, turn count and up to four speakers in the text."""
    spoken = raws.withColumn("session", tx.canonical_session("turn_id")).filter("session <> ''")
    base = spoken.groupBy("conv_id", "session").agg(
        F.count(F.lit(1)).alias("turn_count"), F.min_by("time", F.when(F.col("time").isNotNull(), F.col("pos"))).alias("time")
    )
    speakers = spoken.filter("speaker <> ''").select("conv_id", "session", "speaker").distinct()
    first = top_per(speakers, ["conv_id", "session"], [F.asc("speaker")], 4).groupBy("conv_id", "session").agg(
        F.array_join(F.array_sort(F.collect_list("speaker")), ", ").alias("names")
    )
    hint = F.concat(
        F.lit("Session "), F.col("session"), F.lit(" in "), F.col("conv_id"),
        F.coalesce(F.concat(F.lit(" at "), F.col("time")), F.lit("")),
        F.coalesce(F.concat(F.lit(" involving "), F.col("names")), F.lit("")), F.lit("."),
    )
    return base.join(first, ["conv_id", "session"], "left").select(
        "conv_id", F.concat_ws(":session:", "conv_id", "session").alias("node_id"), F.lit("SESSION").alias("type"),
        hint.alias("text"), "time", F.lit(0.99).alias("confidence"), "session", "turn_count",
    )


def conversation_nodes(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("conv_id").agg(F.countDistinct("session").alias("session_count")).select(
        "conv_id", F.concat("conv_id", F.lit(":conversation")).alias("node_id"), F.lit("CONVERSATION").alias("type"),
        F.concat(F.lit("Conversation "), "conv_id", F.lit(" containing "), F.col("session_count").cast("string"), F.lit(" sessions.")).alias("text"),
        F.lit(1.0).alias("confidence"), "session_count",
    )


def event_sessions(events: DataFrame, raws: DataFrame) -> DataFrame:
    """(event, session) rows from the event's raw turns, or from its own session ids when no raw turn is known.

    ``events``: (conv_id, event_id, support_raw_ids, session_ids, confidence).
    """
    places = raws.select("conv_id", F.col("node_id").alias("raw_id"), tx.canonical_session("turn_id").alias("session"))
    by_raw = events.select("conv_id", "event_id", F.explode("support_raw_ids").alias("raw_id")).join(
        places, ["conv_id", "raw_id"]
    ).filter("session <> ''").select("conv_id", "event_id", "session").distinct()
    rest = events.join(by_raw.select("conv_id", "event_id").distinct(), ["conv_id", "event_id"], "left_anti")
    by_meta = rest.select("conv_id", "event_id", F.explode("session_ids").alias("s")).select(
        "conv_id", "event_id", tx.canonical_session("s").alias("session")
    ).filter("session <> ''").distinct()
    return by_raw.unionByName(by_meta)


def session_view_edges(events: DataFrame, raws: DataFrame) -> DataFrame:
    """session→conversation edges (0.99) and event→session edges at the event's bounded confidence."""
    linked = event_sessions(events, raws)
    known = raws.select("conv_id", tx.canonical_session("turn_id").alias("session")).filter("session <> ''")
    sessions = known.unionByName(linked.select("conv_id", "session")).distinct()
    up = sessions.select(
        "conv_id", F.concat_ws(":session:", "conv_id", "session").alias("src"), F.concat("conv_id", F.lit(":conversation")).alias("dst"),
        F.lit("session_conversation").alias("role"), F.lit(0.99).alias("confidence"),
    )
    down = linked.join(events.select("conv_id", "event_id", "confidence"), ["conv_id", "event_id"]).select(
        "conv_id", F.col("event_id").alias("src"), F.concat_ws(":session:", "conv_id", "session").alias("dst"),
        F.lit("event_session").alias("role"), clip(F.col("confidence"), 0.55, 0.98).alias("confidence"),
    )
    return up.unionByName(down)


# --- entities --------------------------------------------------------------------------------------------


def entity_node_id(conv: Column, key: Column) -> Column:
    return F.concat(conv, F.lit(":entity:"), tx.slug(key))


def entity_state_id(conv: Column, key: Column, number: Column) -> Column:
    return F.concat(conv, F.lit(":entitystate:"), tx.slug(key), F.lit(":"), pad_number(number))


def entity_states(assigned: DataFrame, units: DataFrame, max_keywords: int = 8) -> DataFrame:
    """ENTITY_STATE rows of clustered units: keywords, coherence, confidence and text."""
    kept = assigned.filter("state_no IS NOT NULL").select("conv_id", "entity_key", "fact_id", "state_no")
    members = kept.join(units.select("conv_id", "entity_key", "fact_id", "entity", "terms", "vector"), ["conv_id", "entity_key", "fact_id"]).select(
        "conv_id", entity_state_id(F.col("conv_id"), F.col("entity_key"), F.col("state_no")).alias("cluster_id"),
        "entity_key", "entity", F.col("fact_id").alias("member_id"), "terms", "vector",
    )
    words = keyword_list(
        ranked_values(members.select(*KEYS, F.explode("terms").alias("value"), F.lit(0).alias("seen")), max_keywords), "value", "keywords"
    )
    names = members.groupBy(*KEYS).agg(F.min("entity").alias("entity"), F.min("entity_key").alias("entity_key"))
    none = F.array().cast("array<string>")
    label = F.array_join(F.slice("keywords", 1, 4), ", ")
    return pairwise_coherence(members).join(names, KEYS).join(words, KEYS, "left").withColumn(
        "keywords", F.coalesce("keywords", none)
    ).select(
        "conv_id", F.col("cluster_id").alias("node_id"), "entity", "entity_key", "size", "coherence", "keywords",
        clip(0.55 + 0.40 * F.col("coherence"), 0.55, 0.98).alias("confidence"),
        F.concat(F.lit("EntityState: "), "entity", F.lit(" - "), F.when(label == "", F.lit("state")).otherwise(label), F.lit(".")).alias("text"),
    )


def entity_nodes(units: DataFrame) -> DataFrame:
    """ENTITY rows with fact and session counts (member lists stay in the unit table)."""
    return units.groupBy("conv_id", "entity_key").agg(
        F.min_by("entity", "fact_id").alias("entity"), F.countDistinct("fact_id").alias("fact_count")
    ).select(
        "conv_id", entity_node_id(F.col("conv_id"), F.col("entity_key")).alias("node_id"), F.lit("ENTITY").alias("type"),
        F.concat(F.lit("Entity: "), "entity", F.lit(" in "), "conv_id", F.lit(".")).alias("text"),
        F.lit(0.94).alias("confidence"), "entity", "entity_key", "fact_count",
    )


def entity_edges(assigned: DataFrame, states: DataFrame) -> DataFrame:
    """fact→state and state→entity edges at the state's confidence, direct fact→entity edges at 0.72."""
    entity = entity_node_id(F.col("conv_id"), F.col("entity_key"))
    confident = states.select("conv_id", F.col("node_id").alias("state_id"), "confidence")
    clustered = assigned.filter("state_no IS NOT NULL").withColumn(
        "state_id", entity_state_id(F.col("conv_id"), F.col("entity_key"), F.col("state_no"))
    ).join(confident, ["conv_id", "state_id"])
    to_state = clustered.select("conv_id", F.col("fact_id").alias("src"), F.col("state_id").alias("dst"), F.lit("fact_entity_state").alias("role"), "confidence")
    to_entity = clustered.select("conv_id", F.col("state_id").alias("src"), entity.alias("dst"), F.lit("entity_state").alias("role"), "confidence").distinct()
    direct = assigned.filter("state_no IS NULL").select(
        "conv_id", F.col("fact_id").alias("src"), entity.alias("dst"), F.lit("fact_entity_direct").alias("role"), F.lit(0.72).alias("confidence")
    ).distinct()
    return to_state.unionByName(to_entity).unionByName(direct)


def entity_hub_stats(assigned: DataFrame, max_facts: int = 20) -> DataFrame:
    """Entities above the state cap and how many of them were split into several states."""
    per = assigned.groupBy("conv_id", "entity_key").agg(
        F.count(F.lit(1)).alias("facts"), F.coalesce(F.max("state_no"), F.lit(0)).alias("states")
    )
    hubs, split = F.count_if(F.col("facts") > max_facts), F.count_if((F.col("facts") > max_facts) & (F.col("states") > 1))
    return per.agg(
        F.count(F.lit(1)).alias("entities"), F.sum("facts").alias("units"), F.sum("states").alias("states"),
        hubs.alias("high_freq_entities"), split.alias("split_high_freq_entities"),
        F.when(hubs > 0, split / hubs).otherwise(F.lit(1.0)).alias("hub_entity_split_ratio"),
    )


# --- evidence packs --------------------------------------------------------------------------------------

PACK = ["conv_id", "pack_id", "pack_type"]


def pack_facts(rows: DataFrame, order: Sequence[str], limit: int = 24) -> DataFrame:
    """First ``limit`` distinct facts per pack in the given order."""
    once = first_per(rows, [*PACK, "fact_id"], order, list(order))
    return top_per(once, PACK, [F.asc(c) for c in order] + [F.asc("fact_id")], limit, "fact_no").drop(*order)


def episode_packs(event_episode: DataFrame, fact_event: DataFrame, limit: int = 24) -> DataFrame:
    rows = event_episode.join(fact_event, ["conv_id", "event_id"]).select(
        "conv_id", F.regexp_replace("episode_id", ":episode:", ":pack:episode:").alias("pack_id"), F.lit("episode").alias("pack_type"),
        "fact_id", "event_id", F.col("fact_id").alias("o2"), F.col("event_id").alias("o1"),
    )
    return pack_facts(rows, ["o1", "o2"], limit)


def entity_state_packs(state_facts: DataFrame, limit: int = 24) -> DataFrame:
    rows = state_facts.select(
        "conv_id", F.regexp_replace("state_id", ":entitystate:", ":pack:entitystate:").alias("pack_id"),
        F.lit("entity_state").alias("pack_type"), "fact_id", F.col("fact_id").alias("o1"),
    )
    return pack_facts(rows, ["o1"], limit)


def bridge_packs(state_facts: DataFrame, fact_event: DataFrame, event_episode: DataFrame, min_facts: int = 2, limit: int = 24) -> DataFrame:
    """Facts of one state inside one episode, where there are at least ``min_facts``."""
    tail = F.regexp_extract("state_id", r":entitystate:(.*)$", 1)
    rows = state_facts.join(fact_event, ["conv_id", "fact_id"]).join(event_episode, ["conv_id", "event_id"]).select(
        "conv_id",
        F.concat(F.col("conv_id"), F.lit(":pack:bridge:"), F.regexp_replace(tail, ":", "_"), F.lit("_"),
                 F.regexp_extract("episode_id", r"([^:]*)$", 1)).alias("pack_id"),
        F.lit("bridge_entity_episode").alias("pack_type"), "fact_id", F.col("fact_id").alias("o1"),
    )
    enough = rows.groupBy(*PACK).agg(F.countDistinct("fact_id").alias("n")).filter(F.col("n") >= min_facts).select(*PACK)
    return pack_facts(rows.join(enough, PACK, "left_semi"), ["o1"], limit)


def linked_packs(rows: DataFrame, keys: Sequence[str], min_facts: int = 2, limit: int = 24) -> DataFrame:
    """``bridge_packs`` of rows that carry the ``keys`` of their pack: the first ``limit`` facts of packs that have at least ``min_facts``.

    Rows are (keys, fact_id) without repeats. Counts need only the facts that are kept, so rows dealt by pack stay where they lie.
    """
    kept = top_per(rows, keys, [F.asc_nulls_last("fact_id")], max(limit, min_facts), "fact_no")
    counted = kept.withColumn("n", F.count("fact_id").over(Window.partitionBy(*keys)))
    return counted.filter((F.col("n") >= min_facts) & (F.col("fact_no") <= limit)).drop("n")


def pack_centrality(members: DataFrame, dim: int) -> DataFrame:
    """Min-max scaled similarity of pack facts to the pack's centre; 1 alone, 0.5 when all are equal."""
    scored = members.join(mean_vector(members, dim, PACK), PACK).withColumn(
        "raw", F.greatest(F.lit(0.0), vx.dot(F.col("vector"), F.col("centroid")))
    )
    whole = Window.partitionBy(*PACK)
    low, high = F.min("raw").over(whole), F.max("raw").over(whole)
    return scored.withColumn("low", low).withColumn("high", high).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn(
        "centrality",
        F.when(F.col("n") == 1, 1.0).when(F.col("high") <= F.col("low"), 0.5).otherwise(
            (F.col("raw") - F.col("low")) / (F.col("high") - F.col("low"))
        ),
    ).drop("raw", "low", "high", "n", "centroid")


def membership_weight(
    pack_type: Column, fact_confidence: Column, coherence: Column, centrality: Column, fact_event: Column,
    event_episode: Column, fact_state: Column,
) -> Column:
    """Weight of a fact in a pack; missing link confidences count 0.5."""
    fe, ee, fs = (F.coalesce(c, F.lit(0.5)) for c in (fact_event, event_episode, fact_state))
    hierarchy = (
        F.when(pack_type == "episode", 0.55 * fe + 0.45 * ee)
        .when(pack_type == "entity_state", 0.60 * fs + 0.40 * fe)
        .when(pack_type == "bridge_entity_episode", 0.40 * fs + 0.30 * fe + 0.30 * ee)
        .otherwise(fe)
    )
    weight = 0.30 * hierarchy + 0.25 * fact_confidence + 0.25 * coherence + 0.20 * F.coalesce(centrality, F.lit(0.5))
    return clip(0.05 + 0.95 * weight)


def container_weight(coherence: Column) -> Column:
    """Weight of a non-fact member of a pack."""
    return clip(0.70 + 0.20 * coherence)


# --- role maps -------------------------------------------------------------------------------------------


def role_map(edges: DataFrame, role: str, src: str, dst: str) -> DataFrame:
    """Child to parent map of one edge role; the last edge in input order wins."""
    return edges.filter(F.col("role") == role).groupBy("conv_id", F.col("src").alias(src)).agg(F.max_by("dst", "pos").alias(dst))


def fact_topic_map(edges: DataFrame, with_episodes: bool = False) -> DataFrame:
    """fact → event → (episode →) topic."""
    facts = role_map(edges, "fact_event", "fact_id", "event_id")
    if not with_episodes:
        return facts.join(role_map(edges, "event_topic", "event_id", "topic_id"), ["conv_id", "event_id"], "left")
    return linked_topics(facts, role_map(edges, "event_episode", "event_id", "episode_id"), role_map(edges, "episode_topic", "episode_id", "topic_id"))


def last_parent(edges: DataFrame, child: Sequence[str], parent: str, src: str | None = None) -> DataFrame:
    """``role_map`` of one role's edges whose child may be several columns; numbers are aggregated where they lie, if dealt by one of them."""
    edges = edges.withColumnRenamed(src, child[0]) if src else edges
    return edges.groupBy("conv_id", *child).agg(F.max_by("dst", "pos").alias(parent))


def linked_topics(facts: DataFrame, episodes: DataFrame, topics: DataFrame) -> DataFrame:
    """fact → event → episode → topic of ``last_parent`` maps. Events learn their episode and topic first, so facts move once."""
    return facts.join(episodes.join(topics, ["conv_id", "episode_id"], "left"), ["conv_id", "event_id"], "left")
