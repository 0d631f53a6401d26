"""Order-dependent greedy grouping as streaming folds.

Each fold runs over rows sorted inside hash partitions and sees them batch by batch; it keeps only its open
clusters in memory, never the rows of a group. Where the rules allow, the fold key is finer than the
conversation: a session for topic segments, a topic for events and episodes, an entity for states.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.functions import vectors as vx
from memloom.operators.greedy import OpenCluster, OpenClusters, Score, set_overlap, unit
from memloom.operators.ordering import dense_ordinal
from memloom.operators.scans import scan_states
from memloom.session import cut_lineage


def sorted_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], Callable[[dict], tuple]],
    fields: str, carry: Sequence[str],
) -> DataFrame:
    """Run ``make()`` once per key and feed it the key's rows in order; it returns the new fields of each row."""
    names = [c for c in df.columns]
    carried = ", ".join(f"{c} {t}" for c, t in df.dtypes if c in carry)
    schema = f"{carried}, {fields}"
    carry = [c for c in names if c in carry]
    key_names = list(keys)
    out_names = carry + [part.split()[0] for part in fields.split(",")]

    def run(batches):
        current, step = None, None
        for batch in batches:
            produced = []
            for values in zip(*[batch[c].tolist() for c in names]):
                row = dict(zip(names, values))
                key = tuple(row[k] for k in key_names)
                if key != current:
                    current, step = key, make()
                produced.append(tuple(row[c] for c in carry) + tuple(step(row)))
            yield pd.DataFrame(produced, columns=out_names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


# --- segmentation ----------------------------------------------------------------------------------------


def with_previous(views: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with the given columns of the row before them in the conversation (equi join on the ordinal)."""
    numbered = dense_ordinal(views, ["conv_id"], "pos")
    previous = numbered.select(
        "conv_id", (F.col("ordinal") + 1).alias("ordinal"), *[F.col(c).alias(f"prev_{c}") for c in columns]
    )
    return numbered.join(previous, ["conv_id", "ordinal"], "left")


def segment_cues(views: DataFrame) -> DataFrame:
    """Similarity of each fact to the one before it: cosine, term and entity overlap, session change."""
    paired = with_previous(views, ["vector", "terms", "entities", "session"])
    return paired.select(
        "conv_id", "node_id", "pos", "ordinal", "session",
        F.coalesce(vx.fused_cosine(F.col("prev_vector"), F.col("vector")), F.lit(0.0)).alias("cos"),
        F.coalesce(tx.jaccard(F.col("prev_terms"), F.col("terms")), F.lit(0.0)).alias("term_sim"),
        F.coalesce(tx.jaccard(F.col("prev_entities"), F.col("entities")), F.lit(0.0)).alias("entity_sim"),
        (F.col("prev_session").isNull() | (F.col("prev_session") != F.col("session"))).alias("new_session"),
    )


PLAIN, SOFT, HARD = 0, 1, 2


def _cutter(max_size: int, min_size: int):
    """Step of a segment's size: a hard row cuts, a soft one from ``min_size`` on, any at ``max_size``."""

    def step(size: Column, kind: Column) -> tuple[Column, Column]:
        cuts = (size == 0) | (kind == HARD) | (size >= max_size) | ((size >= min_size) & (kind == SOFT))
        return F.when(cuts, 1).otherwise(size + 1), cuts

    return step


def _kind(hard: Column, soft: Column) -> Column:
    return F.when(hard, HARD).when(soft, SOFT).otherwise(PLAIN)


def topic_segments(
    views: DataFrame, max_facts: int = 36, min_facts: int = 2, min_cosine: float = 0.10, min_terms: float = 0.08
) -> DataFrame:
    """Facts cut into topics: at a new session, at ``max_facts``, or where neighbours have little in common.

    Small leftovers then join the segment before them. Both are scans over at most ``max_facts + 1`` states.
    """
    cues = segment_cues(views)
    soft = (F.col("cos") < min_cosine) & (F.col("term_sim") < min_terms)
    marked = cues.withColumn("kind", _kind(F.col("new_session"), soft))
    cut = scan_states(marked, ["conv_id"], "ordinal", "kind", max_facts, _cutter(max_facts, min_facts), ["node_id", "pos"])
    return merge_tiny_segments(cut.withColumnRenamed("opened", "seg_no"), min_facts, max_facts)


def merge_tiny_segments(cut: DataFrame, min_size: int, max_size: int) -> DataFrame:
    """A segment below ``min_size`` joins the segment before it when both fit ``max_size``.

    ``cut``: (conv_id, node_id, pos, ordinal, seg_no), segments numbered from 1 without gaps.
    """
    segments = cut.groupBy("conv_id", "seg_no").agg(F.count(F.lit(1)).alias("size")).withColumn("place", F.col("seg_no") - 1)

    def step(size: Column, own: Column) -> tuple[Column, Column]:
        joins = (size > 0) & (own < min_size) & (size + own <= max_size)
        return F.when(joins, size + own).otherwise(own), ~joins

    merged = scan_states(segments, ["conv_id"], "place", "size", max_size, step)
    named = merged.select("conv_id", (F.col("place") + 1).alias("seg_no"), F.col("opened").alias("topic_no"))
    return cut.join(named, ["conv_id", "seg_no"]).select("conv_id", "node_id", "pos", "ordinal", "topic_no")


def event_segments(
    views: DataFrame, topics: DataFrame, max_facts: int = 8, min_facts: int = 2, min_cosine: float = 0.18,
    min_overlap: float = 0.12,
) -> DataFrame:
    """Facts of a topic cut into events at ``max_facts`` or where neighbours have little in common."""
    first = topics.groupBy("conv_id", "topic_no").agg(F.min("ordinal").alias("first_ordinal"))
    placed = topics.join(first, ["conv_id", "topic_no"]).select("conv_id", "node_id", "topic_no", (F.col("ordinal") - F.col("first_ordinal")).alias("place"))
    soft = (F.col("cos") < min_cosine) & (F.greatest("term_sim", "entity_sim") < min_overlap)
    cues = segment_cues(views).join(placed, ["conv_id", "node_id"]).withColumn("kind", _kind(F.lit(False), soft))
    cut = scan_states(cues, ["conv_id", "topic_no"], "place", "kind", max_facts, _cutter(max_facts, min_facts), ["node_id", "pos"])
    return cut.select("conv_id", "node_id", "pos", "topic_no", F.col("opened").alias("event_no"))


# --- greedy clustering -----------------------------------------------------------------------------------


def steps_apart(left: set[int], right: set[int]) -> int:
    """Least distance of two sets of session numbers, 2 where one of them is empty."""
    return min((abs(a - b) for a in left for b in right), default=2)


def with_session_numbers(rows: DataFrame, sessions: Column) -> DataFrame:
    """Adds ``numbers``, the numbers in the session ids of a row."""
    return rows.withColumn("numbers", F.array_compact(F.transform(sessions, tx.session_number)))


def session_similarity(left: dict[str, set], right: dict[str, set]) -> float:
    if not left["sessions"] or not right["sessions"]:
        return 0.0
    if left["sessions"] & right["sessions"]:
        return 1.0
    return 0.5 if steps_apart(left["numbers"], right["numbers"]) == 1 else 0.0


def greedy_maker(read: Callable[[dict], tuple[np.ndarray, dict[str, set]]], score: Score, threshold: float, capacity: int, scan: int | None = None, normal: bool = True):
    """Online clustering: each row joins the best open cluster at or above ``threshold`` or opens a new one."""

    def make():
        clusters = OpenClusters(score, threshold, capacity, scan, normal)
        return lambda row: (clusters.place(*read(row)),)

    return make


def restart_runs(rows: DataFrame, max_gap: int) -> DataFrame:
    """Adds ``run``: where every earlier row's session number lies more than ``max_gap`` below that of this and each later row, no
    earlier cluster takes a row any more, and a new run starts. Runs of a conversation are folded in different tasks.

    Only one row per conversation and session takes part in the running extremes. A row without a number may join any
    cluster, so its conversation is one run.
    """
    number = F.get("numbers", F.lit(0))
    sessions = rows.groupBy("conv_id", "o1").agg(F.min(number).alias("low"), F.max(number).alias("high"), F.max(number.isNull()).alias("open"))
    order = Window.partitionBy("conv_id").orderBy("o1")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("low").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    closed = ~F.max("open").over(Window.partitionBy("conv_id")) & (after - before > max_gap)
    starts = sessions.withColumn("starts", F.when(closed, 1).otherwise(0)).withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(starts.select("conv_id", "o1", "run"), ["conv_id", "o1"])


def cluster_events(
    views: DataFrame, threshold: float = 0.52, max_facts: int = 6, max_session_gap: int = 1, scan: int = 256
) -> DataFrame:
    """Online event clusters of facts ``(conv_id, node_id, session, speaker, terms, entities, vector, order_key, pos)``."""

    def read(row):
        return unit(np.asarray(row["vector"], dtype=np.float32)), {
            "terms": set(row["terms"]), "entities": set(row["entities"]),
            "sessions": {row["session"]} if row["session"] else set(), "numbers": set(row["numbers"]),
            "speakers": {row["speaker"]} if row["speaker"] else set(),
        }

    def extra(sets, cluster):
        held, known = cluster.sets["sessions"], cluster.sets["numbers"] | sets["numbers"]
        if known and max(known) - min(known) > max_session_gap:
            return None
        apart = held and sets["sessions"] and not held & sets["sessions"]
        gap = steps_apart(sets["numbers"], cluster.sets["numbers"]) if apart else 0
        near = 1.0 if gap == 0 else 0.5 if gap == 1 else 0.0
        return 0.05 * near + 0.05 * float(bool(sets["speakers"] & cluster.sets["speakers"])) - 0.06 * gap

    source = views.select(
        "conv_id", "node_id", "session", "speaker", "terms", "entities", "vector", "pos",
        F.col("order_key.session").alias("o1"), F.col("order_key.number").alias("o2"), F.col("order_key.id").alias("o3"),
    )
    runs = restart_runs(with_session_numbers(source, F.array("session")), max_session_gap)
    score = Score(0.60, {"entities": 0.15, "terms": 0.15}, extra, 0.10)
    placed = cut_lineage(sorted_fold(
        runs, ["conv_id", "run"], ["o1", "o2", "o3", "pos"], greedy_maker(read, score, threshold, max_facts, scan), "own_no long", ["conv_id", "run", "node_id", "pos"],
    ))
    sizes = placed.groupBy("conv_id", "run").agg(F.max("own_no").alias("opened"))
    earlier = F.sum("opened").over(Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("conv_id", "run", F.coalesce(earlier, F.lit(0)).alias("offset"))
    return placed.join(offsets, ["conv_id", "run"]).select("conv_id", "node_id", "pos", (F.col("own_no") + F.col("offset")).alias("event_no"))


def running_centroids(members: DataFrame) -> DataFrame:
    """Normalised centre of each cluster after every member, as the greedy folds keep it.

    ``members``: (conv_id, cluster_id, member_id, pos, vector).
    """
    def make():
        held: list[OpenCluster] = []

        def step(row):
            vector = np.asarray(row["vector"], dtype=np.float64)
            if held:
                held[0].absorb(vector, {})
            else:
                held.append(OpenCluster(1, 1, vector))
            return (held[0].size, held[0].centre.tolist())

        return step

    rows = members.select("conv_id", "cluster_id", "member_id", "pos", "vector")
    return sorted_fold(rows, ["conv_id", "cluster_id"], ["pos"], make, "size long, centroid array<double>", ["conv_id", "cluster_id", "member_id"])


def cluster_topics(events: DataFrame, threshold: float = 0.52, max_events: int = 8) -> DataFrame:
    """Online topic clusters of events ``(conv_id, event_id, vector, terms, entities, sessions, first_pos)``."""

    def read(row):
        return unit(np.asarray(row["vector"], dtype=np.float32)), {k: set(row[k]) for k in ("terms", "entities", "sessions", "numbers")}

    score = Score(0.65, {"entities": 0.20, "terms": 0.10}, lambda sets, cluster: 0.05 * session_similarity(sets, cluster.sets), 0.05)
    return sorted_fold(
        with_session_numbers(events.select("conv_id", "event_id", "vector", "terms", "entities", "sessions", "first_pos"), F.col("sessions")),
        ["conv_id"], ["first_pos", "event_id"], greedy_maker(read, score, threshold, max_events),
        "topic_no long", ["conv_id", "event_id", "first_pos"],
    )


def cluster_episodes(events: DataFrame, threshold: float = 0.50, max_events: int = 6) -> DataFrame:
    """Online episode clusters inside each topic; events come in order of their first session."""

    def read(row):
        return unit(np.asarray(row["vector"], dtype=np.float32)), {k: set(row[k]) for k in ("terms", "entities", "sessions")}

    score = Score(0.70, {"entities": 0.15, "terms": 0.10}, lambda sets, cluster: 0.05 * set_overlap(sets["sessions"], cluster.sets["sessions"]), 0.05)
    return sorted_fold(
        events.select("conv_id", "topic_id", "event_id", "vector", "terms", "entities", "sessions", "first_pos",
                      F.coalesce(F.get("sessions", F.lit(0)), F.col("event_id")).alias("first_session")),
        ["conv_id", "topic_id"], ["first_session", "first_pos", "event_id"],
        greedy_maker(read, score, threshold, max_events), "episode_no long",
        ["conv_id", "topic_id", "event_id", "first_pos"],
    )


def cluster_entity_states(
    units: DataFrame, threshold: float = 0.50, max_facts: int = 20, min_facts: int = 2
) -> DataFrame:
    """Facts of one entity grouped into states; groups below ``min_facts`` become direct facts (state_no null).

    ``units``: (conv_id, entity_key, fact_id, terms, vector, episode_id, event_id, session_id).
    """

    def read(row):
        sets = {"terms": set(row["terms"])}
        for name in ("episode_id", "event_id", "session_id"):
            sets[name] = {row[name]} if row[name] else set()
        return np.asarray(row["vector"], dtype=np.float64), sets

    ids = {"episode_id": 0.18, "event_id": 0.12, "session_id": 0.10}
    extra = lambda sets, cluster: sum(w * bool(sets[n] & cluster.sets[n]) for n, w in ids.items())
    score = Score(0.35, {"terms": 0.25}, extra, sum(ids.values()), tuple(ids), positive=True)
    make = greedy_maker(read, score, threshold, max_facts, normal=False)
    last = F.lit("zzzz")
    ordered = units.select(
        "conv_id", "entity_key", "fact_id", "terms", "vector", "episode_id", "event_id", "session_id",
        F.coalesce(F.nullif("episode_id", F.lit("")), last).alias("o1"),
        F.coalesce(F.nullif("session_id", F.lit("")), last).alias("o2"),
        F.coalesce(F.nullif("event_id", F.lit("")), last).alias("o3"),
    )
    assigned = sorted_fold(
        ordered, ["conv_id", "entity_key"], ["o1", "o2", "o3", "fact_id"], make, "cluster_no long",
        ["conv_id", "entity_key", "fact_id", "episode_id", "event_id", "session_id"],
    )
    sizes = assigned.groupBy("conv_id", "entity_key", "cluster_no").agg(F.count(F.lit(1)).alias("size"))
    kept = sizes.filter(F.col("size") >= min_facts)
    order = Window.partitionBy("conv_id", "entity_key").orderBy("cluster_no")
    numbered = kept.withColumn("state_no", F.row_number().over(order)).drop("size")
    return assigned.join(numbered, ["conv_id", "entity_key", "cluster_no"], "left").drop("cluster_no")
