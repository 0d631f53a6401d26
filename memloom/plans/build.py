"""Dialogue turns to a graph with a semantic hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators import edges as ed
from memloom.operators import folds as fo
from memloom.operators import hierarchy as hi
from memloom.operators import nodes as nd
from memloom.session import cut_lineage


def build_graph(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of a turn table."""
    nodes = cut_lineage(nd.extract_nodes(turns))
    return nodes, ed.build_edges(nodes)


def build_hierarchy(nodes: DataFrame, dim: int = 31) -> dict[str, DataFrame]:
    """Events, topics and episodes of the facts with their edges. Fold results are kept as checkpoints."""
    facts = nodes.filter("type = 'FACT'")
    views = nd.fact_views(facts, nd.known_speakers(nodes)).join(nd.hash_embedding(facts, ["node_id"], dim), "node_id")
    number = lambda kind, c: F.concat(F.col("conv_id"), F.lit(f":{kind}:"), nd.pad_number(F.col(c)))
    events = cut_lineage(fo.cluster_events(views)).select("conv_id", "node_id", number("event", "event_no").alias("cluster_id"))
    members = views.join(events, ["conv_id", "node_id"]).select(
        "conv_id", "cluster_id", F.col("node_id").alias("member_id"), "text", "vector", "terms", "entities", "session", F.array("session").alias("sessions"), F.col("support_ids").alias("supports"), "pos")
    event_views = cut_lineage(hi.cluster_view(members, dim).withColumnRenamed("cluster_id", "event_id"))
    topics = cut_lineage(fo.cluster_topics(event_views)).withColumn("topic_id", number("topic", "topic_no"))
    episodes = cut_lineage(fo.cluster_episodes(event_views.join(topics.select("conv_id", "event_id", "topic_id"), ["conv_id", "event_id"])))
    episodes = episodes.withColumn("episode_id", F.concat("topic_id", F.lit(":episode:"), nd.pad_number(F.col("episode_no"))))
    rows = hi.cluster_rows(members, dim, "event")
    return {"events": rows, "fact_event": hi.membership_edges(members, rows, "fact_event"), "topics": topics, "episodes": episodes}
