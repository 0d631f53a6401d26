"""Questions to ranked evidence over a built graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.operators import expansion as ex
from memloom.operators import retrieval as re_


def seeds(questions: DataFrame, nodes: DataFrame, top: int = 20, wide: int = 300) -> tuple[DataFrame, DataFrame]:
    """Seed facts and normalised text scores. ``questions``: (question_id, conv_id, question)."""
    facts = nodes.filter("type = 'FACT'")
    hits = re_.normalize_scores(re_.bm25_top_k(questions, facts, wide, "question_id", "node_id", "conv_id", query_text="question"))
    return hits.filter(F.col("rank") <= top), hits


def seeded_retrieval(questions: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 5, hops: int = 1, pool: int = 100) -> DataFrame:
    """Seeds, their neighbours and siblings, scored and diversified."""
    first, hits = seeds(questions, nodes)
    near = ex.one_hop(first, edges, nodes)
    far = ex.siblings(first, ex.anchor_links(edges, nodes), 8)
    scored = ex.seeded_candidates(first, near, far if hops >= 2 else far.limit(0), hits, nodes)
    best = ex.top_per(scored, ["question_id"], [F.desc(F.round("score", 9)), F.asc("node_id")], pool)
    return re_.mmr_select(best.withColumn("terms", tx.term_set("text")), top)
