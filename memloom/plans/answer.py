"""Dialogue and questions to evidence packs: graph, seeds, expansion, diversified selection, units, budget and answerability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators import packs as pk
from memloom.plans.build import build_graph
from memloom.plans.retrieve import seeded_retrieval
from memloom.session import cut_lineage


def evidence_packs(turns: DataFrame, questions: DataFrame, top: int = 20, hops: int = 2, budget: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The pack of every question, and the units it is made of.

    ``turns`` as the dialogue sources give them; ``questions``: (question_id, conv_id, question). Questions are rows, so any number
    of them is one run. A question whose conversation holds no evidence has a pack without units that says UNSUPPORTED.
    """
    nodes, edges = build_graph(turns)
    chosen = cut_lineage(seeded_retrieval(questions, nodes, cut_lineage(edges), top, hops))
    ranked = chosen.join(questions.select("question_id", "conv_id"), "question_id").select(
        "question_id", "conv_id", "node_id", F.col("mmr_rank").alias("rank"), F.lit("bottom_up").alias("route_source"), F.col("score").alias("ce"), F.lit(None).cast("string").alias("role"))
    contracts = pk.query_contract(questions)
    covered = pk.slot_coverage(pk.evidence_units(ranked, nodes, top), contracts)
    selected = cut_lineage(pk.select_within_budget(covered, budget))
    return pk.assemble_packs(selected, contracts), selected
