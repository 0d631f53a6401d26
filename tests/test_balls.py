"""Branch and bound over balls against scores of every item, and how few items it scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import vectors as vx
from memloom.operators import balls as ba


def clustered(spark, metric, convs=2, balls=30, size=20, dim=6):
    rng = np.random.default_rng(4)
    rows, asked = [], []
    for c in range(convs):
        for b in range(balls):
            centre = rng.normal(size=dim) * 2
            rows += [(f"c{c}", f"{c}-{b:02d}-{i:02d}", None if b == 0 else f"b{b}", (centre + rng.normal(size=dim) * 0.1).tolist()) for i in range(size)]
        asked += [(f"q{c}{n}", f"c{c}", (rng.normal(size=dim) * 2).tolist()) for n in range(6)]
    rows.append(("c0", "copy", "b3", rows[-1][3]))
    items = spark.createDataFrame(rows, "conv_id string, item_id string, ball string, vector array<double>")
    queries = spark.createDataFrame(asked, "question_id string, conv_id string, query_vector array<double>")
    if metric == "lorentz":
        items, queries = items.withColumn("vector", vx.exp_map(vx.scale(F.col("vector"), F.lit(0.4)))), queries.withColumn("query_vector", vx.exp_map(vx.scale(F.col("query_vector"), F.lit(0.4))))
    return queries, items


@pytest.mark.parametrize("name", ["euclidean", "lorentz"])
def test_best_items_equal_those_of_all_scores(spark, name):
    metric = ba.EUCLIDEAN if name == "euclidean" else ba.lorentz()
    queries, items = clustered(spark, name)
    every = items.collect()
    want = {}
    for q in queries.collect():
        score = lambda v: float(np.dot(q.query_vector, v)) if name == "euclidean" else -math.acosh(max(q.query_vector[0] * v[0] - float(np.dot(q.query_vector[1:], v[1:])), 1 + 1e-7))  # noqa: E731,B023
        ranked = sorted(((-round(score(i.vector), 9), i.item_id) for i in every if i.conv_id == q.conv_id))[:15]
        want[q.question_id] = [i for _, i in ranked]
    got = {}
    for r in ba.ball_top_k(queries, items, metric, 15).orderBy("rank").collect():
        got.setdefault(r.question_id, []).append(r.item_id)
    assert got == want
    opened = ba.opened_pairs(queries, items, metric, 15).count()
    assert opened < (0.35 if name == "euclidean" else 0.5) * queries.count() * len(every) / 2


def test_fewer_items_than_asked_and_none(spark):
    queries, items = clustered(spark, "euclidean", 1, 2, 3)
    assert ba.ball_top_k(queries, items, ba.EUCLIDEAN, 50).count() == 6 * 7
    assert ba.ball_top_k(queries, items.limit(0), ba.EUCLIDEAN, 5).count() == 0
