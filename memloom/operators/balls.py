"""Exact best items by branch and bound: items lie in balls, and a ball that cannot reach the k-th score is never opened."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import vectors as vx
from memloom.operators.ordering import top_per


@dataclass(frozen=True)
class Metric:
    """``score(query, item)``; ``reach(item, item)``, a distance; and ``bound(query, centre, radius)``, no less than the score of any
    item within ``radius`` of ``centre``, up to ``slack``."""

    score: Callable[[Column, Column], Column]
    reach: Callable[[Column, Column], Column]
    bound: Callable[[Column, Column, Column], Column]
    slack: float


def _apart(a: Column, b: Column) -> Column:
    return vx.norm(F.zip_with(a, b, lambda x, y: x - y))


#: Dot product: a query's product with an item differs from that with the centre by no more than its length times the radius.
EUCLIDEAN = Metric(vx.dot, _apart, lambda q, c, r: vx.dot(q, c) + vx.norm(q) * r, 1e-6)


def lorentz(curvature: float = 1.0) -> Metric:
    """Negative hyperbolic distance, by the triangle inequality; distances near 0 are rounded up, which the slack covers."""
    distance = lambda a, b: vx.lorentz_distance(a, b, curvature)
    return Metric(lambda q, v: -distance(q, v), distance, lambda q, c, r: r - distance(q, c), 2e-3 / math.sqrt(curvature))


def ball_summaries(items: DataFrame, scope: Sequence[str], metric: Metric) -> DataFrame:
    """``scope, ball, centre, radius, size`` of each ball; its centre is the vector of its least item."""
    keys = [*scope, "ball"]
    centres = items.groupBy(*keys).agg(F.min_by("vector", "item_id").alias("centre"), F.count(F.lit(1)).alias("size"))
    reached = items.join(centres, keys).withColumn("reach", metric.reach(F.col("centre"), F.col("vector")))
    return reached.groupBy(*keys).agg(F.first("centre").alias("centre"), F.max("reach").alias("radius"), F.first("size").alias("size"))


def opened_pairs(queries: DataFrame, items: DataFrame, metric: Metric, k: int, scope: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Scored rows ``question_id, scope, item_id, ball, score`` of all balls that can hold one of a question's ``k`` best items.

    A question first opens its balls of highest bound until they hold ``k`` items; their ``k``-th score then closes every
    other ball whose bound is lower. ``queries``: (question_id, scope, query_vector); ``items``: (scope, item_id, ball, vector).
    """
    scope = list(scope)
    items = items.withColumn("ball", F.coalesce(F.col("ball").cast("string"), F.lit("")))
    balls = ball_summaries(items, scope, metric)
    bounds = queries.join(balls, scope).select(
        "question_id", *scope, "ball", "query_vector", "size", metric.bound(F.col("query_vector"), F.col("centre"), F.col("radius")).alias("bound"))
    order = Window.partitionBy("question_id").orderBy(F.desc("bound"), F.asc("ball"))
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = bounds.withColumn("first", before < k)
    scored = lambda pairs: pairs.join(items.select(*scope, "ball", "item_id", "vector"), [*scope, "ball"]).select(
        "question_id", *scope, "item_id", "ball", metric.score(F.col("query_vector"), F.col("vector")).alias("score"))
    first = scored(bounds.filter("first"))
    worst = top_per(first, ["question_id"], [F.desc("score")], k, "place").filter(F.col("place") == k).select("question_id", F.col("score").alias("worst"))
    rest = bounds.filter("NOT first").join(worst, "question_id", "left").filter(F.col("worst").isNull() | (F.col("bound") >= F.col("worst") - metric.slack))
    return first.unionByName(scored(rest))


def ball_top_k(queries: DataFrame, items: DataFrame, metric: Metric, k: int, scope: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Best ``k`` items of each question inside its scope; scores that agree to nine digits are ordered by item."""
    return top_per(opened_pairs(queries, items, metric, k, scope), ["question_id"], [F.desc(F.round("score", 9)), F.asc("item_id")], k).select(
        "question_id", *scope, "item_id", "ball", "score", "rank")
