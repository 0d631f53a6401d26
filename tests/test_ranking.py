import random

from pyspark.sql import functions as F

from memloom.operators import cards as ca

ROWS = "question_id long, node_id long, conv_id string, label int, near double, noise double"


def planted(spark, questions=60, size=12):
    """Relevant rows exceed the others of their question in ``near``, whose level is the question's own and says nothing."""
    rng = random.Random(1)
    rows = []
    for q in range(questions):
        level = rng.uniform(-50, 50)
        for n in range(size):
            relevant = n < 3
            rows.append((q, q * 100 + n, f"c{q % 3}", int(relevant), level + relevant + rng.uniform(0, 0.9), rng.uniform(-1, 1)))
    return spark.createDataFrame(rows, ROWS)


def pair_accuracy(scores):
    a, b = scores.filter("label = 1").alias("a"), scores.filter("label = 0").alias("b")
    met = a.join(b, "question_id")
    return met.agg(F.avg((F.col("a.s") > F.col("b.s")).cast("double"))).first()[0]


def test_pairs_stay_in_the_question_and_are_bounded(spark):
    rows = planted(spark)
    assert ca.ranking_pairs(rows, ["near", "noise"], partners=4).count() == 60 * 3 * 4
    assert ca.ranking_pairs(rows.filter("label = 1"), ["near"]).count() == 0


def test_pairwise_ranking_beats_pointwise_regression(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = planted(spark).cache()
    scored, importance = ca.cross_validate(rows, ["c0", "c1", "c2"], ["near", "noise"])
    assert scored.count() == rows.count()
    ranked = pair_accuracy(scored.join(rows.select("node_id", "label"), "node_id").withColumn("s", F.col("model_score")))
    assembled = VectorAssembler(inputCols=["near", "noise"], outputCol="features").transform(rows.withColumn("label", F.col("label").cast("double")))
    pointwise = LinearRegression().fit(assembled.filter("conv_id != 'c0'")).transform(assembled.filter("conv_id = 'c0'"))
    assert ranked > 0.99 and ranked >= pair_accuracy(pointwise.withColumn("s", F.round("prediction", 9)))
    weights = {r["feature"]: r["importance"] for r in importance.collect()}
    assert weights["near"] > weights["noise"]


def crossed(spark, questions=80, size=12):
    """Relevant rows have two signs alike: neither sign says anything alone, so no linear score ranks them."""
    rng = random.Random(2)
    rows = []
    for q in range(questions):
        for n in range(size):
            relevant = n < 2
            left = rng.choice([0, 1])
            right = left if relevant else 1 - left
            rows.append((q, q * 100 + n, f"c{q % 4}", int(relevant), left + rng.uniform(0, 0.4), right + rng.uniform(0, 0.4), rng.random(), q % 4 % 2))
    return spark.createDataFrame(rows, "question_id long, node_id long, conv_id string, label int, left double, right double, noise double, fold int")


def test_boosted_trees_rank_what_no_linear_score_can(spark):
    rows = crossed(spark).cache()
    names = ["left", "right", "noise"]
    scored, importance = ca.cross_validate_boosted(rows, [0, 1], names, rounds=4)
    assert scored.count() == rows.count()
    quality = lambda s: ca.ndcg(s.select("question_id", "node_id", "model_score").join(rows.select("node_id", "label"), "node_id")).agg(F.avg("ndcg")).first()[0]
    linear = ca.cross_validate(rows, [0, 1], names, "fold")[0]
    assert quality(scored) > 0.95 > quality(linear) + 0.1
    shares = {r["feature"]: r["importance"] for r in importance.collect()}
    assert shares["noise"] < min(shares["left"], shares["right"])


def test_listwise_steps_equal_the_softmax_gradient(spark):
    import math

    rows = [(1, 1, 0.3), (1, 0, -0.2), (1, 0, 1.0), (2, 0, 0.0), (2, 0, 5.0)]
    got = ca.listwise_targets(spark.createDataFrame(rows, "question_id int, label int, score double")).collect()
    mass = sum(math.exp(s) for q, _, s in rows if q == 1)
    assert len(got) == 3
    for r in got:
        p = math.exp(r.score) / mass
        assert abs(r.target * r.weight - (r.label - p)) < 1e-9 and abs(r.weight - p * (1 - p) - 1e-3) < 1e-9


def test_ndcg_of_a_known_order(spark):
    import math

    rows = [(1, 1, 1, 0.9), (1, 2, 0, 0.8), (1, 3, 1, 0.7), (2, 4, 0, 0.1)]
    got = ca.ndcg(spark.createDataFrame(rows, "question_id int, node_id int, label int, model_score double")).collect()
    assert len(got) == 1 and abs(got[0].ndcg - (1 + 0.5) / (1 + 1 / math.log2(3))) < 1e-9


def test_candidates_equal_to_nine_digits_keep_node_order(spark):
    rows = spark.createDataFrame([("q", "a", 0.3), ("q", "b", 0.1 + 0.2), ("q", "c", 0.9)], "question_id string, node_id string, ce double")
    fields = "question_id string, card_no int, card_type string, role string, role_no int, role_confidence double, role_count long, node_id string, entity string, aspect string, confidence double, size long, is_needed boolean"
    got = ca.annotate_candidates(rows, spark.createDataFrame([], fields)).orderBy("position").collect()
    assert [r.node_id for r in got] == ["c", "a", "b"]
