import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import kernel_quality as kernel

DOCS = "doc_id long, text string, stats string, score string, good int, quality int, __id int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", 1, 2, 3) for i, t in rows], DOCS)


def corpus(rng, n):
    """Prose, and three kinds of junk: shouted, symbol-laden and one line over and over."""
    words = [f"{a}{b}{c}" for a in ("ta", "re", "mo", "li") for b in ("n", "st", "r", "lo") for c in ("a", "en", "is", "ion")]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(20, 300))).capitalize() + "."
        kind = rng.randrange(10)
        if kind == 0:
            text = text.upper().replace(" ", "!! ")
        elif kind == 1:
            text = " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in text.split())
        elif kind == 2:
            text = "\n".join([text[:60]] * 12)
        rows.append((i, text))
        labels.append((i, int(kind > 2)))
    return rows, labels


def test_held_out_accuracy_and_edge_rows(spark):
    rows, labels = corpus(random.Random(1), 1500)
    edge = [(5000, None), (5001, ""), (5002, " \n "), (5003, "word"), (5004, "word " * 200_000), (None, rows[0][1]), rows[1], rows[1]]
    known = spark.createDataFrame([*labels, (7, None), (None, 1), (labels[3][0], 0), (9999, 1)], "doc_id long, quality int")
    scored = kernel.score_quality(docs_of(spark, rows + edge), known).collect()
    assert len(scored) == len(rows) + len(edge) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored)
    truth = dict(labels)
    held = [r for r in scored if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held) and len(held) > 200
    good, bad = ([r["score"] for r in held if truth[r["doc_id"]] == x] for x in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.99
    by = {}
    for r in scored:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert all(len(s) == 1 for s in by.values()) and by[5000] == by[5001] and by[None] == by[0]
    again = {(r["doc_id"], r["score"]) for r in kernel.score_quality(docs_of(spark, rows + edge).repartition(7), known.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in scored}


def test_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert kernel.score_quality(docs_of(spark, []), none).count() == 0
    assert {r["score"] for r in kernel.score_quality(docs_of(spark, [(1, "a"), (2, None)]), none).collect()} == {0.5}
    all_good = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r["score"] for r in kernel.score_quality(docs_of(spark, [(1, "a"), (2, None)]), all_good).collect()} == {0.75}


def test_sums_and_weights_equal_numpy(spark):
    rng = np.random.default_rng(2)
    settings = kernel.Settings(features=20, folds=3)
    stats = np.rint(rng.normal(size=(300, len(kernel.STATISTICS))) * kernel.STEPS).astype(int)
    good, fold = (stats[:, 0] * stats[:, 1] > 0).astype(int), rng.integers(0, 3, 300)
    features = kernel.FourierMap(np.zeros(len(kernel.STATISTICS)), np.ones(len(kernel.STATISTICS)), settings)
    labelled = spark.createDataFrame([(list(map(int, s)), int(g), int(f)) for s, g, f in zip(stats, good, fold)], "stats array<int>, good int, fold int").repartition(5)
    sums = kernel.normal_sums(labelled, features, settings)
    x = features(stats / kernel.STEPS)
    for f in range(3):
        rows = np.concatenate([x, good[:, None]], 1)[fold == f]
        assert (sums[f] == rows.T @ rows).all()
    z = x / kernel.STEPS
    penalty = np.diag([settings.ridge * 300] * 20 + [1e-9])
    wanted = np.linalg.solve(z.T @ z + penalty, z.T @ good)
    assert kernel.ridge_weights(sums.sum(0), settings.ridge) * kernel.STEPS == pytest.approx(wanted, rel=1e-5, abs=1e-7)


def test_features_approach_the_gaussian_kernel():
    rng = np.random.default_rng(3)
    width = len(kernel.STATISTICS)
    features = kernel.FourierMap(np.zeros(width), np.ones(width), kernel.Settings(features=8192))
    a, b = rng.normal(size=(40, width)), rng.normal(size=(40, width))
    found = (features(a)[:, :-1] * features(b)[:, :-1]).sum(1) / kernel.STEPS**2 * 2 / 8192
    assert np.abs(found - np.exp(-((a - b) ** 2).sum(1) / (2 * width))).max() < 0.05


def test_isotonic_fit_equals_the_max_min_formula():
    rng = np.random.default_rng(4)
    n = rng.integers(1, 5, 30)
    good = rng.binomial(n, np.linspace(0.2, 0.9, 30))
    x, share = kernel.pooled(np.arange(30.0), good, n, 0.0)
    direct = [max(min(good[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, 30)) for i in range(k + 1)) for k in range(30)]
    sizes = [n[np.isclose(direct, d)].sum() for d in dict.fromkeys(direct)]
    assert share == pytest.approx(np.maximum.accumulate([d * s / (s + 1.0) for d, s in zip(dict.fromkeys(direct), sizes)])) and (np.diff(x) > 0).all()


def test_statistics_of_a_text():
    found = dict(zip(kernel.STATISTICS, kernel.text_statistics("AB cd\nAB cd\n12 !!\n")))
    assert found["upper_share"] == 4 / 18 and found["lower_share"] == 4 / 18 and found["digit_share"] == 2 / 18 and found["line_end_share"] == pytest.approx((3 / 18) ** 0.5)
    assert found["distinct_words"] == 4 / 6 and found["top_word_share"] == 2 / 6 and found["repeated_lines"] == pytest.approx(1 / 3) and found["upper_words"] == 2 / 6
    assert kernel.text_statistics(None) == kernel.text_statistics("")
    assert len(kernel.text_statistics("\ud800 x")) == len(kernel.STATISTICS)
