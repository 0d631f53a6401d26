"""Percentiles by narrowing ranges against sorted lists."""

import math
import random

import pytest

from memloom.operators import metrics as me


@pytest.mark.parametrize("ranges", [2, 16, 256])
def test_percentiles_equal_sorted_lists(spark, ranges):
    rng = random.Random(ranges)
    rows = [("hot", rng.choice([rng.gauss(0, 5), float(rng.randrange(4))])) for _ in range(3000)] + [("few", float(i % 3)) for i in range(7)] + [("one", 2.5), ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "kind string, v double")
    lists = {}
    for k, v in rows:
        if v is not None:
            lists.setdefault(k, []).append(v)
    for rule, place in (("round", lambda n, q: round((n - 1) * q)), ("trunc", lambda n, q: int((n - 1) * q)), ("ceil", lambda n, q: max(0, math.ceil(n * q) - 1))):
        for q in (0.0, 0.5, 0.95, 1.0):
            got = {r.kind: r.percentile for r in me.percentile_rank(df, ["kind"], "v", q, rule, ranges).collect()}
            assert got == {k: sorted(v)[place(len(v), q)] for k, v in lists.items()}, (rule, q)
    every = sorted(v for _, v in rows if v is not None)
    assert me.percentile_rank(df, [], "v", 0.9, "trunc", ranges).first()[0] == every[int((len(every) - 1) * 0.9)]
