"""Scans by composed transition functions against direct loops, for any block size."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from memloom.catalog.hierarchy import cos_sql
from memloom.operators import folds as fo
from memloom.operators.scans import scan_states


@pytest.mark.parametrize("block", [2, 7, 512])
def test_scan_of_a_hot_key_equals_a_loop(spark, block):
    rng = random.Random(block)
    rows = [("hot", i, rng.choices([0, 1, 2], [8, 3, 1])[0]) for i in range(700)] + [(k, i, rng.choice([0, 1])) for k in "abc" for i in range(9)] + [(None, 0, 2), (None, 1, 0)]
    want, state = {}, {}
    for key, i, kind in rows:
        size, opened = state.get(key, (0, 0))
        cuts = size == 0 or kind == 2 or size >= 5 or (size >= 2 and kind == 1)
        state[key] = (1 if cuts else size + 1, opened + cuts)
        if key is not None:
            want[(key, i)] = state[key][1]
    df = spark.createDataFrame(rows, "key string, place long, kind int").repartition(5)
    got = {(r.key, r.place): r.opened for r in scan_states(df, ["key"], "place", "kind", 5, fo._cutter(5, 2), block=block).collect()}
    assert got == want


def test_tiny_segments_join_the_one_before(spark):
    rng = random.Random(2)
    sizes = [rng.choice([1, 1, 2, 3, 5]) for _ in range(300)]
    rows, want, current, topic = [], {}, 0, 0
    for seg, size in enumerate(sizes, 1):
        if current and size < 2 and current + size <= 5:
            current += size
        else:
            topic, current = topic + 1, size
        for _ in range(size):
            want[f"n{len(rows)}"] = topic
            rows.append(("c", f"n{len(rows)}", len(rows), len(rows), seg))
    cut = spark.createDataFrame(rows, "conv_id string, node_id string, pos long, ordinal long, seg_no long")
    assert {r.node_id: r.topic_no for r in fo.merge_tiny_segments(cut, 2, 5).collect()} == want


def test_no_task_holds_a_key(spark):
    """Rows meet only in blocks: no exchange is dealt by the key alone below the functions of blocks."""
    df = spark.range(10).select(F.lit("k").alias("key"), F.col("id").alias("place"), F.lit(0).alias("kind"))
    plan = scan_states(df, ["key"], "place", "kind", 5, fo._cutter(5, 2))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Python" not in plan and "_lower" in plan and "hashpartitioning(key#" not in plan.split("Scan ExistingRDD")[-1]


def test_cosines_at_a_threshold_fall_as_in_duckdb(spark):
    """Counts whose exact cosine is 0.1 or 0.18: the last bit decides the side, so all bits must agree."""
    rng, rows = random.Random(3), []
    while len(rows) < 400:
        a, b = ([rng.choice([0, 0, 1, -1, 2, -3]) for _ in range(31)] for _ in range(2))
        sizes = sum(x * x for x in a) * sum(x * x for x in b)
        if sizes and any((100 * sum(x * y for x, y in zip(a, b))) ** 2 == n * n * sizes for n in (10, 18, 20)):
            rows += [(f"c{len(rows)}", f"n{i}", i, [x / math.sqrt(sum(y * y for y in v)) for x in v], [], [], "s") for i, v in enumerate((a, b))]
    views = spark.createDataFrame(rows, "conv_id string, node_id string, pos long, vector array<double>, terms array<string>, entities array<string>, session string")
    got = {r.conv_id: r.cos for r in fo.segment_cues(views).filter("ordinal = 1").collect()}
    con = duckdb.connect()
    want = {a[0]: con.execute(f"SELECT {cos_sql('?::DOUBLE[]', '?::DOUBLE[]')}", [x[3] for x in (a, a, b, b, a, b, a, a, b, b)]).fetchone()[0] for a, b in zip(rows[::2], rows[1::2])}
    assert got == want
