"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm.shared import stored

LOWEST = -(2**63)
HIGHEST = 2**63 - 1


def splitters(keyed: DataFrame, ranges: int, sample: int, total: int) -> list[tuple[int, int]]:
    """At most ``ranges - 1`` boundaries (k1, k2) at the quantiles of a size-weighted sample of about ``sample`` keys.

    A row is drawn as often as its size asks for, the remainder of a draw by a hash of its own, so reruns draw the same.
    A boundary inside a run of equal ``k1`` moves to the start of that run, unless the run spans several boundaries: such
    an overfull run is subdivided by ``k2``. What reaches the driver is one row per boundary.
    """
    wanted = F.col("size") * F.lit(sample / max(total, 1))
    lucky = F.pmod(F.xxhash64("k2", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = keyed.select("k1", "k2", F.floor(wanted + lucky).alias("draws")).where("draws > 0")
    up_to = Window.orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quantiles = drawn.withColumn("upto", F.sum("draws").over(up_to))
    step = sample / ranges
    cut = F.floor(F.col("upto") / F.lit(step))
    earlier = F.floor((F.col("upto") - F.col("draws")) / F.lit(step))
    cuts = [(row["k1"], row["k2"]) for row in quantiles.where((cut > earlier) & (cut < ranges)).select("k1", "k2").sort("k1", "k2").collect()]
    runs: dict[int, int] = {}
    for k1, _ in cuts:
        runs[k1] = runs.get(k1, 0) + 1
    bounds = {(k1, LOWEST) for k1 in runs} | {(k1, k2) for k1, k2 in cuts if runs[k1] > 1}
    return sorted(bounds)


def range_of(k1: Column, k2: Column, bounds: list[tuple[int, int]]) -> Column:
    """The number of boundaries at or below the key, by binary search over two constant arrays."""
    bits = max(1, len(bounds).bit_length())
    padded = bounds + [(HIGHEST, HIGHEST)] * ((1 << bits) - 1 - len(bounds))
    first, second = F.lit([b[0] for b in padded]), F.lit([b[1] for b in padded])

    def step(low: Column, jump: Column) -> Column:
        at = low + jump - 1
        reached = (F.get(first, at) < k1) | ((F.get(first, at) == k1) & (F.get(second, at) <= k2))
        return F.when(reached, low + jump).otherwise(low)

    return F.aggregate(F.lit([1 << i for i in reversed(range(bits))]), F.lit(0), step)


def shard_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = 16, ranges: int = 1024, sample: int = 16384, whole_group: float = 1 / 64) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; shards have near equal bytes.

    Keys are hashes of (text, id), so equal texts are neighbours. Records are dealt into ranges by sampled splitters; a
    range's exact bytes and one running sum inside it give each record its place in the byte order, and a shard takes an
    equal stretch of that order. Groups of equal texts up to ``whole_group`` of a shard stay together; larger ones are
    subdivided by id. No window is wider than a range, and only range totals meet in one task.

    Null text: size 1, the checksum of an empty text, and a key of its own, away from empty texts. Null ids and repeated
    rows keep one output row each. An empty table gives no rows. Extra input columns are ignored.
    """
    text = F.col(text_column)
    keyed = docs.select(
        F.col(id_column).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.col(id_column), F.lit("id")).alias("k2"),
    )
    keyed = stored(keyed, "shard-keys")
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    bounds = splitters(keyed, ranges, sample, total)
    ranged = keyed.withColumn("range", range_of(F.col("k1"), F.col("k2"), bounds))

    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = sums.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("range_start"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))

    inside = Window.partitionBy("range").orderBy("k1", "k2", "doc_id")
    group = Window.partitionBy("range", "k1")
    placed = (
        ranged.withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
        .withColumn("rank", F.row_number().over(inside))
        .withColumn("group_size", F.sum("size").over(group))
        .withColumn("group_start", F.min("run").over(group))
        .join(starts, "range")
    )
    together = F.col("group_size") <= F.lit(int(total * whole_group / shards))
    start = F.col("range_start") + F.when(together, F.col("group_start")).otherwise(F.col("run"))
    extent = F.when(together, F.col("group_size")).otherwise(F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor((2 * start + extent) * F.lit(shards) / F.lit(2 * max(total, 1)))).cast("int")
    placed = stored(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("rank") - 1).alias("place")), "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first_place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
