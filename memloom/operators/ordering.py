"""Order-related helpers that never push one hot key through a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65536


def dense_ordinal(
    df: DataFrame, keys: Sequence[str], pos: str, out: str = "ordinal", chunk: int = CHUNK
) -> DataFrame:
    """Zero-based gap-free ordinal of rows per key by a unique non-negative integer ``pos``.

    Rows are ranked inside ``(key, pos div chunk)``; only one count per chunk takes part in the running
    sum, so a key that holds a third of the data is still spread over many tasks.
    """
    keys = list(keys)
    local = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    whole = Window.partitionBy(*keys, "_chunk")
    ranked = (
        df.withColumn("_chunk", F.floor(F.col(pos) / F.lit(chunk)))
        .withColumn("_local", F.row_number().over(local))
        .withColumn("_size", F.count(F.lit(1)).over(whole))
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranked.filter(F.col("_local") == 1)
        .select(*keys, "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        ranked.join(offsets, [*keys, "_chunk"])
        .withColumn(out, (F.col("_offset") + F.col("_local") - 1).cast("bigint"))
        .drop("_chunk", "_local", "_size", "_offset")
    )


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence, carry: Sequence[str] | None = None) -> DataFrame:
    """The first row per key in a given order, as a map-side combinable aggregate (no per-key sort)."""
    keys = list(keys)
    carry = list(carry) if carry is not None else [c for c in df.columns if c not in keys]
    ordering = F.struct(*[o if not isinstance(o, str) else F.col(o) for o in order])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*carry), ordering).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in carry])


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key; the rank filter becomes a group limit on both sides of the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
