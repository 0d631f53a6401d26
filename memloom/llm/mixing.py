"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks per source and shard, then seeded selection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from memloom.llm.shared import hash_bucket, running_total, stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source, block or document is taken more often than this.
MOST = 3
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[Fraction]:
    """Shares of the total size by weight; none above ``most`` times its size, what is over going to the others by weight."""
    left, free = Fraction(sum(sizes)), set(range(len(sizes)))
    out = [Fraction(0)] * len(sizes)
    while free:
        weight = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        if not full:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        free -= full
    return out


def sainte_lague(shares: list[Fraction], seats: int, limits: list[int]) -> list[int]:
    """Seats by highest quotients ``share / (2 seats held + 1)``, ties to the earlier claimant; nobody above its limit.

    The quotients that win are those above a common divisor, so seats are filled up to just below the divisor at once and
    only the last few, about one per claimant, one at a time.
    """
    held = [0] * len(shares)
    seats = min(seats, sum(n for n, s in zip(limits, shares) if s > 0))
    claim = lambda divisor: [min(n, max(0, int(s / divisor + Fraction(1, 2)))) for s, n in zip(shares, limits)]
    if seats and any(shares):
        low, high = Fraction(0), 4 * max(shares)
        while high - low > high / 2**60:
            middle = (low + high) / 2
            middle = Fraction(middle).limit_denominator(10**24)
            if not low < middle < high:
                break
            if sum(claim(middle)) > seats:
                low = middle
            else:
                high = middle
            if sum(claim(high)) == seats:
                break
        held = claim(high)
    while sum(held) < seats:
        best = max((i for i in range(len(shares)) if held[i] < limits[i] and shares[i] > 0), key=lambda i: (shares[i] / (2 * held[i] + 1), -i))
        held[best] += 1
    return held


def spread_evenly(index: Column, count: Column, chosen: Column, offset: Column) -> Column:
    """1 for exactly ``chosen`` of the ``count`` places 0, 1, ..., evenly spread from a seeded offset below ``count``; else 0."""
    reach = lambda i: F.floor((i * chosen + offset) / F.when(count == 0, 1).otherwise(count))
    return (reach(index + 1) - reach(index)).cast("long")


def plan_blocks(sized: DataFrame, block: int, shards: int, max_sources: int) -> DataFrame:
    """One row per source and shard: ``source, source_size, target, shard, blocks, quota``.

    A source's words are cut into blocks of ``block`` words (the last may be shorter), dealt to the shards in turn. Sources
    get blocks by Sainte-Laguë on their targets, and each source's blocks are apportioned to its shards in the same way. One
    row per source comes to the driver; more than ``max_sources`` are refused.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).sort(F.col("source").asc_nulls_last()).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals.sort(key=lambda row: (row["source"] is None, (row["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [row["source_size"] for row in totals]
    wanted = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(totals))])
    blocks = [-(-size // block) for size in sizes]
    full = [w == MOST * s for w, s in zip(wanted, sizes)]
    seats = round(sum(w for w, f in zip(wanted, full) if not f) / block)
    quotas = sainte_lague([Fraction(0) if f else w for w, f in zip(wanted, full)], seats, [MOST * n for n in blocks])
    quotas = [MOST * n if f else q for n, f, q in zip(blocks, full, quotas)]
    rows = []
    for row, size, target, n, quota in zip(totals, sizes, wanted, blocks, quotas):
        per_shard = [n // shards + (k < n % shards) for k in range(shards)]
        shares = sainte_lague([Fraction(m) for m in per_shard], quota, [MOST * m for m in per_shard])
        rows += [(row["source"], size, float(target), k, per_shard[k], shares[k]) for k in range(shards)]
    return sized.sparkSession.createDataFrame(rows, "source string, source_size long, target double, shard int, blocks long, quota long")


def block_times(sized: DataFrame, block: int, shards: int, seed: int, max_sources: int, totals: DataFrame | None = None) -> DataFrame:
    """The rows of ``sized`` with ``source_size, target, start`` and ``times``: for each block that the document touches, how
    often it is taken, in order. ``totals``: the same rows with ``source`` and ``size`` alone, cheaper to sum."""
    plan = stored(plan_blocks(totals or sized, block, shards, max_sources), "mix-plan")
    per_source = plan.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.transform(F.array_sort(F.collect_list(F.struct("shard", "blocks", "quota"))), lambda p: F.struct(p["blocks"].alias("blocks"), p["quota"].alias("quota"))).alias("plan"),
    )
    per_source = stored(per_source.withColumnRenamed("source", "__source"), "mix-sources")
    bucketed = lambda df: df.withColumn("__hash", F.xxhash64(F.col("row"), F.col("doc_id"), F.lit(seed))).withColumn("__bucket", hash_bucket(F.col("__hash"), 10))
    lined = running_total(bucketed(sized), ["source"], "__bucket", ["__hash", "doc_id", "row"], "size", "start", bucketed(totals) if totals is not None else None)
    joined = lined.join(per_source, F.col("source").eqNullSafe(F.col("__source")))

    def taken(index: Column) -> Column:
        share = F.get(F.col("plan"), (index % shards).cast("int"))
        count, quota = share["blocks"], share["quota"]
        place = F.floor(index / shards)
        every = F.floor(quota / F.when(count == 0, 1).otherwise(count))
        offset = F.pmod(F.xxhash64(F.col("source"), (index % shards).cast("int"), F.lit(seed)), F.when(count == 0, 1).otherwise(count))
        return (every + spread_evenly(place, count, quota - every * count, offset)).cast("int")

    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    times = F.when(F.col("size") == 0, F.lit([]).cast("array<int>")).otherwise(F.transform(F.sequence(first, last), taken))
    return joined.select(*sized.columns, "source_size", "target", "start", times.alias("times"))


def words_in_block(start: Column, size: Column, index: Column, block: int) -> Column:
    """Words of a document that lie in the ``index``-th of the blocks it touches."""
    edge = (F.floor(start / block) + index) * block
    return F.least(start + size, edge + block) - F.greatest(start, edge)


def sizes_of(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), words.alias("size"), F.xxhash64(text_column).alias("row"))


def mix_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", block: int = 256, shards: int = 16, seed: int = 17, max_sources: int = 100_000) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per input row.

    A source's documents stand in a line by a seeded hash. Blocks of ``block`` words of that line are what the mix takes, 0 to
    3 times each; ``taken`` sums the words of the document in the taken blocks. A source ends within about one block a shard
    of its target, and exactly on it where the target is three times its size.

    Null texts have no words and are taken 0 times. A null source is a source of its own, after all others. Equal rows stand
    side by side in the line and may be taken differently, in a fixed multiset. An empty table gives no rows.
    """
    sized = stored(sizes_of(docs, id_column, text_column, source_column), "mix-sizes")
    timed = block_times(sized, block, shards, seed, max_sources)
    total = F.aggregate(
        F.transform("times", lambda t, i: t.cast("long") * words_in_block(F.col("start"), F.col("size"), i, block)), F.lit(0).cast("long"), lambda a, b: a + b,
    )
    return timed.select("doc_id", "size", "source_size", "target", total.alias("taken"))


def take_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", length_column: str | None = "n_chars", block: int = 256, shards: int = 16, seed: int = 17, max_sources: int = 100_000) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for every time a document is taken, with the words taken that time.

    The n-th row of a document holds its blocks that are taken at least n times, unbroken stretches with their white space and
    a line end between stretches; a document that is taken whole keeps its text as it is. ``length_column`` is set to the
    code points of the text. Documents without words are taken 0 times.
    """
    sized = sizes_of(docs, id_column, text_column, source_column)
    carried = docs.withColumns({"__doc_id": F.col(id_column).cast("long"), "__source": F.col(source_column).cast("string")}).select(
        F.col("__doc_id").alias("doc_id"), F.col("__source").alias("source"), F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text_column).alias("row"), F.struct(*[F.col(c) for c in docs.columns]).alias("original"),
    )
    plan_input = stored(sized, "mix-sizes")
    timed = block_times(carried, block, shards, seed, max_sources, plan_input).where(F.exists("times", lambda t: t > 0))
    copies = timed.select("original", "start", "size", "times", F.explode(F.sequence(F.lit(1), F.array_max("times"))).alias("copy"))
    marked = copies.select("original", "start", F.transform("times", lambda t: t >= F.col("copy")).alias("taken"), F.col(f"original.{text_column}").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_text(*row, block) for row in zip(batch["text"].to_pylist(), batch["start"].to_pylist(), batch["taken"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["original"], pa.array(texts, pa.string())], names=["original", "text"])

    original = marked.schema["original"].dataType
    out = marked.mapInArrow(cut, StructType([StructField("original", original), StructField("text", StringType())]))
    pick = {text_column: F.col("text")} | ({length_column: F.char_length("text").cast(docs.schema[length_column].dataType)} if length_column in docs.columns else {})
    return out.select(*[pick.get(c, F.col("original").getField(c)).alias(c) for c in docs.columns])


def cut_text(text: str, start: int, taken: list[bool], block: int) -> str:
    """The words of a document that begins at word ``start`` of its line which lie in the taken ones of its blocks."""
    if all(taken):
        return text
    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    pieces, first = [], start // block
    begin = None
    for i, take in enumerate([*taken, False]):
        if take and begin is None:
            begin = max(0, (first + i) * block - start)
        elif not take and begin is not None:
            end = min(len(words), (first + i) * block - start)
            pieces.append(text[words[begin][0] : words[end - 1][1]])
            begin = None
    return "\n".join(pieces)
