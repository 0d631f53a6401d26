"""Mixture-controlled packing: deficit round-robin over source queues fills every window to the target proportions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm.shared import stored
from memloom.llm.tokens import VOCABULARY, document_encoder

SEQUENCE = 1024
END = 0


def served(windows: np.ndarray, lengths: np.ndarray, sequence: int) -> np.ndarray:
    """Tokens that each source queue has given before each of ``windows`` (rows: windows, columns: sources).

    The j-th token of a queue of n falls due at (j + 1/2) / n of the whole; tokens are served in the order in which they fall
    due, ties to the earlier queue, ``sequence`` to a window. That is deficit round-robin with the deficits carried on: after
    any number of windows every queue is within one round of its share. A row depends on its window alone, so any task can
    compute it.
    """
    total = int(lengths.sum())
    goal = np.minimum(windows.astype(np.int64) * sequence, total)
    share = lengths.astype(np.longdouble)
    given = np.clip(np.ceil(share[None, :] * (goal.astype(np.longdouble) / total)[:, None] - np.longdouble(0.5)), 0, share[None, :]).astype(np.int64)
    due = lambda count: np.where(count < lengths[None, :], (count + np.longdouble(0.5)) / share[None, :], np.longdouble(2))
    last = lambda count: np.where(count > 0, (count - np.longdouble(0.5)) / share[None, :], np.longdouble(-1))
    rows = np.arange(len(windows))
    while True:
        short = goal - given.sum(1)
        more, less = np.flatnonzero(short > 0), np.flatnonzero(short < 0)
        if not len(more) and not len(less):
            return given
        if len(more):
            given[rows[more], np.argmin(due(given[more]), 1)] += 1
        if len(less):
            given[rows[less], len(lengths) - 1 - np.argmax(last(given[less])[:, ::-1], 1)] -= 1


def window_of(tokens: np.ndarray, source: np.ndarray, lengths: np.ndarray, sequence: int) -> np.ndarray:
    """The window in which the given token of the given queue is served."""
    total = int(lengths.sum())
    guess = np.floor((tokens + 0.5) / lengths[source] * total / sequence).astype(np.int64)
    found = np.maximum(guess, 0)
    while True:
        before = served(found, lengths, sequence)[np.arange(len(found)), source]
        after = served(found + 1, lengths, sequence)[np.arange(len(found)), source]
        early, late = tokens < before, tokens >= after
        if not early.any() and not late.any():
            return found
        found = found - early + late


def tokenized(docs: DataFrame, id_column: str, text_column: str, source_column: str, vocabulary: str) -> DataFrame:
    """Stored rows ``doc_id, source, part, offset, n, ids``: 16-bit ids, and the tokens of the same source before it in its part."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, given, ids_of = TaskContext.get().partitionId(), {}, document_encoder(vocabulary)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                piece = batch.slice(low, 512)
                offsets, counts, ids = [], [], []
                for text, source in zip(piece["text"].to_pylist(), piece["source"].to_pylist()):
                    found = ids_of(text or "")
                    offsets.append(given.get(source, 0))
                    counts.append(len(found) + 1)
                    given[source] = offsets[-1] + counts[-1]
                    ids.append(found.astype("<u2").tobytes() + b"\0\0")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece["doc_id"], "source": piece["source"], "part": pa.array([part] * piece.num_rows, pa.int32()),
                    "offset": pa.array(offsets, pa.int64()), "n": pa.array(counts, pa.int64()), "ids": pa.array(ids, pa.binary()),
                })
        ids_of.forget()

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.col(text_column).alias("text"))
    return stored(picked.mapInArrow(encode, "doc_id long, source string, part int, offset long, n long, ids binary"), "pack-tokens")


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", sequence: int = SEQUENCE, vocabulary: str = VOCABULARY, max_sources: int = 4096) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every document is its ids and an end id, in the queue of its source; a queue is in the order of the stored parts. All
    queues are packed, so a source's target share is its share of all tokens, and every sequence but the last is full.
    Only totals per part and source leave a task; where a piece goes follows from its place in its queue.

    Null and empty texts are the end id alone. A null source is a queue of its own, after the others. Equal rows are packed
    each. An empty table gives no rows. More than ``max_sources`` queues are refused: a sequence could not hold a token of each.
    """
    spark = docs.sparkSession
    rows = tokenized(docs, id_column, text_column, source_column, vocabulary)
    totals = stored(rows.groupBy("part", "source").agg(F.sum("n").alias("tokens")), "pack-parts")
    queues = totals.groupBy("source").agg(F.sum("tokens").alias("tokens")).sort(F.col("source").asc_nulls_last()).limit(max_sources + 1).collect()
    if len(queues) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    lengths = spark.sparkContext.broadcast(np.array([q["tokens"] for q in queues], np.int64))
    numbered = spark.createDataFrame([(q["source"], i) for i, q in enumerate(queues)], "__source string, queue int")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("base", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).join(F.broadcast(numbered), F.col("source").eqNullSafe(F.col("__source")))
    # Written down, so that its size is known before the ids would be shuffled to meet it.
    bases = stored(bases.select(F.col("part").alias("__part"), F.col("source").alias("__of"), "base", "queue"), "pack-bases")
    placed = rows.join(bases, (F.col("part") == F.col("__part")) & F.col("source").eqNullSafe(F.col("__of"))).select("doc_id", "queue", (F.col("base") + F.col("offset")).alias("place"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lengths.value
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                yield from cut_rows(batch.slice(low, 512), of, sequence)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def cut_rows(batch: pa.RecordBatch, lengths: np.ndarray, sequence: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents of one batch, at the borders of the windows in which their tokens are served."""
    if not batch.num_rows:
        return
    queue, place, n = (batch[c].to_numpy().astype(np.int64) for c in ("queue", "place", "n"))
    first, last = window_of(place, queue, lengths, sequence), window_of(place + n - 1, queue, lengths, sequence)
    spans = last - first + 1
    begin = 0
    while begin < len(spans):
        stop = max(begin + 1, int(np.searchsorted(np.cumsum(spans[begin:]), 200_000, "right")) + begin)
        span = spans[begin:stop]
        row = np.repeat(np.arange(begin, stop), span)
        window = np.arange(len(row)) - np.repeat(np.cumsum(span) - span, span) + first[row]
        distinct, at = np.unique(window, return_inverse=True)
        before, after = served(distinct, lengths, sequence), served(distinct + 1, lengths, sequence)
        ahead = np.cumsum(after - before, 1) - (after - before)
        low = np.maximum(place[row], before[at, queue[row]])
        high = np.minimum(place[row] + n[row], after[at, queue[row]])
        keep = high > low
        row, at, low, high, window = row[keep], at[keep], low[keep], high[keep], window[keep]
        offset = ahead[at, queue[row]] + low - before[at, queue[row]]
        start, length = low - place[row], high - low
        sums, of, wide = [], -1, b""
        ids = batch["ids"]
        for r, s, k in zip(row.tolist(), start.tolist(), length.tolist()):
            if r != of:
                of, wide = r, np.frombuffer(ids[r].as_py(), "<u2").astype("<u4").tobytes()
            sums.append(zlib.crc32(wide[4 * s : 4 * (s + k)]))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch["doc_id"].take(pa.array(row)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(sums, pa.int64()),
            "doc_tokens": pa.array(n[row]), "sequence_id": pa.array(window), "offset": pa.array(offset),
        })
        begin = stop
