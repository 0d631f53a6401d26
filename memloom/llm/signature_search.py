"""Ranked lexical search over bit-sliced Bloom signatures: bounds from slices, then exact scores of all documents not excluded."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm.shared import stored
from memloom.llm.shingles import mix

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Occurrences that have an entry of their own in a document's signature: an entry for each of these that a term reaches.
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024], np.int64)
#: Places of an entry, and bits of a signature per entry at least.
PLACES, BITS = 4, 8
#: Documents of a block at most, and bits of its slices.
DOCUMENTS, BLOCK_BITS = 512, 1 << 23
#: Best bounds of an item that are scored first; the k-th score among them excludes other documents.
FIRST = 48
#: Items, and their distinct terms, searched at once.
ITEMS, ITEM_TERMS = 1_000, 200_000
#: Terms of items times documents whose parts are summed at once.
CELLS = 1 << 22
#: Pairs of item and document up to which the candidates are sent to the documents; more are joined by shuffling both.
SENT = 200_000


def terms_of(text: str | None) -> list[bytes]:
    """Maximal stretches of ASCII letters, digits and all characters beyond ASCII, with A to Z in lower case."""
    return TERM.findall((text or "").encode("utf-8").lower())


def hash_terms(terms: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64, len(terms))


def places(hashes: np.ndarray, level: np.ndarray | int, width: int) -> np.ndarray:
    """``PLACES`` bit numbers below ``width``, a power of two, of each entry (term, level)."""
    salted = mix(hashes ^ (np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    first, step = salted & np.uint64(0xFFFFFFFF), (salted >> np.uint64(32)) | np.uint64(1)
    return ((first[..., None] + np.arange(PLACES, dtype=np.uint64) * step[..., None]) & np.uint64(width - 1)).astype(np.int64)


def width_of(entries: int) -> int:
    return 1 << max(6, math.ceil(math.log2(BITS * max(1, entries))))


class Block:
    """Signatures of up to ``room`` documents, a row of bits per place of the signature and a column per document."""

    def __init__(self, width: int) -> None:
        self.width, self.room = width, max(8, min(DOCUMENTS, BLOCK_BITS // width))
        self.slices = np.zeros((width, self.room // 8), np.uint8)
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.most: list[int] = []

    def add(self, doc_id: int | None, size: int, most: int, bits: np.ndarray) -> None:
        at = len(self.ids)
        self.slices[bits, at >> 3] |= np.uint8(1 << (at & 7))
        self.ids.append(doc_id)
        self.sizes.append(size)
        self.most.append(most)

    def row(self) -> dict:
        used = -(-len(self.ids) // 8)
        return {"width": self.width, "ids": self.ids, "sizes": self.sizes, "most": self.most, "slices": np.ascontiguousarray(self.slices[:, :used]).tobytes()}


_BLOCK = pa.schema([("width", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("most", pa.list_(pa.int64())), ("slices", pa.binary())])


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks of documents of like numbers of entries, as ``width, ids, sizes, most, slices``.

    ``sizes`` counts the terms of a document, ``most`` is the largest count of one term, ``slices`` has ``width`` rows of bits.
    Documents without terms are in no block. A task holds an open block per width.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = {}
        known: dict[bytes, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                counts = Counter(terms_of(text.as_py()))
                if not counts:
                    continue
                if len(known) > 500_000:
                    known.clear()
                hashes = np.fromiter((known[t] if t in known else known.setdefault(t, xxhash.xxh3_64_intdigest(t)) for t in counts), np.uint64, len(counts))
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                reached = np.searchsorted(LEVELS, tf, "right")
                width = width_of(int(reached.sum()))
                level = np.arange(int(reached.sum())) - np.repeat(np.cumsum(reached) - reached, reached)
                bits = places(np.repeat(hashes, reached), level, width).ravel()
                block = blocks.setdefault(width, Block(width))
                block.add(doc_id, int(tf.sum()), int(tf.max()), bits)
                if len(block.ids) == block.room:
                    yield pa.RecordBatch.from_pylist([blocks.pop(width).row()], _BLOCK)
        for block in blocks.values():
            yield pa.RecordBatch.from_pylist([block.row()], _BLOCK)

    return docs.select("doc_id", "text").mapInArrow(build, "width long, ids array<long>, sizes array<long>, most array<long>, slices binary")


@dataclass
class Queries:
    """Items of one block: numbers and ids, the distinct terms with weights, and per item its terms with their counts."""

    numbers: np.ndarray
    terms: dict[bytes, int]
    weights: np.ndarray
    rows: np.ndarray
    repeats: np.ndarray
    starts: np.ndarray
    documents: int
    length: int

    def damping(self, sizes: np.ndarray) -> np.ndarray:
        return 100 - 25 + (25 * sizes * self.documents) // self.length

    def sums(self, parts: np.ndarray) -> np.ndarray:
        """Per item the sum of its terms' weighted ``parts``, repeats included."""
        shaped = parts * self.weights.reshape(-1, *[1] * (parts.ndim - 1))
        return np.add.reduceat(shaped[self.rows] * self.repeats.reshape(-1, *[1] * (parts.ndim - 1)), self.starts, axis=0)


def part(tf: np.ndarray, damping: np.ndarray) -> np.ndarray:
    """Share of a term's weight that ``tf`` occurrences earn, in millionths; it never falls as ``tf`` grows."""
    return (1_000_000_000 * tf) // np.maximum(1, 1000 * tf + 12 * damping)


def bounds(queries: Queries, hashes: np.ndarray, width: int, sizes: np.ndarray, most: np.ndarray, slices: bytes) -> np.ndarray:
    """Per item and document of a block a number that its score does not exceed.

    The slices of a term's places, joined by "and", mark all documents that hold the term, and some that do not; those of a
    level all that hold it so often. A document marked up to one level has fewer occurrences than the next one asks for.
    """
    bits = np.frombuffer(slices, np.uint8).reshape(width, -1)
    level = np.zeros((len(hashes), len(sizes)), np.uint8)
    alive = np.arange(len(hashes))
    top = int(np.searchsorted(LEVELS, most.max(), "right"))
    held = None
    for step in range(top):
        marked = np.bitwise_and.reduce(bits[places(hashes[alive], step, width)], axis=1)
        held = marked if held is None else held & marked
        some = held.any(1)
        alive, held = alive[some], held[some]
        if not len(alive):
            break
        level[alive] += np.unpackbits(held, axis=1, count=len(sizes), bitorder="little")
    tops = np.minimum(np.r_[0, LEVELS[1:] - 1, np.iinfo(np.int64).max // 4_000_000_000][: len(LEVELS) + 1, None], most[None, :])
    table = part(tops, queries.damping(sizes)[None, :])
    columns = max(8, CELLS // len(queries.rows))
    return np.concatenate([queries.sums(np.take_along_axis(table[:, at : at + columns], level[:, at : at + columns].astype(np.int64), 0)) for at in range(0, len(sizes), columns)], 1)


def _block_bounds(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids, with the smallest number for a null one, and bounds of each block of the task."""
    queries = shared.value
    hashes = hash_terms(list(queries.terms))
    for batch in batches:
        for i in range(batch.num_rows):
            values = {name: batch[name][i].as_py() for name in _BLOCK.names}
            ids = np.array([NO_ID if x is None else x for x in values["ids"]], np.int64)
            yield ids, bounds(queries, hashes, values["width"], np.array(values["sizes"], np.int64), np.array(values["most"], np.int64), values["slices"])


#: Stands for a null id inside a task.
NO_ID = np.iinfo(np.int64).min


def _pairs(items: np.ndarray, ids: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"item": pa.array(items, pa.int32()), "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID), **{k: pa.array(v, pa.int64()) for k, v in more.items()}})


def best_bounds(index: DataFrame, shared: Broadcast, k: int) -> DataFrame:
    """``item, doc_id``: the ``FIRST`` best bounds of each item; a task passes on no more than that of its own."""
    keep = max(FIRST, k)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = len(shared.value.starts)
        best, ids = np.zeros((items, 0), np.int64), np.zeros((items, 0), np.int64)
        for own, found in _block_bounds(batches, shared):
            best, ids = np.concatenate([best, found], 1), np.concatenate([ids, np.broadcast_to(own, found.shape)], 1)
            if best.shape[1] > keep:
                order = np.argpartition(-best, keep - 1, axis=1)[:, :keep]
                best, ids = np.take_along_axis(best, order, 1), np.take_along_axis(ids, order, 1)
        item, place = np.nonzero(best > 0)
        yield _pairs(item, ids[item, place], bound=best[item, place])

    found = index.mapInArrow(find, "item int, doc_id long, bound long")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id"))).where(F.col("place") <= keep)
    return ranked.select("item", "doc_id").distinct()


def not_excluded(index: DataFrame, shared: Broadcast, least: np.ndarray) -> DataFrame:
    """``item, doc_id`` of every bound above 0 that is not below the item's ``least``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _block_bounds(batches, shared):
            item, place = np.nonzero(found >= np.maximum(1, least)[:, None])
            yield _pairs(item, ids[place])

    return index.mapInArrow(find, "item int, doc_id long").distinct()


def exact_scores(docs: DataFrame, pairs: DataFrame, shared: Broadcast) -> DataFrame:
    """``item, doc_id, score`` above 0 of the pairs' documents, counted over their whole texts.

    ``pairs`` is stored; its number of rows decides whether it goes to the documents or both are shuffled by id.
    """
    asked = pairs.groupBy("doc_id").agg(F.collect_list("item").alias("items")).withColumnRenamed("doc_id", "__id")
    if pairs.count() <= SENT:
        asked = F.broadcast(asked)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for doc_id, text, items in zip(batch["doc_id"].to_pylist(), batch["text"], batch["items"].to_pylist()):
                words = terms_of(text.as_py())
                counts = {queries.terms[t]: n for t, n in Counter(words).items() if t in queries.terms}
                parts = np.zeros(len(queries.terms), np.int64)
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                parts[np.fromiter(counts, np.int64, len(counts))] = part(tf, queries.damping(np.int64(len(words))))
                wanted = np.array(sorted(items))
                sums = queries.sums(parts)[wanted]
                found.append((wanted[sums > 0], np.full(int((sums > 0).sum()), NO_ID if doc_id is None else doc_id), sums[sums > 0]))
            if found:
                item, ids, sums = (np.concatenate(c) for c in zip(*found))
                yield _pairs(item, ids, score=sums)

    matched = docs.select("doc_id", "text").join(asked, F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", "text", "items")
    return matched.mapInArrow(score, "item int, doc_id long, score long")


def top_scores(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted = [Counter(terms_of(t.as_py())) for t in batch["text"]]
        yield pa.RecordBatch.from_pydict({"item_id": batch["item_id"], "terms": pa.array([list(c) for c in counted], pa.list_(pa.binary())), "counts": pa.array([list(c.values()) for c in counted], pa.list_(pa.int32()))})


def item_blocks(items: DataFrame) -> Iterator[list]:
    """Rows ``item_id, terms, counts`` of items with terms, in blocks of bounded items and terms, read one partition at a time."""
    rows = stored(items.mapInArrow(_item_terms, "item_id long, terms array<binary>, counts array<int>").where(F.size("terms") > 0), "search-items")
    block, many = [], 0
    for row in rows.toLocalIterator():
        if block and (len(block) == ITEMS or many + len(row["terms"]) > ITEM_TERMS):
            yield block
            block, many = [], 0
        block.append(row)
        many += len(row["terms"])
    if block:
        yield block


def document_frequencies(docs: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """Documents that hold each of ``terms``, which an item block bounds; a task passes on one count per term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                tally.update(shared.value.intersection(terms_of(text.as_py())))
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(tally), pa.binary()), "df": pa.array(list(tally.values()), pa.int64())})

    found = docs.select("text").mapInArrow(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in found.toLocalIterator()}


def search_block(docs: DataFrame, index: DataFrame, block: list, documents: int, length: int, k: int) -> DataFrame:
    """Stored ``item_id, rank, doc_id, score`` of one block of items."""
    spark = docs.sparkSession
    terms = {t: i for i, t in enumerate(sorted({bytes(t) for row in block for t in row["terms"]}))}
    df = document_frequencies(docs, set(terms))
    weights = np.array([math.floor(1000 * math.log((2.0 * documents + 2) / (2.0 * df.get(t, 0) + 1))) for t in terms], np.int64)
    sizes = [len(row["terms"]) for row in block]
    queries = Queries(
        np.arange(len(block)), terms, weights, np.array([terms[bytes(t)] for row in block for t in row["terms"]]), np.array([n for row in block for n in row["counts"]], np.int64),
        np.cumsum([0, *sizes[:-1]]), documents, length,
    )
    shared = spark.sparkContext.broadcast(queries)
    first = stored(best_bounds(index, shared, k), "search-first")
    known = top_scores(exact_scores(docs, first, shared), k).where(F.col("rank") == k).select("item", "score").collect()
    least = np.zeros(len(block), np.int64)
    for row in known:
        least[row["item"]] = row["score"]
    pairs = stored(not_excluded(index, shared, least), "search-pairs")
    best = top_scores(exact_scores(docs, pairs, shared), k)
    ids = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(block)], "item int, item_id long")
    return stored(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "search-best")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` documents of highest score above 0, equal scores by ascending id.

    Null, empty and termless texts count nowhere and are never found; items without terms find nothing. A repeated document
    row is ranked for each of its rows, rows of a null id behind equal scores; a repeated item is searched for each of its rows.
    Empty tables give no rows.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    asked = items.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text_column).cast("string").alias("text"))
    index = stored(build_index(texts), "search-index")
    totals = index.agg(F.sum(F.size("ids")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("length")).first()
    found = [search_block(texts, index, block, totals["n"], totals["length"], k) for block in (item_blocks(asked) if totals["n"] else ())]
    nothing = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found, nothing)
