"""Maximal periodic runs of words: tiles per period octave, boundary Z-functions, fragments stitched by document and period."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm.shared import stored

#: Shortest run, in words.
SHORTEST = 12
#: Words of a tile's core at least; the core of an octave has 4 times the octave's largest period at least.
TILE = 8192
#: Found fragments that are merged before more are looked for.
FLUSH = 100_000
FRAGMENT = np.dtype([("period", "<i4"), ("start", "<i8"), ("stop", "<i8")])


@dataclass(frozen=True)
class Octave:
    """Periods ``low`` to ``high - 1``; a run of them covers two neighbouring words of equal letters at ``step`` apart at least once."""

    low: int
    high: int

    @property
    def step(self) -> int:
        """Distance of boundaries: a run's matches (places equal to the one a period on) are no fewer than this."""
        return min(max(p, SHORTEST - p) for p in range(self.low, self.high))

    @property
    def reach(self) -> int:
        """Words a boundary sees to its left; it sees two more periods to its right."""
        return max(self.high, SHORTEST + 4)


def octaves(n: int) -> list[Octave]:
    """The octaves of all periods up to half of ``n`` words: 1 to 7, then 8 to 15, 16 to 31 and so on."""
    found, low, high = [], 1, 8
    while 2 * low <= n and n >= SHORTEST:
        found.append(Octave(low, high))
        low, high = high, 2 * high
    return found


def tiles(n: int, least: int = TILE) -> list[tuple[int, int, int, int, list[Octave]]]:
    """``core start, core stop, start, stop, octaves`` of overlapping tiles; octaves whose tiles are the same words share them.

    A boundary belongs to the tile whose core holds it. A tile reaches three quarters of its core further to either side, so
    that every boundary sees its whole window and the fragments of neighbouring tiles meet.
    """
    shapes: dict[int, list[Octave]] = {}
    for octave in octaves(n):
        shapes.setdefault(min(n, max(least, 4 * octave.high)), []).append(octave)
    margin = lambda core: max(3 * core // 4, 64)
    return [(at, min(n, at + core), max(0, at - margin(core)), min(n, at + core + margin(core)), group) for core, group in shapes.items() for at in range(0, n, core)]


def z_function(s: list[int]) -> list[int]:
    """For each place of ``s`` the length of the longest stretch from there that ``s`` starts with."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def candidates(words: np.ndarray, octave: Octave, at: np.ndarray) -> np.ndarray:
    """Boundaries of ``at`` where three words before or behind equal those a period of the octave on, which every run there has."""
    size = len(words)
    ends = np.full(size + 2 * octave.high + 8, -1, words.dtype)
    ends[4 : size + 4] = words
    alive = np.zeros(len(at), bool)
    for p0 in range(octave.low, octave.high, 64):
        periods = np.arange(p0, min(octave.high, p0 + 64))
        for b0 in range(0, len(at), 4096):
            b = at[b0 : b0 + 4096] + 4
            far = b[:, None] + periods
            ahead = ends[b][:, None] == ends[far]
            behind = ends[b - 1][:, None] == ends[far - 1]
            # Most pairs end here; the few others look at two words more.
            for equal, steps in ((ahead, (1, 2)), (behind, (-2, -3))):
                row, column = np.nonzero(equal)
                for j in steps:
                    keep = (ends[b[row] + j] == ends[far[row, column] + j]) & (ends[b[row] + j] >= 0)
                    row, column = row[keep], column[keep]
                alive[b0 + row] = True
    return at[alive]


def merged(found: np.ndarray) -> np.ndarray:
    """``found`` fragments with those of one period that overlap or touch made one; a fragment is its places equal to the one a period on."""
    if not len(found):
        return found
    found = found[np.lexsort((found["stop"], found["start"], found["period"]))]
    # A running maximum of stops inside a period: periods are lifted apart by more than any place.
    lift = found["period"].astype(np.int64) * (int(found["stop"].max()) + 2)
    most = np.maximum.accumulate(found["stop"] + lift)
    first = np.r_[True, found["start"][1:] + lift[1:] > most[:-1]]
    heads = np.flatnonzero(first)
    out = found[heads].copy()
    out["stop"] = most[np.r_[heads[1:], len(found)] - 1] - lift[heads]
    return out


def solve_tile(words: np.ndarray, start: int, core: tuple[int, int], group: list[Octave]) -> np.ndarray:
    """Fragments of a tile ``words`` that lies at ``start``: per boundary of its core, one Z-function to either side gives for every
    period of an octave how far equal words reach."""
    pieces: list[tuple[int, int, int]] = []
    found = np.zeros(0, FRAGMENT)
    for octave in group:
        step, reach = octave.step, octave.reach
        first = -(-core[0] // step) * step
        at = np.arange(first, core[1], step) - start
        at = at[at < len(words) - octave.low]
        for b in candidates(words, octave, at).tolist():
            right = words[b : b + reach + 2 * octave.high].tolist()
            ahead = z_function(right)
            left = words[max(0, b - reach) : b].tolist()[::-1]
            both = words[max(0, b - reach) : b + octave.high].tolist()[::-1]
            behind = z_function(left + [-1] + both)
            base = len(left) + 1 + len(both) - len(left)
            for p in range(octave.low, min(octave.high, len(right))):
                back = behind[base - p] if left else 0
                if back + ahead[p] >= max(p, SHORTEST - p):
                    pieces.append((p, start + b - back, start + b + ahead[p]))
            if len(pieces) > FLUSH:
                found, pieces = merged(np.concatenate([found, np.array(pieces, FRAGMENT)])), []
    return merged(np.concatenate([found, np.array(pieces, FRAGMENT)]))


def primitive(found: np.ndarray) -> np.ndarray:
    """Runs ``period, start, stop`` (all their words) of merged fragments in order of period and start, without those that a
    run of a divisor of their period contains: their smallest period is that divisor."""
    periods, firsts = np.unique(found["period"], return_index=True)
    ends = np.r_[firsts[1:], len(found)]
    kept: list[np.ndarray] = []
    roots = np.zeros(0, np.int64)
    for p, low, high in zip(periods.tolist(), firsts.tolist(), ends.tolist()):
        rows = found[low:high]
        fine = rows["stop"] - rows["start"] >= max(p, SHORTEST - p)
        for k in np.flatnonzero(p % roots == 0).tolist() if len(roots) else ():
            smaller, q = kept[k], int(roots[k])
            at = np.searchsorted(smaller["start"], rows["start"], "right") - 1
            fine &= (at < 0) | (smaller["stop"][at] + q < rows["stop"] + p)
        if fine.any():
            kept.append(rows[fine])
            roots = np.r_[roots, p]
    runs = np.concatenate([found[:0], *kept])
    runs["stop"] += runs["period"]
    return runs[np.lexsort((runs["period"], runs["start"]))]


def plant_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, with a periodic tail if the id's decimal crc32 says so."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i4").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")


_CUT = pa.schema([
    ("node", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("plain_sha256", pa.string()), ("fragments", pa.binary()), ("text", pa.binary()),
    ("core_start", pa.int64()), ("core_stop", pa.int64()), ("start", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("words", pa.binary()),
])
_CUT_DDL = "node binary, doc_id long, n long, plain_sha256 string, fragments binary, text binary, core_start long, core_stop long, start long, low int, high int, words binary"
#: Rows and bytes after which a task passes on what it has cut.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def document_tiles(docs: DataFrame, tile: int, tails: bool) -> DataFrame:
    """A row per document row and one per tile of a document longer than one tile (``words`` is null in the former).

    The tile of a document no longer than one is solved where it is cut; its fragments stand in ``fragments``. ``text`` has the
    words, compressed, of documents that may have a run.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        weight = 0
        for batch in batches:
            for node, doc_id, text in zip(batch["node"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"]):
                words = (text.as_py() or "").encode("utf-8").split()
                if tails:
                    words = plant_tail(words, doc_id)
                n = len(words)
                known: dict[bytes, int] = {}
                codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, n)
                joined = b" ".join(words)
                found = np.zeros(0, FRAGMENT)
                for core_start, core_stop, start, stop, group in tiles(n, tile):
                    if n <= tile:
                        found = solve_tile(codes, 0, (0, n), group)
                        continue
                    rows.append({"node": node, "core_start": core_start, "core_stop": core_stop, "start": start, "low": group[0].low, "high": group[-1].high, "words": packed(codes[start:stop])})
                    weight += len(rows[-1]["words"])
                    if weight > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _CUT)
                        rows, weight = [], 0
                text = zstandard.ZstdCompressor(level=1).compress(joined) if len(found) or n > tile else None
                rows.append({"node": node, "doc_id": doc_id, "n": n, "plain_sha256": hashlib.sha256(joined).hexdigest(), "fragments": found.tobytes() if len(found) else None, "text": text})
                weight += len(text or b"") + found.nbytes
                if weight > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, _CUT)
                    rows, weight = [], 0
        yield pa.RecordBatch.from_pylist(rows, _CUT)

    return docs.mapInArrow(cut, _CUT_DDL)


def _fragment_rows(nodes: list[bytes], found: list[np.ndarray]) -> pa.RecordBatch:
    all_ = np.concatenate([np.zeros(0, FRAGMENT), *found])
    owner = [node for node, rows in zip(nodes, found) for _ in range(len(rows))]
    return pa.RecordBatch.from_pydict({"node": pa.array(owner, pa.binary()), "period": pa.array(all_["period"].astype(np.int32)), "start": pa.array(all_["start"]), "stop": pa.array(all_["stop"])})


def _own_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _fragment_rows(batch["node"].to_pylist(), [np.frombuffer(b, FRAGMENT) for b in batch["fragments"].to_pylist()])


def _tile_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            group = [o for o in octaves(2 * row["high"]) if row["low"] <= o.low and o.high <= row["high"]]
            yield _fragment_rows([row["node"]], [solve_tile(unpacked(row["words"]), row["start"], (row["core_start"], row["core_stop"]), group)])


def stitched(fragments: DataFrame) -> DataFrame:
    """``node, period, start, stop`` with fragments of one document and period that overlap or touch made one.

    A document and period has one fragment per tile and stretch; the sort and the running maximum are Spark's windows.
    """
    order = Window.partitionBy("node", "period").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = fragments.withColumn("opens", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    numbered = opened.withColumn("piece", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("node", "period", "piece").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("piece")


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains behind its first period."""
    drops = np.zeros(len(words) + 1, np.int64)
    np.add.at(drops, runs["start"] + runs["period"], 1)
    np.add.at(drops, runs["stop"], -1)
    gone = np.cumsum(drops)[:-1] > 0
    return [w for w, x in zip(words, gone.tolist()) if not x]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("n_runs", "start", "length", "period", "exponent_milli")
    for batch in batches:
        for low in range(0, batch.num_rows, 200):
            part = batch.slice(low, 200)
            out: dict[str, list] = {name: [] for name in (*names, "runs_sha256", "collapsed_sha256")}
            for pieces, text, plain in zip(part["pieces"].to_pylist(), part["text"].to_pylist(), part["plain_sha256"].to_pylist()):
                found = np.array([(x["period"], x["start"], x["stop"]) for x in pieces or []], FRAGMENT)
                runs = primitive(found[np.lexsort((found["start"], found["period"]))])
                best = min(((int(s - e), int(s), int(p)) for p, s, e in runs.tolist()), default=None)
                out["n_runs"].append(len(runs))
                for name, value in zip(names[1:], (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4):
                    out[name].append(value)
                out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{e - s},{p}\n" for p, s, e in runs.tolist()).encode()).hexdigest())
                if len(runs):
                    words = zstandard.ZstdDecompressor().decompress(text).split()
                    plain = hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()
                out["collapsed_sha256"].append(plain)
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "n_words": part["n"], **{c: pa.array(out[c], pa.int64()) for c in names}, **{c: pa.array(out[c], pa.string()) for c in ("runs_sha256", "collapsed_sha256")}})


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tails: bool = False, tile: int = TILE) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_runs``, the longest run, and digests of all runs and of the collapsed text.

    A run is a stretch of words of smallest period q that no neighbouring word extends, at least 12 words and 2 q long. Null,
    empty and blank texts have no words and no run. A null id takes part, without a tail. Repeated rows get a row each. Every
    text is processed whole: a long one falls into overlapping tiles per octave, which are spread over all tasks; no row
    holds more than a document. ``tails`` plants the periodic tails that ``plant_tail`` defines.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = rows.withColumn("node", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))).cast("binary"))))
    cut = stored(document_tiles(rows.select("node", "doc_id", "text"), tile, tails), "runs-tiles")
    spread = cut.where("words IS NOT NULL").select("node", "core_start", "core_stop", "start", "low", "high", "words").repartition("node", "low", "start")
    cut = cut.where("words IS NULL")
    fragments = cut.where("fragments IS NOT NULL").select("node", "fragments").mapInArrow(_own_fragments, "node binary, period int, start long, stop long")
    fragments = fragments.unionByName(spread.mapInArrow(_tile_fragments, "node binary, period int, start long, stop long"))
    pieces = stitched(fragments).groupBy("node").agg(F.collect_list(F.struct("period", "start", "stop")).alias("pieces"))
    columns = ["doc_id", "n", "plain_sha256", "text"]
    periodic = cut.where("text IS NOT NULL").select("node", *columns).join(pieces, "node", "left").select(*columns, "pieces")
    nothing = F.lit(None).cast("array<struct<period: int, start: long, stop: long>>").alias("pieces")
    rest = cut.where("text IS NULL").select(*columns, nothing)
    schema = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return periodic.unionByName(rest).mapInArrow(_summaries, schema)
